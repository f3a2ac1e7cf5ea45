"""Closed records, graphs, effects, alignment, advantages, profiles."""

import math

import pytest
from pyspark.sql import functions as F

from loomwright.operators import contracts as C


def test_closed_records(spark):
    rows = [("ok", '{"a": 1, "b": "x"}'), ("miss", '{"b": "x"}'), ("type", '{"a": "1", "b": null}'), ("more", '{"a": 1, "b": "x", "c": 2}'),
            ("twice", '{"a": 1, "a": 2}'), ("bad", "{"), ("list", "[]"), ("null", None)]
    df = spark.createDataFrame(rows, "id string, raw string")
    got = sorted((r.key, r.error, r.field) for r in C.strict_fields(df, "id", "raw", {"a": "BIGINT"}, {"b": "STRING"}).collect())
    assert got == [
        ("bad", "not_object", ""), ("list", "not_object", ""), ("miss", "missing", "a"), ("more", "unknown", "c"),
        ("twice", "not_object", ""), ("type", "type", "a"), ("type", "type", "b"),
    ]


def test_each_graph_rule(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    edges = spark.createDataFrame([("a", "b", 1), ("a", "c", 1), ("b", "zz", None), ("yy", "a", 0)], "u string, v string, precedence int")
    got = sorted((r.rule, r.id) for r in C.graph_violations(nodes, edges, "start").collect())
    assert got == [("dead_end", "c"), ("no_entry", "start"), ("tie", "a"), ("unknown_source", "yy"), ("unknown_target", "zz")]


def test_effects_need_what_they_expect(spark):
    df = spark.createDataFrame(
        [(1, {"x": "1"}, [("x", "1", "2"), ("y", None, "3"), ("x", "2", None)]), (2, {"x": "1"}, [("x", "other", "2")]), (3, {}, [])],
        "id int, files map<string,string>, e array<struct<path:string,before:string,after:string>>",
    )
    got = {r.id: r.m for r in df.select("id", C.apply_effects(F.col("files"), F.col("e")).alias("m")).collect()}
    assert got == {1: {"y": "3"}, 2: None, 3: {}}


def test_drift_under_a_mask(spark):
    df = spark.createDataFrame(
        [([1.0, 2.0, 3.0], [1.5, 9.0, 2.0], [True, False, True]), ([1.0], [1.0, 2.0], [True]), ([1.0], [2.0], [False])],
        "a array<double>, b array<double>, m array<boolean>",
    )
    got = [r.d for r in df.select(C.masked_drift(F.col("a"), F.col("b"), F.col("m")).alias("d")).collect()]
    assert tuple(got[0]) == (2, 0.75, 1.0) and got[1:] == [None, None]


def test_turns_repeat_what_came_before(spark):
    df = spark.createDataFrame(
        [("a", 1, [1, 2], [3]), ("a", 2, [1, 2, 3, 4], [5, 6]), ("b", 1, [1], [2]), ("b", 2, [1, 9, 3], [4])],
        "id string, n int, input_ids array<bigint>, generated_ids array<bigint>",
    )
    got = sorted(tuple(r) for r in C.turn_layout(df, "id", "n").collect())
    assert got == [("a", 1, 2, 2, 3, False), ("a", 2, 1, 4, 6, False), ("b", 1, 1, 1, 2, False), ("b", 2, 1, 3, 4, True)]


def test_advantages_of_equal_rewards_are_zero(spark):
    big = 3_000_000_019
    df = spark.createDataFrame([("t", 1, big), ("t", 2, big), ("t", 3, big), ("r", 1, 0), ("r", 2, 10), ("one", 1, 5)], "g string, m int, r bigint")
    got = {(r.group, r.member): r.advantage for r in C.exact_advantages(df, "g", "m", "r").collect()}
    assert got["t", 1] == got["t", 3] == got["one", 1] == 0.0
    assert got["r", 1] == -1.0 and got["r", 2] == 1.0


def test_score_lines_prefer_the_section(spark):
    df = spark.createDataFrame(
        [("Depth: 3\n[Scores]\nDepth: 4\nVoice : 2.5\nnote\nDepth: 5\n---\nVoice: 1",), ("Depth: 3\nVoice: -1",), ("nothing",), (None,)], "t string"
    )
    got = [r.m for r in df.select(C.score_lines(F.col("t")).alias("m")).collect()]
    assert got[:3] == [{"Depth": 5.0, "Voice": 2.5}, {"Depth": 3.0, "Voice": -1.0}, {}] and not got[3]


def test_profile_states(spark):
    own = spark.createDataFrame([("a", i, f"one two three {i}") for i in range(9)] + [("b", 20, "alone")], "g string, doc_id long, text string")
    other = spark.createDataFrame([("a", "one two three")], "g string, text string")
    got = {(r.g, r.metric): (r.value, r.status, r.power) for r in C.prose_profile(own, other, "g").collect()}
    assert got["b", "D4"] == (None, "insufficient_samples", None) and got["a", "D3"] == (None, "not_implemented", None)
    assert got["a", "D4"][1:] == ("ok", "low") and 0 < got["a", "D4"][0] < 1
    assert math.isclose(got["a", "D1"][0], math.sqrt(3 * (1 / 4 - 1 / 3) ** 2 + 9 * (1 / 36) ** 2))


def test_results_fold_into_their_call(spark):
    m = "struct<role:string,content:string>"
    df = spark.createDataFrame([("a", [("user", "q"), ("assistant", None), ("tool", "1"), ("tool", None), ("assistant", "done")])] * 2, f"id string, messages array<{m}>")
    got = sorted((r.segment, r.content or "", list(r.results)) for r in C.rendered_messages(df).collect())
    assert got == [(1, "q", []), (2, "", ["1", ""]), (3, "done", [])]


@pytest.mark.parametrize(("files", "want"), [({"kb/a": "one two", "x": "three"}, 2), ({}, 0)])
def test_kb_words(spark, files, want):
    df = spark.createDataFrame([(files,)], "f map<string,string>")
    assert df.select(C.kb_words(F.col("f"))).first()[0] == want
