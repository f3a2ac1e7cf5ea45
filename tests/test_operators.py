"""Hand values and edge cases of the core operators."""

import hashlib
import itertools
import json
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.operators import checks, graph, lexical, nested, trajectory, vectors
from loomwright.operators.components import connected_components
from loomwright.streaming import events


def test_pooled_l2_of_two_words(spark):
    df = spark.createDataFrame([("x", "a"), ("y", "b"), ("z", None)], "g string, text string")
    rows = lexical.pooled_l2(df, "g", 1).collect()
    assert [(r.left, r.right) for r in rows] == [("x", "y")]
    assert math.isclose(rows[0].l2, math.sqrt(2))
    assert lexical.pooled_l2(df, "g", 2).count() == 0


def test_self_bleu(spark):
    same = "one two three four five six"
    df = spark.createDataFrame(
        [("a", 1, same), ("a", 2, same), ("b", 3, same), ("c", 4, same), ("c", 5, "")], "g string, doc_id long, text string"
    )
    rows = {r.g: r.self_bleu for r in lexical.self_bleu(df, "g").collect()}
    assert math.isclose(rows["a"], 1.0) and rows["b"] is None and rows["c"] is None


def test_lexical_features_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "A b. A c!")], "id int, text string")
    rows = {r.id: r for r in lexical.lexical_features(df).collect()}
    assert rows[1].distinct_1 is None and rows[2].distinct_1 is None and rows[2].word_count == 0
    assert rows[3].word_count == 4 and rows[3].distinct_1 == 0.75 and rows[3].sentence_lengths == [2, 2]


def test_sample_floors(spark):
    df = spark.createDataFrame([("a", 1), ("b", 10), ("c", 60)], "g string, n int")
    rows = {(r.g, r.metric): (r.status, r.power) for r in lexical.sample_power(df, "n").collect()}
    assert rows["a", "D1"] == ("insufficient_samples", None)
    assert rows["b", "D4"] == ("ok", "low") and rows["c", "D2"] == ("ok", "ok")


def test_text_functions(spark):
    df = spark.createDataFrame(
        [("Straße", "a/../b", " An  Answer. "), (None, "a/b.md", None), ("", "/x", "")], "t string, p string, a string"
    )
    rows = df.select(
        T.fold(F.col("t")).alias("f"),
        T.safe_path(F.col("p")).alias("s"),
        T.alias(F.col("a")).alias("a"),
        T.fingerprint(F.col("t")).alias("h"),
        T.matches_any(F.col("p"), ["a/[ab].m?"]).alias("m"),
    ).collect()
    assert [(r.f, r.s, r.a, r.m) for r in rows] == [
        ("strasse", False, "an answer", False),
        (None, True, None, True),
        ("", False, "", False),
    ]
    assert rows[1].h is None


def test_clean_web_drops_what_is_no_prose(spark):
    prose = " ".join(["word"] * 45)
    page = f"Home | About | Help\n\n***\nCookie settings\n{prose}"
    df = spark.createDataFrame([(page,), ("thin page",), (None,)], "t string")
    assert [r.c for r in df.select(T.clean_web(F.col("t")).alias("c")).collect()] == [prose, None, None]


def test_dispersion_and_kernel(spark):
    df = spark.createDataFrame(
        [(1, "a", [1.0, 0.0]), (2, "a", [0.0, 2.0]), (3, "b", [1.0, 0.0]), (4, "b", None)], "id long, g string, v array<double>"
    )
    rows = {r.g: r.dispersion for r in vectors.dispersion(df, "g", "v").collect()}
    assert math.isclose(rows["a"], 1.0) and rows["b"] is None
    two = spark.createDataFrame(
        [(1, "a", [-1.0]), (2, "a", [1.0]), (3, "b", [-1.0]), (4, "b", [1.0]), (5, "c", [0.0])], "id long, g string, v array<double>"
    )
    got = {(r.left, r.right): r.mmd_squared for r in vectors.mmd_squared(two, "g", "v", 1.0, "id").collect()}
    assert math.isclose(got["a", "b"], math.exp(-2) - 1) and got["a", "c"] is None


def test_kernel_sums_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 3)
    rows = [(i, "ab"[i % 2], [float(i % 5), float(i % 3)]) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, g string, v array<double>")
    got = {(r.left, r.right): (r.pairs, r.total) for r in vectors.kernel_sums(df, "g", "v", 1.0, "id").collect()}
    want: dict = {}
    for i, s, x in rows:
        for j, t, y in rows:
            if (s < t) or (s == t and i < j):
                n, v = want.get((s, t), (0, 0.0))
                want[s, t] = (n + 1, v + math.exp(-sum((p - q) ** 2 for p, q in zip(x, y)) / 2))
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and math.isclose(got[k][1], want[k][1]) for k in want)


def test_nearest_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(0, [0.0]), (1, [1.0]), (20, [1.5]), (3, None)], "vec_id long, embedding array<double>")
    rows = sorted((r.key, r.place, r.neighbour) for r in vectors.query_distances(df, k=1).collect())
    assert rows == [(0, 0, 1), (20, 0, 1)]
    assert vectors.query_distances(df.where("false")).count() == 0


def test_median_distance_is_over_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 7)
    rows = [(i, [float(i % 9), float(i * i % 31), i / 7]) for i in range(60)] + [(60, [0.0, 0.0, 0.0]), (61, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    pairs = [math.dist(x, y) for (_, x), (_, y) in itertools.combinations(rows[:-1], 2) if x != y]
    assert math.isclose(vectors.pair_median(df, "id", "v").first().distance, statistics.median(pairs), rel_tol=1e-12)
    some = df.where("id in (0, 60, 5, 6)")
    pairs = [math.dist(x, y) for (_, x), (_, y) in itertools.combinations([rows[i] for i in (0, 60, 5, 6)], 2) if x != y]
    assert math.isclose(vectors.pair_median(some, "id", "v").first().distance, statistics.median(pairs), rel_tol=1e-12)
    assert vectors.pair_median(df.where("id in (0, 60)"), "id", "v").first().distance is None


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)]
    df = spark.createDataFrame(chain, "u long, v long").repartition(7)
    rows = {r.node: r.component for r in connected_components(df).collect()}
    assert all(rows[i] == 0 for i in range(201)) and rows[500] == rows[501] == 500
    assert connected_components(df.where("false")).count() == 0


def test_components_of_a_hub(spark):
    df = spark.createDataFrame([(0, i) for i in range(1, 3000)], "u long, v long").repartition(9)
    assert {r.component for r in connected_components(df).collect()} == {0}


def test_reachability_and_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "a"), ("c", "d")], "u string, v string")
    start = spark.createDataFrame([("a",)], "node string")
    assert {(r.node, r.depth) for r in graph.reachable(edges, start).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    assert {r.node for r in graph.cyclic_residue(edges).collect()} == {"a", "b", "c", "x"}
    assert graph.cyclic_residue(edges.where("u = 'c'")).count() == 0


def test_checks(spark):
    rows = [
        ("contains", "The Straße", ["STRASSE"], None, None, True, "ok"),
        ("excludes", None, ["x"], None, None, False, "unscored"),
        ("exact", "a", ["a"], None, None, True, "ok"),
        ("word_range", "a b c", [], 2, 3, True, "ok"),
        ("nonempty", "  ", [], None, None, False, "ok"),
        ("alias_answer", "Yes!", ["yes"], None, None, True, "ok"),
        ("sings", "a", [], None, None, None, "unknown_kind"),
    ]
    df = spark.createDataFrame([r[:5] for r in rows], "kind string, text string, wanted array<string>, low int, high int")
    got = {r.kind: (r.passed, r.status) for r in checks.evaluate(df).collect()}
    assert got == {r[0]: r[5:] for r in rows}


def test_roll_up_and_verdict(spark):
    df = spark.createDataFrame(
        [("a", "Q1", "ok", True, 2.0, True), ("a", "Q1", "ok", False, 1.0, False), ("b", "Q1", "pending", None, 1.0, True)],
        "id string, metric string, status string, passed boolean, weight double, required boolean",
    )
    got = {r.id: (r.value, r.status) for r in checks.roll_up(df, ["id"]).collect()}
    assert math.isclose(got["a"][0], 2 / 3) and got["a"][1] == "ok" and got["b"] == (None, "pending")
    assert {r.id: r.verdict for r in checks.required_verdict(df, ["id"]).collect()} == {"a": 1, "b": None}


def test_judge_scores_take_the_last_value(spark):
    df = spark.createDataFrame(
        [("r", ("ok", "j", [("Q1", 2), ("q1 ", 9), ("Q4", 1)])), ("s", ("failed", "j", [("Q1", 1)]))],
        "review_id string, record struct<status:string,judge:string,assessments:array<struct<metric:string,value:int>>>",
    )
    rows = checks.judge_scores(df, {"Q1": 3.0}, ["Q4"]).collect()
    assert [(r.review_id, r.score, r.criteria) for r in rows] == [("r", (5 * 3 + 4) / 4, 2)]


def test_staccato(spark):
    df = spark.createDataFrame([(4.0,), (11.5,), (19.0,)], "i double")
    assert [r.f for r in df.select(checks.staccato_factor(F.col("i")).alias("f")).collect()] == [1.0, pytest.approx(0.8), 0.6]


def test_audit_pairs_classes_once(spark):
    base = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame(
        [(1, base), (2, base), (3, base + " end"), (4, "too short"), (5, None)], "id long, text string"
    )
    rows = checks.overlap_audit(df, "id").collect()
    assert [(r.left, r.right) for r in rows] == [(1, 3)]


def test_every_copy_is_a_member_of_its_class(spark):
    base = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame(
        [(1, base), (2, base), (3, base + " end"), (4, "too short"), (5, None), (6, base.upper().replace(" ", ", ")), (6, base)],
        "id long, text string",
    )
    members = [tuple(r) for r in checks.overlap_members(df, "id").orderBy("key").collect()]
    assert members == [(1, 1), (2, 1), (3, 3), (6, 1)]
    known = {c for _, c in members}
    assert all({r.left, r.right} <= known for r in checks.overlap_audit(df, "id").collect())


def audited(rows, threshold=0.85, sketch=12):
    """The pairs of classes by comparing all of them: ``(left, right, jaccard)``."""
    classes = {}
    for key, text in rows:
        words = text.split()
        runs = {" ".join(words[i : i + 5]) for i in range(len(words) - 4)}
        if runs:
            s = tuple(sorted(hashlib.sha256(r.encode()).hexdigest()[:16] for r in runs))
            classes[s] = min(key, classes.get(s, key))
    told = [(key, set(s), set(s[:sketch])) for s, key in classes.items()]
    both = [(a, b) for a in told for b in told if a[0] < b[0]]
    named = {(a[0], b[0]) for a, b in both if a[2] & b[2]}
    near = [(a[0], b[0], len(a[1] & b[1]) / len(a[1] | b[1])) for a, b in both if (a[0], b[0]) in named]
    return sorted((x, y, round(j, 9)) for x, y, j in near if j >= threshold)


def edited_texts(seed, count):
    """Texts of 1 to 300 words and edited copies of them, near the threshold on either side; some ids come twice."""
    draw, rows = random.Random(seed), []
    for _ in range(count):
        words = [f"w{draw.randrange(4000)}" for _ in range(draw.choice([1, 5, 6, 12, 30, 49, 50, 51, 120, 300]))]
        for _ in range(draw.randrange(1, 4)):
            other = list(words)
            for _ in range(draw.randrange(1 + max(1, len(words) // 40))):
                other[draw.randrange(len(other))] = f"new{draw.randrange(9)}"
            if draw.random() < 0.7:  # at the ends an edit costs one shingle
                other = words[draw.randrange(1 + len(words) // 12) :] + [f"end{draw.randrange(9)}"] * draw.randrange(3)
            rows.append((len(rows) if draw.random() < 0.9 else draw.randrange(len(rows) + 1), " ".join(other)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_equals_comparing_all(spark, seed):
    rows = edited_texts(seed, 150)
    got = checks.overlap_audit(spark.createDataFrame(rows, "id long, text string").repartition(3), "id").collect()
    want = audited(rows)
    assert sorted((r.left, r.right, round(r.jaccard, 9)) for r in got) == want and len(want) > 50
    texts = [(f"k{key}", text) for key, text in rows]
    got = checks.overlap_audit(spark.createDataFrame(texts, "id string, text string"), "id").collect()
    assert sorted((r.left, r.right, round(r.jaccard, 9)) for r in got) == audited(texts)
    assert checks.overlap_audit(spark.createDataFrame(rows, "id long, text string").where("false"), "id").count() == 0


def test_audit_of_a_stock_phrase_moves_no_pairs(spark):
    phrase = min((f"all of them say {i}" for i in range(4000)), key=lambda p: hashlib.sha256(p.encode()).hexdigest())
    rows = [(i, phrase + " " + " ".join(f"x{i}y{j}" for j in range(40))) for i in range(600)]
    rows += [(1000 + i, rows[i][1] + " more") for i in range(5)]
    df, context = spark.createDataFrame(rows, "id long, text string"), spark.sparkContext._jsc.sc()

    def moved():
        context.listenerBus().waitUntilEmpty()
        return context.statusStore().executorList(False).apply(0).totalShuffleWrite()

    before, limit = moved(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = checks.overlap_audit(df, "id").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert sorted((r.left, r.right, round(r.jaccard, 9)) for r in got) == audited(rows)
    # 605 texts hold 24,000 shingles; 183,000 pairs share the phrase
    assert len(got) == 5 and moved() - before < 4_000_000


def message(role, content=None, calls=None, answers=None):
    made = [(i, "function", (n, a)) for i, n, a in calls] if calls else None
    return (role, content, answers, made)


PROBE = (
    "schema_version int, id string, split string, review_status string, provenance struct<author_id:string,work_id:string,"
    "source:string,license:string>, initial_files map<string,string>, expected_files map<string,string>, tools array<string>, "
    "messages array<struct<role:string,content:string,tool_call_id:string,tool_calls:array<struct<id:string,type:string,"
    "function:struct<name:string,arguments:string>>>>>, extra string"
)
GOOD = [
    message("user", "q"),
    message("assistant", None, [("c1", "read", "{}")]),
    message("tool", "r", answers="c1"),
    message("assistant", "done"),
]


def probe(id, messages, **over):
    row = {
        "schema_version": 1, "id": id, "split": "train", "review_status": "accepted",
        "provenance": ("a", "w", "s", "l"), "initial_files": {}, "expected_files": {"kb/a.md": "x"},
        "tools": [json.dumps({"type": "function", "function": {"name": "read", "parameters": {}}})], "messages": messages, "extra": None,
    }
    return tuple((row | over).values())


def test_each_rule_fires_on_its_own_row(spark):
    rows = [
        probe("good", GOOD),
        probe("version", GOOD, schema_version=2),
        probe("split", GOOD, split=None),
        probe("path", GOOD, expected_files={"../x": "y"}),
        probe("none", None),
        probe("open", GOOD[:2] + [message("user", "again"), message("assistant", "x")]),
        probe("orphan", [GOOD[0], message("tool", "r", answers="zz"), GOOD[3]]),
        probe("twice", GOOD[:3] + [message("assistant", None, [("c1", "read", "{}")]), message("tool", "r", answers="c1"), GOOD[3]]),
        probe("end", GOOD[:3]),
        probe("", GOOD),
        probe("double", GOOD), probe("double", GOOD[:1] + [message("assistant", "x")]), probe("again", GOOD), probe("again", GOOD),
        probe("kind", GOOD, tools=[json.dumps({"type": "tool", "function": {"name": "read", "parameters": {}}})]),
        probe("names", GOOD, tools=[json.dumps({"type": "function", "function": {"name": "read", "parameters": {}}})] * 2),
        probe("shape", GOOD, tools=[json.dumps({"type": "function", "function": {"name": "read"}})]),
        probe("other", [GOOD[0], message("assistant", None, [("c1", "write", "{}")]), *GOOD[2:]]),
        probe("unnamed", [GOOD[0], message("assistant", None, [("c1", None, "{}")]), *GOOD[2:]]),
        probe("text", [GOOD[0], message("assistant", None, [("c1", "read", '"{}"')]), *GOOD[2:]]),
        probe("typed", [GOOD[0], ("assistant", None, None, [("c1", None, ("read", "{}"))]), *GOOD[2:]]),
    ]
    df = spark.createDataFrame(rows, PROBE)
    got: dict = {}
    for r in trajectory.violations(df).collect():
        got.setdefault(r.id, set()).add(r.rule)
    assert got == {
        "version": {"schema_version"},
        "split": {"split"},
        "path": {"unsafe_path"},
        "none": {"messages_required"},
        "open": {"missing_tool_response"},
        "orphan": {"unmatched_tool_response"},
        "twice": {"bad_call_id"},
        "end": {"final_answer"},
        "": {"id"}, "double": {"duplicate_id"}, "kind": {"tool_type"}, "names": {"tool_name"}, "shape": {"tool_parameters"},
        "other": {"unavailable_tool"}, "unnamed": {"call_name"}, "text": {"arguments_object"}, "typed": {"call_type"},
    }
    assert trajectory.violations(df.where("false")).count() == 0


def test_call_results_and_admission(spark):
    rows = [
        probe("a", [GOOD[0], message("assistant", None, [("c", "read", "{}"), ("d", "write", "{}")]), GOOD[2], message("tool", "r", answers="c")]),
        probe("b", [GOOD[0], message("assistant", None, [(None, "read", "{}")]), message("user", "x"), message("assistant", None, [("e", "read", '"{}"')])]),
    ]
    df = spark.createDataFrame(rows, PROBE)
    got = sorted((r.id, r.call_id, r.status) for r in trajectory.call_results(df).collect())
    assert got == [("a", "c", "paired"), ("a", "c1", "orphan"), ("a", "d", "not_executed"), ("b", "", "missing"), ("b", "e", "not_executed")]
    codes = sorted((r.id, r.pos, r.place, r.code) for r in trajectory.admission(df).select("id", "pos", "place", F.coalesce("code", F.lit("")).alias("code")).collect())
    assert codes == [("a", 1, 0, ""), ("a", 1, 1, "tool_unavailable"), ("b", 1, 0, "missing_id"), ("b", 3, 0, "arguments_not_object")]
    states = sorted(r.state for r in trajectory.call_arguments(df).collect())
    assert states == ["encoded_twice", "object", "object", "object"]


def test_each_admission_rule_fires(spark):
    tools = [json.dumps({"type": "function", "function": {"name": n, "parameters": {}}}) for n in ("read", "ask_author")]
    cases = {
        "": ("1", "read", '{"path": "a/b.md"}'), "missing_id": (" ", "read", "{}"), "invalid_function_name": ("1", " ", "{}"),
        "invalid_arguments_json": ("1", "read", "{"), "arguments_not_object": ("1", "read", "[]"),
        "arguments_not_utf8_strings": ("1", "read", '{"n": 1}'), "unsafe_path": ("1", "read", '{"path": "../x"}'),
        "tool_unavailable": ("1", "write", "{}"), "envelope_size_limit": ("1", "read", json.dumps({"x": "y" * 66_000})),
        "call_envelope_limit": ("1", "read", json.dumps({"x": "y" * 140_000})),
    }
    rows = [probe(code or "ok", [GOOD[0], message("assistant", None, [call])], tools=tools) for code, call in cases.items()]
    rows += [
        probe("invalid_envelope", [("assistant", None, None, [("1", "tool", ("read", "{}"))])], tools=tools),
        probe("invalid_function_envelope", [("assistant", None, None, [("1", "function", None)])], tools=tools),
        probe("free", [message("assistant", None, [("1", "ask_author", '{"n": [1]}')])], tools=tools),
        probe("mixed", [message("assistant", None, [("1", "read", "{}"), ("2", "ask_author", "{}")])], tools=tools),
        probe("twice", [message("assistant", None, [("1", "read", "{}"), ("1", "read", "{}")])], tools=tools),
    ]
    got: dict = {}
    for r in trajectory.admission(spark.createDataFrame(rows, PROBE)).orderBy("id", "pos", "place").collect():
        got.setdefault(r.id, []).append(r.code)
        assert r.reason == trajectory.REJECTIONS.get(r.code)
    alone = {code: [code] for code in [*cases, "invalid_envelope", "invalid_function_envelope"] if code}
    assert got == alone | {"ok": [None], "free": [None], "mixed": ["mixed_control_file_batch"] * 2, "twice": [None, "duplicate_id"]}
    told = spark.createDataFrame([("Tool call needs an id",), ("tool call needs an id",), (None,)], "m string")
    assert [r[0] for r in told.select(trajectory.rejection_code(F.col("m"))).collect()] == ["missing_id", None, None]


def test_file_checks(spark):
    wiki = {"kb/index.md": "See [[a]] and [[b|that]].", "kb/a.md": "[[index]]", "kb/b.md": "[[a#part]]"}
    rows = [
        ("protected", "x", None, None, {"x": "1"}, {"x": "1"}, None, True), ("protected", "x", [], None, {"x": "1"}, {}, None, False),
        ("protected", "x", ["keep"], None, {"x": "a keep b"}, {"x": "keep"}, None, True), ("protected", "x", ["keep"], None, {}, {"x": "keep"}, None, False),
        ("allowed_changes", None, ["kb/*", "a?.md"], None, {"kb/x": "1"}, {"kb/x": "2", "ab.md": ""}, None, True),
        ("allowed_changes", None, ["kb/*"], None, {"kbx": "1"}, {}, None, False), ("allowed_changes", None, None, None, None, None, None, True),
        ("kb_word_budget", None, None, 3, None, {"kb/a": "one two", "kb/b": "three", "c": "four five"}, None, True),
        ("kb_word_budget", None, None, 2, None, {"kb/a": "one two", "kb/b": "three"}, None, False),
        ("wiki_links", None, None, None, None, wiki, None, True), ("wiki_links", "kb/a.md", None, None, None, wiki, None, True),
        ("wiki_links", None, None, None, None, wiki | {"kb/c.md": "alone"}, None, False), ("wiki_links", None, None, None, None, wiki | {"kb/a.md": "[[gone]]"}, None, False),
        ("wiki_links", None, None, None, None, {"kb/index.md": ""}, None, False), ("wiki_links", None, None, None, None, None, None, False),
        ("evidence_exposed", None, ["Lamp"], None, None, None, ["no", "a LAMP"], True), ("evidence_exposed", None, ["Lamp"], None, None, None, None, False),
        ("other", None, None, None, None, None, None, None),
    ]
    schema = "kind string, path string, wanted array<string>, high int, before map<string,string>, after map<string,string>, seen array<string>, want boolean"
    got = checks.evaluate_files(spark.createDataFrame(rows, schema)).collect()
    assert [(r.kind, r.passed) for r in got] == [(r[0], r[7]) for r in rows]


def test_first_difference(spark):
    rows = [
        ("same", '{"a": [1, 2]}', '{"a":[1,2]}'), ("value", '{"b": 1, "a": {"x": "1", "c": 2}}', '{"b": 2, "a": {"x": "1", "c": 3}}'),
        ("place", json.dumps({"a": list(range(12))}), json.dumps({"a": [0, 1, 9, *range(3, 10), 99, 11]})),
        ("shape", '{"a": []}', '{"a": {}}'), ("gone", '{"a": 1, "b": 2}', '{"b": 2}'), ("null", None, None),
    ]
    got = {r.k: r.path for r in nested.first_difference(spark.createDataFrame(rows, "k string, l string, r string"), "k", "l", "r").collect()}
    assert got == {"same": None, "value": "a.c", "place": "a[2]", "shape": "a", "gone": "a", "null": None}


def test_fences_and_authors(spark):
    df = spark.createDataFrame([("a ```` b `", "One by two by Three"), ("none", "Bye"), (None, None)], "t string, b string")
    got = [tuple(r) for r in df.select(T.fence(F.col("t")), T.author_of(F.col("b"))).collect()]
    assert got == [("`````", "Three"), ("```", None), ("```", None)]


def test_openings(spark):
    long = "The keeper put the lantern down and waited for the ferry that never came. " * 8
    rows = [("THE LAMP\n\nProduced by Some One\n\nChapter 1\n\nshort\n\n" + long + "\n \n" + long + "\n\n" + long,), ("TITLE",), (None,), (long * 5,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(T.opening(F.col("t"))).collect()]
    assert got[:3] == [long.strip() + "\n\n" + long.strip(), None, None] and 2100 < len(got[3]) <= 2200 and (long * 5).startswith(got[3])


def test_changed_paths_tell_missing_from_empty(spark):
    df = spark.createDataFrame([probe("a", GOOD, initial_files={"x": "", "y": "1"}, expected_files={"y": "2", "z": ""})], PROBE)
    got = {(r.path, r.change) for r in trajectory.changed_paths(df, "initial_files", "expected_files").collect()}
    assert got == {("x", "removed"), ("y", "changed"), ("z", "added")}


def test_nested_checks_in_every_shape(spark):
    def check(i=None, **more):
        return {"kind": "k", "inner": {"id": "no", "kind": "no"}} | ({"id": i} if i else {}) | more

    body = {
        "cases": [
            {"checks": [check("a"), None, check(), {"id": 5, "kind": "x"}]},
            {"checks": json.dumps([None, check("s")]), "followups": [None, {"checks": check("lone")}, {"checks": None}]},
            {"checks": {"b": {"metric": 1}, "a": {"metric": 2}}, "followups": 3},
            None,
            {"checks": "no json", "followups": [{"checks": {"k": None, "a": {"x": 1}}}]},
        ]
    }
    rows = [("r", json.dumps(body)), ("r", json.dumps(body)), ("broken", json.dumps(body)[:-9]), ("nan", "NaN"), ("n", None), ("e", "")]
    nodes = nested.shred(spark.createDataFrame(rows, "spec_id string, body string"), F.col("spec_id"), F.col("body"), ["checks"], ["id", "kind"])
    got = sorted((r.parent_path, r.child_pos, r.child_id) for r in nested.check_table(nodes).collect())
    assert got == [
        ("cases[0]", 0, "a"),
        ("cases[0]", 2, ""),
        ("cases[0]", 3, "5"),
        ("cases[1]", 1, "s"),
        ("cases[1].followups[1]", 0, "lone"),
        ("cases[2]", 0, "a"),
        ("cases[2]", 1, "b"),
        ("cases[4].followups[0]", 0, "a"),
    ]


def test_tools_and_calls_of_records(spark):
    tools = ['{"name": "bare"}', None, '{"function": {"name": "in"}, "name": "out"}', "null", "{broken", '{"function": {}}']
    df = spark.createDataFrame([probe("a:b", GOOD, tools=tools), probe("a:b", GOOD, tools=tools), probe("c", None, tools=None)], PROBE)
    got = sorted((r.record_id, r.child_pos, r.child_id) for r in nested.tool_table(df, "id", "tools").collect())
    assert got == [("a:b", 0, "bare"), ("a:b", 2, "in"), ("a:b", 5, "")]
    assert [tuple(r) for r in nested.call_table(df, "id", "messages").collect()] == [("a:b", "messages[1]", "tool_call", 0, "c1")]


def test_path_conflicts(spark):
    df = spark.createDataFrame([("t", "a"), ("t", "a/b"), ("t", "ab/c"), ("u", "a/b")], "tree string, path string")
    assert [tuple(r) for r in graph.path_conflicts(df, "tree", "path").collect()] == [("t", "a", "a/b")]


def test_fold_ignores_stale_rows():
    state = events.fold_events([(2, "click", 1.0), (1, "view", None)], events._START)
    assert state == (2, 1.0, 1.0, "engaged", 2)
    assert events.fold_events([(2, "purchase", 5.0)], state) == state


def test_fold_stream_equals_batch(spark, tmp_path):
    rows = [(i, i % 3, ["view", "click", "purchase", "error"][i % 4], float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double")
    df = df.withColumn("ts", F.timestamp_seconds(F.col("event_id") * 60))
    path = str(tmp_path / "events.parquet")
    df.repartition(3).write.parquet(path)
    got = sorted(map(tuple, events.both(spark, path, events.folded_stream, "update", ["user_id"]).collect()))
    assert got == sorted(map(tuple, events.folded_batch(df).collect()))
