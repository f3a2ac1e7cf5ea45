"""Splits that keep groups together, and window packing."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.llm import packing, splits

RECORDS = "record_id string, split string, label string, keys array<string>"


def test_keys_are_compared_cleaned(spark):
    df = spark.createDataFrame([(" A__b - c ",), ("N/A",), ("Unknown ",), ("",), (None,), ("x",)], "k string")
    assert [r.k for r in df.select(splits.clean_key(F.col("k")).alias("k")).collect()] == ["a-b-c", None, None, None, None, "x"]


def union_find(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for _, _, _, keys in rows:
        for k in keys:
            a, b = find(keys[0]), find(k)
            parent[max(a, b)] = min(a, b)
    return {r[0]: find(r[3][0]) if r[3] else None for r in rows}


def made(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        keys = [f"k{rng.randrange(300)}" for _ in range(rng.choice([0, 1, 1, 2]))] + (["hot"] if rng.random() < 0.3 else [])
        rows.append((f"r{i}", rng.choice(["train", "train", "test", None]), f"l{i % 5}", sorted(set(keys))))
    return rows


def test_parted_records_equal_union_find(spark):
    rows = made(1)
    got = {tuple(r) for r in splits.parted_records(spark.createDataFrame(rows, RECORDS).repartition(5)).collect()}
    root = union_find(rows)
    found: dict = {}
    for r in rows:
        if root[r[0]] and r[1]:
            found.setdefault(root[r[0]], set()).add(r[1])
    assert got == {(r[0], root[r[0]]) for r in rows if root[r[0]] and len(found.get(root[r[0]], ())) > 1}
    assert splits.parted_records(spark.createDataFrame([], RECORDS)).count() == 0


def test_no_component_is_parted_and_proportions_hold(spark):
    rows = [(f"r{i}", None, f"l{i % 4}", [f"k{i // 3}"]) for i in range(3000)] + [("alone", "train", "l0", [])]
    got = splits.assign_splits(spark.createDataFrame(rows, RECORDS)).collect()
    assert len(got) == len(rows) and len({r.record_id for r in got}) == len(rows)
    by_group: dict = {}
    for r in got:
        by_group.setdefault(r.group_key, set()).add(r.split)
    assert all(len(v) == 1 for k, v in by_group.items() if k is not None)
    share = {s: sum(r.split == s for r in got) / len(got) for s in ("train", "validation", "test")}
    assert abs(share["train"] - 0.8) < 0.01 and abs(share["test"] - 0.1) < 0.01


def test_a_giant_component_goes_where_there_is_room(spark):
    rows = [(f"h{i}", None, "l", ["hot"]) for i in range(400)] + [(f"r{i}", None, "l", [f"k{i}"]) for i in range(800)]
    got = splits.assign_splits(spark.createDataFrame(rows, RECORDS), {"a": 0.5, "b": 0.5}).collect()
    share = {s: sum(r.split == s for r in got) for s in "ab"}
    assert len({r.split for r in got if r.group_key == "hot"}) == 1 and abs(share["a"] - share["b"]) <= 6
    assert splits.assign_splits(spark.createDataFrame([], RECORDS)).count() == 0


def test_labels_are_balanced_one_by_one(spark):
    rows = [(f"r{i}", None, f"l{i % 20}", [f"k{i // 2}"]) for i in range(4000)]
    df = spark.createDataFrame([*rows, rows[0], ("null", None, None, None)], RECORDS).distinct()
    got = {r.record_id: r.split for r in splits.assign_splits(df).collect()}
    for label in range(20):
        mine = [got[r[0]] for r in rows if r[2] == f"l{label}"]
        assert abs(mine.count("train") / len(mine) - 0.8) <= 0.03
    fault = splits.split_faults(df).first()
    assert tuple(fault) == (4001, 0, 0.0)


def test_faults_of_a_placement_are_told(spark):
    sizes = spark.createDataFrame([(1, 30), (2, 150), (3, 10)], "doc_id long, tokens int")
    caps = spark.createDataFrame([(1, 100), (2, None)], "pack_id int, capacity_tokens int")
    good = [(1, "a", 0, 1, 0, 0, 30), (1, "b", 0, 2, 0, 0, 100), (1, "a", 1, 2, 1, 100, 50), (1, "a", 2, 3, 0, 0, 10)]
    bad = [(1, "a", 0, 1, 0, 0, 15), (1, "b", 0, 1, 1, 15, 15), (1, "c", 0, 2, 0, 0, 150)]
    schema = "pack_id int, window_id string, place int, doc_id long, piece int, first_token int, tokens int"
    got = [tuple(packing.placement_faults(spark.createDataFrame(x, schema), sizes, caps).first()) for x in (good, bad)]
    assert got == [(1, 3, 0, 0), (1, 2, 2, 1)]  # document 1 is divided, 3 missing


def test_annealing_keeps_the_best():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 9, (60, 3)).astype(float)
    target = np.array([0.8, 0.2])[:, None] * sizes.sum(axis=0)[None, :]
    start = np.zeros(60, dtype=int)
    found, cost = splits.anneal(sizes, start, target, 3, 4000)
    have = np.array([sizes[found == s].sum(axis=0) for s in range(2)])
    gap = have - target
    assert np.isclose(cost, ((gap.sum(1) ** 2 + (gap**2).sum(1)) / target.sum(1)).sum()) and cost < 1


def test_placement_is_whole(spark):
    rng = random.Random(2)
    sizes = {i: rng.choice([1, 5, 90, 100, 101, 250, rng.randrange(1, 400)]) for i in range(700)}
    df = spark.createDataFrame(list(sizes.items()), "doc_id long, tokens int").repartition(6)
    rows = packing.place_texts(df, [(1, 100), (2, 1000), (3, None), (4, 0)], open_windows=8).collect()
    for pack, capacity in ((1, 100), (2, 1000)):
        mine = [r for r in rows if r.pack_id == pack]
        held: dict = {}
        for r in mine:
            held[r.window_id] = held.get(r.window_id, 0) + r.tokens
        assert max(held.values()) <= capacity
        for doc, size in sizes.items():
            parts = sorted((r.piece, r.first_token, r.tokens) for r in mine if r.doc_id == doc)
            assert sum(p[2] for p in parts) == size and [p[0] for p in parts] == list(range(len(parts)))
            assert len(parts) == 1 or size > capacity
        assert sum(sizes.values()) / (len(held) * capacity) > 0.93
    assert {r.pack_id for r in rows} == {1, 2}


def test_leftovers_merge_in_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "MERGE", 2)
    df = spark.createDataFrame([(i, 30) for i in range(90)], "doc_id long, tokens int").repartition(9)
    rows = packing.place_texts(df, [(1, 100)], open_windows=2).collect()
    assert len(rows) == 90 and len({r.doc_id for r in rows}) == 90


@pytest.mark.skipif(not __import__("os").path.exists(packing.VOCABULARY), reason="no tokenizer files")
def test_whole_documents(spark):
    docs = spark.createDataFrame([(1, "one two three"), (1, "one two three"), (2, None), (3, ""), (4, "word " * 900)], "doc_id long, text string")
    caps = spark.createDataFrame([(1, "w", 64)], "pack_id int, label string, capacity_tokens int")
    rows = packing.packed_documents(docs, caps).collect()
    counts = {r.doc_id: r.tokens for r in packing.token_counts(docs).collect()}
    encode = packing.encoder(packing.VOCABULARY).encode_ordinary
    assert counts == {1: len(encode("one two three")), 4: len(encode("word " * 900))}
    assert sum(r.tokens for r in rows if r.doc_id == 4) == counts[4] and sum(r.doc_id == 1 for r in rows) == 1
    assert packing.packed_documents(docs.where("false"), caps).count() == 0
