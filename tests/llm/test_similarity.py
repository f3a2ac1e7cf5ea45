"""Near-duplicates and cross-split overlaps against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.llm import neardup, overlap, similar
from loomwright.llm.textkit import WordHashes, bag_id, common_share, numbered, words

VOCABULARY = [f"w{i}" for i in range(900)]


def corpus(seed, bases=40, size=90):
    rng = random.Random(seed)
    rows = []
    for b in range(bases):
        text = [rng.choice(VOCABULARY) for _ in range(size)]
        rows.append((f"b{b}", " ".join(text)))
        for v in range(rng.randrange(4)):
            other = list(text)
            for _ in range(rng.randrange(1, 12)):
                at = rng.randrange(len(other))
                act = rng.random()
                if act < 0.4:
                    other[at] = rng.choice(VOCABULARY)
                elif act < 0.7:
                    del other[at]
                else:
                    other.insert(at, rng.choice(VOCABULARY))
            if v == 2:
                half = len(other) // 2
                other = other[half:] + other[:half]
            rows.append((f"b{b}v{v}", " ".join(other)))
    return rows


def brute(rows, threshold):
    bags = [(a, words(x)) for a, x in rows if x]
    return {
        tuple(sorted((a, b)))
        for (a, x), (b, y) in itertools.combinations(bags, 2)
        if a != b and x and y and len({*x} & {*y}) * 4 >= len({*x}) and common_share(x, y) >= threshold
    }


def frame(spark, rows):
    return similar.texts_of([(spark.createDataFrame(rows, "id string, prose string"), "id", ["prose"])])


def test_bag_ids_ignore_order_but_not_number():
    h = WordHashes()
    ids = [bag_id(numbered(h.of(t.split()))) for t in ("a b a", "a a b", "a b", "a b b")]
    assert ids[0] == ids[1] and len({*ids}) == 3


def test_word_hashes_outlive_a_clearing():
    h = WordHashes(most=10)
    first = h.of([f"x{i}" for i in range(2000)])
    again = h.of([f"x{i}" for i in range(2000)])
    assert np.array_equal(first, again)


def test_common_share():
    assert common_share(["a", "a", "b"], ["a", "b", "b"]) == 2 / 4
    assert common_share([], []) == 0.0


def test_near_duplicates_equal_brute_force(spark):
    rows = corpus(1)
    got = {tuple(r) for r in neardup.near_duplicate_pairs(frame(spark, rows).repartition(5)).collect()}
    want = brute(rows, 0.7)
    assert len(got - want) == 0 and len(want - got) <= 0.02 * len(want)


def test_keys_of_all_words_go_with_their_sketch(spark):
    stock = [f"stock{i}" for i in range(85)]
    rows = [(f"r{p}", " ".join(stock + [f"p{p}rare{i}" for i in range(15)])) for p in range(12)]
    rows += [(f"f{i}", f"filler{i} other{i}") for i in range(60)]
    got = {tuple(r) for r in neardup.near_duplicate_pairs(frame(spark, rows)).collect()}
    want = brute(rows, 0.7)
    assert len(want) == 66 and got <= want and len(want - got) <= 0.1 * len(want)


def test_near_duplicates_of_odd_texts(spark):
    long = " ".join(VOCABULARY * 30)
    rows = [
        ("a", "Only three words"), ("b", "only, three WORDS!"), ("c", ""), ("d", None), ("e", "..."), ("a", "Only three words"),
        ("f", long), ("g", long + " end"), (None, "only three words"),
    ]
    got = {tuple(r) for r in neardup.near_duplicate_pairs(frame(spark, rows)).collect()}
    assert got == {("a", "b"), ("f", "g")}
    assert neardup.near_duplicate_pairs(frame(spark, rows).where("false")).count() == 0


def test_a_third_of_all_rows_are_copies(spark):
    rows = [(f"c{i:03}", "the same text again " * 5) for i in range(60)] + corpus(2, 20)
    df = frame(spark, rows).repartition(6)
    links, members = neardup.near_duplicates(df)
    assert members.where("rid like 'c%'").select("cid").distinct().count() == 1
    got = {tuple(r) for r in neardup.near_duplicate_pairs(df).collect()}
    assert sum(a[0] == b[0] == "c" for a, b in got) == 60 * 59 // 2


def sided(spark, rows):
    df = spark.createDataFrame(rows, "rid string, side string, text string")
    return df.select("rid", F.lit("t").alias("field"), "side", F.lit("s").alias("source"), "text").where("text is not null and side is not null")


def across(rows, threshold=0.7):
    side = {r[0]: r[1] for r in rows}
    texts = [(r[0], r[2]) for r in rows if r[1]]
    return {p for p in brute(texts, threshold) if side[p[0]] != side[p[1]]}


@pytest.mark.parametrize("cell", [4096, 2])
def test_overlaps_equal_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(overlap, "CELL", cell)
    rng = random.Random(3)
    rows = [(i, rng.choice("ett"), t) for i, t in corpus(4, 50)]
    rows += [(f"s{i}", rng.choice("et"), " ".join(rng.choices(VOCABULARY[:60], k=rng.randrange(4, 45)))) for i in range(60)]
    rows += [(f"t{i}", rng.choice("et"), r[2] + " more") for i, r in enumerate(rows[-20:])]
    got = {tuple(r) for r in overlap.overlap_pairs(sided(spark, rows).repartition(4)).collect()}
    assert got == across(rows)


def test_copies_on_both_sides_and_odd_texts(spark):
    rows = [("a", "e", "one two three"), ("b", "t", "Three, two. One"), ("c", "t", "one two three"), ("d", "e", ""), ("f", "t", "")]
    rows += [("g", None, "one two three"), ("h", "e", None)]
    got = {tuple(r) for r in overlap.overlap_pairs(sided(spark, rows)).collect()}
    assert got == {("a", "b"), ("a", "c")}
    assert overlap.overlap_pairs(sided(spark, rows).where("false")).count() == 0


def test_meetings_that_rank_last_count(spark):
    rng = random.Random(11)
    common = " ".join(f"stock{i}" for i in range(60))
    rows = []
    for p in range(12):  # each text has 15 rare words, of which a pair shares a run of five
        own = [[f"p{p}{s}{i}" for i in range(10)] for s in "et"]
        shared = [f"p{p}shared{i}" for i in range(5)]
        rows += [(f"{s}{p}", s, f"{common} {' '.join(o)} {' '.join(shared)}") for s, o in zip("et", own)]
    rows += [(f"f{i}", rng.choice("et"), " ".join(rng.choices(VOCABULARY, k=80))) for i in range(40)]
    got = {tuple(r) for r in overlap.overlap_pairs(sided(spark, rows)).collect()}
    assert {(f"e{p}", f"t{p}") for p in range(12)} <= got == across(rows)


@pytest.mark.parametrize("size", [2, 10, 32, 1000])
def test_overlaps_of_stock_words_in_tables_of_any_size(spark, size):
    rng = random.Random(size)
    stock = [f"stock{i}" for i in range(600)]
    rows = []
    for p in range(size // 2):
        told = rng.sample(stock, 100)
        other = list(told)
        for at in rng.sample(range(100), 2):
            other[at] = rng.choice(stock) if p % 2 else f"own{p}n{at}"
        rows += [(f"e{p}", "e", " ".join(told)), (f"t{p}", "t", " ".join(other))]
    got = {tuple(r) for r in overlap.overlap_pairs(sided(spark, rows).coalesce(1)).collect()}
    assert len(got) >= size // 2 and got == across(rows)


def test_a_bare_text_meets_its_form_with_rare_words(spark):
    rng = random.Random(5)
    stock = [f"stock{i}" for i in range(130)]
    rows = [(f"f{i}", rng.choice("et"), " ".join(rng.sample(stock, 70) + [f"f{i}w{k}" for k in range(50)])) for i in range(300)]
    for p in range(8):  # one side has no rare word, the other 40 of 140
        told = rng.sample(stock, 100)
        more = [w for i, w in enumerate(told) for w in ([w, f"p{p}w{i}"] if 5 <= i < 45 else [w])]
        rows += [(f"e{p}", "e", " ".join(told)), (f"t{p}", "t", " ".join(more))]
    got = {tuple(r) for r in overlap.overlap_pairs(sided(spark, rows)).collect()}
    want = across(rows)
    assert len(want) >= 8 and got == want


def test_counts_do_not_saturate(spark):
    tables = overlap.Tables()
    places, more = np.array([3, 9]), overlap.zlib.compress(np.array([70_000, 2], dtype="<u4").tobytes())
    tables.merge("e", "counts", 0, places, more)
    tables.merge("e", "counts", 0, places, more)
    assert tables.counts["e"][[3, 9]].tolist() == [140_000, 4]


def test_report_is_per_split_and_source(spark):
    same, other = "one two three four", "five six seven eight"
    design = spark.createDataFrame(
        [("d1", 7, " Dev", same, None), ("d2", 7, "test", other, None), ("d3", None, "train", same, None)],
        "id string, book long, split string, prose string, source string",
    )
    pilot = spark.createDataFrame(
        [("p1", "final-eval", "human", same), ("p2", "development", "human", other), ("p3", "training", "human", other)],
        "id string, role string, provenance string, text string",
    )
    probes = spark.createDataFrame(
        [("m1", "test", ("north",), [("user", same)]), ("m2", "TEST ", ("south",), [("user", "nine ten")])],
        "id string, split string, provenance struct<source:string>, messages array<struct<role:string,content:string>>",
    )
    got = {tuple(r) for r in overlap.overlap_report(overlap.sided_texts(design, pilot, probes)).collect()}
    assert got == {
        ("starter_design", "validation", "archive-7", 1, 1), ("starter_design", "test", "archive-7", 1, 1),
        ("pilot_matched_v1", "final_eval", "human", 1, 1), ("pilot_matched_v1", "development", "human", 1, 1),
        ("sft_mask_probes", "test", "north", 1, 1), ("sft_mask_probes", "test", "south", 1, 0),
    }


def test_sides_of_spellings(spark):
    df = spark.createDataFrame([(" TRAIN ",), ("Dev",), ("final-eval",), (None,), ("other",)], "s string")
    got = [tuple(r) for r in df.select(overlap.side_of(F.col("s")), overlap.side_of(F.col("s"), overlap._PILOT_ROLE_OF)).collect()]
    assert got == [("t", "t"), ("e", "e"), (None, "e"), (None, None), (None, None)]
