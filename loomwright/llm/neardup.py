"""Near-duplicate records by tensored banding.

A text is a bag of words; two texts are near-duplicates if their multiset similarity
(common words over words in either) reaches a threshold. Words that stand in more than
``COMMON`` of all texts carry little and are left out of the signatures, never of the
verification; texts of at most ``SHORT`` words, and those that keep less than ``FEW`` of
their words, are also signed with all of them, so that a short text or one of common words
is found too.

A signature has ``GROUPS`` groups of ``WIDTH`` minhashes. A table key combines two
groups: the groups are the small collections, and each of them serves several tables, so
``GROUPS * WIDTH`` minhashes feed ``GROUPS * len(STEPS)`` tables of ``2 * WIDTH`` rows.
Texts that share a key are candidates if enough nibbles of a second, independent sketch
of the same words agree; every candidate is verified on the whole texts.

Hot keys: texts with the same bag of words are one class from the start, so copies never
meet; other hot keys are left to the skew handling of the sort-merge join, whose inputs
are plain exchanges on the key. No bucket is cut and no pair is dropped.

Defined results: null texts, empty texts and texts without letters or digits are near
nothing; a record is never paired with itself; repeated rows count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.similar import class_texts, record_pairs, verified
from loomwright.llm.textkit import WordHashes, bag_id, minhashes, mix, numbered, words
from loomwright.session import staged

COMMON, FLOOR = 0.08, 50
SHORT, FEW = 60, 0.3
GROUPS, WIDTH, STEPS = 20, 2, (1, 3)
NIBBLES, AGREE = 16, 4


def common_words(texts: DataFrame, share: float = COMMON) -> list[str]:
    """Words that stand in more than ``share`` of all texts and in more than ``FLOOR``, counted over all of them.

    Their number is bounded by the mean number of different words of a text divided by
    ``share``, whatever the size of the corpus.
    """

    counted = texts.select(
        F.explode(F.array_union(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), F.array(F.lit("")))).alias("word")
    )
    # every text also holds the empty word, whose count is the number of texts
    summed = staged(counted.groupBy("word").agg(F.count("*").alias("n")), "word-counts")
    total = summed.where("word = ''").agg(F.sum("n")).first()[0] or 0
    return [row[0] for row in summed.where((F.col("word") != "") & (F.col("n") > max(share * total, FLOOR))).select("word").collect()]


def _sign(bags: list[np.ndarray], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Table keys (texts x tables) and sketches of bags."""
    drawn = minhashes(bags, GROUPS * WIDTH + NIBBLES, seed)
    groups = drawn[0 : GROUPS * WIDTH : WIDTH].copy()
    for k in range(1, WIDTH):
        groups = mix(groups * np.uint64(31) + drawn[k : GROUPS * WIDTH : WIDTH])
    keys = []
    for step in STEPS:
        for i in range(GROUPS):
            table = np.uint64(1 + len(keys) + 4096 * seed)
            keys.append(mix(mix(groups[i] + table) ^ groups[(i + step) % GROUPS]))
    sketch = np.zeros(len(bags), dtype=np.uint64)
    for k in range(NIBBLES):
        sketch |= (drawn[GROUPS * WIDTH + k] & np.uint64(15)) << np.uint64(4 * k)
    return np.stack(keys, axis=1), sketch


def signatures(texts: DataFrame, common: list[str]) -> DataFrame:
    """``(rid, field, cid, keys, sketch, all_keys, all_sketch)``, from the rare words and
    from all words; within a partition only the first text of a class carries keys."""
    left_out = frozenset(common)
    schema = "rid string, field string, cid long, keys array<long>, sketch long, all_keys array<long>, all_sketch long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        for batch in batches:
            rids, fields, out_text = (c.to_pylist() for c in batch.columns)
            rows, rare, short = [], [], []
            for rid, field, text in zip(rids, fields, out_text):
                tokens = words(text)
                if not tokens:
                    continue
                full = numbered(hashes.of(tokens))
                cid = bag_id(full)
                at = len(rows)
                rows.append((rid, field, cid))
                if cid in seen:
                    continue
                seen.add(cid)
                kept = [t for t in tokens if t not in left_out]
                if kept:
                    rare.append((at, numbered(hashes.of(kept))))
                if len(tokens) <= SHORT or len(kept) < FEW * len(tokens):
                    short.append((at, full))
            if not rows:
                continue
            columns = []
            for seed, signed in ((1, rare), (2, short)):
                sizes, sketches = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
                flat = np.zeros(0, dtype=np.int64)
                if signed:
                    made, sketch = _sign([b for _, b in signed], seed)
                    at = [n for n, _ in signed]
                    sizes[at], sketches[at], flat = made.shape[1], sketch.view(np.int64), made.view(np.int64).ravel()
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                columns += [pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int64())), pa.array(sketches)]
            rid, field, cid = (list(c) for c in zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rid, pa.string()),
                    pa.array(field, pa.string()),
                    pa.array(cid, pa.int64()),
                    *columns,
                ],
                names=["rid", "field", "cid", "keys", "sketch", "all_keys", "all_sketch"],
            )

    return texts.select("rid", "field", "text").mapInArrow(run, schema)


def near_duplicates(texts: DataFrame, threshold: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Verified links ``(a, b, similarity)`` between classes, and members ``(cid, rid)``."""
    signed = staged(signatures(texts, common_words(texts)), "neardup")
    members = signed.select("cid", "rid").distinct()
    classes = (
        signed.where("size(keys) + size(all_keys) > 0")
        .groupBy("cid")
        .agg(F.first(F.struct("rid", "field", "keys", "sketch", "all_keys", "all_sketch")).alias("one"))
    )
    # a key goes with the sketch of the words that it was made of
    told = "transform({0}keys, k -> named_struct('key', k, 'sketch', {0}sketch))"
    both = F.explode(F.expr(f"concat({told.format('one.')}, {told.format('one.all_')})"))
    rows = classes.select("cid", both.alias("k")).select("k.key", "cid", "k.sketch")
    x, y = rows.alias("x"), rows.alias("y")
    # nibbles that differ leave a bit in the masked word; 16 less their number agree
    folded = "(x.sketch ^ y.sketch)"
    differ = f"bit_count(({folded} | shiftright({folded}, 1) | shiftright({folded}, 2) | shiftright({folded}, 3)) & 1229782938247303441L)"
    pairs = (
        x.join(y, F.expr(f"x.key = y.key and x.cid < y.cid and {NIBBLES} - {differ} >= {AGREE}"))
        .select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b"))
        .distinct()
    )
    pairs = staged(pairs, "neardup-pairs")
    representatives = classes.select("cid", "one.rid", "one.field")
    held = class_texts(pairs, ["a", "b"], representatives, texts)
    return verified(pairs, held, held, threshold), members


def near_duplicate_pairs(texts: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``(id_a, id_b)``: every pair of different records with near-duplicate texts."""
    links, members = near_duplicates(texts, threshold)
    same = (
        members.alias("m")
        .join(members.alias("n"), F.expr("m.cid = n.cid and m.rid < n.rid"))
        .select(F.col("m.rid").alias("x"), F.col("n.rid").alias("y"))
    )
    return record_pairs(links, members, members, same)
