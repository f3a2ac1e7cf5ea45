"""Verification and expansion shared by the similarity joins.

Texts are joined as classes: all texts with the same bag of words are one class. A link
between two classes is verified once, on one text of each, and holds for all members.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.textkit import common_share, words
from loomwright.session import staged


def texts_of(tables: list[tuple[DataFrame, str, list[str]]]) -> DataFrame:
    """``(rid, field, text)`` of the named text fields of several tables; nulls are left out."""
    parts = [
        df.select(F.col(key).cast("string").alias("rid"), F.lit(name).alias("field"), F.col(name).alias("text"))
        for df, key, names in tables
        for name in names
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where("text is not null and rid is not null")


def verified(pairs: DataFrame, first: DataFrame, second: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``(a, b)`` of classes whose texts reach the similarity, with it.

    ``first`` and ``second`` hold ``(cid, text)``, one row for each class that occurs in
    the pairs (more rows of a class only repeat the result).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, ta, tb = (c.to_pylist() for c in batch.columns)
            kept = [
                (x, y, s)
                for x, y, s in (
                    (x, y, common_share(words(p), words(q))) for x, y, p, q in zip(a, b, ta, tb)
                )
                if s >= threshold - 1e-12
            ]
            if kept:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), t) for c, t in zip(zip(*kept), (pa.int64(), pa.int64(), pa.float64()))],
                    names=["a", "b", "similarity"],
                )

    with_texts = (
        pairs.join(first.select(F.col("cid").alias("a"), F.col("text").alias("ta")), "a")
        .join(second.select(F.col("cid").alias("b"), F.col("text").alias("tb")), "b")
        .select("a", "b", "ta", "tb")
    )
    return with_texts.mapInArrow(run, "a long, b long, similarity double")


FILTER = 1 << 18
"""Places of the filter on record ids: its size, and so what is broadcast, is fixed."""


def class_texts(pairs: DataFrame, sides: list[str], representatives: DataFrame, texts: DataFrame) -> DataFrame:
    """``(cid, text)`` for the classes that occur in the given columns of the pairs.

    ``representatives`` has ``(cid, rid, field)``, one text for each class. Texts whose id
    falls on no place of a hashed filter of ``FILTER`` places are left before the exchange.
    """
    needed = pairs.select(F.col(sides[0]).alias("cid"))
    for side in sides[1:]:
        needed = needed.union(pairs.select(F.col(side).alias("cid")))
    wanted = staged(representatives.join(needed.distinct(), "cid", "left_semi"), "wanted")
    place = F.pmod(F.xxhash64("rid"), F.lit(FILTER))
    places = wanted.select(place.alias("place")).distinct()
    kept = texts.withColumn("place", place).join(F.broadcast(places), "place", "left_semi")
    found = kept.select("rid", "field", "text").join(wanted, ["rid", "field"])
    return staged(found.groupBy("cid").agg(F.first("text").alias("text")), "class-texts")


def record_pairs(links: DataFrame, left: DataFrame, right: DataFrame, within: DataFrame) -> DataFrame:
    """Pairs of different records, smaller id first.

    ``links`` are verified class pairs, ``left`` and ``right`` the members ``(cid, rid)``
    of each side, ``within`` pairs ``(x, y)`` of records that share a class.
    """
    across = (
        links.select("a", "b")
        .join(left.select(F.col("cid").alias("a"), F.col("rid").alias("x")), "a")
        .join(right.select(F.col("cid").alias("b"), F.col("rid").alias("y")), "b")
        .select("x", "y")
    )
    return (
        across.unionByName(within)
        .where("x <> y")
        .select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
        .distinct()
    )
