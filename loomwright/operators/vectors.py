"""Embedding statistics. Vectors are cast to double before any arithmetic.

Pairs of rows are never emitted. Mean pairwise cosine distance follows from the sum of the
unit vectors. Kernel sums need every pair, so vectors are gathered in blocks of ``BLOCK``,
blocks meet in a grid of cells, and each cell gives one number. The median distance needs
every pair as well: each cell gives a histogram of at most ``BINS`` counts, and the bins
that hold the middle are refined until one value is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1024
BINS = 4096
_INFINITY = 0x7FF0000000000000


def dispersion(df: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """Mean pairwise cosine distance of each group; null below two vectors.

    With unit vectors u, the sum of the dot products of all pairs is half of the squared
    norm of their sum less their number. Null and zero vectors are left out.
    """
    v = df.select(group, F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    unit = v.withColumn("norm", norm).where("norm > 0")
    parts = unit.select(group, "norm", F.posexplode("v").alias("i", "x"))
    sums = parts.groupBy(group, "i").agg(F.sum(F.col("x") / F.col("norm")).alias("s"), F.count("*").alias("k"))
    total = sums.groupBy(group).agg(F.sum(F.col("s") * F.col("s")).alias("square"), F.max("k").alias("k"))
    pairs = F.col("k") * (F.col("k") - 1)
    return total.select(
        group,
        F.col("k").alias("vectors"),
        F.when(F.col("k") >= 2, 1 - (F.col("square") - F.col("k")) / pairs).alias("dispersion"),
    )


def _cells(rows: DataFrame) -> DataFrame:
    """Every row in each cell ``(low, high)`` of the grid in which its block meets another."""
    blocks = max(1, -(-rows.count() // BLOCK))
    placed = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return spread.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})


def kernel_sums(df: DataFrame, side: str, vector: str, sigma: float, key: str) -> DataFrame:
    """``(left, right, pairs, total)``: sums of the Gaussian kernel over all unordered pairs
    of different rows within a side and over all pairs across two sides."""
    rows = df.select(F.col(side).alias("side"), F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    cells = _cells(rows.where("side is not null and v is not null")).select("low", "high", "block", "side", "v")

    def cell(key_: tuple, part: pd.DataFrame) -> pd.DataFrame:
        low, high = int(key_[0]), int(key_[1])
        a = part[part["block"] == low]
        b = part[part["block"] == high]
        out: dict[tuple, list[float]] = {}
        for s, x in a.groupby("side"):
            for t, y in b.groupby("side"):
                left, right = np.stack(x["v"].to_list()), np.stack(y["v"].to_list())
                gap = (left**2).sum(1)[:, None] + (right**2).sum(1)[None, :] - 2 * left @ right.T
                k = np.exp(-np.maximum(gap, 0) / (2 * sigma**2))
                if low == high:  # every pair stands in the square twice, equal rows once
                    if s > t:
                        continue
                    if s == t:
                        n = len(left)
                        out[(s, t)] = [n * (n - 1) / 2, (k.sum() - np.trace(k)) / 2]
                        continue
                pair = (s, t) if s <= t else (t, s)
                old = out.get(pair, [0.0, 0.0])
                out[pair] = [old[0] + k.size, old[1] + float(k.sum())]
        return pd.DataFrame([(s, t, n, v) for (s, t), (n, v) in out.items()], columns=["left", "right", "pairs", "total"])

    schema = "left string, right string, pairs double, total double"
    return (
        cells.withColumn("side", F.col("side").cast("string"))
        .groupBy("low", "high")
        .applyInPandas(cell, schema)
        .groupBy("left", "right")
        .agg(F.sum("pairs").alias("pairs"), F.sum("total").alias("total"))
    )


def mmd_squared(df: DataFrame, side: str, vector: str, sigma: float, key: str) -> DataFrame:
    """Unbiased squared discrepancy of every two sides; null below two rows, may be negative."""
    sums = kernel_sums(df, side, vector, sigma, key)
    own = sums.where("left = right").select(F.col("left").alias("s"), (F.col("total") / F.nullif("pairs", F.lit(0.0))).alias("mean"))
    across = sums.where("left <> right")
    return (
        across.join(own.select(F.col("s").alias("left"), F.col("mean").alias("a")), "left", "left")
        .join(own.select(F.col("s").alias("right"), F.col("mean").alias("b")), "right", "left")
        .select("left", "right", (F.col("a") + F.col("b") - 2 * F.col("total") / F.col("pairs")).alias("mmd_squared"))
    )


def _pair_bits(part: pd.DataFrame, low: int, high: int) -> Iterator[np.ndarray]:
    """Distances above 0 of the pairs that meet in a cell, as the bits of the doubles.

    The bits of positive doubles are ordered as their values. Differences are exact, so a
    pair has the same distance in every pass and equal vectors have 0.
    """
    first, second = part[part["block"] == low], part[part["block"] == high]
    if first.empty or second.empty:
        return
    a, b = np.stack(first["v"].to_list()), np.stack(second["v"].to_list())
    for start in range(0, len(a), 16):
        gap = np.sqrt(((a[start : start + 16, None, :] - b[None, :, :]) ** 2).sum(2))
        if low == high:  # every pair stands in the square twice
            gap[np.arange(start, start + len(gap))[:, None] >= np.arange(len(b))[None, :]] = 0
        yield gap[gap > 0].view(np.int64)


def pair_median(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``(distance)``: the median distance over all pairs of different vectors; null without any.

    Exact: each pass counts, for the range of each of the two middle pairs, ``BINS`` equal
    parts of the bits of the distances, with the least and greatest of each part, and goes
    on with the part that holds the middle pair until that part has one value.
    """
    rows = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    cells = _cells(rows).select("low", "high", "block", "v")

    def counted(ranges: list[tuple[int, int]]) -> list[list[tuple[int, int, int]]]:
        """``(pairs, least, greatest)`` of the parts of each range that hold pairs, in order."""

        def cell(key_: tuple, part: pd.DataFrame) -> pd.DataFrame:
            shape = (len(ranges), BINS)
            total, least, most = np.zeros(shape, np.int64), np.full(shape, _INFINITY), np.zeros(shape, np.int64)
            for bits in _pair_bits(part, int(key_[0]), int(key_[1])):
                for r, (begin, end) in enumerate(ranges):
                    held = bits[(bits >= begin) & (bits <= end)]
                    at = (held - begin) // -(-(end - begin + 1) // BINS)
                    total[r] += np.bincount(at, minlength=BINS)
                    np.minimum.at(least[r], at, held)
                    np.maximum.at(most[r], at, held)
            r, at = np.nonzero(total)
            return pd.DataFrame({"r": r, "bin": at, "n": total[r, at], "least": least[r, at], "most": most[r, at]})

        found = cells.groupBy("low", "high").applyInPandas(cell, "r long, bin long, n long, least long, most long")
        sums = found.groupBy("r", "bin").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
        out: list[list[tuple[int, int, int]]] = [[] for _ in ranges]
        for row in sorted(sums.collect(), key=lambda x: x["bin"]):
            out[row["r"]].append((row["n"], row["least"], row["most"]))
        return out

    whole = (1, _INFINITY)
    parts = {whole: counted([whole])[0]}
    total = sum(n for n, _, _ in parts[whole])
    if not total:
        return df.sparkSession.createDataFrame([(None,)], "distance double")
    middle = [(whole, (total - 1) // 2), (whole, total // 2)]  # ranges and ranks within them
    while any(begin < end for (begin, end), _ in middle):
        for m, (held, rank) in enumerate(middle):
            for n, least, most in parts.get(held, []):
                if rank < n:
                    middle[m] = ((least, most), rank)
                    break
                rank -= n
        ranges = sorted({held for held, _ in middle if held[0] < held[1]})
        parts = dict(zip(ranges, counted(ranges))) if ranges else {}
    low, high = np.array([begin for (begin, _), _ in middle], dtype=np.int64).view(np.float64).tolist()
    return df.sparkSession.createDataFrame([((low + high) / 2,)], "distance double")


def query_distances(df: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 5) -> DataFrame:
    """For every row whose id is divisible by ``every``, its ``k`` nearest other rows.

    Queries and rows are dealt into blocks that meet in a grid of cells; a cell keeps the
    best ``k`` of each of its queries, and the best of those are kept. Nothing is collected
    or broadcast. ``(key, neighbour, distance, place)``; ties go to the smaller id.
    """
    v = df.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v"))
    v = v.where("v is not null and key is not null")
    asked = v.where(F.col("key") % every == 0)
    total, queries = v.agg(F.count("*"), F.count_if(F.col("key") % every == 0)).first()
    across, down = max(1, -(-queries // BLOCK)), max(1, -(-total // (BLOCK * 8)))
    deal = lambda n: F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select(deal(across).alias("q"), spread(down).alias("r"), F.lit(True).alias("asks"), "key", "v")
    right = v.select(deal(down).alias("r"), spread(across).alias("q"), F.lit(False).alias("asks"), "key", "v")

    def cell(part: pd.DataFrame) -> pd.DataFrame:
        q, rows = part[part["asks"]], part[~part["asks"]].sort_values("key")
        if q.empty or rows.empty:
            return pd.DataFrame({"key": [], "neighbour": [], "distance": []})
        a, b = np.stack(q["v"].to_list()), np.stack(rows["v"].to_list())
        ids, own = q["key"].to_numpy(), rows["key"].to_numpy()
        found = []
        for start in range(0, len(a), 16):  # the exact differences of a few queries at a time
            gap = np.sqrt(((a[start : start + 16, None, :] - b[None, :, :]) ** 2).sum(2))
            gap[ids[start : start + 16, None] == own[None, :]] = np.inf
            best = np.argsort(gap, axis=1, kind="stable")[:, :k]
            found.append(
                pd.DataFrame(
                    {
                        "key": np.repeat(ids[start : start + 16], best.shape[1]),
                        "neighbour": own[best].ravel(),
                        "distance": np.take_along_axis(gap, best, 1).ravel(),
                    }
                )
            )
        out = pd.concat(found)
        return out[np.isfinite(out["distance"])]

    cells = left.unionByName(right).groupBy("q", "r").applyInPandas(cell, "key long, neighbour long, distance double")
    one = F.slice(F.sort_array(F.collect_list(F.struct("distance", "neighbour"))), 1, k)
    ranked = cells.groupBy("key").agg(one.alias("best")).select("key", F.posexplode("best").alias("place", "b"))
    return ranked.select("key", "b.neighbour", "b.distance", "place")
