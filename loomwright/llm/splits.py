"""Splits that keep related records together, by component swap search.

Records that share a key, directly or through others, form a component; a component is
never parted. The search starts from a hashed assignment and exchanges or moves whole
components while the temperature falls, so that the sizes of the splits and of the labels
within them come near the asked proportions; the best state seen is kept. It runs in
parallel: components are dealt into blocks of about ``BLOCK``, every block is annealed
``CHAINS`` times from different seeds in a task of its own, and the best chain of each
block is kept. As every block meets the proportions, so does their sum. Components above
``GIANT`` of all records can't be balanced inside a block: there are at most
``1 / GIANT`` of them, so they are placed first and what they leave over is shared out as
the blocks' target. The ``LABELS`` - 1 most frequent labels are balanced one by one, the
others as one label.

Keys are compared after trimming, lower-casing and reading runs of blanks, ``_`` and
``-`` as one ``-``; null, empty, ``unknown``, ``anonymous`` and ``n/a`` are no keys.

Defined results: a record without a key is a component of its own; repeated rows count
once; empty tables give no rows; null labels are a label of their own.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.operators.components import connected_components
from loomwright.session import staged

NO_KEY = ("", "unknown", "anonymous", "n/a")
SPLITS = {"train": "train", "training": "train", "validation": "validation", "valid": "validation", "dev": "validation", "test": "test"}
PROPORTIONS = {"train": 0.8, "validation": 0.1, "test": 0.1}
BLOCK, CHAINS, STEPS, GIANT, LABELS = 5_000, 3, 20_000, 0.001, 32


def clean_key(key: Column) -> Column:
    """The key as it is compared, or null if it is none."""
    low = F.lower(F.regexp_replace(key, r"(?U)^\s+|\s+$", ""))
    joined = F.regexp_replace(low, r"(?U)[\s_-]+", "-")
    return F.when(joined.isin(*NO_KEY), None).otherwise(joined)


def clean_split(split: Column) -> Column:
    """``train``, ``validation``, ``test``, or the cleaned text; null if blank."""
    low = F.lower(F.regexp_replace(split, r"(?U)^\s+|\s+$", ""))
    out = F.when(low == "", None).otherwise(low)
    for spelled, name in SPLITS.items():
        out = F.when(low == spelled, F.lit(name)).otherwise(out)
    return out


def keyed_records(design: DataFrame, probes: DataFrame) -> DataFrame:
    """``(record_id, split, label, keys)`` of the two tables, one row for each record."""
    first = design.select(
        F.col("id").alias("record_id"),
        clean_split(F.col("split")).alias("split"),
        F.concat(F.lit("design/"), F.coalesce("genre", F.lit("-"))).alias("label"),
        F.array(
            F.col("author_id"),
            F.when(F.col("book").isNotNull(), F.concat(F.lit("archive-"), F.col("book").cast("string"))),
        ).alias("keys"),
    )
    second = probes.select(
        F.col("id").alias("record_id"),
        clean_split(F.col("split")).alias("split"),
        F.concat(F.lit("probe/"), F.coalesce("family", F.lit("-"))).alias("label"),
        F.concat(
            F.array("provenance.author_id"), F.coalesce("source_groups", F.array().cast("array<string>"))
        ).alias("keys"),
    )
    both = first.unionByName(second).where("record_id is not null")
    cleaned = both.withColumn(
        "keys", F.array_sort(F.array_distinct(F.filter(F.transform("keys", clean_key), lambda k: k.isNotNull())))
    )
    return cleaned.distinct()


def record_components(records: DataFrame) -> DataFrame:
    """``(record_id, split, label, component, group_key)``.

    ``component`` is a number; ``group_key`` the smallest key of the component in byte
    order, null for a record without keys.
    """
    records = staged(records, "split-records")
    hashed = lambda c: F.xxhash64(c)
    # the keys of a record are linked in a chain, so a key with many records stays a light node
    edges = (
        records.where("size(keys) > 1")
        .select(F.expr("transform(keys, (k, i) -> struct(k as a, get(keys, i + 1) as b))").alias("e"))
        .select(F.explode("e").alias("e"))
        .where("e.b is not null")
        .select(hashed("e.a").alias("u"), hashed("e.b").alias("v"))
        .distinct()
    )
    linked = connected_components(edges)
    keys = records.select(F.explode("keys").alias("key")).distinct().withColumn("node", hashed("key"))
    placed = keys.join(linked, "node", "left").select(
        "key", "node", F.coalesce("component", "node").alias("component")
    )
    smallest = placed.groupBy("component").agg(F.min("key").alias("group_key"))
    named = placed.select("node", "component").join(smallest, "component")
    named = staged(named, "split-keys")
    with_key = records.select(
        "record_id", "split", "label", F.when(F.size("keys") > 0, hashed(F.get("keys", 0))).alias("node")
    )
    return with_key.join(named, "node", "left").select(
        "record_id",
        "split",
        "label",
        F.coalesce("component", F.xxhash64(F.lit("record"), "record_id")).alias("component"),
        "group_key",
    )


def parted_records(records: DataFrame) -> DataFrame:
    """``(record_id, group_key)`` of all records in components whose splits differ."""
    placed = record_components(records)
    parted = (
        placed.where("group_key is not null")
        .groupBy("group_key")
        .agg(F.min("split").alias("low"), F.max("split").alias("high"))
        .where("low <> high")
        .select("group_key")
    )
    return placed.join(parted, "group_key").select("record_id", "group_key").distinct()


def anneal(sizes: np.ndarray, start: np.ndarray, target: np.ndarray, seed: int, steps: int) -> tuple[np.ndarray, float]:
    """Assign components (rows, with their label counts) to splits.

    ``target`` has the asked label counts (splits x labels). Cost is the sum of the
    squared deviations of split sizes and of label counts, relative to the targets.
    """
    rng = np.random.default_rng(seed)
    now = start.copy()
    count, splits = len(sizes), len(target)
    have = np.zeros_like(target)
    for s in range(splits):
        have[s] = sizes[now == s].sum(axis=0)
    weight = 1.0 / np.maximum(target.sum(axis=1), 1.0)

    def cost(h: np.ndarray) -> np.ndarray:
        gap = h - target
        return (gap.sum(axis=1) ** 2 + (gap**2).sum(axis=1)) * weight

    per = cost(have)
    best, best_cost = now.copy(), float(per.sum())
    heat = max(best_cost / 20, 1e-9)
    cool = (1e-4) ** (1 / max(1, steps))
    picks = rng.integers(0, count, (steps, 2))
    others = rng.integers(1, splits, steps)
    moves = rng.random(steps)
    luck = np.log(np.maximum(rng.random(steps), 1e-300))
    for i in range(steps):
        a, b = picks[i]
        heat *= cool
        old = now[a]
        if moves[i] < 0.5 or now[b] == old:
            new, change = (old + others[i]) % splits, sizes[a]
            b = -1
        else:
            new, change = now[b], sizes[a] - sizes[b]
        two = np.array([old, new])
        tried = have[two]
        tried[0] -= change
        tried[1] += change
        gap = tried - target[two]
        made = (gap.sum(axis=1) ** 2 + (gap**2).sum(axis=1)) * weight[two]
        delta = made.sum() - per[old] - per[new]
        if delta <= 0 or luck[i] < -delta / heat:
            have[two], per[two] = tried, made
            now[a] = new
            if b >= 0:
                now[b] = old
            total = float(per.sum())
            if total < best_cost - 1e-12:
                best, best_cost = now.copy(), total
    return best, best_cost


def _deal(names: list[str], shares: np.ndarray, key: np.ndarray) -> np.ndarray:
    place = (key.astype(np.uint64) % np.uint64(1 << 20)).astype(np.float64) / (1 << 20)
    return np.minimum(np.searchsorted(np.cumsum(shares), place, side="right"), len(names) - 1)


def assign_splits(records: DataFrame, proportions: dict[str, float] | None = None) -> DataFrame:
    """``(record_id, group_key, split)``: an assignment in which no component is parted."""
    asked = proportions or PROPORTIONS
    names = sorted(asked)
    shares = np.array([asked[n] for n in names]) / sum(asked.values())
    placed = staged(record_components(records), "split-components")
    ranked = placed.groupBy("label").count().orderBy(F.desc("count"), "label").limit(LABELS - 1).collect()
    spark = records.sparkSession
    named = spark.createDataFrame([(r["label"], n) for n, r in enumerate(ranked)], "name string, bin int")
    bins = placed.join(F.broadcast(named), F.col("label").eqNullSafe(F.col("name")), "left").select(
        "component", F.coalesce("bin", F.lit(LABELS - 1)).alias("bin")
    )
    counts = bins.groupBy("component", "bin").agg(F.count("*").alias("n"))
    totals = counts.groupBy("component").agg(
        F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("bins")
    )
    totals = staged(totals, "split-sizes")
    every, number = totals.agg(F.sum("n"), F.count("*")).first()
    if not every:
        return placed.select("record_id", "group_key", F.lit(None).cast("string").alias("split"))
    giant = totals.where(F.col("n") > GIANT * every).select("component", "n").collect()
    giant.sort(key=lambda r: (-r["n"], r["component"]))
    room = shares * every
    put = []
    for row in giant:  # largest first, to the split with the most room for its share
        s = int(np.argmax(room - row["n"] * (room < row["n"])))
        put.append((row["component"], names[s]))
        room[s] -= row["n"]
    left = np.maximum(room, 0)
    rest = left / left.sum() if left.sum() > 0 else shares
    blocks = max(1, math.ceil((number - len(giant)) / BLOCK))
    large = spark.createDataFrame(put, "component long, split string")
    small = totals.join(large.select("component"), "component", "left_anti")
    dealt = small.withColumn("block", F.pmod(F.xxhash64("component", F.lit(17)), F.lit(blocks)))
    schema = "component long, split string, chain int, cost double, block long"

    def search(keys: tuple, part: pd.DataFrame) -> pd.DataFrame:
        block, chain = (int(k) for k in keys)
        part = part.sort_values("component")
        sizes = np.zeros((len(part), LABELS))
        for i, bins_of in enumerate(part["bins"]):
            for label, n in bins_of.items() if isinstance(bins_of, dict) else bins_of:
                sizes[i, label] = n
        target = rest[:, None] * sizes.sum(axis=0)[None, :]
        component = part["component"].to_numpy()
        start = _deal(names, rest, component ^ (component >> 21) ^ (chain * 7919))
        found, cost = anneal(sizes, start, target, seed=block * 31 + chain, steps=STEPS)
        return pd.DataFrame(
            {
                "component": component,
                "split": [names[s] for s in found],
                "chain": chain,
                "cost": cost,
                "block": block,
            }
        )

    chains = dealt.withColumn("chain", F.explode(F.sequence(F.lit(0), F.lit(CHAINS - 1))))
    searched = staged(chains.groupBy("block", "chain").applyInPandas(search, schema), "split-chains")
    best = (
        searched.select("block", "chain", "cost")
        .distinct()
        .groupBy("block")
        .agg(F.min_by("chain", F.struct("cost", "chain")).alias("chain"))
    )
    chosen = searched.join(best, ["block", "chain"]).select("component", "split").unionByName(large)
    return placed.select("record_id", "group_key", "component").join(chosen, "component").select(
        "record_id", "group_key", "split"
    )


def split_report(assigned: DataFrame) -> DataFrame:
    """Records and their share in each split."""
    sizes = assigned.groupBy("split").agg(F.count("*").alias("records"))
    total = F.sum("records").over(Window.partitionBy(F.lit(0)))  # as many rows as splits
    return sizes.select("split", "records", (F.col("records") / total).alias("share"))


def split_faults(records: DataFrame, proportions: dict[str, float] | None = None) -> DataFrame:
    """``(records, parted, deviation)`` of an assignment: its records, the groups it parts,
    and the largest distance of a split's share from the asked one, to two places."""
    asked = proportions or PROPORTIONS
    assigned = staged(assign_splits(records, asked), "split-assigned")
    parted = (
        assigned.where("group_key is not null")
        .groupBy("group_key")
        .agg((F.min("split") != F.max("split")).alias("parted"))
        .agg(F.count_if("parted").alias("parted"))
    )
    shares = [F.abs(F.count_if(F.col("split") == name) / F.count("*") - F.lit(float(share))) for name, share in sorted(asked.items())]
    sizes = assigned.agg(F.count("*").alias("records"), F.round(F.greatest(*shares), 2).alias("deviation"))
    return sizes.join(parted).select("records", "parted", "deviation")  # one row each
