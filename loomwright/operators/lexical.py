"""Lexical and n-gram statistics. An undefined statistic is null, never zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions import text as T


def lexical_features(df: DataFrame, text: str = "text") -> DataFrame:
    """Counts and rates of each text: words, distinct-1 to -3, repeated trigrams, sentence
    and paragraph shapes. A null text has null features; an empty one has zero words."""
    # n-grams are columns of their own, so that each list is built once
    words = df.withColumn("_w", T.tokens(F.col(text))).withColumn("_s", T.sentences(F.col(text)))
    words = words.withColumn("_p", T.paragraphs(F.col(text)))
    words = words.withColumns({f"_g{n}": T.ngrams(F.col("_w"), n) for n in (2, 3)}).withColumn(
        "_o", F.transform("_s", lambda s: F.array_join(F.slice(T.spaced(T.fold(s)), 1, 3), " "))
    )
    names = {1: "_w", 2: "_g2", 3: "_g3"}

    def distinct(n: int) -> Column:
        return T.share(F.size(F.array_distinct(names[n])), F.size(names[n]))

    repeated = lambda a: T.share(F.size(a) - F.size(F.array_distinct(a)), F.size(a))
    return words.select(
        *df.columns,
        F.size("_w").alias("word_count"),
        *[distinct(n).alias(f"distinct_{n}") for n in (1, 2, 3)],
        repeated("_g3").alias("repeated_trigram_rate"),
        F.transform("_s", lambda s: F.size(T.spaced(s))).alias("sentence_lengths"),
        F.transform("_p", lambda p: F.size(T.spaced(p))).alias("paragraph_lengths"),
        repeated("_p").alias("duplicate_paragraph_rate"),
        repeated("_o").alias("repeated_opening_rate"),
    )


def gram_counts(df: DataFrame, keys: list[str], n: int, text: str = "text") -> DataFrame:
    """``(*keys, gram, c)``: how often each n-gram occurs in a group; none spans two texts."""
    words = df.select(*keys, T.tokens(F.col(text)).alias("_w"))  # once, not for every n-gram
    grams = words.select(*keys, F.explode(T.ngrams(F.col("_w"), n)).alias("gram"))
    return grams.groupBy(*keys, "gram").agg(F.count("*").alias("c"))


def pooled_l2(df: DataFrame, group: str, n: int) -> DataFrame:
    """Distance of the pooled n-gram frequencies of every two groups.

    Only shared n-grams are joined: the squared distance is the sum of both squared norms
    less twice the product of what both hold. A group without n-grams is not listed.
    """
    counted = gram_counts(df.where(F.col(group).isNotNull()), [group], n)
    total = counted.groupBy(group).agg(F.sum("c").alias("total"), F.sum(F.col("c").cast("double") ** 2).alias("square"))
    norms = total.select(group, "total", (F.col("square") / F.col("total") / F.col("total")).alias("norm"))
    a, b = counted.alias("a"), counted.alias("b")
    both = (
        a.join(b, F.expr(f"a.gram = b.gram and a.{group} < b.{group}"))
        .groupBy(F.col(f"a.{group}").alias("left"), F.col(f"b.{group}").alias("right"))
        .agg(F.sum(F.col("a.c").cast("double") * F.col("b.c")).alias("product"))
    )
    pairs = norms.alias("x").join(norms.alias("y"), F.expr(f"x.{group} < y.{group}"))
    told = pairs.select(
        F.col(f"x.{group}").alias("left"),
        F.col(f"y.{group}").alias("right"),
        (F.col("x.norm") + F.col("y.norm")).alias("norms"),
        (F.col("x.total") * F.col("y.total")).alias("scale"),
    )
    squared = F.col("norms") - 2 * F.coalesce(F.col("product"), F.lit(0.0)) / F.col("scale")
    return told.join(both, ["left", "right"], "left").select(
        "left", "right", F.sqrt(F.greatest(squared, F.lit(0.0))).alias("l2")
    )


def overlap_share(df: DataFrame, reference: DataFrame, n: int = 3, text: str = "text") -> DataFrame:
    """For each document the share of its n-gram occurrences that a reference set holds."""
    known = gram_counts(reference, [], n, text).select("gram")
    marked = gram_counts(df, ["doc_id"], n, text).join(
        known.withColumn("known", F.lit(1)), "gram", "left"
    )
    return marked.groupBy("doc_id").agg(
        T.share(F.sum(F.when(F.col("known") == 1, F.col("c")).otherwise(0)), F.sum("c")).alias("overlap")
    )


def macro_and_pooled(df: DataFrame, group: str, n: int) -> DataFrame:
    """Distinct-n of each group, averaged over its texts and over the pooled n-grams."""
    words = df.select(group, T.tokens(F.col("text")).alias("_w"))
    features = words.select(group, T.ngrams(F.col("_w"), n).alias("_g"))
    macro = features.groupBy(group).agg(
        F.avg(T.share(F.size(F.array_distinct("_g")), F.size("_g"))).alias("macro")
    )
    pooled = gram_counts(df, [group], n).groupBy(group).agg(
        T.share(F.count("*"), F.sum("c")).alias("pooled")
    )
    return macro.join(pooled, macro[group].eqNullSafe(pooled[group]), "left").select(macro[group], "macro", "pooled")


def duplicate_rate(df: DataFrame, group: str) -> DataFrame:
    """Texts of each group and the share of them that repeat another."""
    seen = df.where("text is not null").groupBy(group, F.sha2("text", 256).alias("h")).agg(F.count("*").alias("c"))
    return seen.groupBy(group).agg(
        F.sum("c").alias("texts"), T.share(F.sum("c") - F.count("*"), F.sum("c")).alias("duplicate_rate")
    )


def self_bleu(df: DataFrame, group: str, order: int = 4) -> DataFrame:
    """Mean sentence BLEU of every sample against the others of its group.

    Counts are clipped by the largest count in another sample: the top two counts of a
    gram suffice, the second where the sample itself owns the first. Precisions are
    smoothed by one; the closest length is the shorter on a tie. A group with fewer than
    two samples, or with an empty one, has no value.
    """
    base = df.select(group, "doc_id", T.tokens(F.col("text")).alias("w")).withColumn("len", F.size("w"))

    def sized(n: int) -> Column:
        return F.transform(T.ngrams(F.col("w"), n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram")))

    every = F.flatten(F.array(*[sized(n) for n in range(1, order + 1)]))
    grams = base.select(group, "doc_id", F.explode(every).alias("_g"))
    counted = grams.groupBy(group, "doc_id", "_g.n", "_g.gram").agg(F.count("*").alias("c"))
    top = (
        counted.groupBy(group, "n", "gram")
        .agg(F.max(F.struct("c", "doc_id")).alias("first"))
    )
    second = (
        counted.join(top.select(group, "n", "gram", "first"), [group, "n", "gram"])
        .where("doc_id <> first.doc_id")
        .groupBy(group, "n", "gram")
        .agg(F.max("c").alias("second"))
    )
    limits = top.join(second, [group, "n", "gram"], "left").select(
        group, "n", "gram", "first", F.coalesce("second", F.lit(0)).alias("second")
    )
    clipped = counted.join(limits, [group, "n", "gram"]).withColumn(
        "hit", F.least("c", F.when(F.col("first.doc_id") == F.col("doc_id"), F.col("second")).otherwise(F.col("first.c")))
    )
    orders = base.select(group, "doc_id", "len").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(order))))
    hits = clipped.groupBy(group, "doc_id", "n").agg(F.sum("hit").alias("hits"), F.sum("c").alias("total"))
    precision = orders.join(hits, [group, "doc_id", "n"], "left").select(
        group,
        "doc_id",
        "len",
        F.log((F.coalesce("hits", F.lit(0)) + 1) / (F.coalesce("total", F.lit(0)) + 1)).alias("lp"),
    )
    lengths = base.groupBy(group, "len").agg(F.count("*").alias("n"))
    by_length = Window.partitionBy(group).orderBy("len")
    around = lengths.select(
        group,
        F.col("len"),
        F.lag("len").over(by_length).alias("below"),
        F.lead("len").over(by_length).alias("above"),
        "n",
    )
    near = around.withColumn(
        "closest",
        F.when(F.col("n") > 1, F.col("len"))
        .when(F.col("above").isNull(), F.col("below"))
        .when(F.col("below").isNull(), F.col("above"))
        .when(F.col("len") - F.col("below") <= F.col("above") - F.col("len"), F.col("below"))
        .otherwise(F.col("above")),
    ).select(group, "len", "closest")
    each = (
        precision.groupBy(group, "doc_id", "len")
        .agg(F.avg("lp").alias("mean_log"))
        .join(near, [group, "len"])
        .withColumn("bleu", F.exp(F.least(F.lit(0.0), 1 - F.col("closest") / F.nullif("len", F.lit(0)))) * F.exp("mean_log"))
    )
    return each.groupBy(group).agg(
        F.count("*").alias("samples"),
        F.when((F.count("*") >= 2) & (F.min("len") > 0), F.avg("bleu")).alias("self_bleu"),
    )


FLOORS = {"D1": (2, 25), "D2": (20, 50), "D4": (8, 25), "D6": (8, 25)}
"""Fixed values: samples below which a measure is withheld, and from which it is reliable."""


def sample_power(groups: DataFrame, samples: str) -> DataFrame:
    """For each group and measure whether it may be told, and with what power."""
    rows = [F.struct(F.lit(k).alias("metric"), F.lit(a).alias("floor"), F.lit(b).alias("enough")) for k, (a, b) in FLOORS.items()]
    listed = groups.withColumn("m", F.explode(F.array(*rows)))
    status = F.when(F.col(samples) < F.col("m.floor"), "insufficient_samples").otherwise("ok")
    power = F.when(F.col(samples) < F.col("m.floor"), None).when(F.col(samples) >= F.col("m.enough"), "ok").otherwise("low")
    return listed.select(*groups.columns, F.col("m.metric").alias("metric"), status.alias("status"), power.alias("power"))
