"""Record operators: sections, delimited prose, blinding, evidence, ROUGE, manifests, graphs of cases."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions import text as T


def sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, ordinal, title, slug, characters)``: a text cut at its headings, headings kept.

    The n-th repetition of a slug gets ``-n``. What stands before the first heading is
    section 0 with an empty title.
    """
    marked = F.regexp_replace(F.col(text), r"(?m)^(#{1,6}[ \u00a0]+\S)", "\x01$1")
    cut = df.select(F.col(key).alias("key"), F.posexplode(F.split(marked, "\x01")).alias("ordinal", "body"))
    named = cut.where("ordinal > 0 or body <> ''").withColumn(
        "title", T.strip(F.regexp_extract("body", r"^#{1,6}[ \u00a0]+([^\n\r]*)", 1))
    )
    slugged = named.withColumn("base", T.slug(F.col("title")))
    again = F.row_number().over(Window.partitionBy("key", "base").orderBy("ordinal")) - 1
    slug = F.when(again == 0, F.col("base")).otherwise(F.concat("base", F.lit("-"), again.cast("string")))
    return slugged.select("key", "ordinal", "title", slug.alias("slug"), F.length("body").alias("characters"))


def occurrences(text: Column, part: Column) -> Column:
    """How often a nonempty part stands in a text, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")


def delimited(df: DataFrame, text: str, begin: Column, end: Column) -> DataFrame:
    """Adds ``status`` and ``selected``: the text between two delimiters that occur once each.

    ``missing_prose`` without text or delimiters, ``needs_review`` when one is repeated or
    out of order, else ``ok``.
    """
    body = F.col(text)
    first, last = F.instr(body, begin), F.instr(body, end)
    once = (occurrences(body, begin) == 1) & (occurrences(body, end) == 1)
    status = (
        F.when(body.isNull() | (first == 0) | (last == 0), "missing_prose")
        .when(~once | (last < first + F.length(begin)), "needs_review")
        .otherwise("ok")
    )
    inside = F.substring(body, first + F.length(begin), last - first - F.length(begin))
    return df.withColumn("status", status).withColumn("selected", F.when(F.col("status") == "ok", T.strip(inside)))


def blinded(reviews: DataFrame) -> DataFrame:
    """What a grader may see: brief, output and pending rubrics; no source, no record."""
    return reviews.select(
        "review_id",
        F.col("packet.brief").alias("brief"),
        F.col("packet.output").alias("output"),
        F.map_keys(F.map_filter("packet.rubrics", lambda k, _: ~F.coalesce(F.exists("record.assessments", lambda a: a["metric"] == k), F.lit(False)))).alias("open"),
    )


def evidence_found(df: DataFrame, quote: Column, source: Column) -> Column:
    """Whether a quote stands in its source, blanks aside."""
    flat = lambda c: F.regexp_replace(T.strip(c), r"(?U)\s+", " ")
    return F.contains(flat(source), flat(quote))


def _lcs(a: list[str], b: list[str]) -> int:
    masks: dict[str, int] = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & masks.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def rouge(df: DataFrame, key: str, reference: str, candidate: str) -> DataFrame:
    """``(key, rouge1, rouge2, rougeL)``: F-measures of shared n-grams and of the longest
    common subsequence; null when a side has none."""
    words = df.select(
        F.col(key).alias("key"), T.tokens(F.col(reference), T.PLAIN_TOKEN).alias("r"), T.tokens(F.col(candidate), T.PLAIN_TOKEN).alias("c")
    ).where("r is not null and c is not null")
    kind = df.schema[key].dataType.simpleString()

    def bag(x: list[str], y: list[str], n: int) -> float | None:
        a = list(zip(*[x[i:] for i in range(n)]))
        b = list(zip(*[y[i:] for i in range(n)]))
        if not a or not b:
            return None
        left: dict = {}
        for g in a:
            left[g] = left.get(g, 0) + 1
        shared = 0
        for g in b:
            if left.get(g, 0):
                left[g] -= 1
                shared += 1
        return 2 * shared / (len(a) + len(b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rs, cs = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            long = [2 * _lcs(r, c) / (len(r) + len(c)) if r and c else None for r, c in zip(rs, cs)]
            cols = [[bag(r, c, n) for r, c in zip(rs, cs)] for n in (1, 2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(x, pa.float64()) for x in (*cols, long)]], names=["key", "rouge1", "rouge2", "rougeL"]
            )

    return words.mapInArrow(run, f"key {kind}, rouge1 double, rouge2 double, rougeL double")


def manifest(df: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """``(group, members, digest)``: one hash over the hashes of a group's members.

    Members are dealt into blocks by the first four digits of their key's hash; a block's
    hash is over its members in order, the digest over the hashes of the blocks in order,
    so that no task gathers a whole group, only its at most 65,536 block hashes.
    """
    each = df.select(
        F.col(group).alias("group"), F.substring(F.sha2(F.col(key), 256), 1, 4).alias("block"), F.col(key).alias("key"), F.sha2(F.col(value), 256).alias("h")
    ).distinct()
    lines = F.transform(F.array_sort(F.collect_list(F.struct("key", "h"))), lambda x: F.concat(x["key"], F.lit(":"), x["h"]))
    blocks = each.where("h is not null").groupBy("group", "block").agg(
        F.count("*").alias("n"), F.sha2(F.array_join(lines, "\n"), 256).alias("b")
    )
    told = F.transform(F.array_sort(F.collect_list(F.struct("block", "b"))), lambda x: x["b"])
    return blocks.groupBy("group").agg(F.sum("n").alias("members"), F.sha2(F.array_join(told, "\n"), 256).alias("digest"))


def unresolved(df: DataFrame, reference: str, targets: DataFrame, target: str) -> DataFrame:
    """References that no target answers, with the number of rows that hold them."""
    known = targets.select(F.col(target).alias("reference")).distinct()
    held = df.select(F.col(reference).alias("reference")).where("reference is not null")
    return held.join(known, "reference", "left_anti").groupBy("reference").agg(F.count("*").alias("rows"))


def select_edge(edges: DataFrame, group: str, precedence: str, edge: str) -> DataFrame:
    """The edge of least precedence of each group; null and ``tie`` when it isn't the only one."""
    low = edges.groupBy(group).agg(F.min(F.coalesce(precedence, F.lit(0))).alias("least"))
    held = edges.join(low, group).where(F.coalesce(precedence, F.lit(0)) == F.col("least"))
    return held.groupBy(group).agg(
        F.when(F.count("*") == 1, F.min(edge)).alias("edge"), F.when(F.count("*") > 1, "tie").otherwise("ok").alias("status")
    )
