"""Closed records, graph admission, state effects, masked alignment, exact advantages."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal, localcontext

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions import text as T


def strict_fields(df: DataFrame, key: str, raw: str, required: dict[str, str], optional: dict[str, str]) -> DataFrame:
    """``(key, error, field)`` for JSON objects that don't fit a closed set of typed fields.

    Errors: ``not_object`` (also broken JSON and repeated keys), ``missing``, ``unknown``
    and ``type``. Types are those of a variant's schema: STRING, BIGINT, ARRAY, OBJECT, ...
    A JSON null fits no type. Null documents are left out.
    """
    rows = df.where(F.col(raw).isNotNull()).select(F.col(key).alias("key"), F.col(raw).alias("raw")).distinct()
    parsed = rows.withColumn("kind", F.expr("schema_of_variant(try_parse_json(raw))"))
    sound = F.coalesce(F.col("kind").startswith("OBJECT"), F.lit(False))
    names = F.expr("json_object_keys(raw)")
    known = {**required, **optional}
    listed = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    error = lambda kind, field: F.struct(F.lit(kind).alias("error"), field.alias("field"))
    wrong = F.array_compact(
        F.array(*[
            F.when(
                F.array_contains("names", f)
                & ~F.coalesce(F.expr(f"schema_of_variant(try_variant_get(try_parse_json(raw), '$.{f}', 'variant'))").startswith(t), F.lit(False)),
                error("type", F.lit(f)),
            )
            for f, t in known.items()
        ])
    )
    errors = F.concat(
        F.transform(F.array_except(listed(required), F.col("names")), lambda f: error("missing", f)),
        F.transform(F.array_except(F.col("names"), listed(known)), lambda f: error("unknown", f)),
        wrong,
    )
    good = parsed.where(sound).withColumn("names", names).select("key", F.explode(errors).alias("e")).select("key", "e.error", "e.field")
    bad = parsed.where(~sound).select("key", F.lit("not_object").alias("error"), F.lit("").alias("field"))
    return good.unionByName(bad)


def graph_violations(nodes: DataFrame, edges: DataFrame, entry: str) -> DataFrame:
    """``(rule, id)`` of a graph with nodes ``(node)`` and edges ``(u, v, precedence)``.

    ``unknown_source`` and ``unknown_target`` tell edges that lead from or to no node,
    ``tie`` nodes with two edges of one precedence, ``dead_end`` nodes without an edge out,
    ``no_entry`` a graph without its entry.
    """
    n, e = nodes.select("node").distinct(), edges.select("u", "v", "precedence").distinct()
    rule = lambda df, name, col: df.select(F.lit(name).alias("rule"), F.col(col).alias("id")).distinct()
    sources = e.join(n.select(F.col("node").alias("u")), "u", "left_anti")
    targets = e.join(n.select(F.col("node").alias("v")), "v", "left_anti")
    ties = e.groupBy("u", F.coalesce("precedence", F.lit(0)).alias("p")).agg(F.count("*").alias("c")).where("c > 1")
    ends = n.join(e.select(F.col("u").alias("node")).distinct(), "node", "left_anti")
    lost = n.agg(F.count_if(F.col("node") == entry).alias("c")).where("c = 0").select(F.lit(entry).alias("node"))
    out = rule(sources, "unknown_source", "u").unionByName(rule(targets, "unknown_target", "v"))
    out = out.unionByName(rule(ties, "tie", "u")).unionByName(rule(ends, "dead_end", "node"))
    return out.unionByName(rule(lost, "no_entry", "node"))


def apply_effects(files: Column, effects: Column) -> Column:
    """Fold ordered effects ``struct<path, before, after>`` into a file map.

    An effect whose ``before`` isn't what the map holds (null: no such file) makes the whole
    result null; a null ``after`` removes the file.
    """

    def step(held: Column, e: Column) -> Column:
        rest = F.map_filter(held, lambda k, _: k != e["path"])
        put = F.when(e["after"].isNull(), rest).otherwise(F.map_concat(rest, F.create_map(e["path"], e["after"])))
        return F.when(F.try_element_at(held, e["path"]).eqNullSafe(e["before"]), put)

    return F.aggregate(effects, files, step)


def map_effects(before: str, after: str) -> Column:
    """The effects, by path, that turn one file map into another."""
    paths = F.array_sort(F.array_union(F.map_keys(before), F.map_keys(after)))
    whole = F.transform(
        paths,
        lambda p: F.struct(p.alias("path"), F.try_element_at(F.col(before), p).alias("before"), F.try_element_at(F.col(after), p).alias("after")),
    )
    return F.filter(whole, lambda e: ~e["before"].eqNullSafe(e["after"]))


def masked_drift(sampled: Column, recomputed: Column, mask: Column) -> Column:
    """``struct<n, mean, high>`` of the absolute differences where the mask is true.

    Null when the arrays differ in length or nothing is masked.
    """
    kept = F.filter(F.arrays_zip(sampled.alias("a"), recomputed.alias("b"), mask.alias("m")), lambda z: z["m"])
    gaps = F.transform(kept, lambda z: F.abs(z["a"] - z["b"]))
    fits = (F.size(sampled) == F.size(recomputed)) & (F.size(sampled) == F.size(mask)) & (F.size(gaps) > 0)
    mean = F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(gaps), F.lit(0))
    return F.when(fits, F.struct(F.size(gaps).alias("n"), mean.alias("mean"), F.array_max(gaps).alias("high")))


def turn_layout(turns: DataFrame, key: str, order: str) -> DataFrame:
    """``(key, order, suffix, start, end, broken)`` of turns ``input_ids, generated_ids``.

    A turn's input must begin with the input and output of the turn before; what it adds is
    its suffix. ``start`` and ``end`` are the offsets of its output in the whole sequence.
    """
    by = Window.partitionBy(key).orderBy(order)
    before = F.concat(F.coalesce(F.lag("input_ids").over(by), F.array().cast("array<bigint>")), F.coalesce(F.lag("generated_ids").over(by), F.array().cast("array<bigint>")))
    rows = turns.withColumn("prefix", before)
    size = F.size("prefix")
    broken = (F.size("input_ids") < size) | (F.slice("input_ids", F.lit(1), size) != F.col("prefix"))
    start = F.size("input_ids")
    return rows.select(
        key, order, F.greatest(F.size("input_ids") - size, F.lit(0)).alias("suffix"), start.alias("start"),
        (start + F.size("generated_ids")).alias("end"), broken.alias("broken"),
    )


def exact_advantages(df: DataFrame, group: str, member: str, reward: str) -> DataFrame:
    """``(group, member, advantage)``: centred reward over the population deviation.

    Rewards are whole numbers; sums are exact, the root is taken to 60 digits and rounded
    once. A group without spread has advantage 0, told by an exact test.
    """
    sums = df.groupBy(group).agg(
        F.count("*").alias("k"),
        F.sum(F.col(reward).cast("decimal(38,0)")).alias("s"),
        F.sum((F.col(reward).cast("decimal(18,0)") * F.col(reward).cast("decimal(18,0)")).cast("decimal(38,0)")).alias("q"),
    )
    rows = df.join(sums, group).select(
        F.col(group).alias("group"), F.col(member).alias("member"), F.col(reward).cast("bigint").alias("r"), "k", F.col("s").cast("string"), F.col("q").cast("string")
    )

    def one(r: int, k: int, s: str, q: str) -> float:
        spread = k * int(q) - int(s) ** 2
        if spread == 0:
            return 0.0
        with localcontext() as context:
            context.prec = 60
            return float(Decimal(k * r - int(s)) / Decimal(spread).sqrt())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [one(*v) for v in zip(*(batch.column(c).to_pylist() for c in ("r", "k", "s", "q")))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.float64())], names=["group", "member", "advantage"])

    kinds = [df.schema[c].dataType.simpleString() for c in (group, member)]
    return rows.mapInArrow(run, f"group {kinds[0]}, member {kinds[1]}, advantage double")


def score_lines(text: Column) -> Column:
    """``Metric: score`` lines of a judgment as a map; the last value of a metric wins.

    With a ``[Scores]`` section only its lines count, up to a line of dashes.
    """
    section = F.regexp_extract(text, r"(?s)\[Scores\](.*?)(?:\n---|\n\[End Scores\]|$)", 1)
    body = F.when(F.contains(text, F.lit("[Scores]")), section).otherwise(text)
    pattern = r"^\s*([\p{L}][\p{L}\p{N} _-]*?)\s*:\s*(-?\d+(?:\.\d+)?)\s*$"
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(pattern))
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, pattern, 1).alias("k"), F.regexp_extract(x, pattern, 2).cast("double").alias("v")))
    return F.aggregate(
        pairs,
        F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")),
        lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["k"]), F.create_map(p["k"], p["v"])),
    )


def prose_profile(samples: DataFrame, reference: DataFrame, group: str) -> DataFrame:
    """``(group, metric, value, samples, status, power)`` of the groups of samples.

    D1: distance of the pooled unigrams to the reference's; D4: self-BLEU; D5: pooled
    distinct-2. A measure below its floor is withheld; one without a value is
    ``unavailable``; D3, D12 and D13 are told as not implemented.
    """
    from loomwright.operators import lexical

    own = samples.select(F.col(group).alias("g"), "doc_id", "text").where("g is not null")
    sized = own.groupBy("g").agg(F.count("*").cast("int").alias("samples"))
    both = own.select(F.concat(F.lit("s/"), "g").alias("side"), "text").unionByName(
        reference.where(F.col(group).isNotNull()).select(F.concat(F.lit("r/"), group).alias("side"), "text")
    )
    l2 = lexical.pooled_l2(both, "side", 1).where("substr(left, 3) = substr(right, 3)")
    d1 = l2.select(F.expr("substr(left, 3)").alias("g"), F.lit("D1").alias("metric"), F.col("l2").alias("value"))
    d4 = lexical.self_bleu(own, "g").select("g", F.lit("D4").alias("metric"), F.col("self_bleu").alias("value"))
    d5 = lexical.macro_and_pooled(own, "g", 2).select("g", F.lit("D5").alias("metric"), F.col("pooled").alias("value"))
    values = d1.unionByName(d4).unionByName(d5)
    names = F.array(*[F.lit(m) for m in ("D1", "D3", "D4", "D5", "D12", "D13")])
    told = sized.withColumn("metric", F.explode(names)).join(values, ["g", "metric"], "left")
    floor, enough = F.lit(0), F.lit(0)
    for metric, (low, high) in lexical.FLOORS.items():
        floor = F.when(F.col("metric") == metric, low).otherwise(floor)
        enough = F.when(F.col("metric") == metric, high).otherwise(enough)
    status = (
        F.when(F.col("metric").isin("D3", "D12", "D13"), "not_implemented")
        .when(F.col("samples") < floor, "insufficient_samples")
        .when(F.col("value").isNull(), "unavailable")
        .otherwise("ok")
    )
    told = told.withColumn("status", status)
    ok = F.col("status") == "ok"
    return told.select(
        F.col("g").alias(group), "metric", F.when(ok, F.col("value")).alias("value"), "samples", "status",
        F.when(ok, F.when(F.col("samples") >= enough, "ok").otherwise("low")).alias("power"),
    )


def rendered_messages(records: DataFrame) -> DataFrame:
    """``(id, segment, content, results)``: tool results folded into the message that called.

    Results stand in their order; a result without a call before it has segment 0.
    """
    rows = records.select("id", F.posexplode("messages").alias("pos", "m"))
    small = rows.select("id", "pos", F.col("m.role").alias("role"), F.col("m.content").alias("content")).dropDuplicates(["id", "pos"])
    by = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    segment = F.sum(F.when(F.col("role") == "tool", 0).otherwise(1)).over(by)
    numbered = small.withColumn("segment", segment)
    results = F.array_sort(F.collect_list(F.when(F.col("role") == "tool", F.struct("pos", F.coalesce("content", F.lit("")).alias("c")))))
    return numbered.groupBy("id", "segment").agg(
        F.max(F.when(F.col("role") != "tool", F.col("content"))).alias("content"), F.transform(results, lambda r: r["c"]).alias("results")
    )


def kb_words(files: Column, prefix: str = "kb/") -> Column:
    """Words in the files of a map below a folder."""
    inside = F.map_values(F.map_filter(files, lambda k, _: k.startswith(prefix)))
    return F.aggregate(inside, F.lit(0), lambda s, t: s + F.size(T.spaced(t)))
