"""Queries over closed records, graphs, effects and profiles, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.operators import contracts as C
from loomwright.operators import graph as G
from loomwright.operators import nested
from loomwright.plans.measure_queries import _PAGES
from loomwright.plans.text_queries import _BLANK
from loomwright.plans.trajectory_queries import _ONE, _TEXTS
from loomwright.session import table

_REQUIRED = {"schema_version": "BIGINT", "benchmark": "STRING", "cases": "ARRAY"}



def body_fields(spark, sf_dir):
    """V6: long-form bodies that don't fit their closed record."""
    out = C.strict_fields(table(spark, sf_dir, "longform_v1"), "spec_id", "body", _REQUIRED, {"sampling": "OBJECT"})
    return out.groupBy("error", "field").agg(F.count("*").alias("bodies"))


def wiki_admission(spark, sf_dir):
    """V7: the link graph's broken rules; precedence is the length of the target's name."""
    pages = table(spark, sf_dir, "documents").where("kind = 'wiki' and text is not null")
    nodes, links = G.page_links(pages, "doc_id", "text")
    edges = links.withColumn("precedence", F.length("v"))
    out = C.graph_violations(nodes.select(F.col("page").alias("node")), edges, "no-such-page")
    return out.groupBy("rule").agg(F.count("*").alias("n"))


def applied_effects(spark, sf_dir):
    """Effects applied in order give the expected files."""
    probes = table(spark, sf_dir, "sft_mask_probes").select("id", "initial_files", "expected_files")
    made = probes.withColumn("effects", C.map_effects("initial_files", "expected_files"))
    done = made.withColumn("after", C.apply_effects(F.col("initial_files"), F.col("effects")))
    entries = lambda c: F.to_json(F.array_sort(F.map_entries(c)))
    told = done.select("id", F.size("effects").alias("effects"), (entries("after") == entries("expected_files")).alias("reached"))
    return told.distinct().groupBy("effects", "reached").agg(F.count("*").alias("records"))


def masked_alignment(spark, sf_dir):
    """Drift between neighbouring vectors where the first is positive."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id")
    drift = C.masked_drift(F.col("v"), F.col("w"), F.transform("v", lambda x: x > 0))
    return pairs.select("vec_id", drift.alias("d")).select("vec_id", "d.n", F.round("d.mean", 9).alias("mean"), F.round("d.high", 9).alias("high"))


def turn_layouts(spark, sf_dir):
    """Offsets of conversations whose turns repeat what came before."""
    from loomwright.operators.trajectory import token_spans

    spans = token_spans(table(spark, sf_dir, "sft_mask_probes", _TEXTS)).where("mask = 1 and end > start")
    ids = lambda lo, hi: F.when(hi > lo, F.sequence(lo, F.greatest(hi - 1, lo))).otherwise(F.array().cast("array<bigint>"))
    turns = spans.select("id", "pos", ids(F.lit(0).cast("bigint"), F.col("start")).alias("input_ids"), ids(F.col("start"), F.col("end")).alias("generated_ids"))
    return C.turn_layout(turns, "id", "pos")


def advantage_exact(spark, sf_dir):
    """Advantages with one rounding, by exact sums."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("bigint").alias("r"))
    out = C.exact_advantages(lines, "l_orderkey", "l_linenumber", "r")
    return out.select("group", "member", F.round("advantage", 9).alias("advantage"))


def score_line_parse(spark, sf_dir):
    """Scores read back from judgments written as lines."""
    rows = table(spark, sf_dir, "judgment_review").where("size(record.assessments) > 0").select("review_id", "record.assessments").distinct()
    lines = F.transform("assessments", lambda a: F.concat(a["metric"], F.lit(": "), a["value"].cast("string")))
    told = F.concat(F.lit("Words: many\nQ9: 7\n[Scores]\n"), F.array_join(lines, "\n"), F.lit("\n---\nQ8: 1"))
    return rows.select("review_id", F.explode(C.score_lines(told)).alias("metric", "score"))


def prose_profile(spark, sf_dir):
    """Measures of the held-out items of each language against the documents."""
    items = table(spark, sf_dir, "heldout_items").select("lang", F.col("item_id").alias("doc_id"), "text")
    out = C.prose_profile(items, table(spark, sf_dir, "documents").select("lang", "text").where("text is not null"), "lang")
    return out.withColumn("value", F.round("value", 7))


def folded_results(spark, sf_dir):
    """Tool results folded into the messages that called."""
    out = C.rendered_messages(table(spark, sf_dir, "sft_mask_probes", _TEXTS))
    return out.select("id", "segment", F.md5("content").alias("content"), F.size("results").alias("results"))


def kb_budget(spark, sf_dir):
    """Words in each record's knowledge files."""
    probes = table(spark, sf_dir, "sft_mask_probes")
    return probes.select("id", C.kb_words(F.col("expected_files")).alias("words")).distinct()


def compiled_cases(spark, sf_dir):
    """Cases of a body as nodes, each with the next case as its edge."""
    bodies = table(spark, sf_dir, "longform_v1")
    nodes = nested.shred(bodies, F.col("spec_id"), F.col("body"), keep=["id", "axis"])
    cases = nested.entities(nodes, ["id", "axis"]).where(F.col("path").rlike(r"^cases\[\d+\]$"))
    nxt = cases.select("record_id", (F.col("ordinal") - 1).alias("ordinal"), F.col("s_id").alias("target"))
    return cases.join(nxt, ["record_id", "ordinal"], "left").select(
        "record_id", F.col("s_id").alias("node"), F.col("s_axis").alias("kind"), F.coalesce("target", F.lit("terminate")).alias("target")
    )


QUERIES = {
    f.__name__: f
    for f in (
        body_fields, wiki_admission, applied_effects, masked_alignment, turn_layouts, advantage_exact, score_line_parse,
        prose_profile, folded_results, kb_budget, compiled_cases,
    )
}

_SPLIT_WORDS = f"len(list_filter(regexp_split_to_array(x, '{_BLANK}+'), lambda y: y <> ''))"
ORACLES = {
    "body_fields": """with b as (select distinct spec_id as k, body as b from longform_v1 where body is not null), g as (select k, b::json as j from b where json_valid(b)),
 f as (select k, unnest(json_keys(j)) as f, j from g),
 r(f, t) as (values ('schema_version', 'UBIGINT'), ('benchmark', 'VARCHAR'), ('cases', 'ARRAY'), ('sampling', 'OBJECT')),
 e as (select k, 'not_object' as error, '' as field from b where not json_valid(b)
 union all select g.k, 'missing', r.f from g join r on r.f <> 'sampling' where not list_contains(json_keys(g.j), r.f)
 union all select k, 'unknown', f from f where f not in (select f from r)
 union all select f.k, 'type', f.f from f join r on r.f = f.f where json_type(f.j, '$.' || f.f) <> r.t)
 select error, field, count(*) as bodies from e group by error, field""",
    "wiki_admission": f"""with {_PAGES}, l as (select distinct u, v, len(v) as p from links where v <> ''),
 r as (select distinct 'unknown_target' as rule, v as id from l where v not in (select page from pages)
 union all select distinct 'tie', u from (select u, p, count(*) as c from l group by u, p) where c > 1
 union all select 'dead_end', page from pages where page not in (select u from l) union all select 'no_entry', 'no-such-page')
 select rule, count(*) as n from r group by rule""",
    "applied_effects": f"""with {_ONE}, p as (select id, initial_files as b, expected_files as a, unnest(list_distinct(list_concat(map_keys(initial_files), map_keys(expected_files)))) as path from one),
 c as (select id, count(*) filter (where b[path] is distinct from a[path]) as n from p group by id)
 select cast(coalesce(n, 0) as integer) as effects, true as reached, count(*) as records from one left join c using (id) group by 1, 2""",
    "masked_alignment": """with e as (select vec_id, embedding::double[] as v from embeddings), p as (select a.vec_id, list_filter(list_zip(a.v, b.v), lambda z: z[1] > 0) as z from e a join e b on b.vec_id = a.vec_id + 1),
 g as (select vec_id, list_transform(z, lambda x: abs(x[1] - x[2])) as g from p where len(z) > 0)
 select vec_id, len(g)::integer as n, round(list_avg(g), 9) as mean, round(list_max(g), 9) as high from g""",
    "turn_layouts": None,
    "advantage_exact": """with s as (select l_orderkey as "group", l_linenumber as member, l_quantity::bigint as r, count(*) over w as k, sum(l_quantity::bigint) over w as s, sum(l_quantity::bigint * l_quantity::bigint) over w as q from lineitem window w as (partition by l_orderkey))
 select "group", member, case when k * q = s * s then 0.0 else round((k * r - s) / sqrt((k * q - s * s)::double), 9) end as advantage from s""",
    "score_line_parse": """with r as (select distinct review_id, record.assessments as a from judgment_review where len(record.assessments) > 0), e as (select review_id, i, a[i] as x from (select *, unnest(generate_series(1, len(a))) as i from r))
 select review_id, x.metric as metric, arg_max(x.value, i)::double as score from e group by review_id, x.metric""",
    "folded_results": f"""with {_ONE}, each as (select id, messages, unnest(generate_series(1, len(messages))) as i from one),
 s as (select id, messages[i] as m, sum(case when messages[i].role = 'tool' then 0 else 1 end) over (partition by id order by i) as segment from each)
 select id, segment::bigint as segment, md5(max(case when m.role <> 'tool' then m.content end)) as content, count(*) filter (where m.role = 'tool')::integer as results from s group by id, segment""",
    "kb_budget": f"""with {_ONE}, f as (select id, list_transform(list_filter(map_entries(expected_files), lambda e: starts_with(e.key, 'kb/')), lambda e: e.value) as v from one)
 select id, coalesce(list_sum(list_transform(v, lambda x: {_SPLIT_WORDS})), 0)::integer as words from f""",
    "compiled_cases": """with b as (select distinct spec_id, body::json as b from longform_v1 where json_valid(body)),
 c as (select spec_id as record_id, i, json_extract_string(b, '$.cases[' || i || '].id') as node, json_extract_string(b, '$.cases[' || i || '].axis') as kind
 from (select *, unnest(generate_series(0, json_array_length(b, '$.cases')::bigint - 1)) as i from b))
 select record_id, node, kind, coalesce(lead(node) over (partition by record_id order by i), 'terminate') as target from c""",
}
ORACLES = {k: v for k, v in ORACLES.items() if v}
