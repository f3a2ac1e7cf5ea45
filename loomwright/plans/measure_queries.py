"""Queries over embeddings, checks, reviews and links, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.operators import checks as C
from loomwright.operators import graph as G
from loomwright.operators import vectors as V
from loomwright.operators.components import connected_components
from loomwright.session import table

SIGMA = 1.0
# A small rubric for documents; fixed values.
CHECKS = [
    ("c1", "Q1", "contains", ["keep", "kept"], None, None, 2.0, True),
    ("c2", "Q1", "excludes", ["&amp;"], None, None, 1.0, False),
    ("c3", "Q2", "word_range", [], 40, 600, 1.0, True),
    ("c4", "Q2", "nonempty", [], None, None, 1.0, True),
    ("c5", "Q3", "excludes_all", ["policy", "guidelines"], None, None, 3.0, False),
    ("c6", "Q3", "alias_answer", ["none", "nothing"], None, None, 1.0, False),
]
_SCHEMA = "check_id string, metric string, kind string, wanted array<string>, low int, high int, weight double, required boolean"


def dispersion_by_label(spark, sf_dir):
    """Mean pairwise cosine distance of each label."""
    out = V.dispersion(table(spark, sf_dir, "embeddings"), "label")
    return out.select("label", "vectors", F.round("dispersion", 7).alias("dispersion"))


def mmd_by_label(spark, sf_dir):
    """Squared discrepancy of every two labels."""
    out = V.mmd_squared(table(spark, sf_dir, "embeddings"), "label", "embedding", SIGMA, "vec_id")
    return out.select("left", "right", F.round("mmd_squared", 7).alias("mmd_squared"))


def nearest_vectors(spark, sf_dir):
    """The five nearest rows of every row whose id is divisible by 20."""
    out = V.query_distances(table(spark, sf_dir, "embeddings"))
    return out.select("key", "place", "neighbour", F.round("distance", 6).alias("distance"))


def bandwidth_median(spark, sf_dir):
    """Median distance of all pairs of different vectors."""
    out = V.pair_median(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return out.select(F.round("distance", 6).alias("sigma"))


def _rubric(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    wanted = F.array(*[
        F.struct(
            *[F.lit(v).cast(t).alias(n) for (n, t), v in zip((f.split() for f in _SCHEMA.split(", ")), (i, m, k))],
            F.array(*[F.lit(x) for x in w]).cast("array<string>").alias("wanted"),
            F.lit(lo).cast("int").alias("low"),
            F.lit(hi).cast("int").alias("high"),
            F.lit(wt).alias("weight"),
            F.lit(rq).alias("required"),
        )
        for i, m, k, w, lo, hi, wt, rq in CHECKS
    ])
    told = C.prepared(docs).withColumn("c", F.explode(wanted))
    return C.evaluate(told.select("doc_id", "source", *C.PREPARED, "c.*")).drop(*C.PREPARED)


def checks_weighted(spark, sf_dir):
    """Weighted passed share for each source and metric."""
    out = C.roll_up(_rubric(spark, sf_dir), ["source"])
    return out.select("source", "metric", F.round("value", 9).alias("value"), "status", "pending")


def checks_verdict(spark, sf_dir):
    """A3, F16: documents that pass all required checks."""
    verdict = C.required_verdict(_rubric(spark, sf_dir), ["source", "doc_id"])
    return verdict.groupBy("source").agg(F.sum("verdict").alias("passed"), F.count("*").alias("documents"))


def judge_report(spark, sf_dir):
    """Mean judge score of each judge."""
    scores = C.judge_scores(table(spark, sf_dir, "judgment_review"), {"Q1": 2.0, "Q4": 0.5}, ["Q4"])
    return scores.groupBy("judge").agg(
        F.count("*").alias("reviews"), F.round(F.avg("score"), 9).alias("score"), F.sum("criteria").alias("criteria")
    )


def staccato_scores(spark, sf_dir):
    """Score of each document after the penalty for short lines."""
    docs = table(spark, sf_dir, "documents").where("n_chars > 0")
    lines = F.size(F.split("text", "\n"))
    index = lines * 100.0 / F.col("n_chars")
    return docs.where("text is not null").select("doc_id", F.round(10.0 * C.staccato_factor(index), 9).alias("score"))


def near_dup_pairs(spark, sf_dir):
    """Near-duplicate pairs of classes of documents by bottom-12 sketches; the
    documents of each class are the rows of ``near_dup_members``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = C.overlap_audit(docs, "doc_id")
    return out.select("left", "right", F.round("jaccard", 9).alias("jaccard"))


def near_dup_members(spark, sf_dir):
    """The class of every document, told by its smallest id; copies share a class."""
    out = C.overlap_members(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return out.select(F.col("key").alias("doc_id"), "class")


def _wiki(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").where("kind = 'wiki' and text is not null")
    return G.page_links(pages, "doc_id", "text")


def wiki_links(spark, sf_dir):
    """Links of each page and how many lead to a page."""
    pages, links = _wiki(spark, sf_dir)
    known = pages.select(F.col("page").alias("v")).withColumn("valid", F.lit(1))
    return links.join(known, "v", "left").groupBy(F.col("u").alias("page")).agg(
        F.count("*").alias("links"), F.count("valid").alias("valid")
    )


def wiki_reach(spark, sf_dir):
    """Pages reachable from the first page in name order, with their depth."""
    pages, links = _wiki(spark, sf_dir)
    inside = links.join(pages.select(F.col("page").alias("v")), "v", "left_semi")
    start = pages.agg(F.min("page").alias("node")).where("node is not null")
    return G.reachable(inside, start)


def wiki_orphans(spark, sf_dir):
    """Pages that no other page links to."""
    pages, links = _wiki(spark, sf_dir)
    return pages.join(links.where("u <> v").select(F.col("v").alias("page")), "page", "left_anti")


def wiki_cycles(spark, sf_dir):
    """Pages from which a cycle of links can be reached."""
    pages, links = _wiki(spark, sf_dir)
    return G.cyclic_residue(links.join(pages.select(F.col("page").alias("v")), "v", "left_semi"))


def wiki_components(spark, sf_dir):
    """Connected pages, told by the smallest name."""
    pages, links = _wiki(spark, sf_dir)
    names = pages.select("page", F.xxhash64("page").alias("node"))
    inside = links.join(pages.select(F.col("page").alias("v")), "v", "left_semi")
    edges = inside.select(F.xxhash64("u").alias("u"), F.xxhash64("v").alias("v")).distinct()
    placed = names.join(connected_components(edges), "node", "left").select(
        "page", F.coalesce("component", "node").alias("component")
    )
    roots = placed.groupBy("component").agg(F.min("page").alias("root"))
    return placed.join(roots, "component").select("page", "root")


def path_conflicts(spark, sf_dir):
    """Files whose path is a folder of another file."""
    files = table(spark, sf_dir, "sft_mask_probes").select("id", F.explode(F.map_keys("expected_files")).alias("path"))
    extra = files.select("id", F.concat("path", F.lit("/notes.md")).alias("path"))
    return G.path_conflicts(files.unionByName(extra), "id", "path")


QUERIES = {
    f.__name__: f
    for f in (
        dispersion_by_label, mmd_by_label, nearest_vectors, bandwidth_median, checks_weighted, checks_verdict,
        judge_report, staccato_scores, near_dup_pairs, near_dup_members, wiki_links, wiki_reach, wiki_orphans, wiki_cycles,
        wiki_components, path_conflicts,
    )
}

_FOLD = "replace(lower({}), 'ß', 'ss')"
_WORDS = r"len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\s\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda y: y <> ''))"
_B = "coalesce(text, '')"
_ALIAS = r"regexp_replace(trim(regexp_replace(replace(lower({}), 'ß', 'ss'), '\s+', ' ', 'g')), '^[.!?]+|[.!?]+$', '', 'g')"
_CHECKED = rf"""d as (select doc_id, source, text, {_FOLD.format(_B)} as f, {_WORDS} as n from documents),
 k as (select doc_id, source, 'Q1' as metric, true as required, 2.0 as weight, 'ok' as status, contains(f, 'keep') or contains(f, 'kept') as passed from d
 union all select doc_id, source, 'Q1', false, 1.0, case when text is null then 'unscored' else 'ok' end, text is not null and not contains(f, '&amp;') from d
 union all select doc_id, source, 'Q2', true, 1.0, 'ok', n between 40 and 600 from d
 union all select doc_id, source, 'Q2', true, 1.0, 'ok', regexp_replace({_B}, '[\s\x{{85}}\x{{a0}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', '', 'g') <> '' from d
 union all select doc_id, source, 'Q3', false, 3.0, case when text is null then 'unscored' else 'ok' end, text is not null and not (contains(f, 'policy') or contains(f, 'guidelines')) from d
 union all select doc_id, source, 'Q3', false, 1.0, 'ok', {_ALIAS.format(_B)} in ('none', 'nothing') from d)"""
_PAGES = r"""p as (select lower(regexp_extract(regexp_extract(text, '(?m)^\s*#{1,6}[ \x{a0}]+([^\n\r]+)', 1), '([\p{L}\p{N}-]+)[^\p{L}\p{N}]*$', 1)) as page,
 regexp_extract_all(text, '\[\[([^\[\]]+)\]\]', 1) as l from documents where kind = 'wiki' and text is not null),
 pages as (select distinct page from p where page <> ''),
 links as (select distinct page as u, lower(regexp_extract(t, '([\p{L}\p{N}-]+)[^\p{L}\p{N}]*$', 1)) as v from (select page, unnest(l) as t from p where page <> '')),
 inside as (select u, v from links where v in (select page from pages))"""
_DIST = "sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: pow(z[1] - z[2], 2))))"
_NEAR = f"""e as (select vec_id, embedding::double[] as v from embeddings), d as (select a.vec_id as key, b.vec_id as neighbour, {_DIST} as distance
 from e a join e b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id), r as (select *, row_number() over (partition by key order by distance, neighbour) - 1 as place from d)"""

ORACLES = {
    "dispersion_by_label": """with e as (select vec_id, label, embedding::double[] as v from embeddings)
 select a.label, (select count(*) from e where e.label = a.label) as vectors, round(avg(1 - list_cosine_similarity(a.v, b.v)), 7) as dispersion from e a join e b on a.label = b.label and a.vec_id < b.vec_id group by a.label""",
    "mmd_by_label": f"""with e as (select vec_id, label::varchar as s, embedding::double[] as v from embeddings),
 k as (select a.s as l, b.s as r, exp(-list_sum(list_transform(list_zip(a.v, b.v), lambda z: pow(z[1] - z[2], 2))) / {2 * SIGMA**2}) as k from e a join e b on a.s < b.s or (a.s = b.s and a.vec_id < b.vec_id)),
 m as (select l, r, avg(k) as k from k group by l, r)
 select m.l as "left", m.r as "right", round(x.k + y.k - 2 * m.k, 7) as mmd_squared from m left join m x on x.l = m.l and x.r = m.l left join m y on y.l = m.r and y.r = m.r where m.l <> m.r""",
    "nearest_vectors": f"with {_NEAR} select key, cast(place as integer) as place, neighbour, round(distance, 6) as distance from r where place < 5",
    "bandwidth_median": f"""with e as (select vec_id, embedding::double[] as v from embeddings), d as (select {_DIST} as distance from e a join e b on a.vec_id < b.vec_id)
 select round(median(distance), 6) as sigma from d where distance > 0""",
    "checks_weighted": f"""with {_CHECKED} select source, metric, round(sum(case when status = 'ok' and passed then weight else 0 end) / sum(case when status = 'ok' then weight end), 9) as value,
 case when bool_and(status = 'ok') then 'ok' else 'pending' end as status, count(*) filter (where status <> 'ok') as pending from k group by source, metric""",
    "checks_verdict": f"""with {_CHECKED}, v as (select source, doc_id, case when bool_or(required and not passed) then 0 when bool_or(required and status <> 'ok') then null else 1 end as verdict from k group by source, doc_id)
 select source, sum(verdict)::bigint as passed, count(*) as documents from v group by source""",
    "judge_report": """with o as (select distinct on (review_id) review_id, record from judgment_review where record.status = 'ok'),
 a as (select review_id, record.judge as judge, i, record.assessments[i] as a from (select *, unnest(generate_series(1, len(record.assessments))) as i from o)),
 l as (select review_id, judge, lower(trim(a.metric)) as metric, arg_max(a.value, i)::double as value from a group by all),
 x as (select review_id, judge, case metric when 'q1' then 2.0 when 'q4' then 0.5 else 1.0 end as w, case when metric = 'q4' then 5 - greatest(0, least(value, 5)) else greatest(0, least(value, 5)) end as x from l where value is not null),
 s as (select review_id, judge, sum(x * w) / sum(w) as score, count(*) as c from x group by all)
 select judge, count(*) as reviews, round(avg(score), 9) as score, sum(c)::bigint as criteria from s group by judge""",
    "staccato_scores": """with i as (select doc_id, len(string_split(text, chr(10))) * 100.0 / n_chars as i from documents where n_chars > 0 and text is not null)
 select doc_id, round(10.0 * case when i < 5 then 1.0 when i > 18 then 0.6 else 1 - (i - 5) / 13.0 * 0.4 end, 9) as score from i""",
    "near_dup_pairs": r"""with w as (select doc_id as key, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}_]+') as w from documents),
 g as (select key, list_sort(list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: substr(sha256(array_to_string(w[i:i + 4], ' ')), 1, 16)))) as s from w where len(w) >= 5),
 c as (select min(key) as key, s from g group by s), x as (select key, unnest(s[1:12]) as h from c),
 p as (select distinct a.key as l, b.key as r from x a join x b on a.h = b.h and a.key < b.key),
 j as (select l, r, len(list_intersect(a.s, b.s)) as n, len(a.s) as x, len(b.s) as y from p join c a on a.key = l join c b on b.key = r)
 select l as "left", r as "right", round(n::double / (x + y - n), 9) as jaccard from j where n::double / (x + y - n) >= 0.85""",
    "near_dup_members": r"""with w as (select doc_id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}_]+') as w from documents),
 g as (select doc_id, list_sort(list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: substr(sha256(array_to_string(w[i:i + 4], ' ')), 1, 16)))) as s from w where len(w) >= 5),
 m as (select doc_id, sha256(array_to_string(s, '')) as s from g), c as (select s, min(doc_id) as class from m group by s)
 select distinct doc_id, class from m join c using (s)""",
    "wiki_links": f"with {_PAGES} select u as page, count(*) as links, count(*) filter (where v in (select page from pages)) as valid from links where v <> '' group by u",
    "wiki_reach": f"""with recursive {_PAGES}, r(node, depth) as (select min(page), 0 from pages union select v, depth + 1 from r join inside on u = node where depth < 40) select node, min(depth) as depth from r group by node""",
    "wiki_orphans": f"with {_PAGES} select page from pages where page not in (select v from links where u <> v)",
    "wiki_cycles": f"""with recursive {_PAGES}, t(u, v) as (select u, v from inside union select t.u, i.v from t join inside i on i.u = t.v) select distinct u as node from t where v in (select u from t where u = v)""",
    "wiki_components": f"""with recursive {_PAGES}, s as (select u, v from inside union select v, u from inside), r(page, root) as (select page, page from pages union select s.v, r.root from r join s on s.u = r.page)
 select page, min(root) as root from r group by page""",
    "path_conflicts": """with f as (select distinct id, unnest(map_keys(expected_files)) as path from sft_mask_probes), a as (select id, path from f union select id, path || '/notes.md' from f)
 select x.id as tree, x.path as parent, y.path as child from a x join a y on x.id = y.id and starts_with(y.path, x.path || '/')""",
}
