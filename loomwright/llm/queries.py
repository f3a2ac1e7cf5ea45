"""All queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm import abuse, cuts, leaks, neardup, overlap, packing, pairs, similar, splits
from loomwright.session import table


# The fields of a conversation that an operator reads; the rest stays in the files.
_TEXTS = "id string, split string, provenance struct<source:string>, messages array<struct<role:string,content:string>>"
_TURNS = (
    "id string, provenance struct<source:string>, "
    "messages array<struct<role:string,content:string,tool_calls:array<struct<id:string>>>>"
)


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.texts_of(
        [
            (table(spark, sf_dir, "starter_design"), "id", ["prose", "source"]),
            (table(spark, sf_dir, "worlds"), "id", ["source"]),
        ]
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records that carry lightly reworked forms of one passage."""
    return neardup.near_duplicate_pairs(_passages(spark, sf_dir), 0.7)


def p1_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every record with a text: records of one class hold the same bag of words."""
    return neardup.near_duplicates(_passages(spark, sf_dir), 0.7)[1].select(
        F.col("rid").alias("record_id"), F.col("cid").alias("class_id")
    )


def p1_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes; with ``p1_members`` every pair of ``p1_found`` in linear space."""
    links = neardup.near_duplicates(_passages(spark, sf_dir), 0.7)[0]
    return links.select(F.col("a").alias("class_a"), F.col("b").alias("class_b"), "similarity")


def _sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.sided_texts(
        table(spark, sf_dir, "starter_design"),
        table(spark, sf_dir, "pilot_matched_v1"),
        table(spark, sf_dir, "sft_mask_probes", _TEXTS),
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation records that also stand, exactly or almost, in training records."""
    return overlap.overlap_pairs(_sided(spark, sf_dir), 0.7)


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping evaluation records per table, split and source."""
    return overlap.overlap_report(_sided(spark, sf_dir), 0.7)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages and outputs that were cut while being stored or sent."""
    return cuts.cut_texts(table(spark, sf_dir, "sft_mask_probes", _TEXTS), table(spark, sf_dir, "judgment_review"))


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of cut texts per exporter."""
    return cuts.cut_rates(table(spark, sf_dir, "sft_mask_probes", _TEXTS), table(spark, sf_dir, "judgment_review"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies that are no usable answer, with their defect."""
    return pairs.defective_pairs(table(spark, sf_dir, "sft_mask_probes", _TURNS), table(spark, sf_dir, "judgment_review"))


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective pairs per defect."""
    return pairs.defect_rates(table(spark, sf_dir, "sft_mask_probes", _TURNS), table(spark, sf_dir, "judgment_review"))


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.keyed_records(table(spark, sf_dir, "starter_design"), table(spark, sf_dir, "sft_mask_probes"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the groups that their recorded splits part."""
    return splits.parted_records(_keyed(spark, sf_dir))


def p2_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train, validation and test at 80, 10 and 10 percent; no group is parted."""
    return splits.assign_splits(_keyed(spark, sf_dir))


def p2_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the assigned splits."""
    return splits.split_report(p2_assignment(spark, sf_dir))


def p2_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of the assignment: none of its groups is parted and the shares are met."""
    return splits.split_faults(_keyed(spark, sf_dir))


def p7_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of the placement: none."""
    return packing.check_placement(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_capacities"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold passages of held-out items."""
    return leaks.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout_items"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked items with the number of documents and sources."""
    return leaks.leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout_items"))


def p7_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document placed in windows of each size."""
    return packing.packed_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_capacities"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows and their fill for each size."""
    return packing.packing_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_capacities"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with abusive, hateful or sexual language."""
    return abuse.abusive_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels"))


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document."""
    return abuse.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels"))


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of such documents per source."""
    return abuse.abuse_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels"))


QUERIES = {"p9_found": p9_found, "p9_scores": p9_scores, "p9_rates": p9_rates, "p7_placement": p7_placement, "p7_report": p7_report, "p8_found": p8_found, "p8_report": p8_report, "p1_found": p1_found, "p1_members": p1_members, "p1_links": p1_links, "p2_found": p2_found, "p2_assignment": p2_assignment, "p2_shares": p2_shares, "p2_check": p2_check, "p7_check": p7_check, "p3_found": p3_found, "p3_rates": p3_rates, "p5_found": p5_found, "p5_rates": p5_rates, "p6_found": p6_found, "p6_report": p6_report}
_P2 = """
with recursive cleaned as (
  select id as record_id, regexp_replace(lower(trim(k, E' \\t\\n\\r')), '[\\s_-]+', '-', 'g') as k,
         case lower(trim(split)) when 'training' then 'train' when 'valid' then 'validation' when 'dev' then 'validation'
              else nullif(lower(trim(split)), '') end as split
  from (select id, split, author_id as k from starter_design
        union all select id, split, 'archive-' || book from starter_design where book is not null
        union all select id, split, provenance.author_id from sft_mask_probes
        union all select id, split, unnest(source_groups) from sft_mask_probes)),
rk as (select distinct record_id, split, k from cleaned where k is not null and k not in ('', 'unknown', 'anonymous', 'n/a')),
e as (select distinct a.k as u, b.k as v from rk a join (select record_id, min(k) as k from rk group by record_id) b
      on a.record_id = b.record_id),
sym as (select u, v from e union select v, u from e),
reach(node, low) as (select distinct k, k from rk
  union select s.v, r.low from reach r join sym s on s.u = r.node where r.low < s.v),
label as (select node, min(low) as group_key from reach group by node),
placed as (select distinct r.record_id, r.split, l.group_key from rk r join label l on l.node = r.k),
parted as (select group_key from placed group by group_key having min(split) <> max(split))
"""

# Every two texts that share a word, by the definition of the similarity.
_SIMILAR = """
w as (select rid, tid, w, count(*) as n from (select rid, tid, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as w from t) group by all),
z as (select tid, any_value(rid) as rid, sum(n) as size from w group by tid),
c as (select a.tid as x, b.tid as y, sum(least(a.n, b.n)) as common from w a join w b on a.w = b.w and PAIR group by all),
s as (select c.x, c.y from c join z a on a.tid = c.x join z b on b.tid = c.y where c.common / (a.size + b.size - c.common) >= 0.7 - 1e-12)
"""
_P1 = (
    """with u as (select distinct id as rid, prose as text from starter_design where prose is not null
 union select id, source from starter_design where source is not null union select id, source from worlds where source is not null),
t as (select rid, text, row_number() over () as tid from u),"""
    + _SIMILAR.replace("PAIR", "a.tid < b.tid and a.rid <> b.rid")
    + "select distinct least(a.rid, b.rid) as id_a, greatest(a.rid, b.rid) as id_b from s join t a on a.tid = s.x join t b on b.tid = s.y where a.rid <> b.rid"
)
_SIDE = """case when lower(trim({0})) in ('train', 'training') then 't' when lower(trim({0})) in ({1}) then 'e' end"""
_SPLIT = _SIDE.format("split", "'validation', 'valid', 'dev', 'test'")
_P6 = (
    f"""with u as (select distinct id as rid, {_SPLIT} as side, prose as text from starter_design union select id, {_SPLIT}, source from starter_design
 union select id, {_SIDE.format("role", "'development', 'dev', 'final_eval', 'final-eval'")}, text from pilot_matched_v1
 union select id, {_SPLIT}, array_to_string(list_transform(list_filter(messages, lambda m: m.role in ('user', 'assistant') and m.content is not null), lambda m: m.content), ' ') from sft_mask_probes),
t as (select rid, side, text, row_number() over () as tid from u where side is not null and text is not null),"""
    + _SIMILAR.replace("select rid, tid, w, count", "select rid, side, tid, w, count").replace("select rid, tid, unnest", "select rid, side, tid, unnest").replace("PAIR", "a.side = 'e' and b.side = 't'")
    + "select distinct least(a.rid, b.rid) as id_a, greatest(a.rid, b.rid) as id_b from s join t a on a.tid = s.x join t b on b.tid = s.y"
)

ORACLES: dict = {
    "p1_found": _P1,
    "p6_found": _P6,
    "p6_report": _P6.replace(
        "select distinct least(a.rid, b.rid) as id_a, greatest(a.rid, b.rid) as id_b from s join t a on a.tid = s.x join t b on b.tid = s.y",
        """, h as (select distinct a.rid from s join t a on a.tid = s.x),
 n as (select distinct id as rid, 'starter_design' as "table", case lower(trim(split)) when 'test' then 'test' else 'validation' end as split, 'archive-' || book as source
       from starter_design where prose is not null or source is not null
 union select id, 'pilot_matched_v1', case when lower(trim(role)) in ('dev', 'development') then 'development' else 'final_eval' end, provenance from pilot_matched_v1 where text is not null
 union select id, 'sft_mask_probes', case lower(trim(split)) when 'test' then 'test' else 'validation' end, provenance.source from sft_mask_probes where messages is not null)
 select n."table", n.split, n.source, count(*) as records, count(h.rid) as overlapping from n left join h using (rid)
 where rid in (select rid from t where side = 'e') group by all""",
    ),
    # each document placed once for each capacity, its pieces in order, none divided that fits, no window overfull
    "p7_check": """select p.pack_id, count(distinct d.doc_id) as documents, 0::bigint as misplaced, 0::bigint as overfull from pack_capacities p
 cross join (select distinct doc_id from documents where text is not null and text <> '') d group by p.pack_id""",
    "p2_check": """select count(distinct id) as records, 0::bigint as parted, 0.0::double as deviation
 from (select id from starter_design union all select id from sft_mask_probes)""",
    "p2_found": _P2 + "select distinct record_id, group_key from placed join parted using (group_key)",
}
