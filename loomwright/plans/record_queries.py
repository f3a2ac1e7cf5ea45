"""Queries over records, reviews and references, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomwright.functions import numbers as N
from loomwright.functions import text as T
from loomwright.operators import records as R
from loomwright.operators.nested import first_difference
from loomwright.plans.relational_queries import _names, statement
from loomwright.session import table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def document_sections(spark, sf_dir):
    """Sections of each document with their slugs."""
    return R.sections(_docs(spark, sf_dir), "doc_id", "text")


def anchor_containment(spark, sf_dir):
    """How many documents hold the title of each held-out item."""
    items = table(spark, sf_dir, "heldout_items").select("item_id", "title")
    held = _docs(spark, sf_dir).select("text").join(F.broadcast(items), F.contains(F.col("text"), F.col("title")))
    rows = held.select("item_id", F.lit(1).alias("n")).unionAll(items.select("item_id", F.lit(0)))
    return rows.groupBy("item_id").agg(F.sum("n").alias("holders"))


def delimited_prose(spark, sf_dir):
    """what each brief holds between its first instruction and its last word."""
    rows = table(spark, sf_dir, "judgment_review").select("review_id", F.col("packet.brief").alias("brief")).distinct()
    out = R.delimited(rows, "brief", F.lit(" the "), F.lit(", and "))
    return out.groupBy("status").agg(F.count("*").alias("n"), F.sum(F.length("selected")).alias("characters"))


def blinded_packets(spark, sf_dir):
    """grading packets without what would tell the candidate."""
    out = R.blinded(table(spark, sf_dir, "judgment_review")).select("review_id", F.md5("output").alias("output"), F.size("open").alias("open"))
    return out.distinct()


def evidence_quotes(spark, sf_dir):
    """Selected passages that their outputs hold word for word."""
    rows = table(spark, sf_dir, "judgment_review").select(
        "review_id", F.col("packet.output").alias("output"), F.explode("packet.selected_prose").alias("s")
    ).distinct()
    found = R.evidence_found(rows, F.col("s.text"), F.col("output"))
    return rows.groupBy(found.alias("found")).agg(F.count("*").alias("n"))


def rouge_of_outputs(spark, sf_dir):
    """Overlap of outputs with their briefs."""
    rows = table(spark, sf_dir, "judgment_review").select("review_id", F.col("packet.brief").alias("b"), F.col("packet.output").alias("o")).distinct()
    out = R.rouge(rows, "review_id", "b", "o")
    return out.select("key", F.round("rouge1", 9).alias("rouge1"), F.round("rouge2", 9).alias("rouge2"))


def source_manifests(spark, sf_dir):
    """One digest over the worlds of each style."""
    return R.manifest(table(spark, sf_dir, "worlds"), "style", "id", "source")


def unresolved_parents(spark, sf_dir):
    """V8: parents of reviewed passages that no archive record answers."""
    books = table(spark, sf_dir, "starter_design").select(F.concat(F.lit("archive-"), F.col("book").cast("string")).alias("archive"))
    return R.unresolved(table(spark, sf_dir, "pilot_matched_v1"), "parent_id", books, "archive")


def chosen_edges(spark, sf_dir):
    """The supplier of least balance for each part's lines, ties told."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", F.col("l_suppkey").cast("string").alias("s")).distinct()
    return R.select_edge(lines, "l_partkey", "l_quantity", "s")


def exact_rewards(spark, sf_dir):
    """Mean reward of every order as a reduced fraction."""
    sums = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("s"), F.count("*").alias("k")
    )
    return sums.select("l_orderkey", N.reduced(F.col("s"), F.col("k")).alias("f")).select("l_orderkey", "f.num", "f.den")


def token_bytes(spark, sf_dir):
    """Word lengths of titles as little-endian bytes and back."""
    items = table(spark, sf_dir, "heldout_items").select("item_id", F.transform(T.spaced(F.col("title")), F.length).alias("v"))
    data = items.select("item_id", "v", N.u32_le(F.col("v")).alias("b"))
    return data.select("item_id", F.lower(F.hex("b")).alias("bytes"), F.array_join(N.from_u32_le(F.col("b")).cast("array<string>"), ",").alias("back"))


def resolved_links(spark, sf_dir):
    """File paths resolved against a folder above their own."""
    files = table(spark, sf_dir, "sft_mask_probes").select(F.explode(F.map_keys("expected_files")).alias("path")).distinct()
    return files.select("path", N.normal_path(F.concat("path", F.lit("/./../../x//"), "path")).alias("target"))


def held_out_authors(spark, sf_dir):
    """Training records whose author also has test records, left out of a selection."""
    probes = table(spark, sf_dir, "sft_mask_probes").select("id", "split", F.col("provenance.author_id").alias("author")).distinct()
    blocked = probes.where("split = 'test' and author is not null").select("author").distinct()
    return probes.where("split = 'train'").join(blocked, "author", "left_semi").select("id", "author")


def search_lines(spark, sf_dir):
    """O3: the first hundred lines that hold a word, in order, cut at 1,000 characters."""
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", r"\r\n?|\n")).alias("pos", "line"))
    found = lines.where(F.contains(T.fold(F.col("line")), F.lit("lantern"))).select(
        "doc_id", (F.col("pos") + 1).alias("line_number"), F.substring("line", 1, 1000).alias("line")
    )
    return found.orderBy("doc_id", "line_number").limit(100)


def first_differences(spark, sf_dir):
    """Where the bodies of two neighbouring long-form records first differ."""
    bodies = table(spark, sf_dir, "longform_v1").select("spec_id", "body").where("body is not null").dropDuplicates(["spec_id"])
    order = Window.partitionBy("role").orderBy("spec_id")
    roles = table(spark, sf_dir, "longform_v1").select("spec_id", "role").distinct()
    pairs = bodies.join(roles, "spec_id").withColumn("other", F.lag("body").over(order)).where("other is not null")
    return first_difference(pairs, "spec_id", "other", "body")


STATEMENTS = {
    # Ladders, first rule wins
    "selected_sources": "select id, provenance, role from {pilot_matched_v1} where provenance = 'human' and review_status is not null group by id, provenance, role",
    "eligibility_ladder": """select coalesce(review_status, 'none') as review_status, case when split is null then 'no_split' when source_groups is null then 'no_groups' when review_status <> 'accepted' then 'not_accepted'
 when provenance.license is null then 'no_license' else 'eligible' end as verdict, count(distinct id) as records from {sft_mask_probes} group by 1, 2""",
    "protocol_shape": """select case when message like '%rollback%' then 'x' when kind in ('wiki', 'notes') then 'knowledge' when kind in ('scene', 'script') then 'prose' else 'meta' end as shape, count(*) as n
 from (select kind, source as message from {documents}) t group by 1""",
    "termination_reason": """select case when value > 95 then 'context_limit' when value > 90 then 'generated_limit' when event_type = 'error' then 'failed' else 'stop' end as reason, count(*) as n from {events} group by 1""",
    # J2, J3, J5, J11, J12, J17, J19
    "lookup_join": "select w.style, count(distinct w.id) as worlds, count(distinct s.id) as designs from {worlds} w left join {starter_design} s on s.style = w.style group by w.style",
    "derived_key_join": "select count(*) as matched from (select distinct parent_id from {pilot_matched_v1}) p join (select distinct concat('archive-', cast(book as varchar(30))) as k from {starter_design} where book is not null) s on s.k = p.parent_id",
    "matched_references": "select p.genre, count(distinct p.id) as passages, count(distinct s.id) as designs from {pilot_matched_v1} p join {starter_design} s on concat('archive-', cast(s.book as varchar(30))) = p.parent_id group by p.genre",
    "binding_mismatch": "select count(*) as rows_differing from (select distinct id, title, parent_id from {pilot_matched_v1}) p join (select distinct book, title from {starter_design} where book is not null) s on concat('archive-', cast(s.book as varchar(30))) = p.parent_id and s.title <> p.title",
    "anchor_containment": "select h.item_id, count(d.doc_id) as holders from {heldout_items} h left join {documents} d on contains(d.text, h.title) group by h.item_id",
    "missing_results": "select count(*) as missing from (select distinct doc_id from {documents}) d left join (select distinct doc_id from {doc_labels}) l on l.doc_id = d.doc_id where l.doc_id is null",
    # J14, J15, A31, A32, W16, W17
    "span_credit_join": """select sum(case when c.orders is null then 1 else 0 end) as uncovered, sum(case when t.lines is null then 1 else 0 end) as loose, count(*) as spans from
 (select o_orderkey as k, 1 as orders from {orders}) c full join (select l_orderkey as k, count(*) as lines from {lineitem} group by l_orderkey) t on c.k = t.k""",
    "logprob_drift": "select l_returnflag, round(avg(abs(l_discount - l_tax)), 9) as mean_drift, round(max(abs(l_discount - l_tax)), 9) as max_drift from {lineitem} where l_linestatus = 'F' group by l_returnflag",
    "prefill_metrics": """select user_id, round(sum(value), 4) as prefill, round(sum(case when value > coalesce(prior, 0) then value - coalesce(prior, 0) else 0 end), 4) as fresh from
 (select user_id, value, lag(value) over (partition by user_id order by ts, event_id) as prior from {events}) t group by user_id""",
    "context_changed_after": """select user_id, max(case when event_type = 'error' and event_id > boundary then 1 else 0 end) as changed from
 (select user_id, event_id, event_type, max(case when event_type = 'purchase' then event_id end) over (partition by user_id) as boundary from {events}) t group by user_id""",
    "resource_peaks": "select user_id, date_trunc('day', ts) as day, max(value) as peak from {events} group by user_id, date_trunc('day', ts)",
    "monotonic_results": """select user_id, max(case when regress then 1 else 0 end) as regressed from (select user_id, event_type = 'signup' and
 max(case when event_type = 'purchase' then 1 else 0 end) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) = 1 as regress from {events}) t group by user_id""",
    # A20, A21, A26, A27, A35, A38, A39, A40
    "inventory_summary": "select split, family, provenance.source as source, count(distinct id) as records from {sft_mask_probes} group by grouping sets ((split), (family), (provenance.source))",
    "strict_accuracy": """select round(avg(case when ok = n then cast(1 as double) else cast(0 as double) end), 9) as prompt_accuracy, round(cast(sum(ok) as double) / sum(n), 9) as instruction_accuracy from
 (select l_orderkey, count(*) as n, sum(case when l_quantity > 10 then 1 else 0 end) as ok from {lineitem} group by l_orderkey) t""",
    "pass_at_one": "select round(avg(case when l_discount <= 0.05 then cast(1 as double) else cast(0 as double) end), 9) as base, round(avg(case when l_discount <= 0.05 and l_tax <= 0.04 then cast(1 as double) else cast(0 as double) end), 9) as plus from {lineitem}",
    "run_summary": "select count(*) as tasks, sum(case when event_type = 'error' then 1 else 0 end) as errors, sum(case when event_type = 'purchase' then 1 else 0 end) as passed from {events}",
    "memory_envelope": "select p_size, p_size * 2 * 4096 as kv_bytes, least(p_size, 32) * 2 * 4096 as window_bytes from {part} group by p_size",
    "grader_progress": "select source, count(distinct case when record.status = 'ok' then review_id end) as graded, count(distinct review_id) as expected, count(distinct case when record.status = 'pending' then review_id end) as pending from {judgment_review} group by source",
    "group_identity": "select o_orderkey, md5(concat_ws('|', cast(o_custkey as varchar(20)), o_orderstatus, o_orderpriority)) as identity from {orders}",
    "outcome_codes": "select user_id, event_type as code, count(*) as n from {events} group by user_id, event_type",
    "verdict": "select bool_and(value >= 0) as all_measured, bool_and(event_type is not null) as all_typed, count(*) as checked from {events}",
    # O1, O4, O5, W11, W12, Z41
    "shortest_that_fit": "select doc_id, n_chars from {documents} where n_chars between 200 and 4000 order by n_chars, doc_id limit 4",
    "report_order": "select source, kind, count(*) as n from {documents} group by source, kind order by source, kind",
    "rotating_genre": "select c_custkey, (c_custkey + 2 * (c_nationkey % 6)) % 12 as genre from {customer}",
    "context_ladder": "select r_name, s.context, s.context * 2048 as bytes from {region} join (select 4096 as context union all select 8192 union all select 32768) s on s.context > 0",
    # V6, V9, V12, V13, U1, Z45
    "span_monotone": """select l_orderkey, max(case when l_linenumber <= prior then 1 else 0 end) as broken from (select l_orderkey, l_linenumber, lag(l_linenumber) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as prior from {lineitem}) t group by l_orderkey""",
    "declared_difference": "select r_name, count(n_name) as declared, sum(case when s.k is null then 1 else 0 end) as omitted from {region} join {nation} on n_regionkey = r_regionkey left join (select distinct s_nationkey as k from {supplier}) s on s.k = n_nationkey group by r_name",
    "repeated_ids": "select id, count(*) as deliveries, count(distinct title) as contents from {starter_design} group by id having count(*) > 1",
    "review_consistency": "select status, assessed, count(*) as n from (select distinct review_id, record.status as status, case when record.assessments is null then 'none' else 'some' end as assessed from {judgment_review}) t group by status, assessed",
    "step_reservations": "select count(*) as steps, count(distinct o_orderkey) as reserved, max(o_orderkey) as last_step from {orders}",
    "failed_checks": "select l_orderkey, sum(case when l_quantity <= 5 then 1 else 0 end) as small, sum(case when l_discount > 0.08 then 1 else 0 end) as cheap from {lineitem} group by l_orderkey having sum(case when l_quantity <= 5 then 1 else 0 end) > 1",
    "stage_budget": "select user_id, event_id, round(sum(value) over (partition by user_id, event_type order by ts, event_id rows unbounded preceding), 4) as spent from {events} where event_type in ('view', 'click')",
    "rendered_steps": "select title, concat(title, ': ', style, ' (', genre, ')') as heading, count(*) as n from {starter_design} group by title, style, genre",
}

QUERIES = {name: statement(sql) for name, sql in STATEMENTS.items()} | {
    f.__name__: f
    for f in (
        document_sections, anchor_containment, delimited_prose, blinded_packets, evidence_quotes, rouge_of_outputs, source_manifests,
        unresolved_parents, chosen_edges, exact_rewards, token_bytes, resolved_links, held_out_authors, search_lines, first_differences,
    )
}

_BLANK = r"[\s\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_SLUG = "regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_TOK = r"regexp_extract_all(replace(lower({}), 'ß', 'ss'), '[\p{{L}}\p{{N}}_]+')"


def _bag(n: int) -> str:
    g = "r" if n == 1 else "list_transform(generate_series(1, len(r) - 1), lambda i: r[i] || ' ' || r[i + 1])"
    h = g.replace("r[", "c[").replace("len(r)", "len(c)") if n > 1 else "c"
    return f"""b{n} as (select k, (select sum(least(x.n, y.n)) from (select g, count(*) as n from (select unnest({g}) as g) group by g) x join (select g, count(*) as n from (select unnest({h}) as g) group by g) y using (g)) as s,
 greatest(len(r) - {n - 1}, 0) as p, greatest(len(c) - {n - 1}, 0) as q from t)"""


ORACLES = {
    "document_sections": rf"""with c as (select doc_id as key, string_split(regexp_replace(text, '(?m)^(#{{1,6}}[ \x{{a0}}]+\S)', chr(1) || '\1', 'g'), chr(1)) as l from documents where text is not null),
 e as (select key, i - 1 as ordinal, l[i] as body from (select *, unnest(generate_series(1, len(l))) as i from c)),
 t as (select key, ordinal, body, regexp_replace(regexp_extract(body, '^#{{1,6}}[ \x{{a0}}]+([^\n\r]*)', 1), '^{_BLANK}+|{_BLANK}+$', '', 'g') as title from e where ordinal > 0 or body <> ''),
 s as (select *, {_SLUG} as base from t), n as (select *, row_number() over (partition by key, base order by ordinal) - 1 as n from s)
 select key, cast(ordinal as integer) as ordinal, title, case when n = 0 then base else base || '-' || n end as slug, len(body)::integer as characters from n""",
    "delimited_prose": rf"""with d as (select distinct review_id, packet.brief as b from judgment_review),
 p as (select b, instr(b, ' the ') as f, instr(b, ', and ') as l, (len(b) - len(replace(b, ' the ', ''))) // 5 as x, (len(b) - len(replace(b, ', and ', ''))) // 6 as y from d),
 s as (select *, case when b is null or f = 0 or l = 0 then 'missing_prose' when not (x = 1 and y = 1) or l < f + 5 then 'needs_review' else 'ok' end as status from p)
 select status, count(*) as n, sum(case when status = 'ok' then len(regexp_replace(substr(b, f + 5, l - f - 5), '^{_BLANK}+|{_BLANK}+$', '', 'g')) end)::bigint as characters from s group by status""",
    "blinded_packets": """select distinct review_id, md5(packet.output) as output, len(list_filter(map_keys(packet.rubrics), lambda k: not coalesce(list_contains(list_transform(record.assessments, lambda a: a.metric), k), false)))::integer as open from judgment_review""",
    "evidence_quotes": rf"""with s as (select distinct review_id, packet.output as o, unnest(packet.selected_prose) as s from judgment_review)
 select contains(regexp_replace(regexp_replace(o, '^{_BLANK}+|{_BLANK}+$', '', 'g'), '{_BLANK}+', ' ', 'g'), regexp_replace(regexp_replace(s.text, '^{_BLANK}+|{_BLANK}+$', '', 'g'), '{_BLANK}+', ' ', 'g')) as found, count(*) as n from s group by 1""",
    "rouge_of_outputs": f"""with t as (select distinct review_id as k, {_TOK.format('packet.brief')} as r, {_TOK.format('packet.output')} as c from judgment_review where packet.brief is not null and packet.output is not null),
 {_bag(1)}, {_bag(2)} select b1.k as key, case when b1.p > 0 and b1.q > 0 then round(2.0 * coalesce(b1.s, 0) / (b1.p + b1.q), 9) end as rouge1,
 case when b2.p > 0 and b2.q > 0 then round(2.0 * coalesce(b2.s, 0) / (b2.p + b2.q), 9) end as rouge2 from b1 join b2 using (k)""",
    "source_manifests": """with h as (select distinct style, id, substr(sha256(id), 1, 4) as k, sha256(source) as h from worlds where source is not null),
 b as (select style, k, count(*) as n, sha256(string_agg(id || ':' || h, chr(10) order by id)) as b from h group by style, k)
 select style as "group", sum(n)::bigint as members, sha256(string_agg(b, chr(10) order by k)) as digest from b group by style""",
    "unresolved_parents": "select parent_id as reference, count(*) as rows from pilot_matched_v1 where parent_id is not null and parent_id not in (select 'archive-' || book from starter_design where book is not null) group by parent_id",
    "chosen_edges": """with l as (select distinct l_partkey, l_quantity, l_suppkey::varchar as s from lineitem), m as (select l_partkey, min(l_quantity) as q from l group by l_partkey)
 select l.l_partkey, case when count(*) = 1 then min(s) end as edge, case when count(*) > 1 then 'tie' else 'ok' end as status from l join m on m.l_partkey = l.l_partkey and m.q = l.l_quantity group by l.l_partkey""",
    "exact_rewards": """with s as (select l_orderkey, sum(l_quantity::bigint) as s, count(*) as k from lineitem group by l_orderkey)
 select l_orderkey, (s / gcd(s::bigint, k))::bigint as num, (k / gcd(s::bigint, k))::bigint as den from s""",
    "token_bytes": """with v as (select item_id, list_transform(list_filter(string_split(title, ' '), lambda x: x <> ''), lambda x: len(x)) as v from heldout_items)
 select item_id, array_to_string(list_transform(v, lambda n: printf('%02x', n) || '000000'), '') as bytes, array_to_string(v, ',') as back from v""",
    "resolved_links": """with p as (select distinct unnest(map_keys(expected_files)) as path from sft_mask_probes)
 select path, case when contains(path, '/') then array_to_string(string_split(path, '/')[:-3], '/') || case when len(string_split(path, '/')) > 2 then '/' else '' end else '../' end || 'x/' || path as target from p""",
    "held_out_authors": """with p as (select distinct id, split, provenance.author_id as author from sft_mask_probes)
 select distinct id, author from p where split = 'train' and author in (select author from p where split = 'test' and author is not null)""",
    "search_lines": r"""with l as (select doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) as l from documents where text is not null),
 e as (select doc_id, i as line_number, l[i] as line from (select *, unnest(generate_series(1, len(l))) as i from l))
 select doc_id, line_number::integer as line_number, substr(line, 1, 1000) as line from e where contains(replace(lower(line), 'ß', 'ss'), 'lantern') order by doc_id, line_number limit 100""",
} | {name: sql.format(**{n: n for n in _names(sql)}) for name, sql in STATEMENTS.items()}
