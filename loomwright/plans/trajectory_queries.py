"""Queries over conversations with tool calls, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.operators import trajectory as T
from loomwright.operators.checks import evaluate_files
from loomwright.session import table


# What the queries read of a message.
_IDS = "id string, messages array<struct<role:string,tool_call_id:string,tool_calls:array<struct<id:string>>>>"
_TEXTS = "id string, messages array<struct<role:string,content:string>>"


def _probes(spark, sf_dir, schema=None):
    return table(spark, sf_dir, "sft_mask_probes", schema)


def trajectory_violations(spark, sf_dir):
    """V1: broken rules and how many records break them."""
    return T.violations(_probes(spark, sf_dir)).groupBy("rule").agg(F.count("*").alias("records"))


def trajectory_crossing(spark, sf_dir):
    """Authors and works in more than one split."""
    records = _probes(spark, sf_dir)
    return T.crossing_splits(records, {"author_id": F.col("provenance.author_id"), "work_id": F.col("provenance.work_id")})


def call_result_pairs(spark, sf_dir):
    """Calls and results by state."""
    return T.call_results(_probes(spark, sf_dir, _IDS)).groupBy("status").agg(F.count("*").alias("n"))


def completed_exchanges(spark, sf_dir):
    """The last two exchanges of each conversation."""
    return T.exchanges(_probes(spark, sf_dir, _IDS))


def token_layout(spark, sf_dir):
    """Token offsets and loss mask of every message."""
    return T.token_spans(_probes(spark, sf_dir, _TEXTS))


def context_summary(spark, sf_dir):
    """Fixed summaries of the conversations."""
    return T.fixed_summary(_probes(spark, sf_dir, _TEXTS))


def argument_states(spark, sf_dir):
    """Calls by the state of their arguments."""
    return T.call_arguments(_probes(spark, sf_dir)).groupBy("state").agg(F.count("*").alias("calls"))


def call_admission(spark, sf_dir):
    """Calls by rejection code."""
    return T.admission(_probes(spark, sf_dir)).groupBy("code", "reason").agg(F.count("*").alias("calls"))


FILE_CHECKS = [
    ("protected", "kb/index.md", [], None),
    ("allowed_changes", None, ["kb/*", "drafts/?*"], None),
    ("kb_word_budget", None, [], 60),
    ("wiki_links", None, [], None),
    ("evidence_exposed", None, ["the lantern"], None),
    ("unheard_of", None, [], None),
]


def file_checks(spark, sf_dir):
    """checks on the files of each trajectory, by kind and result."""
    seen = F.expr("transform(filter(messages, m -> m.role = 'tool' and m.content is not null), m -> m.content)")
    kept = _probes(spark, sf_dir).dropDuplicates(["id"]).select("id", F.col("initial_files").alias("before"), F.col("expected_files").alias("after"), seen.alias("seen"))
    listed = F.array(*[
        F.struct(F.lit(k).alias("kind"), F.lit(p).cast("string").alias("path"), F.array(*map(F.lit, w)).cast("array<string>").alias("wanted"), F.lit(h).cast("int").alias("high"))
        for k, p, w, h in FILE_CHECKS
    ])
    out = evaluate_files(kept.withColumn("c", F.explode(listed)).select("id", "before", "after", "seen", "c.*"))
    return out.groupBy("kind", "passed").agg(F.count("*").alias("records"))


def changed_paths(spark, sf_dir):
    """files that a trajectory adds, removes or changes."""
    return T.changed_paths(_probes(spark, sf_dir), "initial_files", "expected_files")


def sft_export_rows(spark, sf_dir):
    """K2: rows of the training export with their sizes."""
    return T.exported(_probes(spark, sf_dir)).select(
        "id", F.size("messages").alias("messages"), F.greatest(F.coalesce(F.size("tools"), F.lit(0)), F.lit(0)).alias("tools")
    )


QUERIES = {
    f.__name__: f
    for f in (
        trajectory_violations, trajectory_crossing, call_result_pairs, completed_exchanges, token_layout,
        context_summary, argument_states, call_admission, file_checks, changed_paths, sft_export_rows,
    )
}

_ONE = "one as (select * from sft_mask_probes qualify row_number() over (partition by id order by loaded_at) = 1)"
_ROWS = f"""{_ONE}, each as (select id, messages, unnest(generate_series(1, len(messages))) as i from one),
 rows as (select id, cast(i - 1 as integer) as pos, messages[i] as m, sum(case when messages[i].role = 'tool' then 0 else 1 end) over (partition by id order by i) as segment from each)"""
_CALLS = f"""{_ROWS}, calls as (select id, pos, segment, cast(j - 1 as integer) as place, m.tool_calls[j] as c
 from (select *, unnest(generate_series(1, len(m.tool_calls))) as j from rows where len(m.tool_calls) > 0))"""
_SAFE = "len(list_filter(map_keys({0}), lambda p: not (len(p) > 0 and len(list_filter(string_split(p, '/'), lambda x: x in ('', '.', '..'))) = 0 and not contains(p, chr(92)) and not contains(p, chr(0))))) > 0"

ORACLES = {
    "trajectory_violations": f"""with {_CALLS},
 seg as (select id, segment, list_sort(list(coalesce(m.tool_call_id, '')) filter (where m.role = 'tool')) as got from rows group by id, segment),
 want as (select id, segment, list_sort(list(c.id) filter (where c.id is not null)) as want from calls group by id, segment),
 s as (select seg.id, coalesce(got, []) as got, coalesce(want, []) as want from seg left join want using (id, segment)),
 v as (
 select id, 'schema_version' as rule from one where schema_version is distinct from 1
 union all select id, 'split' from one where coalesce(split, '') not in ('train', 'validation', 'test')
 {' '.join(f"union all select id, 'provenance_{k}' from one where coalesce(trim(provenance.{k}), '') = ''" for k in ('author_id', 'work_id', 'source', 'license'))}
 union all select id, 'unsafe_path' from one where {_SAFE.format('initial_files')} or {_SAFE.format('expected_files')}
 union all select id, 'review_status' from one where coalesce(review_status, '') not in ('pending', 'accepted', 'rejected')
 union all select id, 'messages_required' from one where coalesce(len(messages), 0) = 0
 union all select id, 'role' from rows where coalesce(m.role, '') not in ('system', 'user', 'assistant', 'tool')
 union all select id, 'calls_by_assistant_only' from rows where len(m.tool_calls) > 0 and m.role <> 'assistant'
 union all select id, 'content_required' from rows where coalesce(len(m.tool_calls), 0) = 0 and m.content is null
 union all select id, 'final_answer' from rows where pos = (select max(r.pos) from rows r where r.id = rows.id) and (m.role <> 'assistant' or len(m.tool_calls) > 0)
 union all select id, 'bad_call_id' from calls where coalesce(c.id, '') = ''
 union all select id, 'bad_call_id' from (select id, c.id as cid, count(*) as k from calls where c.id is not null group by 1, 2) where k > 1
 union all select id, 'missing_tool_response' from s where len(list_filter(list_distinct(want), lambda w: len(list_filter(got, lambda g: g = w)) < 1)) > 0
 union all select id, 'unmatched_tool_response' from (select id, want, unnest(got) as g, got from s) where not list_contains(want, g) or len(list_filter(got, lambda y: y = g)) > 1)
 , tl as (select id, list_transform(list_filter(coalesce(tools, []), lambda t: t is not null), lambda t: t::json) as ts from one),
 nm as (select id, ts, list_transform(ts, lambda t: json_extract_string(t, '$.function.name')) as names from tl),
 w as (select * from v
 union all select id, 'id' from one where coalesce(id, '') = ''
 union all select id, 'tool_type' from tl where len(list_filter(ts, lambda t: json_extract_string(t, '$.type') is distinct from 'function' or json_type(t, '$.function') is distinct from 'OBJECT')) > 0
 union all select id, 'tool_name' from nm where len(list_filter(names, lambda n: coalesce(n, '') = '')) > 0 or len(list_distinct(names)) < len(names)
 union all select id, 'tool_parameters' from tl where len(list_filter(ts, lambda t: json_type(t, '$.function.parameters') is distinct from 'OBJECT')) > 0
 union all select id, 'call_type' from calls where c.type is distinct from 'function'
 union all select id, 'call_name' from calls where c."function".name is null
 union all select calls.id, 'unavailable_tool' from calls join nm on nm.id = calls.id where c."function".name is not null and not coalesce(list_contains(names, c."function".name), false)
 union all select id, 'arguments_object' from calls where not coalesce(json_valid(c."function".arguments) and json_type(c."function".arguments) = 'OBJECT', false)
 union all select id, 'duplicate_id' from (select id, count(distinct md5(to_json(struct_pack(split, family, messages, tools, provenance, initial_files, expected_files, review_status, source_groups, schema_version))::varchar)) as k from sft_mask_probes group by id) where k > 1)
 select rule, count(distinct id) as records from w group by rule""",
    "trajectory_crossing": """with k as (select split, 'author_id' as kind, provenance.author_id as key from sft_mask_probes union all select split, 'work_id', provenance.work_id from sft_mask_probes)
 select kind, key, array_to_string(list_sort(list(distinct split)), ',') as splits from k where key is not null and split is not null group by kind, key having count(distinct split) > 1""",
    "call_result_pairs": f"""with {_CALLS}, c as (select id, segment, coalesce(c.id, '') as cid, row_number() over (partition by id, segment, coalesce(c.id, '') order by place) as nth from calls),
 r as (select id, segment, coalesce(m.tool_call_id, '') as cid, row_number() over (partition by id, segment, coalesce(m.tool_call_id, '') order by pos) as nth from rows where m.role = 'tool'),
 f as (select id, max(segment) as final from rows group by id)
 select case when c.id is null then 'orphan' when r.id is not null then 'paired' when c.segment = f.final then 'not_executed' else 'missing' end as status, count(*) as n
 from c full join r on c.id = r.id and c.segment = r.segment and c.cid = r.cid and c.nth = r.nth left join f on f.id = c.id group by 1""",
    "completed_exchanges": f"""with {_ROWS}, s as (select id, segment, min(pos) as first, max(pos) as last from rows where m.role <> 'system' group by all)
 select id, row_number() over (partition by id order by segment desc) as exchange, first, last from s qualify exchange <= 2""",
    "token_layout": f"""with {_ROWS}, n as (select id, pos, m.role as role, coalesce(len(list_filter(regexp_split_to_array(m.content, '[\\s\\x{{85}}\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+'), lambda y: y <> '')), 0) as n from rows),
 e as (select *, sum(n) over (partition by id order by pos) as e from n) select id, pos, cast(e - n as bigint) as start, cast(e as bigint) as "end", case when role = 'assistant' then 1 else 0 end as mask from e""",
    "context_summary": f"""with {_ONE} select id, substr(array_to_string(list_transform(messages, lambda m: m.role || ': ' || coalesce(m.content, '')), chr(10)), 1, 400) as summary from one""",
    "argument_states": f"""with {_CALLS}, a as (select c.function.arguments as a from calls)
 select case when a is null then 'missing' when strlen(a) > 65536 then 'too_long' when not json_valid(a) then 'invalid' when json_type(a) = 'OBJECT' then 'object'
 when json_type(a) = 'VARCHAR' and json_valid(a::json ->> '$') and json_type(a::json ->> '$') = 'OBJECT' then 'encoded_twice' else 'not_object' end as state, count(*) as calls from a group by 1""",
    "call_admission": f"""with {_CALLS}, t as (select id, list_transform(list_filter(coalesce(tools, []), lambda t: t is not null), lambda t: coalesce(json_extract_string(t, '$.function.name'), json_extract_string(t, '$.name'))) as names from one),
 y as (select calls.id, pos, place, names, c, c.type as type, c."function".name as name, c."function".arguments as a, c.id as cid, row_number() over (partition by calls.id, c.id order by pos, place) as nth,
  count(*) over (partition by calls.id, pos) > 1 and bool_or(coalesce(c."function".name = 'ask_author', false)) over (partition by calls.id, pos) as mixed from calls join t on t.id = calls.id),
 x as (select case when mixed then 'mixed_control_file_batch' when type is distinct from 'function' then 'invalid_envelope' when strlen(a) > 65536 then 'envelope_size_limit'
 when c."function" is null then 'invalid_function_envelope' when trim(coalesce(cid, '')) = '' then 'missing_id' when nth > 1 then 'duplicate_id' when trim(coalesce(name, '')) = '' then 'invalid_function_name'
 when a is null or not json_valid(a) then 'invalid_arguments_json' when json_type(a) <> 'OBJECT' then 'arguments_not_object'
 when name <> 'ask_author' and len(list_filter(json_keys(a), lambda k: json_type(json_extract(a, '$."' || k || '"')) <> 'VARCHAR')) > 0 then 'arguments_not_utf8_strings'
 when json_extract_string(a, '$.path') is not null and (json_extract_string(a, '$.path') = '' or len(list_filter(string_split(json_extract_string(a, '$.path'), '/'), lambda x: x in ('', '.', '..'))) > 0 or contains(json_extract_string(a, '$.path'), chr(92))) then 'unsafe_path'
 when not coalesce(list_contains(names, name), false) then 'tool_unavailable' end as code from y)
 select code, case code {' '.join(f"when '{k}' then '{v}'" for k, v in T.REJECTIONS.items())} end as reason, count(*) as calls from x group by 1, 2""",
    "file_checks": rf"""with {_ONE}, f as (select id, coalesce(initial_files, map()) as b, coalesce(expected_files, map()) as a, list_transform(list_filter(messages, lambda m: m.role = 'tool' and m.content is not null), lambda m: m.content) as seen from one),
 k as (select *, list_filter(map_keys(a), lambda p: starts_with(p, 'kb/')) as kb from f),
 ch as (select id, unnest(list_distinct(list_concat(map_keys(b), map_keys(a)))) as p, b, a from f),
 bad as (select id, count(*) filter (where b[p] is distinct from a[p] and not (p like 'kb/%' or p like 'drafts/_%')) as n from ch group by id),
 pages as (select id, unnest(kb) as p, a from k),
 words as (select id, sum(len(list_filter(regexp_split_to_array(a[p], '[\s\x{{85}}\x{{a0}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+'), lambda y: y <> ''))) as n from pages group by id),
 r as (select 'protected' as kind, b['kb/index.md'] is not distinct from a['kb/index.md'] as passed from k
 union all select 'allowed_changes', coalesce(n, 0) = 0 from f left join bad using (id)
 union all select 'kb_word_budget', coalesce(n, 0) <= 60 from f left join words using (id)
 union all select 'wiki_links', len(kb) >= 2 and len(list_filter(kb, lambda p: contains(a[p], '[['))) > 0 and list_contains(kb, 'kb/index.md') from k
 union all select 'evidence_exposed', len(list_filter(seen, lambda s: contains(lower(s), 'the lantern'))) > 0 from k
 union all select 'unheard_of', null from k) select kind, passed, count(*) as records from r group by all""",
    "changed_paths": f"""with {_ONE}, p as (select id, initial_files as b, expected_files as a, unnest(list_distinct(list_concat(map_keys(initial_files), map_keys(expected_files)))) as path from one),
 q as (select id, path, list_contains(map_keys(b), path) as had, list_contains(map_keys(a), path) as has, b[path] as bv, a[path] as av from p)
 select id, path, case when not had then 'added' when not has then 'removed' else 'changed' end as change from q where had <> has or bv is distinct from av""",
    "sft_export_rows": f"""with {_ONE} select id, len(messages)::integer as messages, coalesce(len(tools), 0)::integer as tools from one where split = 'train' and review_status = 'accepted'""",
}
