"""Queries of the nested-record operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomwright.operators.nested import call_entities, nested_children
from loomwright.session import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every call, tool and check, linked to its parent."""
    return nested_children(table(spark, sf_dir, "sft_mask_probes"), table(spark, sf_dir, "longform_v1"))


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children per kind and depth of their parent, from the flat tables."""
    found = p4_found(spark, sf_dir)
    return found.groupBy("child_kind").count().withColumnRenamed("count", "n")


def p4_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity table of the calls: place, id, function name and arguments."""
    return call_entities(table(spark, sf_dir, "sft_mask_probes"), "id", "messages")


QUERIES = {"p4_found": p4_found, "p4_counts": p4_counts, "p4_calls": p4_calls}

_P4 = """
with calls as (
  select distinct id as record_id, 'messages[' || (i - 1) || ']' as parent_path, 'tool_call' as child_kind,
         cast(j - 1 as integer) as child_pos, coalesce(messages[i].tool_calls[j].id, '') as child_id
  from (select id, messages, i, unnest(generate_series(1, len(messages[i].tool_calls))) as j
        from (select id, messages, unnest(generate_series(1, len(messages))) as i from sft_mask_probes))
  where messages[i].tool_calls[j] is not null),
tools as (
  select distinct id as record_id, '$' as parent_path, 'tool' as child_kind, cast(i - 1 as integer) as child_pos,
         case when json_extract(t, '$.function') is not null then coalesce(json_extract_string(t, '$.function.name'), '')
              else coalesce(json_extract_string(t, '$.name'), '') end as child_id
  from (select id, i, tools[i] as t from (select id, tools, unnest(generate_series(1, len(tools))) as i from sft_mask_probes))
  where t is not null and json_valid(t) and json_type(t) = 'OBJECT'),
bodies as (select distinct spec_id, body::json as b from longform_v1 where json_valid(body)),
cases as (
  select spec_id, 'cases[' || i || ']' as p, json_extract(b, '$.cases[' || i || ']') as c
  from (select spec_id, b, unnest(generate_series(0, cast(json_array_length(b, '$.cases') as bigint) - 1)) as i from bodies)),
owners as (
  select spec_id, p, json_extract(c, '$.checks') as k from cases
  union all
  select spec_id, p || '.followups[' || j || ']', json_extract(c, '$.followups[' || j || '].checks')
  from (select spec_id, p, c, unnest(generate_series(0, cast(json_array_length(c, '$.followups') as bigint) - 1)) as j
        from cases where json_type(c, '$.followups') = 'ARRAY')),
held as (
  select spec_id, p, case when json_type(k) = 'VARCHAR' and json_valid(k ->> '$') then (k ->> '$')::json else k end as k
  from owners),
checks as (
  select spec_id, p, n as pos, coalesce(json_extract_string(k, '$[' || n || '].id'), '') as cid
  from (select spec_id, p, k, unnest(generate_series(0, cast(json_array_length(k) as bigint) - 1)) as n
        from held where json_type(k) = 'ARRAY') where json_type(k, '$[' || n || ']') = 'OBJECT'
  union all
  select spec_id, p, 0, coalesce(json_extract_string(k, '$.id'), '') from held
  where json_type(k) = 'OBJECT' and json_extract(k, '$.kind') is not null
  union all
  select spec_id, p, row_number() over (partition by spec_id, p order by name) - 1, name
  from (select spec_id, p, unnest(json_keys(k)) as name from held
        where json_type(k) = 'OBJECT' and json_extract(k, '$.kind') is null)),
found as (
  select * from calls union all select * from tools union all
  select spec_id, p, 'check', cast(pos as integer), cid from checks)
"""

ORACLES = {
    "p4_found": _P4 + "select record_id, parent_path, child_kind, child_pos, child_id from found",
    "p4_calls": """select distinct id as record_id, cast(i - 1 as integer) as message, cast(j - 1 as integer) as place, messages[i].tool_calls[j].id as id,
 messages[i].tool_calls[j]."function".name as name, messages[i].tool_calls[j]."function".arguments as arguments
 from (select id, messages, i, unnest(generate_series(1, len(messages[i].tool_calls))) as j
       from (select id, messages, unnest(generate_series(1, len(messages))) as i from sft_mask_probes)) where messages[i].tool_calls[j] is not null""",
    "p4_counts": _P4 + "select child_kind, count(*) as n from found group by child_kind",
}
