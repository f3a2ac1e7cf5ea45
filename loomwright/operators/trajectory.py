"""Conversations with tool calls: validation, pairing, exchanges, layout, admission.

Everything is local to a record and stays in the JVM: sequencing rules fold a message
array with ``aggregate`` instead of exploding it. Rules over several records (splits that
cross an author) are grouped aggregates. A violation is a row ``(id, rule)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions import text as T

ROLES = ("system", "user", "assistant", "tool")

_SEQUENCE = """
aggregate(messages,
  named_struct('pending', cast(array() as array<string>), 'seen', cast(array() as array<string>), 'bad', cast(array() as array<string>)),
  (s, m) -> named_struct(
    'pending', concat(
       if(m.role = 'tool', array_remove(s.pending, coalesce(m.tool_call_id, '')), s.pending),
       coalesce(filter(transform(m.tool_calls, c -> c.id), i -> i is not null), cast(array() as array<string>))),
    'seen', concat(s.seen, coalesce(filter(transform(m.tool_calls, c -> c.id), i -> i is not null), cast(array() as array<string>))),
    'bad', concat(s.bad,
       if(size(s.pending) > 0 and coalesce(m.role, '') <> 'tool', array('missing_tool_response'), cast(array() as array<string>)),
       if(m.role = 'tool' and not array_contains(s.pending, coalesce(m.tool_call_id, '')), array('unmatched_tool_response'), cast(array() as array<string>)),
       if(exists(coalesce(m.tool_calls, cast(array() as array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>)),
            c -> c.id is null or c.id = '' or array_contains(s.seen, c.id))
          or size(array_distinct(coalesce(transform(m.tool_calls, c -> c.id), cast(array() as array<string>)))) < coalesce(size(m.tool_calls), 0),
          array('bad_call_id'), cast(array() as array<string>)))),
  s -> if(size(s.pending) > 0, concat(s.bad, array('missing_tool_response')), s.bad))
"""


def _rule(name: str, broken: Column) -> Column:
    return F.when(F.coalesce(broken, F.lit(False)), F.lit(name))


_TOOLS = """
transform(filter(coalesce(tools, cast(array() as array<string>)), t -> t is not null), t -> named_struct(
  'kind', get_json_object(t, '$.type'), 'wrapped', get_json_object(t, '$.function'), 'name', get_json_object(t, '$.function.name'),
  'parameters', get_json_object(t, '$.function.parameters')))
"""
_CALLS = """
flatten(filter(transform(messages, m -> filter(m.tool_calls, c -> c is not null)), x -> x is not null))
"""


def repeated_contents(records: DataFrame) -> DataFrame:
    """``(id, contents)`` of ids that stand on more than one content; deliveries of one
    content are one record. Null ids are told by :func:`violations`."""
    told = [c for c in records.columns if c not in ("id", "loaded_at", "created_at")]
    content = F.sha2(F.to_json(F.struct(*told)), 256)
    return (
        records.where("id is not null").select("id", content.alias("content")).groupBy("id")
        .agg(F.count_distinct("content").alias("contents")).where("contents > 1")
    )


def violations(records: DataFrame) -> DataFrame:
    """``(id, rule)`` for every broken rule of every distinct record.

    Tools are JSON documents that must be function schemas: a ``type`` of function, a
    name of their own and an object of parameters. Calls must be of that type, name an
    offered tool, and give their arguments as an object. A null message array breaks ``messages_required``; null fields break the rule that
    asks for them; empty tables have no violations.
    """
    calls = "coalesce(size(m.tool_calls), 0)"
    unsafe = lambda c: F.exists(F.map_keys(c), lambda p: ~T.safe_path(p))
    tools, made = F.expr(_TOOLS), F.expr(_CALLS)
    nameless = lambda n: F.coalesce(n, F.lit("")) == ""
    names = F.transform(tools, lambda t: t["name"])
    listed = F.array(
        _rule("id", F.coalesce("id", F.lit("")) == ""),
        _rule("tool_type", F.exists(tools, lambda t: ~t["kind"].eqNullSafe("function") | ~F.coalesce(t["wrapped"].startswith("{"), F.lit(False)))),
        _rule("tool_name", F.exists(names, nameless) | (F.size(F.array_distinct(names)) < F.size(names))),
        _rule("tool_parameters", F.exists(tools, lambda t: ~F.coalesce(t["parameters"].startswith("{"), F.lit(False)))),
        _rule("call_type", F.exists(made, lambda c: ~c["type"].eqNullSafe("function"))),
        _rule("call_name", F.exists(made, lambda c: c["function"]["name"].isNull())),
        _rule("unavailable_tool", F.exists(made, lambda c: c["function"]["name"].isNotNull() & ~F.coalesce(F.array_contains(F.array_compact(names), c["function"]["name"]), F.lit(False)))),
        _rule("arguments_object", F.expr(f"exists({_CALLS.strip()}, c -> not coalesce(startswith(schema_of_variant(try_parse_json(c.function.arguments)), 'OBJECT'), false))")),
        _rule("schema_version", ~F.col("schema_version").eqNullSafe(1)),
        _rule("split", ~F.coalesce(F.col("split").isin("train", "validation", "test"), F.lit(False))),
        *[
            _rule(f"provenance_{k}", F.coalesce(F.trim(f"provenance.{k}"), F.lit("")) == "")
            for k in ("author_id", "work_id", "source", "license")
        ],
        _rule("unsafe_path", unsafe(F.col("initial_files")) | unsafe(F.col("expected_files"))),
        _rule("review_status", ~F.coalesce(F.col("review_status").isin("pending", "accepted", "rejected"), F.lit(False))),
        _rule("messages_required", F.coalesce(F.size("messages"), F.lit(0)) <= 0),
        _rule("role", F.expr(f"exists(messages, m -> m.role is null or m.role not in {ROLES})")),
        _rule("calls_by_assistant_only", F.expr(f"exists(messages, m -> {calls} > 0 and m.role <> 'assistant')")),
        _rule("content_required", F.expr(f"exists(messages, m -> {calls} <= 0 and m.content is null)")),
        _rule(
            "final_answer",
            F.expr(f"exists(slice(messages, -1, 1), m -> m.role <> 'assistant' or {calls} > 0)"),
        ),
    )
    twice = repeated_contents(records).select("id", F.lit("duplicate_id").alias("rule"))
    sequence = F.when(F.size("messages") > 0, F.expr(_SEQUENCE)).otherwise(F.array().cast("array<string>"))
    return records.select(
        "id",
        F.explode(F.array_distinct(F.array_compact(F.concat(listed, F.array_compact(sequence))))).alias("rule"),
    ).unionByName(twice).distinct()


def crossing_splits(records: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """``(kind, key, splits)`` of the keys that stand in more than one split."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("key")) for k, c in keys.items()])
    listed = records.where("split is not null").select("split", F.explode(pairs).alias("p"))
    return (
        listed.where("p.key is not null")
        .groupBy("p.kind", "p.key")
        .agg(F.array_sort(F.collect_set("split")).alias("found"))
        .where("size(found) > 1")
        .select("kind", "key", F.array_join("found", ",").alias("splits"))
    )


def slim(records: DataFrame) -> DataFrame:
    """``(id, messages)`` of the distinct records, messages without their texts.

    Only roles and call ids cross the network when repeated records are dropped.
    """
    told = F.expr(
        "transform(messages, m -> named_struct('role', m.role, 'tool_call_id', m.tool_call_id, "
        "'tool_calls', transform(m.tool_calls, c -> named_struct('id', c.id))))"
    )
    return records.select("id", told.alias("messages")).dropDuplicates(["id"])


def numbered_messages(records: DataFrame) -> DataFrame:
    """``(id, pos, segment, m)``: a segment is a message and the tool results after it."""
    rows = records.select("id", F.posexplode("messages").alias("pos", "m"))
    by = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("segment", F.sum(F.when(F.col("m.role") == "tool", 0).otherwise(1)).over(by))


def call_results(records: DataFrame) -> DataFrame:
    """Calls joined to their results: ``(id, segment, call_id, status)``.

    Within a segment the n-th call of an id meets the n-th result of that id. A call
    without a result is ``not_executed`` in the last segment and ``missing`` elsewhere; a
    result without a call is ``orphan``.
    """
    rows = numbered_messages(slim(records))
    last = Window.partitionBy("id")
    rows = rows.withColumn("final", F.max("segment").over(last))
    calls = rows.where("size(m.tool_calls) > 0").select(
        "id", "segment", "final", F.posexplode("m.tool_calls").alias("place", "c")
    )
    calls = calls.select("id", "segment", "final", "place", F.coalesce("c.id", F.lit("")).alias("call_id"))
    results = rows.where("m.role = 'tool'").select(
        "id", "segment", "pos", F.coalesce("m.tool_call_id", F.lit("")).alias("call_id")
    )
    nth = lambda order: F.row_number().over(Window.partitionBy("id", "segment", "call_id").orderBy(order))
    left = calls.withColumn("nth", nth("place"))
    right = results.withColumn("nth", nth("pos")).withColumn("answered", F.lit(True))
    joined = left.join(right.drop("pos"), ["id", "segment", "call_id", "nth"], "full")
    status = (
        F.when(F.col("place").isNull(), "orphan")
        .when(F.col("answered"), "paired")
        .when(F.col("segment") == F.col("final"), "not_executed")
        .otherwise("missing")
    )
    return joined.select("id", "segment", "call_id", "nth", status.alias("status"))


def exchanges(records: DataFrame, keep: int = 2) -> DataFrame:
    """The last ``keep`` exchanges of each record as ``(id, exchange, first, last)``.

    An exchange is an assistant message with its tool results, or a later user message.
    """
    rows = numbered_messages(slim(records)).where("m.role <> 'system'")
    spans = rows.groupBy("id", "segment").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    back = Window.partitionBy("id").orderBy(F.desc("segment"))
    return spans.withColumn("exchange", F.row_number().over(back)).where(F.col("exchange") <= keep).select(
        "id", "exchange", "first", "last"
    )


def token_spans(records: DataFrame) -> DataFrame:
    """Token offsets of every message, blanks parting tokens; assistant text is learnt."""
    rows = records.select("id", F.posexplode("messages").alias("pos", "m"))
    count = F.greatest(F.coalesce(F.size(T.spaced(F.col("m.content"))), F.lit(0)), F.lit(0))
    sized = rows.select("id", "pos", F.col("m.role").alias("role"), count.alias("n")).dropDuplicates(["id", "pos"])
    by = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum("n").over(by)
    return sized.select(
        "id", "pos", (end - F.col("n")).alias("start"), end.alias("end"), (F.col("role") == "assistant").cast("int").alias("mask")
    )


def fixed_summary(records: DataFrame, most: int = 400) -> DataFrame:
    """``role: text`` lines of a conversation, cut at ``most`` characters."""
    lines = F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), F.coalesce(m["content"], F.lit(""))))
    return records.select("id", F.substring(F.array_join(lines, "\n"), 1, most).alias("summary")).distinct()


def call_arguments(records: DataFrame, most_bytes: int = 65_536) -> DataFrame:
    """Every call with the state of its arguments, the first rule that holds:

    ``missing``, ``too_long``, ``invalid`` (no JSON or repeated keys), ``object``,
    ``encoded_twice`` (a string that holds an object) or ``not_object``.
    """
    calls = records.select("id", F.posexplode("messages").alias("pos", "m")).where("size(m.tool_calls) > 0")
    rows = calls.select("id", "pos", F.posexplode("m.tool_calls").alias("place", "c"))
    raw = F.col("c.function.arguments")
    parsed = F.expr("schema_of_variant(try_parse_json(c.function.arguments))")
    inner = F.expr(
        "schema_of_variant(try_parse_json(try_variant_get(try_parse_json(c.function.arguments), '$', 'string')))"
    )
    state = (
        F.when(raw.isNull(), "missing")
        .when(F.octet_length(raw) > most_bytes, "too_long")
        .when(parsed.isNull(), "invalid")
        .when(parsed.startswith("OBJECT"), "object")
        .when((parsed == "STRING") & inner.startswith("OBJECT"), "encoded_twice")
        .otherwise("not_object")
    )
    told = rows.select("id", "pos", "place", F.col("c.function.name").alias("name"), state.alias("state"))
    return told.dropDuplicates(["id", "pos", "place"])


# Rejection codes and what they tell; fixed values, compared whole, never by substring.
REJECTIONS = {
    "call_envelope_limit": "Tool call envelope exceeds size or nesting limit",
    "invalid_envelope": "Invalid tool call envelope",
    "envelope_size_limit": "Tool call envelope exceeds size limit",
    "invalid_function_envelope": "Invalid tool function envelope",
    "missing_id": "Tool call needs an id",
    "duplicate_id": "Duplicate tool call id",
    "invalid_function_name": "Invalid tool function",
    "invalid_arguments_json": "Invalid tool arguments JSON",
    "arguments_not_object": "Tool arguments must be an object",
    "ask_author_arguments_shape": "ask_author needs exact structured arguments",
    "ask_author_question_shape": "ask_author question must be nonempty text",
    "ask_author_decision_ids_shape": "ask_author decision_ids must be nonempty text IDs",
    "ask_author_duplicate_decision_id": "ask_author repeats a decision ID",
    "ask_author_proposals_shape": "ask_author proposals need exact id/text pairs",
    "ask_author_duplicate_proposal_id": "ask_author repeats a proposal ID",
    "ask_author_option_refs_shape": "ask_author option_refs must be text IDs",
    "ask_author_duplicate_option_ref": "ask_author repeats an option reference",
    "arguments_not_utf8_strings": "Tool arguments must be an object of UTF-8 strings",
    "unsafe_path": "Unsafe or noncanonical workspace path",
    "tool_unavailable": "Tool is not available in this condition",
    "mixed_control_file_batch": "Mixed control and file-tool batch is forbidden",
    "tool_calls_not_array": "tool_calls must be an array",
    "ask_author_unavailable": "ask_author is unavailable",
    "ask_author_question_limit": "ask_author question exceeds limit",
    "ask_author_decision_count_limit": "ask_author has too many decision IDs",
    "ask_author_undeclared_decision": "ask_author names undeclared decision ID",
    "ask_author_proposal_limit": "ask_author proposals exceed limits",
    "ask_author_option_ref_limit": "ask_author option references exceed limits",
    "ask_author_undeclared_proposal": "ask_author references an undeclared proposal",
    "ask_author_redefined_proposal": "ask_author redefines a prior proposal",
    "tool_call_budget_exceeded": "Tool-call budget exceeded",
    "author_call_budget_exceeded": "Author-call budget exceeded",
    "read_token_budget_exceeded": "Read-token budget exceeded",
}
CONTROL_TOOL = "ask_author"
MOST_ARGUMENT_BYTES, MOST_CALL_BYTES = 65_536, 131_072


def rejection_code(message: Column) -> Column:
    """The code of a rejection message that is equal to it; null for any other text."""
    known = F.create_map(*[F.lit(x) for code, told in REJECTIONS.items() for x in (told, code)])
    return F.try_element_at(known, message)


def admission(records: DataFrame) -> DataFrame:
    """``(id, pos, place, code, reason)``: each call accepted (null) or rejected.

    The ladder, first rule that holds: sizes, envelopes, id, name, arguments as a JSON
    object, of strings unless it is the control tool's, a safe ``path`` among them, an
    offered tool. In a message of several calls with the control tool among them, every
    call is rejected as mixed, whatever the ladder says.
    """
    names = F.expr(
        "transform(filter(coalesce(tools, array()), t -> t is not null), "
        "t -> coalesce(get_json_object(t, '$.function.name'), get_json_object(t, '$.name')))"
    )
    calls = (
        records.select("id", names.alias("names"), F.posexplode("messages").alias("pos", "m"))
        .where("size(m.tool_calls) > 0")
        .withColumn("mixed", F.expr(f"size(m.tool_calls) > 1 and exists(m.tool_calls, c -> coalesce(c.function.name = '{CONTROL_TOOL}', false))"))
        .select("id", "names", "mixed", "pos", F.posexplode("m.tool_calls").alias("place", "c"))
        .dropDuplicates(["id", "pos", "place"])
    )
    arguments, name = F.col("c.function.arguments"), F.col("c.function.name")
    told = calls.select(
        "id", "pos", "place", "names", "mixed", F.col("c.id").alias("call_id"), F.col("c.type").alias("type"), name.alias("name"),
        (F.col("c").isNull() | F.col("c.type").isNull()).alias("bare"),
        F.col("c.function").isNull().alias("unwrapped"),
        (F.coalesce(F.octet_length(F.to_json("c")), F.lit(0))).alias("bytes"),
        F.coalesce(F.octet_length(arguments), F.lit(0)).alias("argument_bytes"),
        F.expr("schema_of_variant(try_parse_json(c.function.arguments))").alias("shape"),
        F.from_json(arguments, "map<string,string>").alias("given"),
    )
    before = Window.partitionBy("id", "call_id").orderBy("pos", "place")
    control = name_is(CONTROL_TOOL)
    texts = F.coalesce(F.regexp_replace("shape", r": STRING(, |>)", "").rlike(r"^OBJECT<([^:]*)$"), F.lit(False))
    path = F.try_element_at("given", F.lit("path"))
    code = (
        F.when(F.col("mixed"), "mixed_control_file_batch")
        .when(F.col("bytes") > MOST_CALL_BYTES, "call_envelope_limit")
        .when(F.col("bare") | (F.col("type") != "function"), "invalid_envelope")
        .when(F.col("argument_bytes") > MOST_ARGUMENT_BYTES, "envelope_size_limit")
        .when(F.col("unwrapped"), "invalid_function_envelope")
        .when(F.trim(F.coalesce("call_id", F.lit(""))) == "", "missing_id")
        .when(F.row_number().over(before) > 1, "duplicate_id")
        .when(F.coalesce("name", F.lit("")).rlike(r"^\s*$|\p{Cntrl}"), "invalid_function_name")
        .when(F.col("shape").isNull(), "invalid_arguments_json")
        .when(~F.col("shape").startswith("OBJECT"), "arguments_not_object")
        .when(~control & ~texts, "arguments_not_utf8_strings")
        .when(path.isNotNull() & ~T.safe_path(path), "unsafe_path")
        .when(~F.coalesce(F.array_contains("names", F.col("name")), F.lit(False)), "tool_unavailable")
    )
    reasons = F.create_map(*[F.lit(x) for pair in REJECTIONS.items() for x in pair])
    return told.select("id", "pos", "place", code.alias("code")).withColumn("reason", F.try_element_at(reasons, F.col("code")))


def name_is(name: str) -> Column:
    return F.coalesce(F.col("name") == name, F.lit(False))


def changed_paths(records: DataFrame, before: str, after: str) -> DataFrame:
    """``(id, path, change)`` where two file maps differ; a missing file differs from an empty one."""
    keys = F.array_union(F.map_keys(before), F.map_keys(after))
    rows = records.select("id", before, after, F.explode(keys).alias("path")).withColumns(
        {"b": F.try_element_at(before, F.col("path")), "a": F.try_element_at(after, F.col("path"))}
    )
    had = F.expr(f"map_contains_key({before}, path)")
    has = F.expr(f"map_contains_key({after}, path)")
    change = F.when(~had, "added").when(~has, "removed").otherwise("changed")
    return rows.where((had != has) | ~F.col("a").eqNullSafe(F.col("b"))).select("id", "path", change.alias("change")).distinct()


def exported(records: DataFrame) -> DataFrame:
    """Training rows: accepted records of the training split, messages and tools only."""
    kept = records.where("split = 'train' and review_status = 'accepted'")
    return kept.dropDuplicates(["id"]).select("id", "messages", "tools")
