"""Deeply nested records turned into related flat tables by adjacency shredding.

A document becomes rows ``(record_id, node, parent, path, label, ordinal, kind,
parent_label, parent_kind, scalar)``: one row for each object, array, scalar and null.
Object nodes are then joined with their scalar children and pivoted into entity rows.
The join and the pivot are one grouping on ``(record_id, node)``: a scalar row is sent
to its parent's key, an object row to its own, so that the nodes cross the network once.

Defined results: a null, empty or broken document gives no rows; a repeated record
gives its rows once; null array elements keep their place and are not listed; members
of an object take their place in ascending key order.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE_SCHEMA = (
    "record_id string, node int, parent int, path string, label string, ordinal int, "
    "kind string, parent_label string, parent_kind string, scalar string"
)
_ARROW = pa.schema(
    [
        ("record_id", pa.string()),
        ("node", pa.int32()),
        ("parent", pa.int32()),
        ("path", pa.string()),
        ("label", pa.string()),
        ("ordinal", pa.int32()),
        ("kind", pa.string()),
        ("parent_label", pa.string()),
        ("parent_kind", pa.string()),
        ("scalar", pa.string()),
    ]
)


def _reject(token: str):
    raise ValueError(token)


def parse_strict(text: str | None):
    """One JSON value, or ``ValueError``; NaN and infinities are no JSON."""
    if text is None:
        raise ValueError("null")
    return json.loads(text, parse_constant=_reject)


def _plain(value) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    text = value if isinstance(value, str) else json.dumps(value)
    return text.encode("utf-8", "replace").decode("utf-8")


def document_nodes(value, embedded: frozenset[str], keep: frozenset[str] | None) -> Iterator[tuple]:
    """Adjacency rows of one parsed document, without its record id.

    ``embedded`` labels may hold their object or array as a JSON string. With ``keep``,
    scalars under other labels are left out; objects and arrays always stay.
    """
    count = 0
    stack = [(value, -1, "", "", 0, "", "")]
    while stack:
        item, parent, path, label, ordinal, parent_label, parent_kind = stack.pop()
        if isinstance(item, str) and label in embedded:
            try:
                inner = parse_strict(item)
            except (ValueError, RecursionError):
                inner = item
            if isinstance(inner, (list, dict)):
                item = inner
        node, count = count, count + 1
        if isinstance(item, dict):
            yield node, parent, path, label, ordinal, "object", parent_label, parent_kind, None
            for place, key in enumerate(sorted(item)):
                inside = f"{path}.{key}" if path else key
                stack.append((item[key], node, inside, key, place, label, "object"))
        elif isinstance(item, list):
            yield node, parent, path, label, ordinal, "array", parent_label, parent_kind, None
            for place, element in enumerate(item):
                stack.append((element, node, f"{path}[{place}]", "", place, label, "array"))
        elif keep is None or label in keep:
            kind = "null" if item is None else "scalar"
            text = None if item is None else _plain(item)
            yield node, parent, path, label, ordinal, kind, parent_label, parent_kind, text


def shred(
    df: DataFrame,
    record_id: Column,
    document: Column,
    embedded: Iterable[str] = (),
    keep: Iterable[str] | None = None,
) -> DataFrame:
    """The adjacency table of a JSON column; see :func:`document_nodes`."""
    inside = frozenset(embedded)
    wanted = None if keep is None else frozenset(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    value = parse_strict(text)
                except (ValueError, RecursionError):
                    continue
                for row in document_nodes(value, inside, wanted):
                    rows.append((rid, *row))
                if len(rows) >= 20_000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    picked = df.select(record_id.cast("string").alias("record_id"), document.alias("document"))
    return picked.where("document is not null").mapInArrow(run, NODE_SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows)
    arrays = [
        pa.array(
            [x.encode("utf-8", "replace").decode("utf-8") if isinstance(x, str) else x for x in column]
            if field.name in ("path", "label", "parent_label")
            else list(column),
            field.type,
        )
        for column, field in zip(columns, _ARROW)
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=_ARROW)


def entities(nodes: DataFrame, scalars: Iterable[str]) -> DataFrame:
    """Object nodes joined with their scalar children, the scalars pivoted to columns.

    A scalar that is missing or null is null. The columns are named ``s_<label>``.
    """
    is_object = F.col("kind") == "object"
    own = lambda name: F.max(F.when(is_object, F.col(name))).alias(name)
    names = list(scalars)
    grouped = (
        nodes.where(is_object | ((F.col("kind") == "scalar") & F.col("label").isin(names)))
        .withColumn("at", F.when(is_object, F.col("node")).otherwise(F.col("parent")))
        .groupBy("record_id", "at")
        .agg(
            *[own(c) for c in ("parent", "path", "label", "ordinal", "parent_label", "parent_kind")],
            *[
                F.max(F.when((~is_object) & (F.col("label") == n), F.col("scalar"))).alias(f"s_{n}")
                for n in names
            ],
        )
    )
    return grouped.where("path is not null").withColumnRenamed("at", "node")


def check_table(nodes: DataFrame, label: str = "checks", marker: str = "kind") -> DataFrame:
    """The objects under ``label``: array elements, keyed members, or one lone object.

    Gives ``record_id, parent_path, child_kind, child_pos, child_id``. An object under
    ``label`` that has the scalar ``marker`` is itself the child, at place 0; otherwise
    its members are, with their key as id.
    """
    objects = entities(nodes, ["id", marker])
    suffix = rf"\.?{label}(\[\d+\])?$"
    lone = (F.col("label") == label) & F.col(f"s_{marker}").isNotNull()
    listed = (F.col("parent_label") == label) & (F.col("parent_kind") == "array")
    keyed = (F.col("parent_label") == label) & (F.col("parent_kind") == "object")
    direct = objects.where(lone | listed).select(
        "record_id",
        F.regexp_replace("path", suffix, "").alias("parent_path"),
        F.when(lone, F.lit(0)).otherwise(F.col("ordinal")).alias("child_pos"),
        F.coalesce("s_id", F.lit("")).alias("child_id"),
    )
    singles = objects.where(lone).select("record_id", F.col("node").alias("parent"))
    members = (
        objects.where(keyed)
        .join(singles, ["record_id", "parent"], "left_anti")
        .select(
            "record_id",
            F.expr(f"left(path, length(path) - length(label) - {len(label) + 1})").alias("owner"),
            F.col("ordinal").alias("child_pos"),
            F.col("label").alias("child_id"),
        )
        .select("record_id", F.regexp_replace("owner", r"\.$", "").alias("parent_path"), "child_pos", "child_id")
    )
    return direct.unionByName(members).select(
        "record_id", "parent_path", F.lit("check").alias("child_kind"), "child_pos", "child_id"
    )


def call_nodes(df: DataFrame, record_id: str, messages: str, keep: Iterable[str]) -> DataFrame:
    """The adjacency rows of the tool calls in an array of message structs, with the scalars of ``keep``.

    A call is an object under ``tool_calls``, its scalar fields and those of its
    ``function`` are its scalar children. The fields are typed, so the rows come from
    expressions; they have the columns of :func:`shred`, but nodes count calls only.
    """
    calls = (
        df.select(F.col(record_id).cast("string").alias("record_id"), F.posexplode(messages).alias("i", "m"))
        .where("m.tool_calls is not null")
        .select("record_id", "i", F.posexplode("m.tool_calls").alias("j", "c"))
        .where("c is not null")
        .withColumn("node", F.expr("shiftleft(cast(i as bigint), 32) + j"))
    )
    fields = {f.name: f.dataType for f in calls.schema["c"].dataType.fields}
    scalars = [(n, F.col(f"c.{n}")) for n, kind in fields.items() if not hasattr(kind, "fields")]
    if "function" in fields and hasattr(fields["function"], "fields"):
        scalars += [(f.name, F.col(f"c.function.{f.name}")) for f in fields["function"].fields]
    wanted = frozenset(keep)

    def row(kind: str, label: str, ordinal: Column, scalar: Column, own: bool) -> Column:
        return F.struct(
            (F.col("node") if own else F.lit(None).cast("bigint")).alias("node"),
            (F.col("i").cast("bigint") if own else F.col("node")).alias("parent"),
            F.format_string("messages[%d].tool_calls[%d]", "i", "j").alias("path"),
            F.lit(label).alias("label"),
            ordinal.cast("int").alias("ordinal"),
            F.lit(kind).alias("kind"),
            F.lit("tool_calls" if own else "").alias("parent_label"),
            F.lit("array" if own else "object").alias("parent_kind"),
            scalar.cast("string").alias("scalar"),
        )

    rows = [row("object", "", F.col("j"), F.lit(None), True)]
    rows += [row("scalar", name, F.lit(place), value, False) for place, (name, value) in enumerate(scalars) if name in wanted]
    listed = calls.select("record_id", F.explode(F.array(*rows)).alias("n")).select("record_id", "n.*")
    return listed.where("kind = 'object' or scalar is not null")


def call_table(df: DataFrame, record_id: str, messages: str) -> DataFrame:
    """One row for each tool call in an array of message structs; parent ``messages[i]``."""
    return entities(call_nodes(df, record_id, messages, ["id"]), ["id"]).select(
        "record_id",
        F.split_part("path", F.lit("."), F.lit(1)).alias("parent_path"),
        F.lit("tool_call").alias("child_kind"),
        F.col("ordinal").alias("child_pos"),
        F.coalesce("s_id", F.lit("")).alias("child_id"),
    )


def call_entities(df: DataFrame, record_id: str, messages: str) -> DataFrame:
    """``(record_id, message, place, id, name, arguments)``: the calls with their fields."""
    names = ["id", "name", "arguments"]
    return entities(call_nodes(df, record_id, messages, names), names).select(
        "record_id",
        F.col("parent").cast("int").alias("message"),
        F.col("ordinal").alias("place"),
        F.col("s_id").alias("id"),
        F.col("s_name").alias("name"),
        F.col("s_arguments").alias("arguments"),
    )


def tool_table(df: DataFrame, record_id: str, tools: str) -> DataFrame:
    """One row for each tool document in an array of JSON strings; parent ``$``.

    The name is that of the ``function`` wrapper if there is one, else the document's.
    """
    listed = df.select(
        F.col(record_id).cast("string").alias("rid"), F.posexplode(tools).alias("place", "document")
    )
    # record and place travel as one key, so that each tool document is a record of its own
    keyed = F.concat_ws(":", F.col("place"), F.col("rid"))
    objects = entities(shred(listed, keyed, F.col("document"), keep=["name"]), ["name"])
    wrapped = F.max(F.when(F.col("path") == "function", F.coalesce("s_name", F.lit(""))))
    bare = F.max(F.when(F.col("path") == "", F.coalesce("s_name", F.lit(""))))
    return (
        objects.where("path in ('', 'function')")
        .groupBy("record_id")
        .agg(F.coalesce(wrapped, bare).alias("child_id"), bare.alias("root"))
        .where("root is not null")
        .select(
            F.expr("substring(record_id, instr(record_id, ':') + 1)").alias("record_id"),
            F.lit("$").alias("parent_path"),
            F.lit("tool").alias("child_kind"),
            F.expr("cast(split_part(record_id, ':', 1) as int)").alias("child_pos"),
            "child_id",
        )
    )


def nested_children(probes: DataFrame, longform: DataFrame) -> DataFrame:
    """Calls and tools of the probes and checks of the long-form bodies, linked to parents."""
    calls = call_table(probes, "id", "messages")
    tools = tool_table(probes, "id", "tools")
    nodes = shred(longform, F.col("spec_id"), F.col("body"), embedded=["checks"], keep=["id", "kind"])
    checks = check_table(nodes).where(F.col("parent_path").rlike(r"^cases\[\d+\](\.followups\[\d+\])?$"))
    return calls.unionByName(tools).unionByName(checks)


def first_difference(pairs: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """``(key, path)``: the first path, members in key order and elements by place, where two
    JSON documents differ; null where they are equal.

    Both sides are shredded; a path differs if only one side has it or if kind or value
    do. The root's path is empty. A document that is no JSON has no paths.
    """
    sides = [
        shred(pairs, F.col(key), F.col(c)).select("record_id", "path", F.struct("kind", F.coalesce("scalar", F.lit("")).alias("scalar")).alias(name))
        for c, name in ((left, "l"), (right, "r"))
    ]
    both = sides[0].join(sides[1], ["record_id", "path"], "full").where(~F.col("l").eqNullSafe(F.col("r")))
    steps = F.transform(F.split("path", r"[.\[]"), lambda x: F.when(x.rlike(r"^\d+\]$"), F.lpad(x, 12, "0")).otherwise(x))
    first = both.groupBy("record_id").agg(F.min(F.struct(steps.alias("steps"), "path"))["path"].alias("path"))
    named = pairs.select(F.col(key).cast("string").alias("record_id")).distinct()
    return named.join(first, "record_id", "left").select(F.col("record_id").alias(key), "path")
