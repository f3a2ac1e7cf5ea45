"""Hand values of numbers and records; the registry; layering."""

import ast
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomwright.functions import numbers as N
from loomwright.operators import records as R

ROOT = Path(__file__).resolve().parents[1]


def test_fractions(spark):
    df = spark.createDataFrame([(6, 4), (-6, 4), (6, -4), (0, 5), (7, 0), (None, 3)], "a long, b long")
    got = [tuple(r.f) if r.f else None for r in df.select(N.reduced(F.col("a"), F.col("b")).alias("f")).collect()]
    assert got[:4] == [(3, 2), (-3, 2), (-3, 2), (0, 1)] and got[4] is None


def test_bytes_round_trip(spark):
    df = spark.createDataFrame([([0, 1, 255, 65536, 4294967295],), ([],)], "v array<long>")
    rows = df.select(N.u32_le(F.col("v")).alias("b"), "v").select("v", N.from_u32_le(F.col("b")).alias("w"), "b").collect()
    assert all(list(r.v) == list(r.w) for r in rows)
    assert bytes(rows[0].b)[4:8] == (1).to_bytes(4, "little")
    odd = spark.createDataFrame([(bytearray(b"abc"),)], "b binary").select(N.from_u32_le(F.col("b")).alias("w"))
    assert odd.first().w is None


def test_money_and_paths(spark):
    df = spark.createDataFrame([("0.0000001", "a/./b/../c"), ("1", "../x"), ("2.5", "a//b")], "m string, p string")
    got = [tuple(r) for r in df.select(N.micro_units(F.col("m")), N.normal_path(F.col("p"))).collect()]
    assert got == [(1, "a/c"), (1_000_000, "../x"), (2_500_000, "a/b")]


def test_sections_number_repeated_slugs(spark):
    df = spark.createDataFrame([(1, "intro\n# One\nx\n## One\ny\n# Two!"), (2, None), (3, "")], "id long, text string")
    got = [(r.key, r.ordinal, r.slug) for r in R.sections(df, "id", "text").orderBy("key", "ordinal").collect()]
    assert got == [(1, 0, ""), (1, 1, "one"), (1, 2, "one-1"), (1, 3, "two")]


def test_delimited_states(spark):
    df = spark.createDataFrame([("a <b> c </b> d",), ("<b> <b> </b>",), ("none",), (None,), ("</b> <b>",)], "t string")
    got = [(r.status, r.selected) for r in R.delimited(df, "t", F.lit("<b>"), F.lit("</b>")).collect()]
    assert got == [("ok", "c"), ("needs_review", None), ("missing_prose", None), ("missing_prose", None), ("needs_review", None)]


def test_rouge(spark):
    df = spark.createDataFrame([(1, "the cat sat", "the cat ran"), (2, "", "x"), (3, None, "x")], "id long, r string, c string")
    rows = {r.key: r for r in R.rouge(df, "id", "r", "c").collect()}
    assert rows[1].rouge1 == pytest.approx(2 / 3) and rows[1].rouge2 == pytest.approx(0.5) and rows[1].rougeL == pytest.approx(2 / 3)
    assert rows[2].rouge1 is None and 3 not in rows


def test_manifest_and_edges(spark):
    df = spark.createDataFrame([("g", "b", "2"), ("g", "a", "1"), ("g", "a", "1"), ("h", "x", None)], "g string, k string, v string")
    one = R.manifest(df, "g", "k", "v").collect()
    two = R.manifest(df.repartition(5), "g", "k", "v").collect()
    assert one == two and [r.members for r in one] == [2]
    edges = spark.createDataFrame([("n", 1, "a"), ("n", 2, "b"), ("m", None, "c"), ("m", 0, "d")], "n string, p int, e string")
    assert {r.n: (r.edge, r.status) for r in R.select_edge(edges, "n", "p", "e").collect()} == {"n": ("a", "ok"), "m": (None, "tie")}


def test_staged_tables_are_read_again_and_dropped(spark):
    from loomwright.session import drop_staged, staged

    df = staged(spark.range(10), "ten")
    assert df.count() == 10 and drop_staged(spark) >= 1
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|PATH_NOT_FOUND"):
        df.count()


def test_all_customers_and_documents_are_read(spark, tmp_path):
    import __spark_entry__ as entry

    keys = [1, 2, 3, 5, 10]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame(
        [(1, "scene", "# One\nan anchor"), (2, "brief", "the anchor"), (3, "wiki", "none"), (4, None, None)], "doc_id long, kind string, text string"
    ).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, "anchor"), (8, "absent"), (9, None)], "item_id long, title string").write.parquet(str(tmp_path / "heldout_items.parquet"))
    rows = lambda name: sorted(tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).collect())
    chains = {1: [1], 2: [2, 1], 3: [3, 1], 5: [5, 2, 1], 10: [10, 5, 2, 1]}
    assert rows("recursive_chain") == sorted((s, n, d) for s, chain in chains.items() for d, n in enumerate(chain))
    assert rows("anchor_containment") == [(7, 2), (8, 0), (9, 0)]
    assert {r[0] for r in rows("document_sections")} == {1, 2, 3}


def test_every_oracle_has_a_query():
    import __spark_entry__ as entry

    queries = entry.queries()
    assert set(entry.oracle_sql()) <= set(queries) and len(queries) > 150


def test_the_core_never_imports_the_subpackage():
    for path in (ROOT / "loomwright").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path
