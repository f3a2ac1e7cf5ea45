"""Readers: JSON lines, CSV, text trees, HTML and EPUB stories, saved attempts, generators.

Schemas are always given, never inferred. A record that can't be read becomes a row with a
reason; readers that must not lose rows say so.
"""

from __future__ import annotations

import html.parser
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwright.functions import text as T


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object per line that isn't blank."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line, raw)``: lines numbered within a file from 1, blank ones included.

    Files are read in splits: a line's number is its place in the split plus the lines of
    the splits before, so no file has to fit in a task.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("place"),
        F.col("value").alias("raw"),
    )
    splits = lines.groupBy("path", "split").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return lines.join(offsets, ["path", "split"]).select(
        "file", (F.col("place") - F.col("first") + F.col("before") + 1).alias("line"), "raw"
    )


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``(file, line, record, reason)``: a line that is no object with unique keys keeps a reason.

    Lines are numbered within a file, blank ones included, from 1.
    """
    kept = numbered_lines(spark, path).where(T.strip(F.col("raw")) != "")
    parsed = F.expr("schema_of_variant(try_parse_json(raw))")
    reason = F.when(parsed.isNull(), "invalid JSON or repeated key").when(~parsed.startswith("OBJECT"), "not an object")
    return kept.select("file", "line", F.when(reason.isNull(), F.from_json("raw", schema)).alias("record"), reason.alias("reason"))


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV file with a header; every column a string, quoted cells may hold lines."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_positional_csv(spark: SparkSession, path: str) -> DataFrame:
    """``(id, title, url, year, reason)`` where only the title may hold commas; a line with
    fewer than three commas keeps a reason, its text stands in ``title``."""
    line = F.col("value")
    pattern = r"^([^,]*),(.*),([^,]*),([^,]*)$"
    names = ("id", "title", "url", "year")
    fits = line.rlike(pattern)
    return spark.read.text(path).select(
        *[F.when(fits, F.regexp_extract(line, pattern, k + 1)).otherwise(line if n == "title" else F.lit(None)).alias(n) for k, n in enumerate(names)],
        F.when(~fits, "fewer than four fields").alias("reason"),
    )


def list_dir(files: DataFrame, path: str, folder: str, most: int = 500) -> DataFrame:
    """The first ``most`` entries of a folder in order, folders marked by a slash."""
    prefix = folder.strip("/") + "/" if folder.strip("/") else ""
    inside = files.where(F.col(path).startswith(prefix)).select(F.substring(F.col(path), F.lit(len(prefix) + 1), F.length(path)).alias("rest"))
    entry = F.when(F.contains("rest", F.lit("/")), F.concat(F.split_part("rest", F.lit("/"), F.lit(1)), F.lit("/"))).otherwise(F.col("rest"))
    return inside.where("rest <> ''").select(entry.alias("entry")).distinct().orderBy("entry").limit(most)


def read_text_tree(spark: SparkSession, path: str) -> DataFrame:
    """``(id, text)`` of a tree of text files; the id is the file's stem, bad bytes are replaced.

    Spark's file scans pass over files without a byte, so those give no row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(path)
    name = F.regexp_extract("path", r"([^/]+)\.txt$", 1)
    return files.select(name.alias("id"), F.expr("decode(content, 'UTF-8')").alias("text"))


# Tags that part blocks and tags that hide what they hold; fixed values.
_PARTS_BEFORE = frozenset("p div br h1 h2 h3 li".split())
_PARTS_AFTER = frozenset("p div h1 h2 h3 li".split())
_HIDDEN = frozenset("script style nav".split())
_EMPTY_LINES = re.compile(r"\n[ \t]*\n(?:[ \t]*\n)+")


class _Text(html.parser.HTMLParser):
    """Collects visible text; ``depth`` counts the hidden tags that are open."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text = io.StringIO()
        self.depth = 0

    def _part(self, tag: str, tags: frozenset[str]) -> None:
        if self.depth == 0 and tag in tags:
            self.text.write("\n\n")

    def handle_starttag(self, tag, attrs):
        self.depth += tag in _HIDDEN
        self._part(tag, _PARTS_BEFORE)

    def handle_endtag(self, tag):
        if tag in _HIDDEN and self.depth:
            self.depth -= 1
        self._part(tag, _PARTS_AFTER)

    def handle_data(self, data):
        if self.depth == 0:
            self.text.write(data)


def html_to_text(page: str | None) -> str | None:
    """Visible text; blocks are parted by one blank line."""
    if page is None:
        return None
    reader = _Text()
    reader.feed(page)
    reader.close()
    return _EMPTY_LINES.sub("\n\n", reader.text.getvalue()).strip()


def html_text(pages: DataFrame, key: str, page: str) -> DataFrame:
    """``(key, text)`` of HTML pages, parsed by a real tokenizer in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([html_to_text(p) for p in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=["key", "text"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(F.col(key).alias("key"), F.col(page).cast("string")).mapInArrow(run, f"key {kind}, text string")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def epub_text(data: bytes, budget: int = 100 << 20) -> str:
    """The chapters of a book in spine order; parts out of the line of reading are skipped."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        if sum(i.file_size for i in book.infolist()) > budget:
            raise ValueError("book is larger than its budget")
        container = ElementTree.fromstring(book.read("META-INF/container.xml"))
        root = next(e.get("full-path") for e in container.iter() if _local(e.tag) == "rootfile")
        package = ElementTree.fromstring(book.read(root))
        items = {e.get("id"): e.get("href") for e in package.iter() if _local(e.tag) == "item"}
        spine = [e.get("idref") for e in package.iter() if _local(e.tag) == "itemref" and e.get("linear") != "no"]
        folder = posixpath.dirname(root)
        pages = [book.read(posixpath.normpath(posixpath.join(folder, items[i]))).decode("utf-8", "replace") for i in spine]
    return "\n\n".join(t for t in map(html_to_text, pages) if t)


def read_stories(spark: SparkSession, path: str) -> DataFrame:
    """``(id, format, text, reason)`` of txt, md, html and epub files; unreadable ones keep a reason."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    picked = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "content")

    def one(name: str, data: bytes) -> tuple[str, str | None, str | None]:
        kind = name.rpartition(".")[2].lower()
        try:
            if kind in ("txt", "md"):
                return kind, data.decode("utf-8-sig"), None
            if kind in ("html", "htm", "xhtml"):
                return "html", html_to_text(data.decode("utf-8", "replace")), None
            if kind == "epub":
                return kind, epub_text(data), None
            return kind, None, "unknown format"
        except Exception as error:  # the row tells what is wrong with the file
            return kind, None, f"{type(error).__name__}: {error}"[:200]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, data = (c.to_pylist() for c in batch.columns)
            rows = [(n.rpartition(".")[0] or n, *one(n, d)) for n, d in zip(names, data)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*rows)], names=["id", "format", "text", "reason"])

    return picked.mapInArrow(run, "id string, format string, text string, reason string")


def valid_prefix(lines: DataFrame, key: str, order: str, raw: str) -> DataFrame:
    """The lines of each trace before its first undecodable one; a torn tail is no error."""
    bad = F.when(F.expr(f"try_parse_json({raw})").isNull(), 1).otherwise(0)
    so_far = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("_bad", F.max(bad).over(so_far)).where("_bad = 0").drop("_bad")


def latest_attempts(attempts: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last attempt of every identity, with the states of all of them in order."""
    back = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    history = attempts.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(*order, "status"))), lambda x: x["status"]).alias("history")
    )
    last = attempts.withColumn("_k", F.row_number().over(back)).where("_k = 1").drop("_k")
    return last.join(history, key)


def checked_join(left: DataFrame, right: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that meet on all keys, hashes included, and the left rows that don't."""
    return left.join(right, on), left.join(right.select(*on), on, "left_anti")


def requests(spark: SparkSession, start: int, count: int, families: int, sources: int, variants: int) -> DataFrame:
    """Addressable assignments: request i doesn't depend on the others, so a run can resume anywhere."""
    i = F.col("id")
    return spark.range(start, start + count).select(
        i.alias("index"),
        (i % families).alias("family"),
        (F.floor(i / families) % sources).alias("source"),
        (F.floor(i / (families * sources)) % variants).alias("variant"),
        T.seed64(F.concat(F.lit("request:"), i.cast("string"))).alias("seed"),
    )
