"""Writers. A target that exists is refused unless the writer is an upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.operators.trajectory import exported
from loomwright.session import staged


def save_json(df: DataFrame, path: str) -> None:
    """JSON lines, moved into place when all are written; an existing target is an error."""
    df.write.mode("errorifexists").json(path)


def export_sft(records: DataFrame, path: str) -> int:
    """Accepted training records as JSON lines; their number. No record is an error."""
    rows = staged(exported(records).select("messages", "tools"), "export")
    count = rows.count()
    if not count:
        raise ValueError("no accepted training records")
    save_json(rows, path)
    return count


def put_artifacts(new: DataFrame, path: str) -> int:
    """Append content-addressed rows ``(hash, body, ...)`` that the table lacks; their number."""
    spark = new.sparkSession
    fresh = new.dropDuplicates(["hash"])
    try:
        known = spark.read.parquet(path).select("hash")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
    else:
        fresh = fresh.join(known, "hash", "left_anti")
    fresh = staged(fresh, "artifacts")  # read before the append changes the table
    count = fresh.count()
    if count:
        fresh.write.mode("append").parquet(path)
    return count


def merged_reviews(old: DataFrame, new: DataFrame, key: str, content: str, human: list[str]) -> DataFrame:
    """New reviews that keep the human fields where the content is the same.

    Where it changed, the human fields are null again and ``archived`` holds the old row;
    reviews that are only in the old table stay.
    """
    o, n = old.alias("o"), new.alias("n")
    same = F.col(f"o.{content}").eqNullSafe(F.col(f"n.{content}"))
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    gone, added = F.col(f"n.{key}").isNull(), F.col(f"o.{key}").isNull()
    return joined.select(
        F.coalesce(f"n.{key}", f"o.{key}").alias(key),
        F.when(gone, F.col(f"o.{content}")).otherwise(F.col(f"n.{content}")).alias(content),
        *[F.when(gone | (~added & same), F.col(f"o.{h}")).alias(h) for h in human],
        F.when(~gone & ~added & ~same, F.to_json(F.struct(*[F.col(f"o.{c}") for c in old.columns]))).alias("archived"),
    )


def commit_conflicts(commits: DataFrame) -> DataFrame:
    """``(lineage, parent, commits)`` where two commits of a lineage have the same parent.

    Plain files have no compare-and-set; heads are an append-only table, and this is the
    check that would have refused the second writer. Equal commits are the same retry.
    """
    return (
        commits.select("lineage", "parent", "commit")
        .distinct()
        .groupBy("lineage", F.coalesce("parent", F.lit("")).alias("parent"))
        .agg(F.count("*").alias("commits"))
        .where("commits > 1")
    )


def markdown_report(groups: DataFrame, order: list[str]) -> str:
    """A small report table as Markdown; the groups are a bounded summary."""
    rows = groups.orderBy(*order).toLocalIterator()
    head = "| " + " | ".join(groups.columns) + " |\n|" + "-|" * len(groups.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)])
