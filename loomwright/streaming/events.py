"""Event streams: windows, deduplication, joins and ordered folds in Structured Streaming.

A query is run to the end of what has arrived (``availableNow``) and gives its result as a
table in the shared folder, so it can be compared with the batch result. Event time comes
from timestamps without zone; they are read in the session zone. Complete and update
results keep the last row of a key; append results would lack the windows above the final
watermark.

Defined results: events without a time or key are left out; an empty stream gives an empty
table; late events count as long as the watermark lets them in.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwright.session import shared_folder


def event_stream(spark: SparkSession, path: str, time: str = "ts") -> DataFrame:
    """A file stream over Parquet events with ``ts`` as a timestamp.

    The path may be one file; the source takes a file only by way of a pattern.
    """
    schema = spark.read.parquet(path).schema
    pattern = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).parquet(pattern).withColumn(time, F.col(time).cast("timestamp"))


def run_to_end(result: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Run a streaming result over all that is there and read what it wrote.

    With ``keys`` only the last row of a key is kept, by micro-batch: the final state of a
    complete or update query. Rows of each micro-batch are appended with its number, and a
    batch that runs again writes its rows again to the same place.
    """
    spark = result.sparkSession
    base = os.path.join(shared_folder(spark), f"stream-{uuid.uuid4().hex}")
    table = f"{base}/rows"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{table}/b={number}")

    query = (
        result.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{base}/checkpoint")
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in result.schema.fields)
    try:
        rows = spark.read.schema(fields + ", _batch long").parquet(f"{table}/b=*")
    except Exception:  # no micro-batch ran
        return spark.createDataFrame([], fields)
    if keys is None:
        return rows.drop("_batch")
    last = Window.partitionBy(*keys).orderBy(F.desc("_batch"))
    return rows.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k", "_batch")


def tumbling(events: DataFrame, width: str, keys: Iterable[str] = ("event_type",)) -> DataFrame:
    """Counts and sums of values in windows of ``width``: ``(start, *keys, n, total)``."""
    return (
        events.where("ts is not null")
        .withWatermark("ts", "1 hour")
        .groupBy(F.window("ts", width).alias("w"), *keys)
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("start"), *keys, "n", "total")
    )


def sliding(events: DataFrame, width: str, slide: str) -> DataFrame:
    """Events in overlapping windows: ``(start, n)``."""
    windows = events.where("ts is not null").withWatermark("ts", "1 hour").groupBy(F.window("ts", width, slide).alias("w"))
    return windows.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str, key: str = "user_id") -> DataFrame:
    """Runs of events of a key with pauses below ``gap``: ``(key, start, n)``."""
    one = events.where(f"ts is not null and {key} is not null").withWatermark("ts", "1 hour")
    runs = one.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return runs.select(key, F.col("w.start").alias("start"), "n")


def deduplicated(events: DataFrame, key: str = "event_id", delay: str = "2 hours") -> DataFrame:
    """The first arrival of every key; a later one within the delay is dropped."""
    return events.where(f"ts is not null and {key} is not null").withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def interval_join(left: DataFrame, right: DataFrame, key: str, within: str) -> DataFrame:
    """Pairs of a left event and a right event of the same key at most ``within`` later."""
    a = left.withWatermark("ts", "1 hour").alias("a")
    b = right.withWatermark("ts", "1 hour").alias("b")
    when = F.expr(f"a.{key} = b.{key} and b.ts > a.ts and b.ts <= a.ts + interval {within}")
    return a.join(b, when).select(F.col(f"a.{key}").alias(key), F.col("a.event_id").alias("left_id"), F.col("b.event_id").alias("right_id"))


# The phases of a keyed machine and what moves it on; fixed values.
PHASES = {
    ("idle", "view"): "looking",
    ("idle", "signup"): "known",
    ("looking", "click"): "engaged",
    ("engaged", "purchase"): "done",
    ("known", "view"): "looking",
    ("done", "view"): "looking",
}


def fold_events(rows: list[tuple], state: tuple) -> tuple:
    """Fold ``(order, event_type, value)`` rows into ``(seen, total, high, phase, last)``.

    Rows at or before ``last`` are duplicates or stale and change nothing.
    """
    seen, total, high, phase, last = state
    for order, kind, value in sorted(rows):
        if order <= last:
            continue
        value = 0.0 if value is None or value != value else value
        seen, total, high, last = seen + 1, total + value, max(high, value), order
        phase = "failed" if kind == "error" and phase != "done" else PHASES.get((phase, kind), phase)
        if kind != "error" and phase == "failed":
            phase = "idle"
    return seen, total, high, phase, last


FOLD_OUT = "user_id long, seen long, total double, high double, phase string, last long"
_START = (0, 0.0, float("-inf"), "idle", -1)


def folded_stream(events: DataFrame) -> DataFrame:
    """The ordered fold of every user as a stateful stream in update mode."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else _START
        rows: list[tuple] = []
        for frame in frames:
            rows.extend(zip(frame["event_id"].tolist(), frame["event_type"].tolist(), frame["value"].tolist()))
        now = fold_events(rows, now)
        state.update(now)
        yield pd.DataFrame([(key[0], *now)], columns=["user_id", "seen", "total", "high", "phase", "last"])

    picked = events.where("user_id is not null and event_id is not null").select("user_id", "event_id", "event_type", "value")
    return picked.groupBy("user_id").applyInPandasWithState(
        step, FOLD_OUT, "seen long, total double, high double, phase string, last long", "update", "NoTimeout"
    )


def folded_batch(events: DataFrame) -> DataFrame:
    """The same fold over a table."""

    def whole(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rows = list(zip(frame["event_id"].tolist(), frame["event_type"].tolist(), frame["value"].tolist()))
        return pd.DataFrame([(key[0], *fold_events(rows, _START))], columns=["user_id", "seen", "total", "high", "phase", "last"])

    picked = events.where("user_id is not null and event_id is not null").select("user_id", "event_id", "event_type", "value")
    return picked.groupBy("user_id").applyInPandas(whole, FOLD_OUT)


def both(spark: SparkSession, path: str, build: Callable[[DataFrame], DataFrame], mode: str, keys: list[str] | None) -> DataFrame:
    """Build a result on the stream over ``path`` and run it to the end."""
    return run_to_end(build(event_stream(spark, path)), mode, keys)
