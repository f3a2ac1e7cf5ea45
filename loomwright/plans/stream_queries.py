"""Streaming queries, run to the end of the events, with the SQL of the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.streaming import events as S


def _path(sf_dir: str) -> str:
    return f"{sf_dir}/events.parquet"


def stream_tumbling(spark, sf_dir):
    """Daily counts by type, in complete mode."""
    out = S.both(spark, _path(sf_dir), lambda e: S.tumbling(e, "1 day"), "complete", ["start", "event_type"])
    return out.select(F.col("start").cast("date").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_sliding(spark, sf_dir):
    """Events in windows of six hours every three hours."""
    out = S.both(spark, _path(sf_dir), lambda e: S.sliding(e, "6 hours", "3 hours"), "complete", ["start"])
    return out.select(F.unix_timestamp("start").alias("start"), "n")


def stream_sessions(spark, sf_dir):
    """Sessions with pauses below thirty minutes, in complete mode."""
    out = S.both(spark, _path(sf_dir), lambda e: S.sessions(e, "30 minutes"), "complete", ["user_id", "start"])
    return out.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def stream_dedupe(spark, sf_dir):
    """Every event twice, each kept once."""
    out = S.both(spark, _path(sf_dir), lambda e: S.deduplicated(e.unionByName(e)), "append", None)
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def stream_interval_join(spark, sf_dir):
    """Views followed by a purchase of the user within the hour."""

    def build(e):
        one = e.select("user_id", "event_id", "ts", "event_type")
        return S.interval_join(one.where("event_type = 'view'"), one.where("event_type = 'purchase'"), "user_id", "1 hour")

    out = S.both(spark, _path(sf_dir), build, "append", None)
    return out.groupBy("user_id").agg(F.count("*").alias("pairs"))


def stateful_fold(spark, sf_dir):
    """The ordered fold of every user by a stateful stream."""
    out = S.both(spark, _path(sf_dir), S.folded_stream, "update", ["user_id"])
    return out.select("user_id", "seen", F.round("total", 4).alias("total"), "high", "last")


def fold_phases(spark, sf_dir):
    """Users by the phase that the batch fold ends in."""
    return S.folded_batch(spark.read.parquet(_path(sf_dir))).groupBy("phase").agg(F.count("*").alias("users"))


QUERIES = {
    f.__name__: f
    for f in (stream_tumbling, stream_sliding, stream_sessions, stream_dedupe, stream_interval_join, stateful_fold, fold_phases)
}

ORACLES = {
    "stream_tumbling": "select cast(ts as date) as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by all",
    "stream_sliding": """with w as (select epoch(ts)::bigint as t, unnest([0, 1]) as k from events), s as (select (t // 10800 - k) * 10800 as start from w)
 select start, count(*) as n from s group by start""",
    "stream_sessions": """with s as (select *, case when ts >= lag(ts) over w + interval '30' minute or lag(ts) over w is null then 1 else 0 end as fresh from events window w as (partition by user_id order by ts, event_id)),
 g as (select *, sum(fresh) over (partition by user_id order by ts, event_id) as g from s), c as (select user_id, g, count(*) as n from g group by user_id, g)
 select user_id, count(*) as sessions, max(n) as longest from c group by user_id""",
    "stream_dedupe": "select event_type, count(*) as n, sum(event_id)::bigint as ids from events group by event_type",
    "stream_interval_join": """select a.user_id, count(*) as pairs from events a join events b on a.user_id = b.user_id and a.event_type = 'view' and b.event_type = 'purchase'
 and b.ts > a.ts and b.ts <= a.ts + interval '1' hour group by a.user_id""",
    "stateful_fold": "select user_id, count(*) as seen, round(sum(value), 4) as total, max(value) as high, max(event_id) as last from events group by user_id",
}
