"""Relational coverage on the star tables and events.

Each statement is written once, in the SQL that Spark and the oracle share; ``{name}``
stands for a table. Spark gets the tables as data frames, so nothing is registered and
Catalyst sees one plan from scan to result.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.session import staged, table


def _names(sql: str) -> set[str]:
    return {name for _, name, _, _ in string.Formatter().parse(sql) if name}


def statement(sql: str, ntz: tuple[str, ...] = ()) -> Callable[[SparkSession, str], DataFrame]:
    """A query that runs ``sql`` over the named tables."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(sql, **{name: table(spark, sf_dir, name) for name in _names(sql)})

    return run


STATEMENTS = {
    # scans, filters, aggregates
    "pricing_summary": """select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice), 2) as sum_base,
 round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) as sum_charge,
 round(avg(l_quantity), 6) as avg_qty, count(*) as n from {lineitem} where l_shipdate <= timestamp '2001-09-02 00:00:00' group by l_returnflag, l_linestatus""",
    "shipping_priority": """select o_orderkey, o_orderdate, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from {customer}
 join {orders} on c_custkey = o_custkey join {lineitem} on l_orderkey = o_orderkey where c_mktsegment = 'HOUSEHOLD' and o_orderdate < timestamp '1998-03-15 00:00:00'
 group by o_orderkey, o_orderdate order by revenue desc, o_orderkey limit 10""",
    "regional_volume": """select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from {customer} join {orders} on c_custkey = o_custkey
 join {lineitem} on l_orderkey = o_orderkey join {supplier} on l_suppkey = s_suppkey and c_nationkey = s_nationkey
 join {nation} on s_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey group by n_name""",
    "forecast_revenue": """select round(sum(l_extendedprice * l_discount), 2) as revenue, count(*) as n from {lineitem}
 where l_discount between 0.05 and 0.07 and l_quantity < 24""",
    "order_priority_check": """select o_orderpriority, count(*) as n from {orders} where exists (select 1 from {lineitem} where l_orderkey = o_orderkey and l_quantity > 40) group by o_orderpriority""",
    "customer_order_counts": """select c_count, count(*) as custdist from (select c_custkey, count(o_orderkey) as c_count from {customer} left join {orders} on c_custkey = o_custkey group by c_custkey) t group by c_count""",
    "large_volume_orders": """select o_orderkey, sum(l_quantity) as qty from {orders} join {lineitem} on o_orderkey = l_orderkey group by o_orderkey having sum(l_quantity) > 180""",
    # joins
    "join_inner_broadcast": "select n_name, r_name, count(*) as customers from {customer} join {nation} on c_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey group by n_name, r_name",
    "join_left": "select c_custkey, count(o_orderkey) as orders from {customer} left join {orders} on c_custkey = o_custkey and o_orderstatus = 'F' group by c_custkey",
    "join_full": """select coalesce(a.k, b.k) as k, a.n as early, b.n as late from (select o_custkey as k, count(*) as n from {orders} where o_orderdate < timestamp '1996-01-01 00:00:00' group by o_custkey) a
 full join (select o_custkey as k, count(*) as n from {orders} where o_orderdate >= timestamp '1998-06-01 00:00:00' group by o_custkey) b on a.k = b.k""",
    "join_semi": "select p_partkey, p_name from {part} where p_partkey in (select l_partkey from {lineitem} where l_quantity >= 49)",
    "join_anti": "select c_custkey from {customer} where not exists (select 1 from {orders} where o_custkey = c_custkey and o_totalprice > 100000)",
    "join_range": """select b.bin, count(*) as n from {orders} join (select 0 as bin, 0.0 as lo, 50000.0 as hi union all select 1, 50000.0, 200000.0 union all select 2, 200000.0, 1000000.0) b
 on o_totalprice >= b.lo and o_totalprice < b.hi group by b.bin""",
    "join_asof": """select event_id, user_id, prior_value from (select event_id, user_id, event_type, last_value(case when event_type = 'purchase' then value end) ignore nulls
 over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as prior_value from {events}) t where event_type = 'click'""".replace(") ignore nulls\n over", ") ignore nulls over"),
    "join_interval": """select a.user_id, count(*) as pairs from {events} a join {events} b on a.user_id = b.user_id and a.event_type = 'view' and b.event_type = 'purchase'
 and b.ts > a.ts and b.ts <= a.ts + interval '1' hour group by a.user_id""",
    # grouping sets and aggregates
    "agg_cube": "select o_orderstatus, o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total from {orders} group by cube (o_orderstatus, o_orderpriority)",
    "agg_rollup": "select l_returnflag, l_linestatus, count(*) as n from {lineitem} group by rollup (l_returnflag, l_linestatus)",
    "agg_grouping_sets": "select p_brand, p_type, count(*) as n, grouping(p_brand) as g from {part} group by grouping sets ((p_brand), (p_type), ())",
    "agg_distinct": "select l_suppkey, count(distinct l_partkey) as parts, count(distinct l_orderkey) as orders from {lineitem} group by l_suppkey",
    "agg_filter": "select event_type, count(*) filter (where value > 50) as high, count(*) filter (where value <= 50) as low, max(value) as top from {events} group by event_type",
    "agg_stats": "select event_type, round(stddev_pop(value), 6) as sd, round(var_pop(value), 4) as var, round(corr(value, cast(user_id as double)), 6) as corr from {events} group by event_type",
    "agg_having_max": "select o_custkey, max(o_totalprice) as top from {orders} group by o_custkey having count(*) >= 12",
    # windows
    "win_rank": "select o_orderkey, rank() over (partition by o_custkey order by o_orderdate) as r, dense_rank() over (partition by o_custkey order by o_orderdate) as d from {orders}",
    "win_ntile": "select c_custkey, ntile(4) over (partition by c_mktsegment order by c_acctbal, c_custkey) as quartile from {customer}",
    "win_percent_rank": "select s_suppkey, round(percent_rank() over (partition by s_nationkey order by s_acctbal), 9) as pr, round(cume_dist() over (partition by s_nationkey order by s_acctbal), 9) as cd from {supplier}",
    "win_lag_lead": "select event_id, value - lag(value) over (partition by user_id order by ts, event_id) as delta, lead(event_type) over (partition by user_id order by ts, event_id) as following from {events}",
    "win_range_frame": """select o_orderkey, count(*) over (partition by o_custkey order by o_orderdate range between interval '90' day preceding and current row) as recent from {orders}""",
    "win_running_sum": "select event_id, round(sum(value) over (partition by user_id order by ts, event_id rows unbounded preceding), 4) as running from {events}",
    "win_first_last": "select distinct user_id, first_value(event_type) over w as first_type, last_value(event_type) over w as last_type from {events} window w as (partition by user_id order by ts, event_id rows between unbounded preceding and unbounded following)",
    # set operations
    "set_union": "select c_nationkey as k from {customer} union select s_nationkey from {supplier}",
    "set_union_all": "select k, count(*) as n from (select c_nationkey as k from {customer} union all select s_nationkey from {supplier}) t group by k",
    "set_intersect": "select l_partkey as k from {lineitem} where l_quantity > 45 intersect select l_partkey from {lineitem} where l_discount = 0",
    "set_except": "select o_custkey as k from {orders} where o_orderstatus = 'F' except select o_custkey from {orders} where o_orderstatus = 'O'",
    "set_intersect_all": "select k, count(*) as n from (select l_suppkey as k from {lineitem} where l_returnflag = 'A' intersect all select l_suppkey from {lineitem} where l_returnflag = 'N') t group by k",
    "set_except_all": "select k, count(*) as n from (select l_suppkey as k from {lineitem} where l_returnflag = 'A' except all select l_suppkey from {lineitem} where l_returnflag = 'N') t group by k",
    # top-k and limits
    "top_customers": "select c_custkey, c_name, c_acctbal from {customer} order by c_acctbal desc, c_custkey limit 20",
    "top_per_nation": "select n_name, s_suppkey, k from (select n_name, s_suppkey, row_number() over (partition by s_nationkey order by s_acctbal desc, s_suppkey) as k from {supplier} join {nation} on s_nationkey = n_nationkey) t where k <= 3",
    # events as attempts: reports, ledgers, accounting
    "report_groups": """select event_type as model, count(*) as attempts, round(avg(value), 9) as mean, round(percentile_cont(0.5) within group (order by value), 9) as median,
 percentile_disc(0.95) within group (order by value) as p95 from {events} group by event_type""",
    "latest_attempt": "select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as k from {events}) t where k = 1",
    "paired_arms": """select count(*) as cases, round(avg(a.v), 9) as mean_a, round(avg(b.v), 9) as mean_b, round(avg(b.v - a.v), 9) as mean_difference from
 (select user_id, avg(value) as v from {events} where event_type = 'click' group by user_id) a join (select user_id, avg(value) as v from {events} where event_type = 'view' group by user_id) b on a.user_id = b.user_id""",
    "budget_running": """select event_id, round(spent, 4) as spent, high_water, case when spent > 500 then 'spend' when high_water > 90 then 'context' end as exhausted from
 (select event_id, sum(value) over (partition by user_id order by ts, event_id rows unbounded preceding) as spent, max(value) over (partition by user_id order by ts, event_id rows unbounded preceding) as high_water from {events}) t""",
    "first_exhausted": """select user_id, min(seq) as stopped_at from (select user_id, row_number() over (partition by user_id order by ts, event_id) as seq,
 sum(value) over (partition by user_id order by ts, event_id rows unbounded preceding) as spent from {events}) t where spent > 500 group by user_id""",
    "event_chain_gaps": """select user_id, count(*) as events, sum(case when gap > 1 then 1 else 0 end) as gaps, max(gap) as widest from
 (select user_id, event_id - lag(event_id) over (partition by user_id order by event_id) as gap from {events}) t group by user_id""",
    "session_gap_islands": """select user_id, count(*) as sessions, max(n) as longest from (select user_id, session, count(*) as n from
 (select user_id, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as session from
 (select user_id, ts, event_id, case when lag(ts) over (partition by user_id order by ts, event_id) is null or ts > lag(ts) over (partition by user_id order by ts, event_id) + interval '30' minute then 1 else 0 end as fresh from {events}) a) b
 group by user_id, session) c group by user_id""",
    "tumbling_day": "select cast(date_trunc('day', ts) as date) as day, event_type, count(*) as n, round(sum(value), 4) as total from {events} group by 1, 2",
    "ledger_totals": """select o_orderstatus as status, sum(cast(round(o_totalprice * 100) as bigint)) as cents, count(*) as entries,
 sum(case when o_orderstatus = 'P' then cast(round(o_totalprice * 100) as bigint) else 0 end) as reserved from {orders} group by o_orderstatus""",
    "cost_ceiling": "select l_orderkey, l_linenumber, cast(ceil(cast(l_extendedprice as decimal(18,2)) * cast(l_tax as decimal(4,2)) * 100) as bigint) as micro from {lineitem}",
    "group_advantage": """select l_orderkey, l_linenumber, case when k * q2 = s * s then 0.0 else round((k * r - s) / sqrt(cast(k * q2 - s * s as double)), 9) end as advantage from
 (select l_orderkey, l_linenumber, cast(l_quantity as bigint) as r, count(*) over w as k, sum(cast(l_quantity as bigint)) over w as s, sum(cast(l_quantity as bigint) * cast(l_quantity as bigint)) over w as q2
 from {lineitem} window w as (partition by l_orderkey)) t""",
    "group_decision_status": """select l_orderkey, case when sum(case when l_tax < 0 then 1 else 0 end) > 0 then 'invalid' when sum(case when l_returnflag = 'N' then 1 else 0 end) > 0 then 'pending'
 when count(*) * sum(cast(l_quantity as bigint) * cast(l_quantity as bigint)) = sum(cast(l_quantity as bigint)) * sum(cast(l_quantity as bigint)) then 'tie' else 'ready' end as status from {lineitem} group by l_orderkey""",
    "reward_components": """select l_orderkey, l_linenumber, case when l_linestatus = 'F' then (case when l_quantity > 10 then 4000 else 0 end + case when l_discount < 0.05 then 3500 else 0 end
 + case when l_returnflag = 'R' then 2500 else 0 end) else 0 end as reward from {lineitem}""",
    "checkpoint_growth": "select user_id, event_id, value - lag(value, 1, 0.0) over (partition by user_id order by ts, event_id) as growth from {events} where event_type = 'purchase'",
    "degradation": """select user_id, round(min_v - max_v, 9) as fallen from (select distinct user_id, first_value(value) over w as min_v, last_value(value) over w as max_v from {events}
 window w as (partition by user_id order by ts, event_id rows between unbounded preceding and unbounded following)) t""",
    "request_assignment": """select c_custkey as slot, c_custkey % 6 as family, cast(floor(c_custkey / 6) as bigint) % 25 as source, cast(floor(c_custkey / 150) as bigint) % 3 as variant from {customer}""",
    "inspect_plan": "select count(*) as attempts, sum(p_size) as minutes from {part} where p_size > 10",
    # annotated trajectories and reviews
    "judge_mean": "select source, count(*) as outputs, count(packet.output) as answered from {judgment_review} group by source",
    "coverage_grouping_sets": """select split, family, review_status, count(*) as n from {sft_mask_probes} group by grouping sets ((split), (family), (review_status))""",
    "split_leak_first_seen": """select author_id, count(distinct split) as splits, min(split) as first_split from {starter_design} where author_id is not null and split is not null group by author_id having count(distinct split) > 1""",
    "label_agreement": """select d.source, count(*) as labels, sum(l.toxic) as toxic, round(avg(l.quality), 9) as quality from {doc_labels} l join {documents} d on d.doc_id = l.doc_id group by d.source""",
    "compare_groups_len": """select kind, case when n_chars < 500 then 'short' when n_chars < 2000 then 'middle' when n_chars is null then 'unknown' else 'long' end as bin, count(*) as n, round(avg(n_chars), 6) as mean
 from {documents} group by 1, 2""",
    "reference_holdout": """select h.suite, count(distinct d.doc_id) as exact_copies from {heldout_items} h left join {documents} d on d.text = h.text group by h.suite""",
    "resume_missing": "select h.item_id from {heldout_items} h left join {documents} d on d.doc_id = h.item_id where d.doc_id is null",
    "delivery_lag": "select source, count(*) as n, sum(case when loaded_at > written_at + interval '1' day then 1 else 0 end) as late from {documents} group by source",
}


def pivot_status(spark, sf_dir):
    """Order counts with the statuses as columns."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)


def approx_parts(spark, sf_dir):
    """Approximate distinct parts per supplier."""
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"))


def props_usage_merge(spark, sf_dir):
    """Numeric leaves of the events' properties, summed by path."""
    leaves = table(spark, sf_dir, "events").select(
        F.explode(F.from_json("props", "map<string,double>")).alias("path", "value")
    )
    return leaves.groupBy("path").agg(F.round(F.sum("value"), 6).alias("total"), F.count("*").alias("n"))


def recursive_chain(spark, sf_dir):
    """The ancestry of every customer: ``(start, node, depth)``, by the half of each key."""
    customers = table(spark, sf_dir, "customer").where("c_custkey is not null").select(F.col("c_custkey").cast("long").alias("node"))
    walk = customers.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth"))
    out = walk
    while True:
        up = walk.where("node > 0").select("start", F.floor(F.col("node") / 2).alias("node"), F.expr("depth + 1").alias("depth"))
        walk = staged(up.join(customers, "node").select("start", "node", "depth"), "chain")
        if walk.isEmpty():
            return out
        out = out.unionByName(walk)


QUERIES = {name: statement(sql) for name, sql in STATEMENTS.items()} | {
    f.__name__: f for f in (pivot_status, approx_parts, props_usage_merge, recursive_chain)
}
ORACLES = {name: sql.format(**{n: n for n in _names(sql)}) for name, sql in STATEMENTS.items()} | {
    "pivot_status": """select o_orderpriority, count(*) filter (where o_orderstatus = 'F') as "F", count(*) filter (where o_orderstatus = 'O') as "O", count(*) filter (where o_orderstatus = 'P') as "P" from orders group by 1""",
    "recursive_chain": """with recursive walk(start, node, depth) as (select c_custkey::bigint, c_custkey::bigint, 0 from customer
 union all select w.start, c.c_custkey::bigint, depth + 1 from walk w join customer c on c.c_custkey = w.node // 2 where w.node > 0) select start, node, depth from walk""",
    "props_usage_merge": """select path, round(sum(v), 6) as total, count(*) as n from (select unnest(json_keys(props)) as path, props from events) t,
 lateral (select cast(json_extract(props, '$.' || path) as double) as v) group by path""",
}
ORACLES["join_asof"] = ORACLES["join_asof"].replace("end) ignore nulls over", "end ignore nulls) over")
