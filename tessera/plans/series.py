"""Queries of order: rolling values, rates, ranks, blocks, streaks, slices."""

from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import windows as W
from tessera.plans.catalog import register
from tessera.streaming import ledgers

SECONDS = "floor(epoch(ts))::BIGINT"


def timed(t):
    return t.events.withColumn("s", F.unix_timestamp("ts"))


TIMED = f"SELECT *, {SECONDS} AS s FROM events"


@register(
    "rolling_median_centered",
    "SELECT event_id, quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 20 PRECEDING AND 20 FOLLOWING) AS rolling FROM events",
    "rolling",
)
def rolling_median_centered(t):
    return W.rolling_median(t.events, ["user_id"], ["ts", "event_id"], "value", 41).select("event_id", "rolling")


RATES = f"""SELECT user_id, i AS interval, (s + s2) / 2.0::DOUBLE AS middle, (v2 - value) / (s2 - s) AS velocity FROM (SELECT user_id, value, s, lead(s) OVER w AS s2, lead(value) OVER w AS v2, row_number() OVER w - 1 AS i
    FROM ({TIMED}) WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)) WHERE s2 > s"""


@register("velocity_intervals", f"SELECT user_id, CAST(interval AS INTEGER) AS interval, middle, velocity FROM ({RATES})", "middle velocity")
def velocity_intervals(t):
    return W.velocities(timed(t), ["user_id"], "s", "value", ["event_id"])


@register(
    "velocity_summary",
    f"""SELECT user_id, count(*) AS n, avg(velocity) AS mean, quantile_cont(velocity, 0.5) AS median, stddev_samp(velocity) AS sd, avg((velocity < 0)::INTEGER) AS falling, avg((velocity > 0)::INTEGER) AS rising,
    quantile_cont(velocity, 0.05) AS p05, quantile_cont(velocity, 0.95) AS p95 FROM ({RATES}) GROUP BY 1""",
    "mean median sd falling rising p05 p95",
)
def velocity_summary(t):
    return W.velocity_summary(W.velocities(timed(t), ["user_id"], "s", "value", ["event_id"]), ["user_id"])


@register("cumulative_count", "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS INTEGER) AS nth FROM events")
def cumulative_count(t):
    return W.numbered(t.events, ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "nth")


@register("multi_key_rank", "SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC NULLS LAST, p_retailprice NULLS LAST, p_partkey) AS INTEGER) AS rank FROM part")
def multi_key_rank(t):
    return W.numbered(t.part, ["p_brand"], [F.desc_nulls_last("p_size"), F.asc_nulls_last("p_retailprice"), "p_partkey"], "rank", 1).select("p_partkey", "rank")


@register("average_rank", "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0::DOUBLE AS rank FROM part", "rank")
def average_rank(t):
    from tessera.operators.aggregates import average_rank as ranked

    return t.part.select("p_partkey", ranked("p_size", ["p_brand"]).alias("rank"))


@register(
    "percentile_rank_class",
    """SELECT p_partkey, percentile, CASE WHEN percentile >= 90 THEN 'top' WHEN percentile >= 50 THEN 'upper' WHEN percentile >= 10 THEN 'lower' ELSE 'bottom' END AS class
    FROM (SELECT p_partkey, 100 * cume_dist() OVER (PARTITION BY p_brand ORDER BY p_retailprice) AS percentile FROM part)""",
    "percentile",
)
def percentile_rank_class(t):
    p = F.col("percentile")
    return W.percentile_rank(t.part, ["p_brand"], "p_retailprice").select("p_partkey", "percentile", C.first_match([(p >= 90, "top"), (p >= 50, "upper"), (p >= 10, "lower")], "bottom").alias("class"))


@register("first_per_group", "SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def first_per_group(t):
    return W.heads(t.orders, ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"]).select("o_orderkey", "o_custkey")


@register("head_n_per_group", "SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def head_n_per_group(t):
    return W.heads(t.orders, ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3).select("o_orderkey", "o_custkey")


@register("equal_count_blocks", "SELECT event_id, CAST(ntile(5) OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS block FROM events")
def equal_count_blocks(t):
    return W.blocks(t.events, ["user_id"], ["ts", "event_id"], 5).select("event_id", "block")


@register(
    "quantile_blocks",
    """SELECT event_id, CAST(greatest(0, ceil(CASE WHEN n > 1 THEN p * 5 / (n - 1)::DOUBLE END) - 1) AS INTEGER) AS block
    FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS p, count(*) OVER (PARTITION BY user_id) AS n FROM events)""",
)
def quantile_blocks(t):
    return W.quantile_blocks(t.events, ["user_id"], ["ts", "event_id"], 5).select("event_id", "block")


@register(
    "time_block_stability",
    """WITH b AS (SELECT event_type, ntile(5) OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS block FROM events), c AS (SELECT CAST(block AS INTEGER) AS block, event_type, count(*) AS n FROM b GROUP BY 1, 2)
    SELECT block, event_type, n, n / sum(n) OVER (PARTITION BY block) AS share FROM c""",
    "share",
)
def time_block_stability(t):
    return W.block_shares(W.blocks(t.events, ["user_id"], ["ts", "event_id"], 5), "event_type", "block")


@register(
    "tail_aggregate",
    f"SELECT user_id, count(*) AS n, avg(value) AS mean FROM (SELECT *, max(s) OVER (PARTITION BY user_id) AS last FROM ({TIMED})) WHERE s >= last - 86400 GROUP BY 1",
    "mean",
)
def tail_aggregate(t):
    return W.tail(timed(t), ["user_id"], "s", 86400).groupBy("user_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


@register(
    "run_length_rises",
    """WITH e AS (SELECT user_id, row_number() OVER w AS r, coalesce(value > lag(value) OVER w, false) AS up FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, CAST(max(r) - coalesce(max(r) FILTER (NOT up), 0) AS INTEGER) AS rises FROM e GROUP BY 1""",
)
def run_length_rises(t):
    return W.closing_rises(t.events, ["user_id"], ["ts", "event_id"], "value")


@register(
    "run_verdict",
    """WITH e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events)
    SELECT user_id, count(*) AS n, arg_max(value, r) - arg_min(value, r) AS from_first, arg_max(value, r) - min(value) AS from_best, max(value) FILTER (r > n - 8) - min(value) FILTER (r > n - 8) AS recent_range FROM e GROUP BY user_id""",
    "from_first from_best recent_range",
)
def run_verdict(t):
    return W.run_verdict(t.events, ["user_id"], ["ts", "event_id"], "value")


@register(
    "convergence_streak",
    """WITH e AS (SELECT user_id, event_id, coalesce((lag(value) OVER w - value) / greatest(abs(lag(value) OVER w), 1e-12) < 0.05, false) AS small FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    s AS (SELECT *, sum(small::INTEGER) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS streak FROM e) SELECT user_id, min(event_id) FILTER (streak >= 2) AS converged FROM s GROUP BY 1""",
)
def convergence_streak(t):
    return W.converged_at(t.events, ["user_id"], "event_id", "value")


@register(
    "group_relabel",
    """WITH g AS (SELECT s_nationkey, avg(s_acctbal) AS mean FROM supplier GROUP BY 1) SELECT s_nationkey, 'Group ' || row_number() OVER (ORDER BY (s_nationkey = 3) DESC, mean DESC, s_nationkey) AS label FROM g""",
)
def group_relabel(t):
    g = t.supplier.groupBy("s_nationkey").agg(F.avg("s_acctbal").alias("mean"))
    return W.relabelled(g, [F.desc("mean"), F.col("s_nationkey")], F.col("s_nationkey") == 3).select("s_nationkey", "label")


ERF = "(1 - {t} * (0.254829592::DOUBLE + {t} * (-0.284496736::DOUBLE + {t} * (1.421413741::DOUBLE + {t} * (-1.453152027::DOUBLE + {t} * 1.061405429::DOUBLE)))) * exp(-x * x))"


@register(
    "zscore_rank",
    f"""WITH z AS (SELECT s_suppkey, stddev_pop(s_acctbal) OVER w AS sd, (s_acctbal - avg(s_acctbal) OVER w) / nullif(stddev_pop(s_acctbal) OVER w, 0) AS z FROM supplier WINDOW w AS (PARTITION BY s_nationkey)),
    e AS (SELECT *, z / sqrt(2.0::DOUBLE) AS x FROM z), q AS (SELECT *, 1 / (1 + 0.3275911::DOUBLE * abs(x)) AS t FROM e) SELECT s_suppkey, CASE WHEN sd < 1e-9 THEN 0.5 ELSE 0.5 * (1 + sign(x) * {ERF.format(t="t")}) END AS score FROM q""",
    "score",
)
def zscore_rank(t):
    return W.normal_scores(t.supplier, ["s_nationkey"], "s_acctbal").select("s_suppkey", "score")


@register(
    "robust_scale",
    """WITH r AS (SELECT s_acctbal AS v, row_number() OVER (ORDER BY s_acctbal) - 1 AS i, count(*) OVER () AS n FROM supplier),
    b AS (SELECT min(v) FILTER (i = CAST(round_even((n - 1) * 0.05::DOUBLE, 0) AS BIGINT)) AS lo, min(v) FILTER (i = CAST(round_even((n - 1) * 0.95::DOUBLE, 0) AS BIGINT)) AS hi FROM r)
    SELECT s_suppkey, CASE WHEN abs(hi - lo) < 1e-12 THEN 0.5 ELSE greatest(0, least(1, (s_acctbal - lo) / (hi - lo))) END AS scaled FROM supplier CROSS JOIN b""",
    "scaled",
)
def robust_scale(t):
    return W.robust_scaled(t.supplier, "s_acctbal").select("s_suppkey", "scaled")


@register("unique_id_suffix", "SELECT p_partkey, p_brand || CASE WHEN r = 1 THEN '' ELSE '_dup' || r END AS unique_id FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part)")
def unique_id_suffix(t):
    return W.unique_ids(t.part, "p_brand", ["p_partkey"]).select("p_partkey", "unique_id")


@register("next_sequential_id", "SELECT n_nationkey, 'S' || lpad(CAST(5 + row_number() OVER (ORDER BY n_nationkey) AS VARCHAR), 6, '0') AS seq_id FROM nation")
def next_sequential_id(t):
    ledger = t.region.select(F.concat(F.lit("S"), F.lpad((F.col("r_regionkey") + 1).cast("string"), 6, "0")).alias("seq_id"))
    return W.next_ids(ledger, t.nation, "seq_id", ["n_nationkey"]).select("n_nationkey", "seq_id")


@register("state_machine_groups", "SELECT event_id, sum((event_type = 'signup')::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS \"group\" FROM events")
def state_machine_groups(t):
    return W.grouped_by_flag(t.events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup").select("event_id", "group")


@register(
    "marker_slice",
    """WITH b AS (SELECT *, max((event_type = 'signup')::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS inn FROM events),
    o AS (SELECT *, coalesce(max((event_type = 'purchase')::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM b WHERE inn = 1) SELECT event_id, user_id FROM o WHERE done = 0""",
)
def marker_slice(t):
    return W.marked_slice(t.events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", F.col("event_type") == "purchase").select("event_id", "user_id")


@register("stride_sample", "SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS p FROM orders) WHERE p % 10 = 0")
def stride_sample(t):
    return W.every_nth(t.orders, ["o_orderstatus"], ["o_orderkey"], 10).select("o_orderkey")


@register("time_window_filter", f"SELECT event_id FROM ({TIMED}) WHERE s >= 1704067200 AND s < 1711929600 AND s % 4 = 0")
def time_window_filter(t):
    return timed(t).where((F.col("s") >= 1704067200) & (F.col("s") < 1711929600) & (F.col("s") % 4 == 0)).select("event_id")


@register("nearest_in_time", f"SELECT user_id, arg_min(value, (abs(s - 1706745600), s, value)) AS value FROM ({TIMED}) GROUP BY 1", "value")
def nearest_in_time(t):
    from tessera.operators.joins import nearest_in_time as nearest

    return nearest(timed(t), ["user_id"], "s", 1706745600, ["value"]).select("user_id", "value")


@register("tumbling_windows", "SELECT epoch(time_bucket(INTERVAL 1 day, ts))::BIGINT AS day, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2", "total")
def tumbling_windows(t):
    return ledgers.windowed(t.events, "ts", "1 day", ["event_type"], "value").select(F.unix_timestamp("start").alias("day"), "event_type", "n", "total")


@register("long_rolling_median", "SELECT event_id, quantile_cont(value, 0.5) OVER (ORDER BY ts, event_id ROWS BETWEEN 20 PRECEDING AND 20 FOLLOWING) AS rolling FROM events", "rolling")
def long_rolling_median(t):
    """All events as one series, in blocks that borrow from their neighbours."""
    return W.long_rolling_median(t.events, ["ts", "event_id"], "value", 41, block_rows=2048).select("event_id", "rolling")


@register(
    "long_velocities",
    f"""SELECT i AS interval, (s + s2) / 2.0::DOUBLE AS middle, (v2 - value) / (s2 - s) AS velocity FROM (SELECT value, s, lead(s) OVER w AS s2, lead(value) OVER w AS v2, row_number() OVER w - 1 AS i
    FROM ({TIMED}) WINDOW w AS (ORDER BY s, event_id)) WHERE s2 > s""",
    "middle velocity",
)
def long_velocities(t):
    return W.long_velocities(timed(t), "s", "value", ["event_id"], block_rows=2048)


@register(
    "long_closing_rises",
    """WITH u AS (SELECT row_number() OVER w AS r, coalesce(value > lag(value) OVER w, false) AS up FROM events WINDOW w AS (ORDER BY ts, event_id)) SELECT count(*) - coalesce(max(r) FILTER (NOT up), 0) AS rises FROM u""",
)
def long_closing_rises(t):
    return W.long_closing_rises(t.events, ["ts", "event_id"], "value", block_rows=2048)


@register(
    "guarded_readings",
    """SELECT key, "at", n, best, last, CASE WHEN last - best > 300 THEN 'cliff' ELSE 'watching' END AS verdict FROM (SELECT user_id AS key, floor(epoch(ts))::BIGINT AS "at", value AS last,
    count(*) OVER w AS n, min(value) OVER w AS best FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, value ROWS UNBOUNDED PRECEDING))""",
    "best last",
)
def guarded_readings(t):
    return ledgers.guard_table(t.events, "user_id", "ts", "value", 300.0).withColumn("at", F.unix_timestamp("at"))
