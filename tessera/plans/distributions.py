"""Queries of conditional distributions, fractions, quantiles, correlation and agreement."""

from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import aggregates as A, selection as S
from tessera.plans.catalog import register

DIST = "l_extendedprice / l_quantity"
FRAMES = f"SELECT *, {DIST} AS dist FROM lineitem"
CUTS = [950.0, 1000.0, 1100.0, 1250.0, 1500.0, 1750.0, 2000.0]
EDGES = [900.0, 1000.0, 1200.0, 1400.0, 1600.0, 1800.0]
LABELS = ["A", "N", "R"]


def frames(t):
    return t.lineitem.withColumn("dist", F.expr(DIST))


def label_sql(labels=LABELS, column="l_returnflag"):
    return ", ".join(f"count(*) FILTER ({column} = '{x}') AS {x}_n, CASE WHEN count(*) > 0 THEN count(*) FILTER ({column} = '{x}') / count(*)::DOUBLE END AS {x}_fraction" for x in labels)


FRACTIONS = " ".join(f"{x}_fraction" for x in LABELS)


@register(
    "threshold_sweep",
    f"""WITH f AS ({FRAMES}), c AS (SELECT unnest({CUTS}) AS cutoff), k AS (SELECT DISTINCT l_linestatus FROM f)
    SELECT k.l_linestatus, cutoff, count(f.dist) AS n, {", ".join(f"count(*) FILTER (l_returnflag = '{x}') AS {x}_n, CASE WHEN count(f.dist) > 0 THEN count(*) FILTER (l_returnflag = '{x}') / count(f.dist)::DOUBLE END AS {x}_fraction" for x in LABELS)}
    FROM k CROSS JOIN c LEFT JOIN f ON f.l_linestatus = k.l_linestatus AND f.dist <= cutoff GROUP BY 1, 2""",
    FRACTIONS,
)
def threshold_sweep(t):
    return A.threshold_sweep(frames(t), "dist", CUTS, "l_returnflag", LABELS, ["l_linestatus"])


@register("label_fractions", f"SELECT l_linestatus, count(*) AS n, {label_sql()} FROM lineitem GROUP BY 1", FRACTIONS)
def label_fractions(t):
    return A.label_fractions(t.lineitem, ["l_linestatus"], "l_returnflag", LABELS)


RANGES = {"all": "true", "le_1000": "d <= 1000", "lt_1000": "d < 1000", "1000_1250": "d >= 1000 AND d < 1250", "1250_1500": "d >= 1250 AND d < 1500", "ge_1500": "d >= 1500"}


@register(
    "named_range_summary",
    f"WITH f AS (SELECT {DIST} AS d FROM lineitem) "
    + " UNION ALL ".join(f"SELECT '{n}' AS range, count(*) AS n, avg(d) AS mean, quantile_cont(d, 0.5) AS median, min(d) AS low, max(d) AS high, stddev_samp(d) AS sd FROM f WHERE {c} HAVING count(*) > 0" for n, c in RANGES.items()),
    "mean median low high sd",
)
def named_range_summary(t):
    d = frames(t).withColumnRenamed("dist", "d")
    return A.named_ranges(d, {n: F.expr(c) for n, c in RANGES.items()}, "d")


@register(
    "distance_bins",
    f"""WITH f AS ({FRAMES}), b AS (SELECT unnest(range({len(EDGES)})) AS bin), e AS (SELECT CAST(bin AS INTEGER) AS bin, {EDGES}[bin + 1] AS low, coalesce({EDGES}[bin + 2], 'infinity'::DOUBLE) AS high FROM b),
    k AS (SELECT l_linestatus, count(*) AS total FROM f GROUP BY 1)
    SELECT k.l_linestatus, e.bin, CAST(e.low AS DOUBLE) AS low, count(f.dist) AS n, count(f.dist) / max(total)::DOUBLE AS share,
    {", ".join(f"count(*) FILTER (l_returnflag = '{x}') AS {x}_n, CASE WHEN count(f.dist) > 0 THEN count(*) FILTER (l_returnflag = '{x}') / count(f.dist)::DOUBLE END AS {x}_fraction" for x in LABELS)}
    FROM k CROSS JOIN e LEFT JOIN f ON f.l_linestatus = k.l_linestatus AND f.dist >= e.low AND f.dist < e.high GROUP BY 1, 2, 3""",
    f"low share {FRACTIONS}",
)
def distance_bins(t):
    return A.binned(frames(t), "dist", EDGES, "l_returnflag", LABELS, ["l_linestatus"])


@register(
    "distance_bins_pivot_delta",
    f"""WITH f AS (SELECT *, CASE {" ".join(f"WHEN dist >= {e} THEN {k}" for k, e in reversed(list(enumerate(EDGES))))} END AS bin FROM ({FRAMES}))
    SELECT CAST(bin AS INTEGER) AS bin, avg(CASE WHEN l_linestatus = 'F' THEN l_discount END) AS mean_F, avg(CASE WHEN l_linestatus = 'O' THEN l_discount END) AS mean_O,
    avg(CASE WHEN l_linestatus = 'F' THEN l_discount END) - avg(CASE WHEN l_linestatus = 'O' THEN l_discount END) AS mean_delta FROM f WHERE bin IS NOT NULL GROUP BY 1""",
    "mean_F mean_O mean_delta",
)
def distance_bins_pivot_delta(t):
    bin_ = C.first_match([(F.col("dist") >= e, k) for k, e in reversed(list(enumerate(EDGES)))])
    wide = S.pivoted(frames(t).withColumn("bin", bin_).where("bin IS NOT NULL"), ["bin"], "l_linestatus", ["F", "O"], {"mean": lambda c: F.avg(F.when(c, F.col("l_discount")))})
    return S.with_delta(wide, ["mean"], "F", "O")


@register(
    "topn_subset_summary",
    f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY dist, l_orderkey, l_linenumber) AS rank FROM ({FRAMES})), n AS (SELECT unnest([5, 10, 20, 50, 100, 500, 1000]) AS top)
    SELECT CAST(top AS INTEGER) AS top, count(*) AS n, {label_sql()}, max(dist) AS reach FROM n JOIN r ON rank <= top GROUP BY 1""",
    f"{FRACTIONS} reach",
)
def topn_subset_summary(t):
    return A.top_n_summaries(frames(t), "dist", [5, 10, 20, 50, 100, 500, 1000], "l_returnflag", LABELS, ["l_orderkey", "l_linenumber"])


@register(
    "crosstab_three_way_fraction",
    """WITH c AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2)
    SELECT l_returnflag, l_linestatus, n, n / sum(n) OVER () AS of_all, n / sum(n) OVER (PARTITION BY l_returnflag) AS of_l_returnflag, n / sum(n) OVER (PARTITION BY l_linestatus) AS of_l_linestatus FROM c""",
    "of_all of_l_returnflag of_l_linestatus",
)
def crosstab_three_way_fraction(t):
    return A.three_way_fractions(t.lineitem, "l_returnflag", "l_linestatus")


@register("crosstab_counts", "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS l_linestatus_F, count(*) FILTER (l_linestatus = 'O') AS l_linestatus_O FROM lineitem GROUP BY 1")
def crosstab_counts(t):
    return A.crosstab(t.lineitem, "l_returnflag", "l_linestatus", ["F", "O"])


@register(
    "crosstab_shares",
    "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') / count(*)::DOUBLE AS l_linestatus_F, count(*) FILTER (l_linestatus = 'O') / count(*)::DOUBLE AS l_linestatus_O FROM lineitem GROUP BY 1",
    "l_linestatus_F l_linestatus_O",
)
def crosstab_shares(t):
    return A.crosstab(t.lineitem, "l_returnflag", "l_linestatus", ["F", "O"], True)


@register("value_counts_top", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 10")
def value_counts_top(t):
    return A.value_counts(t.part, "p_brand", 10)


@register(
    "quartiles_by_label",
    f"SELECT l_linestatus, l_returnflag, quantile_cont(dist, 0.1) AS q10, quantile_cont(dist, 0.25) AS q25, quantile_cont(dist, 0.5) AS q50, quantile_cont(dist, 0.75) AS q75, quantile_cont(dist, 0.9) AS q90 FROM ({FRAMES}) GROUP BY 1, 2",
    "q10 q25 q50 q75 q90",
)
def quartiles_by_label(t):
    return A.quantiles(frames(t), "dist", [0.1, 0.25, 0.5, 0.75, 0.9], ["l_linestatus", "l_returnflag"])


@register(
    "nearest_rank_percentile",
    """WITH r AS (SELECT o_orderstatus, o_totalprice, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) - 1 AS i, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
    SELECT o_orderstatus, min(o_totalprice) AS quantile FROM r WHERE i = CAST(round_even((n - 1) * 0.95::DOUBLE, 0) AS BIGINT) GROUP BY 1""",
    "quantile",
)
def nearest_rank_percentile(t):
    return A.ranked_quantile(t.orders, "o_totalprice", 0.95, ["o_orderstatus"])


@register(
    "adaptive_bin_edge",
    """WITH r AS (SELECT o_orderstatus, o_totalprice, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) - 1 AS i, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
    SELECT o_orderstatus, min(o_totalprice) AS quantile FROM r WHERE i = least(n - 1, CAST(floor(n * 0.3::DOUBLE) AS BIGINT)) GROUP BY 1""",
    "quantile",
)
def adaptive_bin_edge(t):
    return A.ranked_quantile(t.orders, "o_totalprice", 0.3, ["o_orderstatus"], floor=True)


@register(
    "group_multi_agg_nullkeys",
    """WITH j AS (SELECT CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS segment, o.* FROM orders o LEFT JOIN customer ON o_custkey = c_custkey),
    m AS (SELECT segment, o_orderpriority, count(*) AS c, row_number() OVER (PARTITION BY segment ORDER BY count(*) DESC, o_orderpriority) AS r FROM j GROUP BY 1, 2)
    SELECT j.segment, count(*) AS n, count(DISTINCT o_custkey) AS different, avg(o_totalprice) AS mean, quantile_cont(o_totalprice, 0.5) AS median, stddev_pop(o_totalprice) AS sd_pop, stddev_samp(o_totalprice) AS sd_samp,
    min(o_totalprice) AS low, max(o_totalprice) AS high, max(m.o_orderpriority) AS mode FROM j JOIN m ON j.segment IS NOT DISTINCT FROM m.segment AND m.r = 1 GROUP BY 1""",
    "mean median sd_pop sd_samp low high",
)
def group_multi_agg_nullkeys(t):
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").withColumn("segment", F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")))
    return A.group_summary(j, ["segment"], "o_totalprice", "o_custkey", "o_orderpriority")


@register(
    "circular_stats",
    """WITH e AS (SELECT event_type, radians((floor(epoch(ts))::BIGINT % 86400) / 240.0::DOUBLE) AS a FROM events)
    SELECT event_type, count(*) AS n, CASE WHEN m < 0 THEN m + 360 ELSE m END AS mean_angle, resultant FROM (SELECT event_type, count(*) AS c, degrees(atan2(avg(sin(a)), avg(cos(a)))) AS m, sqrt(avg(sin(a)) ** 2 + avg(cos(a)) ** 2) AS resultant FROM e GROUP BY 1) GROUP BY ALL""".replace("count(*) AS n, CASE", "max(c) AS n, CASE"),
    "mean_angle resultant",
)
def circular_stats(t):
    angle = (F.unix_timestamp("ts") % 86400) / 240.0
    return A.circular(t.events.withColumn("angle", angle), "angle", ["event_type"])


METRICS = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def ranks_sql(column, keys="metric"):
    return f"rank() OVER (PARTITION BY {keys} ORDER BY {column}) + (count(*) OVER (PARTITION BY {keys}, {column}) - 1) / 2.0::DOUBLE"


@register(
    "corr_table_pearson_spearman",
    "WITH l AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, {m}::DOUBLE AS x, l_extendedprice AS y FROM lineitem" for m in METRICS) + f"""), r AS (SELECT *, {ranks_sql("x")} AS rx, {ranks_sql("y")} AS ry FROM l)
    SELECT metric, count(*) AS n, corr(x, y) AS pearson, corr(rx, ry) AS spearman FROM r GROUP BY 1""",
    "pearson spearman",
)
def corr_table_pearson_spearman(t):
    return A.correlation_table(t.lineitem, METRICS, "l_extendedprice")


@register(
    "linfit_by_group",
    """WITH e AS (SELECT event_type, floor(epoch(ts))::BIGINT / 86400.0::DOUBLE AS x, value AS y FROM events)
    SELECT event_type, count(*) AS n, regr_slope(y, x) AS slope, avg(y) - regr_slope(y, x) * avg(x) AS intercept, regr_r2(y, x) AS r2 FROM (SELECT event_type, x - 19000 AS x, y FROM e) GROUP BY 1""",
    "slope intercept r2",
)
def linfit_by_group(t):
    return A.linear_fit(t.events.withColumn("x", F.unix_timestamp("ts") / 86400.0 - 19000), "x", "value", ["event_type"])


@register(
    "first_last_reference",
    """WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, value) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events)
    SELECT user_id, arg_min(value, r) AS first, arg_max(value, r) AS last, avg(CASE WHEN r <= ceil(n * 0.1::DOUBLE) THEN value END) AS reference FROM r GROUP BY 1""",
    "first last reference",
)
def first_last_reference(t):
    return A.ends_by_time(t.events, "ts", "value", ["user_id"])


@register("weighted_support", "SELECT l_suppkey, sum(l_extendedprice * greatest(l_discount - 0.05, 0)) AS support, count(*) FILTER (l_discount - 0.05 > 0) AS supporters FROM lineitem GROUP BY 1", "support")
def weighted_support(t):
    return A.support(t.lineitem.withColumn("sim", F.col("l_discount") - F.lit(0.05)), ["l_suppkey"], "l_extendedprice", "sim")


@register(
    "concat_distinct_in_order",
    """WITH f AS (SELECT l_orderkey, l_shipdate, l_returnflag || l_linestatus AS v, min(l_linenumber) AS pos FROM lineitem GROUP BY 1, 2, 3), g AS (SELECT l_orderkey, v, min(pos) AS pos FROM f GROUP BY 1, 2)
    SELECT l_orderkey, string_agg(v, ';' ORDER BY pos, v) AS joined FROM g GROUP BY 1""",
)
def concat_distinct_in_order(t):
    return A.joined_distinct(t.lineitem.withColumn("v", F.concat("l_returnflag", "l_linestatus")), ["l_orderkey"], "v", "l_linenumber")


@register("group_mean_attached", "SELECT s_suppkey, s_nationkey, avg(s_acctbal) OVER (PARTITION BY s_nationkey) AS mean_balance FROM supplier", "mean_balance")
def group_mean_attached(t):
    return A.with_group_mean(t.supplier, ["s_nationkey"], "s_acctbal", "mean_balance").select("s_suppkey", "s_nationkey", "mean_balance")


@register("set_union_per_key", "SELECT p_brand, array_to_string(list_sort(list_distinct(list(p_type))), ';') AS members FROM part GROUP BY 1")
def set_union_per_key(t):
    return A.merged_sets(t.part, ["p_brand"], "p_type")


FEATURES = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]


@register(
    "effect_size_by_feature",
    "WITH l AS (" + " UNION ALL ".join(f"SELECT '{m}' AS feature, {m}::DOUBLE AS x, l_returnflag = 'R' AS p FROM lineitem" for m in FEATURES) + """),
    g AS (SELECT feature, count(x) FILTER (p) AS n_pos, count(x) FILTER (NOT p) AS n_neg, avg(x) FILTER (p) - avg(x) FILTER (NOT p) AS gap, var_samp(x) FILTER (p) AS va, var_samp(x) FILTER (NOT p) AS vb, var_pop(x) FILTER (p) AS pa, var_pop(x) FILTER (NOT p) AS pb FROM l GROUP BY 1)
    SELECT feature, n_pos, n_neg, gap / sqrt(((n_pos - 1) * va + (n_neg - 1) * vb) / (n_pos + n_neg - 2)) AS cohen_d, gap / sqrt((pa + pb) / 2) AS plain_d FROM g""",
    "cohen_d plain_d",
)
def effect_size_by_feature(t):
    return A.effect_sizes(t.lineitem, FEATURES, F.col("l_returnflag") == "R")


@register(
    "contact_enrichment",
    f"""WITH q AS (SELECT quantile_cont(dist, 0.1) AS lo, quantile_cont(dist, 0.5) AS hi FROM ({FRAMES})), f AS (SELECT l_returnflag, dist AS d, (l_discount >= 0.05)::INTEGER::DOUBLE AS c, lo, hi FROM ({FRAMES}) CROSS JOIN q),
    r AS (SELECT *, {ranks_sql("d", "l_returnflag")} AS rd, {ranks_sql("c", "l_returnflag")} AS rc FROM f), g AS (SELECT l_returnflag, avg(c) FILTER (d <= lo) AS short, avg(c) FILTER (d >= hi) AS long, -corr(rd, rc) AS rho FROM r GROUP BY 1)
    SELECT *, (coalesce(short, 0) - coalesce(long, 0)) * greatest(0, rho) AS enrichment FROM g""",
    "short long rho enrichment",
)
def contact_enrichment(t):
    return A.contact_enrichment(frames(t), "dist", "l_returnflag", F.col("l_discount") >= 0.05)


CLUSTERS = "SELECT (l_suppkey % 6) - 1 AS cluster, l_returnflag AS label FROM lineitem"


def clusters(t):
    return t.lineitem.select((F.col("l_suppkey") % 6 - 1).alias("cluster"), F.col("l_returnflag").alias("label"))


@register(
    "cluster_purity",
    f"""WITH c AS (SELECT cluster, label, count(*) AS c FROM ({CLUSTERS}) GROUP BY 1, 2), w AS (SELECT sum(c) AS n, sum(c) FILTER (label = 'R') AS p FROM c),
    b AS (SELECT cluster, sum(c) AS size, max(c) AS top, sum(c) FILTER (label = 'R') AS pos FROM c WHERE cluster <> -1 GROUP BY 1), g AS (SELECT b.*, n, abs(pos / size - p / n) AS gap FROM b CROSS JOIN w),
    s AS (SELECT count(*) AS clusters, sum(size) / max(n) AS coverage, sum(top) / sum(size) AS purity, sum(gap * size) / sum(size) AS weighted_gap, max(gap) AS largest_gap FROM g)
    SELECT *, weighted_gap * coverage * ln(1 + clusters) AS score FROM s""",
    "coverage purity weighted_gap largest_gap score",
)
def cluster_purity(t):
    return A.cluster_quality(clusters(t), "cluster", "label", "R")


@register(
    "cluster_nmi_ari",
    f"""WITH c AS (SELECT cluster, label, count(*)::DOUBLE AS c FROM ({CLUSTERS}) GROUP BY 1, 2), a AS (SELECT cluster, sum(c) AS m FROM c GROUP BY 1), b AS (SELECT label, sum(c) AS m FROM c GROUP BY 1), n AS (SELECT sum(c) AS n FROM c),
    j AS (SELECT sum(c / n * ln(n * c / (a.m * b.m))) AS mi, sum(c * (c - 1) / 2) AS bo FROM c JOIN a USING (cluster) JOIN b USING (label) CROSS JOIN n),
    s AS (SELECT (SELECT -sum(m / n * ln(m / n)) FROM a CROSS JOIN n) AS ha, (SELECT -sum(m / n * ln(m / n)) FROM b CROSS JOIN n) AS hb, (SELECT sum(m * (m - 1) / 2) FROM a) AS pa, (SELECT sum(m * (m - 1) / 2) FROM b) AS pb)
    SELECT n::BIGINT AS n, 2 * mi / (ha + hb) AS nmi, (bo - pa * pb / (n * (n - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (n * (n - 1) / 2)) AS ari FROM j CROSS JOIN s CROSS JOIN n""",
    "nmi ari",
)
def cluster_nmi_ari(t):
    return A.agreement(clusters(t), "cluster", "label")


@register(
    "auc_mann_whitney",
    """WITH j AS (SELECT n_chars AS score, quality = 1 AS p FROM documents JOIN labels USING (doc_id)), r AS (SELECT p, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM j)
    SELECT count(*) FILTER (p) AS positives, count(*) FILTER (NOT p) AS negatives, (sum(r) FILTER (p) - count(*) FILTER (p) * (count(*) FILTER (p) + 1) / 2.0::DOUBLE) / (count(*) FILTER (p) * count(*) FILTER (NOT p)) AS auc FROM r""",
    "auc",
)
def auc_mann_whitney(t):
    return A.auc(t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id"), "n_chars", F.col("quality") == 1)


@register(
    "accuracy_baseline",
    """WITH j AS (SELECT n_chars > 500 AS p, quality = 1 AS a FROM documents JOIN labels USING (doc_id))
    SELECT count(*) AS n, avg((p = a)::INTEGER) AS accuracy, (avg((p = a)::INTEGER) FILTER (a) + avg((p = a)::INTEGER) FILTER (NOT a)) / 2 AS balanced, greatest(avg(a::INTEGER), 1 - avg(a::INTEGER)) AS majority FROM j""",
    "accuracy balanced majority",
)
def accuracy_baseline(t):
    return A.accuracies(t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id"), F.col("n_chars") > 500, F.col("quality") == 1)


@register(
    "mae_r2",
    f"""WITH f AS (SELECT l_extendedprice AS y, l_quantity * 1400.0::DOUBLE AS p FROM lineitem), m AS (SELECT avg(y) AS mean FROM f)
    SELECT count(*) AS n, avg(abs(y - p)) AS mae, 1 - sum((y - p) ** 2) / sum((y - mean) ** 2) AS r2 FROM f CROSS JOIN m""",
    "mae r2",
)
def mae_r2(t):
    return A.regression_errors(t.lineitem.withColumn("p", F.col("l_quantity") * 1400.0), "p", "l_extendedprice")


@register("run_summary_rows", "SELECT 'rows' AS metric, count(*)::DOUBLE AS value FROM orders UNION ALL SELECT 'customers', count(DISTINCT o_custkey) FROM orders UNION ALL SELECT 'open', count(*) FILTER (o_orderstatus = 'O') FROM orders", "value")
def run_summary_rows(t):
    return A.as_rows(t.orders.agg(F.count("*").alias("rows"), F.count_distinct("o_custkey").alias("customers"), F.count_if(F.col("o_orderstatus") == "O").alias("open")))


@register(
    "within_counts",
    f"SELECT l_suppkey, count(DISTINCT l_partkey) FILTER (dist <= 1000) AS within_1000p0, count(DISTINCT l_partkey) FILTER (dist <= 1500) AS within_1500p0 FROM ({FRAMES}) GROUP BY 1",
)
def within_counts(t):
    return A.within_counts(frames(t), ["l_suppkey"], "dist", "l_partkey", [1000.0, 1500.0])


@register(
    "property_vector",
    "SELECT p_brand, " + ", ".join(f"avg({p}) AS {p}_mean, stddev_pop({p}) AS {p}_sd, min({p}) AS {p}_low, max({p}) AS {p}_high" for p in ("p_size", "p_retailprice")) + " FROM part GROUP BY 1",
    "p_size_mean p_size_sd p_retailprice_mean p_retailprice_sd p_retailprice_low p_retailprice_high",
)
def property_vector(t):
    return A.vector_profile(t.part, ["p_brand"], ["p_size", "p_retailprice"])


AXES = ("l_quantity", "l_discount", "l_tax")


@register(
    "shape_moments",
    "SELECT l_returnflag, count(*) AS n, "
    + ", ".join(f"avg({a}) AS mean_{a}, var_pop({a}) AS var_{a}, max({a}) - min({a}) AS span_{a}" for a in AXES)
    + ", covar_samp(l_quantity, l_discount) AS cov_l_quantity_l_discount, covar_samp(l_quantity, l_tax) AS cov_l_quantity_l_tax, covar_samp(l_discount, l_tax) AS cov_l_discount_l_tax, sqrt("
    + " + ".join(f"var_pop({a})" for a in AXES)
    + ") AS gyration FROM lineitem GROUP BY 1",
    " ".join(f"mean_{a} var_{a} span_{a}" for a in AXES) + " cov_l_quantity_l_discount cov_l_quantity_l_tax cov_l_discount_l_tax gyration",
)
def shape_moments(t):
    return A.shape_moments(t.lineitem, ["l_returnflag"], *AXES).drop(*[f"skew_{a}" for a in AXES])


@register(
    "combined_rollup",
    "SELECT coalesce(o_orderstatus, 'Combined') AS o_orderstatus, count(*) AS n, avg(o_totalprice) AS mean FROM orders GROUP BY ROLLUP (o_orderstatus)",
    "mean",
)
def combined_rollup(t):
    return A.with_combined(t.orders, "o_orderstatus").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean"))


@register(
    "ordered_quantiles",
    "SELECT l_returnflag, quantile_cont(l_extendedprice, 0.05) AS q5, quantile_cont(l_extendedprice, 0.25) AS q25, quantile_cont(l_extendedprice, 0.5) AS q50, quantile_cont(l_extendedprice, 0.95) AS q95 FROM lineitem GROUP BY 1",
    "q5 q25 q50 q95",
)
def ordered_quantiles(t):
    """Quantiles of few large groups: no task holds a group's values."""
    return A.ordered_quantiles(t.lineitem, "l_extendedprice", [0.05, 0.25, 0.5, 0.95], ["l_returnflag"])


@register("ordered_quantiles_of_all", "SELECT quantile_cont(l_extendedprice, 0.1) AS q10, quantile_cont(l_extendedprice, 0.5) AS q50, quantile_cont(l_extendedprice, 0.99) AS q99 FROM lineitem", "q10 q50 q99")
def ordered_quantiles_of_all(t):
    return A.ordered_quantiles(t.lineitem, "l_extendedprice", [0.1, 0.5, 0.99])


@register(
    "average_rank_of_all",
    "SELECT l_orderkey, l_linenumber, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0::DOUBLE AS rank FROM lineitem",
    "rank",
)
def average_rank_of_all(t):
    return A.with_average_rank(t.lineitem, [], "l_extendedprice", "rank").select("l_orderkey", "l_linenumber", "rank")
