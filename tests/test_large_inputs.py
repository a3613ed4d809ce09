"""Operators that must not hold a whole table, a large group or all pairs: their results on small tables, and how they get them."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import joins as J


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_range_join_sends_no_side_to_all_tasks(spark):
    """A table that is small as a file may be many rows: F3, F5 and F8."""
    points = np.random.default_rng(1).uniform(0, 20, (120, 3))
    df = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(points)], "k long, x double, y double, z double")
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    near = J.range_join(df, df, ["x", "y", "z"], 5.0)
    assert "Broadcast" not in plan(near)
    assert {(r.k, r.k_r) for r in near.collect()} == {(int(i), int(j)) for i, j in zip(*np.nonzero(d <= 5.0), strict=True)}
    gap = points[:, None] - points[None]
    gap -= 20 * np.round(gap / 20)
    assert J.range_join(df, df, ["x", "y", "z"], 5.0, box=[20.0] * 3).count() == (np.sqrt((gap**2).sum(2)) <= 5.0).sum()
    most = J.densest_anchor(df, "k", ["x", "y", "z"], 5.0)
    assert most.first().n == (d <= 5.0).sum(1).max() - 1


def test_shared_information_of_large_groups():
    """the plain sum over every number that two groups may share, and groups of which it would have a hundred million terms."""
    from math import lgamma
    from time import process_time

    from tessera.operators import aggregates as A

    for x, y, n in ((3, 4, 10), (7, 9, 12), (1, 1, 1), (40, 400, 1000), (500, 500, 1000), (5, 5, 5)):
        want = 0.0
        for k in range(max(1, x + y - n), min(x, y) + 1):
            log = lgamma(x + 1) + lgamma(y + 1) + lgamma(n - x + 1) + lgamma(n - y + 1) - lgamma(n + 1) - lgamma(k + 1) - lgamma(x - k + 1) - lgamma(y - k + 1) - lgamma(n - x - y + k + 1)
            want += k / n * np.log(n * k / (x * y)) * np.exp(log)
        for step in (1 << 16, 7):
            assert abs(A._shared_information(x, y, n, step) - want) < 1e-11
    at = process_time()
    assert abs(A._shared_information(1e8, 2e8, 6e8) - (2 / 3 * 5 / 6) / (2 * 6e8)) < 1e-12  # as the chi-square of one cell
    assert process_time() - at < 10


def test_medians_and_ranks_from_counts(spark):
    """no task holds a group's values."""
    from tessera.operators import aggregates as A

    dice = np.random.default_rng(2)
    rows = [(int(dice.integers(3)), float(dice.integers(12)) if k % 5 else None, bool(dice.integers(2))) for k in range(300)]
    df = spark.createDataFrame(rows, "f long, d double, c boolean")
    made = A.named_ranges(df, {"all": F.lit(True), "low": F.col("d") < 5, "none": F.col("d") > 99, "null": F.col("d").isNull()}, "d")
    assert "percentile" not in plan(made).lower()
    got = {r.range: (r.n, r["mean"], r["median"]) for r in made.collect()}
    every, low = np.array([d for _, d, _ in rows if d is not None]), np.array([d for _, d, _ in rows if d is not None and d < 5])
    assert got.keys() == {"all", "low", "null"} and got["all"][0] == 300 and got["null"][1:] == (None, None)
    assert np.allclose([*got["all"][1:], *got["low"]], [every.mean(), np.median(every), len(low), low.mean(), np.median(low)])

    full = [r for r in rows if r[1] is not None]
    made = A.contact_enrichment(df.where("d IS NOT NULL"), "d", "f", F.col("c"))
    assert "percentile" not in plan(made).lower() and "rank(" not in plan(made).lower()
    lo, hi = np.quantile(every, [0.1, 0.5])
    rank = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    for r in made.collect():
        d, c = (np.array([x[k] for x in full if x[0] == r.f], float) for k in (1, 2))
        rho = -np.corrcoef(rank(d), rank(c))[0, 1]
        assert np.allclose([r.short, r.long, r.rho], [c[d <= lo].mean(), c[d >= hi].mean(), rho])


def test_partners_without_pairs(spark):
    """the same rows as from all pairs, ties and missing values too; no join lists the pairs of a block."""
    from tessera.operators import graphs as G

    dice = np.random.default_rng(4)
    rows = [(k, int(dice.integers(3)) if k % 11 else None, float(dice.integers(30)) if k % 7 else None) for k in range(160)] + [(500, 77, 1.0), (501, 78, None), (502, 78, None)]
    df = spark.createDataFrame(rows, "k long, b long, v double").repartition(5)
    pairs = J.pairs_within(df, "k", ["b"], ["v"]).withColumn("gap", F.abs(F.col("v_a") - F.col("v_b")))
    for most in (1, 3):
        want = J.prefiltered(pairs, "k_a", "gap", F.col("v_b"), most, ["k_b"])
        assert sorted(map(tuple, J.prefiltered_by_gap(df, "k", ["b"], "v", most).collect())) == sorted(map(tuple, want.collect()))
    for reach in (0.0, 1.0, 2.0):
        want = G.similarity_clusters(pairs.withColumn("s", (F.col("gap") <= reach).cast("int")), df, "k", "s", 1)
        got = J.runs_by_value(df, "k", ["b"], "v", reach, 7)
        assert sorted(map(tuple, got.collect())) == sorted((r.k, r.component) for r in want.collect())


def test_supplier_queries_list_no_pairs(spark):
    """ten copies of the suppliers are not a hundred times the rows."""
    import os

    import pytest

    from tessera.plans import catalog

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("the test tables are not here")
    for name in ("two_stage_prefilter", "nearest_partner", "similarity_clusters"):
        text = plan(catalog.QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert "s_suppkey_a" not in text or "s_suppkey_b" not in text


def test_scaling_of_many_rows(spark):
    """more rows than a matrix of all distances was made for, and the same places as from that matrix."""
    from tessera.operators import kernels as K

    dice = np.random.default_rng(6)

    def plain(v):
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        centre = np.eye(len(v)) - 1 / len(v)
        values, vectors = np.linalg.eigh(-0.5 * centre @ ((1 - v @ v.T) ** 2) @ centre)
        return vectors[:, [-1, -2]] * np.sqrt(np.maximum(values[[-1, -2]], 0))

    for n, width in ((60, 3), (400, 12)):
        v = dice.normal(size=(n, width)) * np.linspace(2, 0.5, width)
        v[5] = 0
        df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)] + [(n, None)], "id long, v array<double>").repartition(3)
        got = {r.id: (r.x, r.y) for r in K.classical_scaling(df, "id", "v").collect()}
        got, want = np.array([got[k] for k in range(n)]), plain(v)
        for k in range(2):
            assert np.allclose(got[:, k] * np.sign(got[:, k] @ want[:, k]), want[:, k], atol=1e-3)
    v = dice.normal(size=(3100, 4))
    many = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, v array<double>")
    assert K.classical_scaling(many, "id", "v").count() == 3100
    assert K.classical_scaling(many.limit(0), "id", "v").count() == 0


def test_betweenness_of_many_edges(spark):
    """over 200,000 edges are no error, and shares of shortest paths are as counted one by one."""
    from tessera.operators import graphs as G

    dice = np.random.default_rng(8)
    ties = {(int(a), int(b)) for a, b in dice.integers(0, 14, (40, 2))} | {(3, 3)}
    far, number = np.full((14, 14), np.inf), np.zeros((14, 14))
    for s in range(14):
        far[s, s], number[s, s], front = 0, 1, [s]
        for level in range(1, 14):
            new = {b for a in front for x, b in ties if x == a and far[s, b] == np.inf}
            for b in new:
                number[s, b] = sum(number[s, a] for a in front if (a, b) in ties)
            for b in new:
                far[s, b] = level
            front = sorted(new)
    nodes = sorted({x for e in ties for x in e})
    got = {r.id: r.betweenness for r in G.betweenness(spark.createDataFrame(sorted(ties), "src long, dst long")).collect()}
    n = len(nodes)
    want = {v: sum(number[s, v] * number[v, t] / number[s, t] for s in nodes for t in nodes if len({s, v, t}) == 3 and far[s, v] + far[v, t] == far[s, t] < np.inf) / ((n - 1) * (n - 2)) for v in nodes}
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-12 for v in nodes)
    star = spark.range(201_000).select(F.lit(-1).cast("long").alias("src"), F.col("id").alias("dst"))
    assert G.betweenness(star).where("betweenness = 0").count() == 201_001
