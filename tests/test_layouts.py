"""Neighbour-graph layouts: memberships and graphs by brute force, neighbours kept, the same places on every run."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import joins as J, layouts as L


def blobs(seed=3, groups=4, each=40, dims=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 12, (groups, dims))
    return np.concatenate([rng.normal(c, 1, (each, dims)) for c in centres]), np.repeat(np.arange(groups), each)


def frame(spark, points):
    return spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(points)], "id long, v array<double>")


def nearest(points, k):
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, 1, kind="stable")[:, :k]
    return order, np.take_along_axis(d, order, 1)


def test_named_neighbours(spark):
    points, _ = blobs()
    order, d = nearest(points, 6)
    df = frame(spark, points)
    for rows in (2048, 23):
        got = {r.key: [(x.key, x.d) for x in r.best] for r in J.nearest_distances(df, df, "id", "v", 6, "euclid", rows, 9, named=True).collect()}
        assert all([x for x, _ in got[k]] == order[k].tolist() and np.allclose([x for _, x in got[k]], d[k]) for k in range(len(points)))


def test_memberships_add_up():
    d = np.sort(np.random.default_rng(1).random((50, 10)), 1)
    w = L.memberships(d)
    assert np.allclose(w.sum(1), np.log2(10), atol=1e-6) and np.allclose(w[:, 0], 1)
    assert np.isfinite(L.memberships(np.zeros((2, 5)))).all()


def test_neighbour_graph_is_the_fuzzy_union(spark):
    points, _ = blobs(each=12)
    order, d = nearest(points, 5)
    w = np.zeros((len(points), len(points)))
    np.put_along_axis(w, order, L.memberships(d), 1)
    both = w + w.T - w * w.T
    got = {(r.a, r.b): r.w for r in L.neighbour_graph(frame(spark, points), "id", "v", 5).collect()}
    assert set(got) == {(i, j) for i, j in zip(*np.nonzero(np.triu(both)), strict=True)} and all(abs(x - both[k]) < 1e-6 for k, x in got.items())


def test_curve_falls_off_after_the_least_distance():
    a, b = L.curve(0.1)
    assert 1.4 < a < 1.8 and 0.8 < b < 1.0


def test_layout_keeps_neighbours(spark):
    points, group = blobs()
    df = frame(spark, points)
    first = {r.id: (r.x, r.y) for r in L.layout(df, "id", "v", 10, rounds=25).collect()}
    again = {r.id: (r.x, r.y) for r in L.layout(df.repartition(7), "id", "v", 10, rounds=25).collect()}
    assert np.allclose([first[k] for k in range(len(points))], [again[k] for k in range(len(points))], atol=1e-6)
    places = np.array([first[k] for k in range(len(points))])
    own, _ = nearest(places, 10)
    assert (group[own] == group[:, None]).mean() > 0.97
    kept = L.neighbour_overlap(df, frame(spark, places).withColumnRenamed("v", "p"), "id", "v", "p", 10).first().overlap
    assert kept > 0.35  # by chance within the groups: 0.25
    assert L.layout(df.limit(2), "id", "v").count() == 2 and L.layout(df.where(F.lit(False)), "id", "v").count() == 0
