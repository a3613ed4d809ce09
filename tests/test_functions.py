"""Column functions, kernels and small operators on hand-made rows."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import aggregates as A, graphs as G, kernels as K, selection as S, windows as W


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()


def test_casts(spark):
    r = one(spark, C.safe_double(F.lit("")), C.safe_double(F.lit("1.5")), C.safe_double(F.lit("NaN")), C.first_number(F.lit("about -2.5 A")), C.first_nonblank(F.lit(" "), F.lit("b")), C.clamp01(F.lit(float("nan"))))
    assert tuple(r) == (None, 1.5, None, -2.5, "b", 0.0)


def test_text(spark):
    r = one(
        spark, C.collapsed(F.lit("a  b\n c")), C.normal_doi(F.lit("https://doi.org/10.1/ABC")), C.normal_accession(F.lit("UniRef90_p12345.2")), C.shortened(F.lit("abcdefghij"), 8), C.keyword_hit(F.lit("an ATP-binding"), "atp"),
        C.keyword_hit(F.lit("catps"), "atp"), C.keyword_hit(F.lit("non heme iron"), "non-heme"), C.multi_tags({"x": F.lit(True), "y": F.lit(False), "z": F.lit(True)}),
    )
    assert tuple(r) == ("a b c", "10.1/abc", "P12345", "abcde...", True, False, True, "x | z")


def test_vectors(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    r = one(spark, C.angle(v(1, 0, 0), v(0, 2, 0)), C.triple(v(1, 0, 0), v(0, 1, 0), v(0, 0, 1)), C.dihedral(v(1, 0, 0), v(0, 0, 0), v(0, 1, 0), v(0, 1, 1)), C.cosine_distance(v(0, 0), v(1, 0)), C.circular_delta(F.lit(350.0), F.lit(10.0)), C.minimum_image(F.lit(9.0), F.lit(10.0)), C.rmsd(F.array(v(0, 0, 0), v(1, 0, 0)), F.array(v(0, 0, 1))))
    assert tuple(round(x, 6) for x in r) == (90.0, 1.0, -90.0, 1.0, -20.0, -1.0, 1.0)


def test_maps(spark):
    m = F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit(" "))
    r = one(spark, C.sorted_json(m), C.alias_value(m, "a", "b"), C.sorted_json(C.merged_maps(m, F.create_map(F.lit("b"), F.lit("2")))))
    assert tuple(r) == ('{"a":" ","b":"1"}', "1", '{"a":" ","b":"2"}')


def test_translation(spark):
    r = one(spark, C.translation(F.lit("ATGTAAGCNTAGA"))).c0
    assert (r.protein, r.terminal_stop, r.internal_stops, r.rest) == ("MX", True, 1, 1)


@pytest.mark.parametrize(("a", "b", "same", "compared"), [("GATTACA", "GCATGCU", 4, 6), ("", "AB", 0, 0), ("ABC", "ABC", 3, 3)])
def test_alignment(a, b, same, compared):
    score, got, n = K.align(a, b)
    assert got <= n and (a != b or got == same)
    # Against the plain recurrence.
    t = np.zeros((len(a) + 1, len(b) + 1))
    t[:, 0], t[0] = -2 * np.arange(len(a) + 1), -2 * np.arange(len(b) + 1)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            t[i, j] = max(t[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), t[i - 1, j] - 2, t[i, j - 1] - 2)
    assert score == t[-1, -1]


def test_common_length():
    assert K.common_length("AGGTAB", "GXTXAYB") == 4 and K.common_length("", "A") == 0


def test_linkage_and_medoids():
    x = np.array([0, 0.1, 0.2, 5, 5.1])
    d = np.abs(x[:, None] - x[None])
    labels = G.average_linkage(d, 1.0)
    assert len(set(labels[:3])) == 1 and len(set(labels)) == 2
    assert set(G.medoids(d, labels).values()) <= {1, 3, 4}


def test_butina():
    out = G.butina({1: {2, 3}, 2: {1}, 3: {1}, 4: set()})
    assert out == {1: 1, 2: 1, 3: 1, 4: 4}


def test_density_clusters():
    points = np.concatenate([np.zeros((5, 2)), np.ones((5, 2)) * 9, [[50, 50]]])
    labels = K.density_clusters(points, 1.0, 3)
    assert labels[-1] == -1 and len(set(labels[:5])) == 1 and labels[0] != labels[5]


def test_labels_by_prefix_count_alike(spark):
    """Raw labels with a suffix fall under the label that they start with."""
    rows = spark.createDataFrame([("R_like_by_reference",), ("R-like",), ("S-like",), (None,)], "label string")
    got = A.label_fractions(rows.withColumn("label", C.label_by_prefix(F.col("label"), {"R": "R-like", "S": "S-like"})), [], "label", ["R-like", "S-like"]).first()
    assert (got["n"], got["R-like_n"], got["S-like_n"]) == (4, 2, 1)


def test_sweep_on_known_rows(spark):
    frames = [(4.36, "R"), (4.42, "R"), (2.926, "R"), (2.939, "S"), (2.979, "S"), (2.866, "S"), (4.65, "S")]
    rows = spark.createDataFrame(frames, "d double, label string")
    got = {r["cutoff"]: (r["n"], r["R_n"], r["S_n"]) for r in A.threshold_sweep(rows, "d", [2.7, 2.9, 3.0, 5.0], "label", ["R", "S"]).collect()}
    assert got == {2.7: (0, 0, 0), 2.9: (1, 0, 1), 3.0: (4, 1, 3), 5.0: (7, 3, 4)}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "k long, v double, label string")
    assert A.label_fractions(empty, ["k"], "label", ["a"]).count() == 0
    assert W.closing_rises(empty, ["k"], ["v"], "v").count() == 0
    assert S.keep_first(empty, ["k"], ["v"]).count() == 0
    assert G.components(empty.select(F.col("k").alias("src"), F.col("k").alias("dst"))).count() == 0


def test_rename_refuses_clashes(spark):
    with pytest.raises(ValueError, match="duplicate"):
        S.renamed(spark.createDataFrame([(1, 2)], "a int, b int"), {"a": "b"})


def test_distinct_parts(spark):
    assert one(spark, S.distinct_parts(F.array(F.lit("B"), F.lit("a"), F.lit("b"), F.lit("A")))).c0 == ["B", "a"]


def test_sql_functions(spark):
    from tessera.functions import sql

    names = sql.register(spark)
    r = spark.sql("SELECT clamp01(2D) a, set_jaccard(array('x'), array('x', 'y')) b, cosine_distance(array(1D, 0D), array(0D, 2D)) c, circular_delta(350D, 10D) d, robust_scale(5D, 0D, 10D) e, alignment_identity('ABC', 'ABD') f").first()
    assert tuple(r) == (1.0, 0.5, 1.0, -20.0, 0.5, 2 / 3) and len(names) == 7


@pytest.mark.parametrize(("a", "b"), [("ACGT", "AGT"), ("AAAA", "AA"), ("", "AB"), ("GATTACA", "GCATGCU"), ("ABCD", "ABCD")])
def test_affine_alignment(a, b):
    n, m, far = len(a), len(b), -1e18
    t = np.full((3, n + 1, m + 1), far)
    t[0, 0, 0] = 0
    for i in range(n + 1):
        for j in range(m + 1):
            if i:
                t[1, i, j] = max(t[:, i - 1, j].max() - 0.1, t[1, i - 1, j] - 0.01)
            if j:
                t[2, i, j] = max(t[:, i, j - 1].max() - 0.1, t[2, i, j - 1] - 0.01)
            if i and j:
                t[0, i, j] = t[:, i - 1, j - 1].max() + (a[i - 1] == b[j - 1])
    assert abs(K.affine_align(a, b) - t[:, n, m].max()) < 1e-9


def test_shared_jaccard_counts_frequent_concepts(spark):
    from tessera.operators import graphs

    held = {k: {"all", f"c{k % 3}"} | ({"some"} if k < 6 else set()) for k in range(11)}
    links = spark.createDataFrame([(k, c) for k, s in held.items() for c in s], "item long, concept string")
    want = {(a, b): (len(held[a] & held[b]), len(held[a] & held[b]) / len(held[a] | held[b])) for a in held for b in held if a < b}
    found = graphs.shared_jaccard(links, "item", "concept", most=3).collect()
    assert len(found) == len(want) and {(r.item_a, r.item_b): (r.shared, r.jaccard) for r in found} == want


def test_half_even_by_binary_value(spark):
    import random

    rng = random.Random(5)
    values = [2.675, 0.125, 0.375, 2.5, 1.005, -2.675, 0.5, 1.5, 1e300, 0.0, 5.015] + [rng.randrange(-(10**6), 10**6) / 1000 for _ in range(2000)]
    for places in (0, 1, 2):
        got = spark.createDataFrame([(v,) for v in values], "v double").select("v", C.half_even(F.col("v"), places).alias("r")).collect()
        assert all(r.r == round(r.v, places) for r in got)


def test_greedy_targets_as_one_after_another(spark):
    from tessera.operators.joins import greedy_targets

    dice = random.Random(1)
    for n, m in ((0, 2), (1, 3), (5, 5), (20, 6), (20, 9)):
        values, targets = [dice.randrange(9) for _ in range(n)], [float(dice.randrange(9)) for _ in range(m)]
        left, want = dict(enumerate(values)), []
        for x in targets:
            best = min(left, key=lambda k: (abs(left[k] - x), k), default=None)
            want.append((x, best))
            left.pop(best, None)
        assert greedy_targets(targets, spark.createDataFrame(list(enumerate(values)), "k long, v int").repartition(3), "k", "v") == want
    with pytest.raises(ValueError, match="targets"):
        greedy_targets([0.0] * 1001, spark.range(1), "id", "id")


def test_identifiers_and_reasons(spark):
    row = spark.createDataFrame([("PDB 2abc and 2ABC, 1999, EC 3.8.1.n2, 1.2.3.4.5, P12345-X, Q9XY12, H149A, hH149A",)], "t string")
    got = row.select(*[C.identifiers(F.col("t"), k).alias(k) for k in C.IDENTIFIERS]).first()
    assert got.structure == ["2ABC"] and got.enzyme == ["3.8.1.N2"] and "H149A" in got.mutation and "HH149A" not in got.mutation
    pair = spark.createDataFrame([(5.0, 1.0, -7.0, -9.0, 2.0), (1.0, 1.0, -7.0, -7.2, 2.5), (None, 1.0, 0.0, 0.0, 2.0)], "sa double, sb double, aa double, ab double, l double")
    why = C.delta_reasons({"score": F.col("sa"), "affinity": F.col("aa"), "logp": F.lit(1.0)}, {"score": F.col("sb"), "affinity": F.col("ab"), "logp": F.col("l")}, "score")
    assert [r.w for r in pair.select(why.alias("w")).collect()] == ["vina_false_positive_or_missing_physics;lipophilicity_shift", "lipophilicity_shift", ""]


def test_places_totals_and_ranks_of_a_whole_table(spark):
    dice = random.Random(2)
    data = [(k, dice.choice([None, 1.0, 2.0, 2.0, 5.0, float(dice.randrange(40))]), dice.randrange(5)) for k in range(300)]
    rows = spark.createDataFrame(data, "k long, v double, w int").repartition(7)
    order = sorted(data, key=lambda r: (r[1] is not None, r[1] or 0.0, r[0]))
    got = {r.k: r.place for r in W.placed(rows, ["v", "k"]).collect()}
    assert got == {r[0]: n for n, r in enumerate(order)}
    total, want = 0, {}
    for r in order:
        total += r[2]
        want[r[0]] = total
    assert {r.k: r.upto for r in W.running_total(rows, ["v", "k"], "w", "upto").collect()} == want
    ranks = {r.k: r.percentile for r in W.percentile_rank(rows, [], "v").collect()}
    assert all(abs(ranks[k] - 100 * sum(x is None or (v is not None and x <= v) for _, x, _ in data) / 300) < 1e-9 for k, v, _ in data)
    for n in (1, 7, 299, 300, 400):
        want = [len(part) for part in np.array_split(np.arange(300), n) if len(part)]
        blocks = {r.k: r.block for r in W.blocks(rows, [], ["v", "k"], n).collect()}
        assert [blocks[r[0]] for r in order] == [b for b, size in enumerate(want) for _ in range(size)]
    assert W.placed(rows.limit(0), ["k"]).count() == W.percentile_rank(rows.limit(0), [], "v").count() == W.blocks(rows.limit(0), [], ["k"], 3).count() == 0


@pytest.mark.parametrize("metric", ["cosine", "euclid"])
def test_nearest_distances_meet_every_neighbour(spark, metric):
    from tessera.operators import joins as J

    dice = np.random.default_rng(3)
    centres = dice.normal(size=(6, 5)) * 8
    points = [centres[i % 6] + dice.normal(size=5) * 0.3 for i in range(150)] + [np.zeros(5)] * 4 + [centres[0]] * 5
    table = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)] + [(999, None)], "id long, v array<double>").repartition(5)

    def distance(a, b):
        size = np.linalg.norm(a) * np.linalg.norm(b)
        return np.linalg.norm(a - b) if metric == "euclid" else 1.0 if size <= 1e-12 else 1 - a @ b / size

    each = [[distance(a, b) for b in points] for a in points]
    for k, pivots, block in ((1, 256, 2048), (4, 12, 10), (20, 3, 25)):
        got = {r.key: r.best for r in J.nearest_distances(table, table, "id", "v", k, metric, block, pivots).collect()}
        want = {i: sorted(d for j, d in enumerate(row) if j != i)[:k] for i, row in enumerate(each)}
        assert got.keys() == want.keys()
        assert all(np.allclose(got[i], want[i], atol=2e-6) for i in want)
    few = {r.id: r.nearest for r in J.nearest_labelled(table, table.where("id in (3, 4)"), "id", "v", metric).collect()}
    assert few[999] is None and abs(few[3] - each[3][4]) < 1e-6 and abs(few[50] - min(each[50][3], each[50][4])) < 1e-6
    assert all(r.nearest is None for r in J.nearest_labelled(table, table.limit(0), "id", "v", metric).collect())


def test_no_name_is_defined_twice():
    """A second definition of a name in a module hides the first one."""
    import ast
    import pathlib

    for path in (pathlib.Path(__file__).parent.parent / "tessera").rglob("*.py"):
        names = [x.name for x in ast.parse(path.read_text()).body if isinstance(x, ast.FunctionDef | ast.ClassDef)]
        assert len(names) == len(set(names)), (path, sorted(n for n in set(names) if names.count(n) > 1))


@pytest.mark.parametrize("block_rows", [1, 3, 7, 1000])
def test_long_series_in_blocks(spark, block_rows):
    from tessera.operators import windows as W

    rng = random.Random(block_rows)
    rows = [(k, rng.choice((1.0, 2.0, 3.0, 5.0, None)) if k < 90 else float(k), 2 * k + rng.randint(0, 1)) for k in range(97)]
    df = spark.createDataFrame(rows, "k int, v double, s int").withColumn("one", F.lit(1))
    plain = {r.k: r.rolling for r in W.rolling_median(df, ["one"], ["k"], "v", 9).collect()}
    assert {r.k: r.rolling for r in W.long_rolling_median(df, ["k"], "v", 9, block_rows=block_rows).collect()} == plain
    want = sorted(tuple(r)[1:] for r in W.velocities(df, ["one"], "s", "v", ["k"]).collect())
    assert sorted(map(tuple, W.long_velocities(df, "s", "v", ["k"], block_rows).collect()), key=repr) == sorted(want, key=repr)
    assert W.long_closing_rises(df, ["k"], "v", block_rows).first().rises == W.closing_rises(df, ["one"], ["k"], "v").first().rises >= 7
    assert W.long_rolling_median(df.limit(0), ["k"], "v", 9).count() == 0 and W.long_closing_rises(df.limit(0), ["k"], "v").first().rises == 0


def test_ordered_quantiles_are_those_of_percentile(spark):
    from tessera.operators import aggregates as A

    rng = random.Random(9)
    rows = [(rng.choice(("a", "b", None)), rng.choice((None, rng.gauss(0, 5), float(rng.randint(0, 3))))) for _ in range(400)] + [("c", None), ("d", 4.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    at = [0.0, 0.1, 0.333, 0.5, 1.0]
    want = {r.g: [None if x is None else round(x, 9) for x in r[1:]] for r in A.quantiles(df, "v", at, ["g"]).collect()}
    got = {r.g: [round(x, 9) for x in r[1:]] for r in A.ordered_quantiles(df, "v", at, ["g"]).collect()}
    assert got == {g: q for g, q in want.items() if g != "c"}
    ranks = A.with_average_rank(df, ["g"], "v", "r").collect()
    plain = df.where("v IS NOT NULL").withColumn("r", A.average_rank("v", ["g"])).collect()
    assert sorted(map(repr, ranks)) == sorted(map(repr, plain))


def test_no_reason_from_a_value_that_is_not_a_number(spark):
    df = spark.range(1).select(F.lit(2.0).alias("sa"), F.lit(1.0).alias("sb"), F.lit(1.0).alias("ha"), F.lit(float("nan")).alias("hb"))
    made = lambda a, b: C.delta_reasons({"score": a, "hbonds": F.col("ha")}, {"score": b, "hbonds": F.col("hb")}, "score")
    row = df.select(made(F.col("sa"), F.col("sb")).alias("x"), made(F.col("hb"), F.col("sb")).alias("y")).first()
    assert row.x == C.UNEXPLAINED and row.y == ""


@pytest.mark.parametrize("block_rows", [1, 5, 1000])
def test_nearest_by_value_is_that_of_all_pairs(spark, block_rows):
    from tessera.operators import joins as J

    rng = random.Random(block_rows)
    rows = [(k, rng.choice(("x", "y", None, f"alone{k}")), rng.choice((1.0, 2.0, 4.0, rng.random() * 9, None))) for k in rng.sample(range(1000), 120)]
    got = {r.k: (r.partner, r.gap) for r in J.nearest_by_value(spark.createDataFrame(rows, "k int, g string, v double"), "k", ["g"], "v", block_rows).collect()}
    want = {}
    for k, g, v in rows:
        others = [(abs(v - w), j) for j, h, w in rows if j != k and h == g and w is not None] if v is not None else []
        if others:
            want[k] = min(others)[::-1]
    assert got == want


def test_evidence_of_reasons(spark):
    rows = [(2.0, 1.0, -7.0, -8.25, 3.0, 3.0), (1.0, 2.0, -7.0, -8.25, 3.0, 1.0), (1.0, 1.0, -7.0, -7.25, 1.0, 3.0), (None, 1.0, 0.0, 9.0, 1.0, 9.0), (2.0, 1.0, float("nan"), 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "sa double, sb double, aa double, ab double, la double, lb double")
    a, b = ({"score": F.col(f"s{k}"), "affinity": F.col(f"a{k}"), "logp": F.col(f"l{k}")} for k in "ab")
    got = [tuple(r) for r in df.select(C.delta_evidence(a, b, "score"), C.delta_reasons(a, b, "score")).collect()]
    assert got == [
        ("low_official_has_better_vina(-8.25<-7.00)", "vina_false_positive_or_missing_physics"), ("low_official_has_weaker_vina(-7.00>-8.25);logp_delta_low_minus_high=2.00", "vina_affinity_consistent_with_cliff;lipophilicity_shift"),
        ("logp_delta_low_minus_high=2.00", "lipophilicity_shift"), ("", ""), (C.NO_EVIDENCE, C.UNEXPLAINED),
    ]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the test tables are not here")
def test_name_alignments_of_all_parts(spark):
    """The query's scores against plain tables of all cells."""
    from tessera.plans import catalog

    names = {r.p_partkey: r.p_name for r in spark.read.parquet("/root/testdata/sf0.001/part.parquet").collect()}
    made = catalog.QUERIES["name_alignments"](spark, "/root/testdata/sf0.001").collect()
    assert {r.p_partkey for r in made} == {k for k in names if k + 1 in names}
    for r in made:
        a, b = names[r.p_partkey], names[r.p_partkey + 1]
        whole, common = np.zeros((len(a) + 1, len(b) + 1)), np.zeros((len(a) + 1, len(b) + 1))
        whole[:, 0], whole[0] = -2.0 * np.arange(len(a) + 1), -2.0 * np.arange(len(b) + 1)
        three = np.full((3, len(a) + 1, len(b) + 1), -1e9)
        three[0, 0, 0] = 0
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                same = i and j and a[i - 1] == b[j - 1]
                if i and j:
                    whole[i, j] = max(whole[i - 1, j - 1] + (2 if same else -1), whole[i - 1, j] - 2, whole[i, j - 1] - 2)
                    common[i, j] = max(common[i - 1, j], common[i, j - 1], common[i - 1, j - 1] + bool(same))
                    three[0, i, j] = three[:, i - 1, j - 1].max() + bool(same)
                if i:
                    three[1, i, j] = max(three[0, i - 1, j] - 0.1, three[1, i - 1, j] - 0.01, three[2, i - 1, j] - 0.1)
                if j:
                    three[2, i, j] = max(three[0, i, j - 1] - 0.1, three[2, i, j - 1] - 0.01, three[1, i, j - 1] - 0.1)
        assert r.score == whole[-1, -1] and abs(r.subsequence - common[-1, -1] / max(len(a), len(b))) < 1e-6 and abs(r.affine - three[:, -1, -1].max()) < 1e-6
        assert abs(r.identity - r.identical / r.compared) < 1e-6 and r.compared <= min(len(a), len(b))


def test_plane_normals_are_those_of_the_points(spark):
    rng = np.random.default_rng(4)
    rows = []
    for key in range(12):
        across = np.linalg.qr(rng.normal(size=(3, 3)))[0]
        rows += [(key, *map(float, p)) for p in rng.normal(size=(6, 2)) * 3 @ across[:2] + 0.01 * rng.normal(size=(6, 3)) + rng.normal(size=3) * 50]
    df = spark.createDataFrame([*rows, (0, None, 1.0, 2.0), (99, 1.0, 2.0, 3.0)], "k int, x double, y double, z double")
    got = {r.k: np.array([r.nx, r.ny, r.nz]) for r in K.plane_normals(df, "k", "x", "y", "z").collect()}
    for key in range(12):
        points = np.array([r[1:] for r in rows if r[0] == key])
        normal = np.linalg.svd(points - points.mean(0))[2][2]
        normal *= np.sign(normal[np.abs(normal).argmax()])
        assert np.allclose(got[key], normal, atol=1e-6)
    assert abs(np.linalg.norm(got[99]) - 1) < 1e-9
