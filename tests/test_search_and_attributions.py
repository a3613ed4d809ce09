"""The box search against a plain loop over rows, and attributions of forests against enumerated subsets."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import attributions, boxes


MOVES = boxes.Moves(centre=(1.0, 2.0, -0.5), size=(4.0, 3.0, 5.0), centre_step=(0.5, 1.0, 0.5), size_step=(1.0, 1.0, 2.0), least_size=(2.0, 1.0, 1.0), most_size=(6.0, 5.0, 7.0), most_shift=(1.5, 2.0, 1.0))


def plain_search(rows, targets, moves, depth, budget, goal):
    """Best-first search in which every box reads all rows."""
    axes = range(len(moves.centre))
    keys = [k for k in targets if targets[k] is not None and k in {r[0] for r in rows}]

    def clamp(c, s):
        s = tuple(min(max(s[a], moves.least_size[a]), moves.most_size[a]) for a in axes)
        return tuple(min(max(c[a], moves.centre[a] - moves.most_shift[a]), moves.centre[a] + moves.most_shift[a]) for a in axes), s

    def around(box):
        made = [box]
        for a, sign in itertools.product(axes, (-1, 1)):
            made.append(clamp(tuple(v + sign * moves.centre_step[a] * (a == b) for b, v in enumerate(box[0])), box[1]))
        for a, sign in itertools.product(axes, (-1, 1)):
            made.append(clamp(box[0], tuple(v + sign * moves.size_step[a] * (a == b) for b, v in enumerate(box[1]))))
        return list(dict.fromkeys(made))

    def worth(box):
        c, s = box
        counts = dict.fromkeys(keys, 0)
        for k, *p in rows:
            if k in counts and all(abs(p[a] - c[a]) <= s[a] / 2 + 1e-9 for a in axes):
                counts[k] += 1
        x, y = np.array([counts[k] for k in keys], float), np.array([targets[k] for k in keys])
        if len(keys) < 3 or x.std() == 0 or y.std() == 0:
            return 0.0, x.sum()
        return float(np.corrcoef(x, y)[0, 1]), x.sum()

    first = clamp(moves.centre, moves.size)
    known, trace, front, done, best = {}, [], [], set(), first

    def visit(box, level):
        nonlocal best
        if box not in known:
            known[box] = worth(box)
        r, held = known[box]
        trace.append((box, r, held))
        if r > known[best][0] + 1e-9 or (abs(r - known[best][0]) <= 1e-9 and held < known[best][1]):
            best = box
        if box not in done:
            front.append((r, level, box))

    known[first] = worth(first)
    for box in around(first):
        visit(box, 0)
    while front and len(trace) < budget and known[best][0] < goal:
        front.sort(key=lambda f: -round(f[0], 9))
        _, level, box = front.pop(0)
        if box in done or level >= depth:
            continue
        done.add(box)
        for other in around(box):
            if len(trace) >= budget:
                break
            visit(other, level + 1)
    return best, known[best][0], trace


def drawn(seed):
    rng = random.Random(seed)
    rows, targets = [], {}
    for k in range(120):
        points = [(k, *(rng.choice((rng.uniform(-4, 6), rng.randint(-3, 5) / 2)) for _ in range(3))) for _ in range(rng.randint(0, 12))]
        rows += points
        targets[k] = sum(0.2 < p[1] < 3 and 1 < p[2] < 4 for p in points) + rng.gauss(0, 0.7) if k % 17 else None
    return rows, targets


@pytest.mark.parametrize(("seed", "depth", "budget", "goal"), [(1, 5, 150, 1.0), (2, 2, 400, 1.0), (3, 6, 300, 0.4)])
def test_box_search(spark, seed, depth, budget, goal):
    rows, targets = drawn(seed)
    df = spark.createDataFrame([(*r, targets[r[0]]) for r in rows], "k int, x double, y double, z double, score double")
    made = boxes.best_box(df, "k", ["x", "y", "z"], "score", MOVES, depth, budget, goal).orderBy("step").collect()
    (centre, size), r, trace = plain_search(rows, targets, MOVES, depth, budget, goal)
    assert len(made) == len(trace) + 1 <= budget + 1
    assert all(abs(m.pearson - t[1]) < 1e-9 and m.held == t[2] for m, t in zip(made, trace, strict=False))
    last = made[-1]
    assert last.selected and abs(last.pearson - r) < 1e-9
    assert np.allclose([last[f"{n}_{a}"] for n in ("centre", "size") for a in "xyz"], [*centre, *size])


def test_box_search_without_rows(spark):
    df = spark.createDataFrame([], "k int, x double, y double, z double, score double")
    made = boxes.best_box(df, "k", ["x", "y", "z"], "score", MOVES, 2, 30).collect()
    assert made and all(m.pearson == 0 and m.held == 0 for m in made)


def test_lattice_faces_belong_to_the_box(spark):
    moves = boxes.Moves((0.0,), (2.0,), (1.0,), (2.0,), (2.0,), (4.0,), (1.0,))
    df = spark.createDataFrame([(k, v, float(k)) for k, v in enumerate((-1.0, 1.0, 1.0000001, -0.9999999, 0.0))], "k int, x double, score double")
    lattice = boxes.Lattice(moves)
    found = boxes.sums(df, "k", ["x"], "score", lattice)
    assert found.x[lattice.inside(lattice.first, found.cells)].sum() == 4


def expected(node, x, known, label=None):
    """A tree's prediction with some features known, the rest averaged over the training rows."""
    if node.subtreeDepth() == 0:
        return attributions._leaf_value(node, label)
    split = node.split()
    left, right = node.leftChild(), node.rightChild()
    if split.featureIndex() in known:
        return expected(left if x[split.featureIndex()] <= split.threshold() else right, x, known, label)
    a, b = left.impurityStats().count(), right.impurityStats().count()
    return (a * expected(left, x, known, label) + b * expected(right, x, known, label)) / (a + b)


def by_subsets(trees, x, width, label=None):
    worth = {s: np.mean([expected(t._java_obj.rootNode(), x, s, label) for t in trees]) for n in range(width + 1) for s in itertools.combinations(range(width), n)}
    out = []
    for i in range(width):
        rest = [k for k in range(width) if k != i]
        out.append(sum(math.factorial(n) * math.factorial(width - 1 - n) / math.factorial(width) * (worth[tuple(sorted((*s, i)))] - worth[s]) for n in range(width) for s in itertools.combinations(rest, n)))
    return worth[()], out


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(6)
    rows = [(k, rng.random(), rng.random(), rng.choice((0.0, 0.5, 1.0)), rng.gauss(0, 1)) for k in range(300)]
    rows = [(*r, 3 * r[1] + r[2] * r[3] - (r[4] > 0.3) + rng.gauss(0, 0.1)) for r in rows]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, d double, y double").withColumn("big", (F.col("y") > 1.5).cast("double"))


@pytest.mark.parametrize("tabled", [10, 0])
def test_forest_attributions(table, tabled, monkeypatch):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor

    monkeypatch.setattr(attributions, "TABLED", tabled)
    names = ["a", "b", "c", "d"]
    data = VectorAssembler(inputCols=names, outputCol="features").transform(table).repartition(1)
    models = [RandomForestRegressor(labelCol="y", numTrees=3, maxDepth=5, seed=1).fit(data), DecisionTreeRegressor(labelCol="y", maxDepth=6).fit(data), RandomForestClassifier(labelCol="big", numTrees=3, maxDepth=4, seed=2).fit(data)]
    for model, label in zip(models, (None, None, 1), strict=True):
        made = attributions.attributed(data, model, names, label).orderBy("id").collect()
        told = {r.id: (r.probability[1] if label else r.prediction) for r in model.transform(data).collect()}
        assert all(abs(r.prediction - told[r.id]) < 1e-9 for r in made)
        trees = getattr(model, "trees", [model])
        for r in made[:6]:
            base, each = by_subsets(trees, [r[n] for n in names], 4, label)
            assert abs(r.base - base) < 1e-9 and np.allclose([r[f"shap_{n}"] for n in names], each, atol=1e-9)


def test_features_not_known_go_right(spark, table):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor

    names = ["a", "b", "c", "d"]
    model = DecisionTreeRegressor(labelCol="y", maxDepth=4).fit(VectorAssembler(inputCols=names, outputCol="features").transform(table))
    odd = spark.createDataFrame([(1, None, 0.5, 0.5, 0.0), (2, float("nan"), float("nan"), 1.0, None)], "id int, a double, b double, c double, d double")
    filled = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep").transform(odd)
    told = {r.id: r.prediction for r in model.transform(filled).collect()}
    assert all(abs(r.prediction - told[r.id]) < 1e-9 for r in attributions.attributed(odd, model, names).collect())
    assert {r.feature for r in attributions.mean_attributions(attributions.attributed(table, model, names), names).collect()} == set(names)
