"""Best-first search for the box whose contents go best with a target.

Every row (a key) has a number of points in space and a target; a box is worth the correlation of the target with how many of a row's points
lie in it. Boxes move in steps, so that all their faces lie on a lattice, and a box is a set of its cells. One pass over the rows
sums up, by cell and by pair of cells, what the correlation of any box is made of; the search itself reads no rows.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, functions as F

#: Pairs of cells whose sums the search may hold.
MOST_PAIRS = 4_000_000


@dataclass(frozen=True)
class Moves:
    """How a box may move and grow, by axis: where it starts, its steps and its bounds."""

    centre: Sequence[float]
    size: Sequence[float]
    centre_step: Sequence[float]
    size_step: Sequence[float]
    least_size: Sequence[float]
    most_size: Sequence[float]
    most_shift: Sequence[float]

    def units(self) -> list[Fraction]:
        """The lattice's spacing on each axis: every face that a box can have is so many spacings from the first centre."""
        out = []
        for size, *others in zip(self.size, self.centre_step, self.size_step, self.least_size, self.most_size, self.most_shift, strict=True):
            step, grow, least, most, shift = (Fraction(str(x)) for x in others)
            parts = [x for x in (step, grow / 2, least / 2, most / 2, shift, Fraction(str(size)) / 2) if x]
            unit = parts[0]
            for x in parts[1:]:
                unit = Fraction(math.gcd(unit.numerator * x.denominator, x.numerator * unit.denominator), unit.denominator * x.denominator)
            out.append(unit)
        return out


@dataclass(frozen=True)
class Box:
    """Shifts of the centre and half sizes, in lattice spacings."""

    shift: tuple[int, ...]
    half: tuple[int, ...]


class Lattice:
    """Boxes under some moves, and the cells that points lie in: even ones are the lattice's planes, odd ones lie between two."""

    def __init__(self, moves: Moves):
        self.moves, self.unit = moves, moves.units()
        of = lambda values, halved=False: [int(Fraction(str(v)) / (2 if halved else 1) / u) for v, u in zip(values, self.unit, strict=True)]
        self.step, self.grow, self.most_shift = of(moves.centre_step), of(moves.size_step, True), of(moves.most_shift)
        self.least, self.most = of(moves.least_size, True), of(moves.most_size, True)
        self.first = self.held((0,) * len(self.unit), of(moves.size, True))
        #: Farthest plane from the first centre that a face can have.
        self.reach = [s + m for s, m in zip(self.most_shift, self.most, strict=True)]

    def held(self, shift: Sequence[int], half: Sequence[int]) -> Box:
        """The nearest box within the bounds."""
        half = tuple(max(lo, min(hi, h)) for h, lo, hi in zip(half, self.least, self.most, strict=True))
        return Box(tuple(max(-m, min(m, s)) for s, m in zip(shift, self.most_shift, strict=True)), half)

    def around(self, box: Box) -> Iterator[tuple[str, Box]]:
        """The box itself and those a move away, each once."""
        seen = set()
        made = [("current", box)]
        for what, steps in (("centre", self.step), ("size", self.grow)):
            for k, sign in itertools.product(range(len(steps)), (-1, 1)):
                shift, half = list(box.shift), list(box.half)
                (shift if what == "centre" else half)[k] += sign * steps[k]
                made.append((f"{what}_{k}{sign:+d}", self.held(shift, half)))
        for move, other in made:
            if other not in seen:
                seen.add(other)
                yield move, other

    def cell(self, axes: Sequence[str]) -> list:
        """Cell indices as columns, null out of reach."""
        out = []
        for a, c, u, r in zip(axes, self.moves.centre, self.unit, self.reach, strict=True):
            at = F.round((F.col(a).cast("double") - F.lit(float(c))) / F.lit(float(u)), 9)
            index = (2 * F.floor(at) + F.when(at == F.floor(at), 0).otherwise(1)).cast("int")
            out.append(F.when((index >= -2 * r) & (index <= 2 * r), index))
        return out

    def inside(self, box: Box, cells: np.ndarray) -> np.ndarray:
        """Which cells (a row of indices each) the box has, faces included."""
        shift, half = np.array(box.shift), np.array(box.half)
        return ((cells >= 2 * (shift - half)) & (cells <= 2 * (shift + half))).all(1)

    def values(self, box: Box) -> tuple[list[float], list[float]]:
        """(centre, size) as numbers."""
        centre = [float(Fraction(str(c)) + s * u) for c, s, u in zip(self.moves.centre, box.shift, self.unit, strict=True)]
        return centre, [float(2 * h * u) for h, u in zip(box.half, self.unit, strict=True)]


@dataclass
class Sums:
    """What correlations are made of: by cell and by pair of cells over all rows."""

    rows: float
    y: float
    yy: float
    cells: np.ndarray
    x: np.ndarray
    xy: np.ndarray
    xx: np.ndarray

    def correlation(self, inside: np.ndarray) -> float:
        """Pearson correlation of the target with the number of points in a set of cells; 0 under three rows or where a side is constant."""
        x, xy, xx = self.x[inside].sum(), self.xy[inside].sum(), self.xx[np.ix_(inside, inside)].sum()
        vx, vy = self.rows * xx - x * x, self.rows * self.yy - self.y * self.y
        if self.rows < 3 or vx <= 1e-9 * max(1.0, self.rows * xx) or vy <= 1e-12 * max(1.0, self.rows * self.yy):
            return 0.0
        return float((self.rows * xy - x * self.y) / math.sqrt(vx * vy))


def sums(points: DataFrame, key: str, axes: Sequence[str], target: str, lattice: Lattice) -> Sums:
    """One pass over the points: (key, axes, target), the target being the same in all rows of a key. Keys without a target are left out; points out of every box's reach count as outside.

    A key has at most as many cells as the lattice, and so have the sums, however many rows there are.
    """
    parts = lattice.cell(axes)
    known = parts[0].isNotNull()
    for p in parts[1:]:
        known = known & p.isNotNull()
    name = F.when(known, F.concat_ws(",", *[p.cast("string") for p in parts]))
    rows = points.where(F.col(target).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), name.alias("cell"), F.col(target).cast("double").alias("y"))
    # The targets are taken about their mean, so that no digits are lost where they are large.
    middle = rows.agg(F.coalesce(F.avg("y"), F.lit(0.0)).alias("m"))
    each = rows.groupBy("k", "cell").agg(F.count("*").cast("double").alias("n"), F.first("y").alias("y")).crossJoin(F.broadcast(middle)).withColumn("y", F.col("y") - F.col("m"))  # one row
    held = each.groupBy("k").agg(F.first("y").alias("y"), F.filter(F.collect_list(F.struct("cell", "n")), lambda c: c["cell"].isNotNull()).alias("m"))
    kind = "array<struct<a:string,b:string,xx:double,x:double,xy:double>>"
    whole = F.array(F.struct(F.lit("").alias("a"), F.lit("").alias("b"), F.lit(1.0).alias("xx"), F.col("y").alias("x"), (F.col("y") * F.col("y")).alias("xy")))
    one = F.transform("m", lambda c: F.struct(c["cell"].alias("a"), F.lit("").alias("b"), F.lit(0.0).alias("xx"), c["n"].alias("x"), (c["n"] * F.col("y")).alias("xy")))
    two = F.flatten(F.transform("m", lambda c: F.transform(F.filter("m", lambda d: d["cell"] >= c["cell"]), lambda d: F.struct(c["cell"].alias("a"), d["cell"].alias("b"), (c["n"] * d["n"]).alias("xx"), F.lit(0.0).alias("x"), F.lit(0.0).alias("xy")))))
    made = held.select(F.inline(F.concat(whole, one, two).cast(kind))).groupBy("a", "b").agg(F.sum("xx").alias("xx"), F.sum("x").alias("x"), F.sum("xy").alias("xy"))
    table = made.limit(MOST_PAIRS + 1).toPandas()  # a row for each pair of cells
    if len(table) > MOST_PAIRS:
        raise ValueError("the lattice is too fine; take larger steps")
    total = table[(table["a"] == "")]
    single = table[(table["a"] != "") & (table["b"] == "")].sort_values("a")
    pairs = table[table["b"] != ""]
    names = single["a"].tolist()
    at = {c: k for k, c in enumerate(names)}
    xx = np.zeros((len(names), len(names)))
    i, j = pairs["a"].map(at).to_numpy(int), pairs["b"].map(at).to_numpy(int)
    xx[i, j] = xx[j, i] = pairs["xx"].to_numpy()
    cells = np.array([[int(v) for v in c.split(",")] for c in names], int).reshape(len(names), len(axes))
    n, y, yy = (float(total[c].iloc[0]) if len(total) else 0.0 for c in ("xx", "x", "xy"))
    return Sums(n, y, yy, cells, single["x"].to_numpy(float), single["xy"].to_numpy(float), xx)


def search(found: Sums, lattice: Lattice, depth: int = 8, budget: int = 2000, goal: float = 1.0) -> tuple[Box, float, list[dict]]:
    """(best box, its correlation, a row for each box tried), best first: the most promising box is moved and resized next, up to so many moves from a start.

    The search starts from the first box and those a move away from it. Of boxes that are equally good within 1e-9 the emptier one wins. It ends with the goal reached, the budget spent, or nothing left.
    """
    tried: dict[Box, tuple[float, float]] = {}

    def worth(box: Box) -> tuple[float, float]:
        if box not in tried:
            inside = lattice.inside(box, found.cells)
            tried[box] = found.correlation(inside), float(found.x[inside].sum())
        return tried[box]

    best, trace, open_, done = lattice.first, [], [], set()
    places = itertools.count()

    def visit(box: Box, start: int, level: int, move: str) -> None:
        nonlocal best
        r, held = worth(box)
        trace.append({"step": len(trace), "start": start, "level": level, "move": move, "pearson": r, "held": held, "box": box})
        top, least = worth(best)
        if r > top + 1e-9 or (abs(r - top) <= 1e-9 and held < least):
            best = box
        if box not in done:
            heapq.heappush(open_, (-r, next(places), start, level, box))

    for start, (_, box) in enumerate(lattice.around(lattice.first)):
        visit(box, start, 0, "start")
    while open_ and len(trace) < budget and worth(best)[0] < goal:
        _, _, start, level, box = heapq.heappop(open_)
        if box in done or level >= depth:
            continue
        done.add(box)
        for move, other in itertools.islice(lattice.around(box), budget - len(trace)):
            visit(other, start, level + 1, move)
    return best, worth(best)[0], trace


def best_box(points: DataFrame, key: str, axes: Sequence[str], target: str, moves: Moves, depth: int = 8, budget: int = 2000, goal: float = 1.0) -> DataFrame:
    """(step, start, level, move, pearson, held, selected, centre_<axis>, size_<axis>): every box that the search tried, the selected one last."""
    lattice = Lattice(moves)
    found = sums(points, key, axes, target, lattice)
    best, r, trace = search(found, lattice, depth, budget, goal)
    rows = []
    last = {"step": len(trace), "start": -1, "level": -1, "move": "selected", "pearson": r, "held": float(found.x[lattice.inside(best, found.cells)].sum()), "box": best}
    for t in [*trace, last]:
        centre, size = lattice.values(t["box"])
        rows.append((t["step"], t["start"], t["level"], t["move"], t["pearson"], t["held"], t["move"] == "selected", *centre, *size))
    schema = "step int, start int, level int, move string, pearson double, held double, selected boolean, " + ", ".join(f"`{n}_{a}` double" for n in ("centre", "size") for a in axes)
    return points.sparkSession.createDataFrame(rows, schema)
