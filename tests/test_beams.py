"""Beam search against a plain loop."""

import itertools
import random

from pyspark.sql import functions as F

from tessera.operators.beams import beam


def worth(text):
    return sum((k + 1) * (ord(c) - 96) for k, c in enumerate(text)) % 37 + len(text) / 8


def plain(seeds, rounds, per_parent, width):
    """Letters are changed, added or left out; anagrams are one candidate."""
    canon = lambda t: "".join(sorted(t))
    first = {}
    for t in sorted(set(seeds), key=lambda t: (-worth(t), t)):
        first.setdefault(canon(t), t)
    out = [(k, t, None, 0, worth(t)) for k, t in first.items()]
    seen, front = set(first), first
    for depth in range(1, rounds + 1):
        found = {}
        for k, t in front.items():
            for x in {t[:i] + c + t[j:] for i in range(len(t) + 1) for j in (i, i + 1) if j <= len(t) for c in ("", "a", "b", "c")}:
                if x and canon(x) not in seen:
                    found.setdefault(canon(x), []).append((k, -worth(x), x))
        best = {c: min(v) for c, v in found.items()}
        of = {}
        for c, (parent, s, x) in best.items():
            of.setdefault(parent, []).append((s, c, x, parent))
        kept = sorted(itertools.chain.from_iterable(sorted(v)[:per_parent] for v in of.values()))[:width]
        out += [(c, x, parent, depth, -s) for s, c, x, parent in kept]
        front = {c: x for _, c, x, _ in kept}
        seen |= set(front)
        if not front:
            break
    return out


def test_beam_search(spark):
    def expand(front):
        n = F.length("text")
        at = front.withColumn("i", F.explode(F.sequence(F.lit(0), n))).withColumn("j", F.explode(F.array(F.lit(0), F.lit(1)))).where(F.col("i") + F.col("j") <= n)
        each = at.withColumn("c", F.explode(F.array(*[F.lit(c) for c in ("", "a", "b", "c")])))
        text = F.concat(F.substr("text", F.lit(1), F.col("i")), "c", F.substr("text", F.col("i") + F.col("j") + 1))
        return each.select(text.alias("text"), F.col("key").alias("parent")).where("text <> ''").distinct()

    letters = lambda: F.filter(F.split("text", ""), lambda c: c != "")
    score = F.aggregate(F.transform(letters(), lambda c, k: (k + 1) * (F.ascii(c) - 96)), F.lit(0), lambda s, v: s + v.cast("int")) % 37 + F.length("text") / 8
    rng = random.Random(1)
    for rounds, per_parent, width in ((3, 4, 10), (4, 2, 5), (2, 100, 1000)):
        seeds = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(6)] + ["ab", "ba", "ab"]
        made = beam(spark.createDataFrame([(s,) for s in seeds], "text string"), expand, F.array_join(F.array_sort(letters()), ""), score, ["text"], rounds, per_parent, width)
        assert sorted(map(tuple, made.collect()), key=repr) == sorted(plain(seeds, rounds, per_parent, width), key=repr)
    assert beam(spark.createDataFrame([], "text string"), expand, F.col("text"), score, ["text"], 2, 2, 2).count() == 0
