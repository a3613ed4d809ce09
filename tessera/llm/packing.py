"""Packing of tokenized documents into fixed windows by non-negative least squares.

A document fills whole windows by itself as long as it can; what is left over has a length below the
window. Shallow combinations of lengths that fill a window exactly are enumerated, their repeat counts are
solved by non-negative least squares against the histogram of those lengths, rounded, and held to what
there is; leftovers beyond the counts are packed greedily, each window being filled to the end and the
document that crosses it cut there. Only the last window of that part is short.

The histogram has a bin for each length below the window and is all that reaches the driver. A document's
place follows from its rank among those of its length: ranks are counted in groups of bounded size, so
that a length which very many documents share is spread over many tasks.

Defined results: a null or empty text is the end id alone; null ids are kept; repeated rows are packed each;
an empty table gives an empty result; other columns are ignored.
Very long texts are taken in whole: their ids need four bytes each, and every window of theirs is a piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tessera.llm import common, tokens

GROUP = 4096
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def patterns_of(histogram: np.ndarray, window: int) -> np.ndarray:
    """Combinations of two or three present lengths that sum to the window, zero-padded, the best supported first: about window**2 / 12 of them."""
    there = np.flatnonzero(histogram[1:window]) + 1
    have = np.zeros(window + 1, np.int64)
    have[: len(histogram)] = histogram
    low = there[there <= window // 2]
    pairs = np.stack([np.zeros_like(low), low, window - low], 1)
    a, b = (x.reshape(-1) for x in np.meshgrid(there, there, indexing="ij"))
    c = window - a - b
    keep = (a <= b) & (b <= c)
    triples = np.stack([a[keep], b[keep], c[keep]], 1)
    found = np.concatenate([pairs, triples])
    have[0] = histogram.max(initial=0)
    support = have[found].min(1)
    found = found[support > 0]
    return found[np.argsort(-support[support > 0], kind="stable")]


def repeat_counts(histogram: np.ndarray, patterns: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares of the patterns' lengths against the histogram, by accelerated projected gradients."""
    size = len(histogram)
    target = histogram.astype(float).copy()
    target[0] = 0
    if not len(patterns):
        return np.zeros(0)
    used = patterns > 0
    uses = np.bincount(patterns[used], minlength=size)
    rate = 1.0 / (3.0 * max(1, uses.max()))
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        made = np.bincount(patterns.reshape(-1), np.repeat(y, 3), minlength=size)
        left = made - target
        left[0] = 0
        new = np.maximum(0, y - rate * left[patterns].sum(1))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


class Plan:
    """Where the document of a given rank among those of its length goes."""

    def __init__(self, histogram: np.ndarray, window: int):
        self.window = window
        left = histogram.astype(np.int64).copy()
        left[0] = 0
        patterns = patterns_of(histogram, window)
        counts = np.rint(repeat_counts(histogram, patterns)).astype(np.int64)
        taken = np.zeros(len(left), np.int64)
        ranges: dict[int, list[tuple[int, int, int]]] = {}
        self.sequences = 0
        for k in np.argsort(-counts, kind="stable").tolist():
            lengths = [x for x in patterns[k].tolist() if x]
            n = min([int(counts[k]), *(int(left[x]) // lengths.count(x) for x in lengths)])
            if n <= 0:
                continue
            offset = 0
            for x in lengths:
                ranges.setdefault(x, []).append((int(taken[x]), self.sequences, offset))
                taken[x] += n
                left[x] -= n
                offset += x
            self.sequences += n
        self.ranges = {x: tuple(np.array(v) for v in zip(*r, strict=True)) for x, r in ranges.items()}
        self.taken = taken
        ends = np.cumsum(left * np.arange(len(left)))
        self.begin = ends - left * np.arange(len(left))
        self.rest = self.sequences
        self.full = self.rest + -(-int(ends[-1]) // window)

    def place(self, length: int, rank: int) -> list[tuple[int, int, int]]:
        """(sequence, offset, tokens) of the one or two pieces."""
        if rank < self.taken[length]:
            first, sequence, offset = self.ranges[length]
            k = int(np.searchsorted(first, rank, side="right")) - 1
            return [(int(sequence[k]) + rank - int(first[k]), int(offset[k]), length)]
        at = int(self.begin[length]) + (rank - int(self.taken[length])) * length
        here = min(length, self.window - at % self.window)
        out = [(self.rest + at // self.window, at % self.window, here)]
        if here < length:
            out.append((self.rest + at // self.window + 1, 0, length - here))
        return out


def pack(docs: DataFrame, encode: Callable[[], Callable[[str], np.ndarray]], end_id: int = 0, window: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""

    def cut(rows):
        to_ids = encode()
        for batch in common.batches(rows):
            made = []
            for t in batch.column(2).to_pylist():
                ids = np.append(to_ids(t), np.uint32(end_id)).astype("<u4")
                whole = len(ids) // window
                data = memoryview(ids.tobytes())
                crc = [zlib.crc32(data[4 * window * k : 4 * window * (k + 1)]) for k in range(whole)]
                made.append((len(ids), len(ids) % window, whole, crc, ids[whole * window :].tobytes()))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            cols = [pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["doc_id", "nth", "n", "left", "whole", "crc", "ids"])

    # nth tells rows apart that repeat an id and its text; it is written with them.
    source = common.slim(docs, id_col, text_col).select("doc_id", F.monotonically_increasing_id().alias("nth"), "text")
    own = common.written(source.mapInArrow(cut, "doc_id long, nth long, n long, left int, whole long, crc array<long>, ids binary"))
    histogram = np.zeros(window, np.int64)
    for row in own.groupBy("left").count().collect():  # a row for each length below the window
        histogram[row["left"]] = row["count"]
    plan = Plan(histogram, window)
    groups = F.array(*[F.lit(int(-(-max(1, n) // GROUP))) for n in histogram.tolist()])
    salted = own.withColumn("salt", F.pmod(F.xxhash64("nth"), F.element_at(groups, F.col("left") + 1)))
    sizes = salted.groupBy("left", "salt").agg(F.count("*").alias("docs"), F.sum("whole").alias("wholes"))
    # A row for each group of about GROUP documents; over all lengths only their totals, a row for each, are added up.
    of_length = Window.partitionBy("left").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    of_all = Window.orderBy("left").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.groupBy("left").agg(F.sum("wholes").alias("wholes")).select("left", F.coalesce(F.sum("wholes").over(of_all), F.lit(0)).alias("all0"))
    sizes = sizes.select("left", "salt", F.coalesce(F.sum("docs").over(of_length), F.lit(0)).alias("rank0"), F.coalesce(F.sum("wholes").over(of_length), F.lit(0)).alias("whole0"))
    sizes = sizes.join(before, "left").select("left", "salt", "rank0", (F.col("whole0") + F.col("all0")).alias("whole0"))
    inside = Window.partitionBy("left", "salt").orderBy("doc_id", "nth").rowsBetween(Window.unboundedPreceding, -1)
    ranked = salted.withColumns({"rank": F.count("*").over(inside), "wholes": F.coalesce(F.sum("whole").over(inside), F.lit(0))}).join(sizes, ["left", "salt"])
    ranked = ranked.select("doc_id", "n", "left", (F.col("rank") + F.col("rank0")).alias("rank"), (F.col("wholes") + F.col("whole0")).alias("wholes"), "crc", "ids")

    def lay(rows):
        for batch in common.batches(rows, "ids"):
            out = []
            for d, n, left, rank, wholes, crc, ids in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                out += [(d, k * window, window, c, n, plan.full + wholes + k, 0) for k, c in enumerate(crc)]
                if left:
                    at = 0
                    for sequence, offset, length in plan.place(left, rank):
                        out.append((d, n - left + at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), n, sequence, offset))
                        at += length
            names = [c.split()[0] for c in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(7)], names)

    return ranked.mapInArrow(lay, PIECES)


def pack_texts(docs: DataFrame, vocabulary: str, end_id: int = 0, window: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """pack() under a vocabulary file of the tokenizers library."""
    return pack(docs, lambda: tokens.encoder(vocabulary), end_id, window, id_col, text_col)
