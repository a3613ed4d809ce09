"""Audit of how filters act together: what each removes in every order in which they can be applied.

Texts are judged on their Arrow buffers. A table names the class of each byte (white space, capital, symbol, later byte of a code
point); prefix sums of the classes, read at the texts' borders, count capitals, symbols and code points, and the changes between
white space and others give the words. Every word gets a 64-bit hash from its bytes, eight at a time; a
text's hashes are sorted, and equal neighbours are compared byte by byte, so that a text in which two different
words share a hash is counted from its words themselves. A text's failures make a mask of a bit a filter.

Rows shrink to (doc_id, part, mask, digest) in that pass. Which rows repeat a smaller id's text follows from the least id of
each digest and a join on digest and id together, which no group of copies can skew. All figures then come from the
counts by part, mask and label: 2**filters cells a part, whatever the table's size.

Defined results: a null text is empty; a null or empty source is one part; a null id repeats no text and none repeats it; rows that
repeat an id and its text are counted each and do not repeat one another; labels that name an id more than once count as
set where any of them is; an empty table gives an empty result; other columns are ignored. Very long texts are
taken in whole, and need about 30 bytes of memory a byte.
"""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tessera.llm import common

WHITE, CAPITAL, SYMBOL, LATER = 1, 2, 4, 8
LETTERS = "ABCDE"
#: Bytes of a prefix sum at a time, and of a word that are hashed side by side with others'.
SLAB, WIDE = 1 << 20, 64
#: Odd multipliers of the word hash.
FIRST, NEXT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def byte_classes(symbols: bytes = b"#$%&*|") -> np.ndarray:
    """The class bits of each byte."""
    out = np.zeros(256, np.uint8)
    out[[0x20, *range(0x09, 0x0E)]] |= WHITE
    out[ord("A") : ord("Z") + 1] |= CAPITAL
    out[list(symbols)] |= SYMBOL
    out[0x80:0xC0] |= LATER
    return out


def sums_at(flags: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """How many flags are set before each border: prefix sums, a slab at a time."""
    out, total = np.zeros(len(borders), np.int64), 0
    for at in range(0, len(flags), SLAB):
        upto = np.cumsum(flags[at : at + SLAB], dtype=np.int32)
        a, b = np.searchsorted(borders, [at, at + len(upto)], side="right")
        out[a:b] = total + upto[borders[a:b] - at - 1]
        total += int(upto[-1])
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; words of over WIDE bytes are hashed one by one."""
    eights = loads(data)
    out = (eights[starts] & KEEP[np.minimum(sizes, 8)]) + sizes.astype(np.uint64) * NEXT
    left = np.flatnonzero((sizes > 8) & (sizes <= WIDE))
    at = 8
    while len(left):
        more = eights[starts[left] + at] & KEEP[np.minimum(sizes[left] - at, 8)]
        mixed = (out[left] ^ (out[left] >> np.uint64(29))) * FIRST
        out[left] = mixed + more
        at += 8
        left = left[sizes[left] > at]
    for k in np.flatnonzero(sizes > WIDE).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : starts[k] + sizes[k]])
    return out


def loads(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one integer, zeros after the end."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def same_words(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether the words of each pair have the same bytes."""
    eights = loads(data)
    out = sizes[one] == sizes[two]
    left, at = np.flatnonzero(out & (sizes[one] <= WIDE)), 0
    while len(left):
        a, b = one[left], two[left]
        keep = KEEP[np.minimum(sizes[a] - at, 8)]
        differ = ((eights[starts[a] + at] ^ eights[starts[b] + at]) & keep) != 0
        out[left[differ]] = False
        at += 8
        left = left[~differ & (sizes[a] > at)]
    for k in np.flatnonzero(out & (sizes[one] > WIDE)).tolist():
        a, b, n = starts[one[k]], starts[two[k]], sizes[one[k]]
        out[k] = np.array_equal(data[a : a + n], data[b : b + n])
    return out


def distinct_words(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, first: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The number of different words of each text; text k has the words from first[k] up to first[k + 1]."""
    order = np.arange(len(starts))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a > 1:
            order[a:b] = a + np.argsort(hashes[a:b])
    sorted_ = hashes[order]
    alike = np.flatnonzero(sorted_[1:] == sorted_[:-1]) + 1
    of = np.searchsorted(first, alike, side="right") - 1
    inside = first[of] < alike  # the neighbour is a word of the same text
    alike, of = alike[inside], of[inside]
    out = np.diff(first) - np.bincount(of, minlength=len(first) - 1)
    same = same_words(data, starts, sizes, order[alike - 1], order[alike])
    for k in np.unique(of[~same]).tolist():
        words = range(int(first[k]), int(first[k + 1]))
        out[k] = len({data[starts[w] : starts[w] + sizes[w]].tobytes() for w in words})
    return out


def measured(column: pa.Array, classes: np.ndarray) -> dict[str, np.ndarray]:
    """Words, different words, capitals, symbols and code points of each text of an Arrow column without nulls."""
    column = column.cast(pa.large_string())
    _, borders, held = column.buffers()
    ends = np.frombuffer(borders, "<i8")[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(held, np.uint8)[ends[0] : ends[-1]] if held is not None else np.empty(0, np.uint8)
    ends = ends - ends[0]
    kinds = classes[data]
    solid = (kinds & WHITE) == 0
    opens, closes = solid.copy(), solid.copy()
    opens[1:] &= ~solid[:-1]
    closes[:-1] &= ~solid[1:]
    # A text's first and last byte stand beside white space.
    some = np.diff(ends) > 0
    opens[ends[:-1][some]] = solid[ends[:-1][some]]
    closes[ends[1:][some] - 1] = solid[ends[1:][some] - 1]
    starts = np.flatnonzero(opens)
    sizes = np.flatnonzero(closes) + 1 - starts
    first = sums_at(opens, ends)
    count = lambda kind: np.diff(sums_at((kinds & kind) != 0, ends))
    return {
        "words": np.diff(first), "distinct": distinct_words(data, starts, sizes, first, word_hashes(data, starts, sizes)),
        "capitals": count(CAPITAL), "symbols": count(SYMBOL), "points": np.diff(ends) - count(LATER), "data": data, "ends": ends,
    }


def masks(m: dict[str, np.ndarray], least_words: int = 200, distinct_percent: int = 50, capital_percent: int = 2) -> np.ndarray:
    """A bit for each of the first four filters that a text fails."""
    failed = [m["words"] < least_words, 100 * m["distinct"] < distinct_percent * m["words"], 100 * m["capitals"] > capital_percent * m["points"], m["symbols"] > 0]
    return sum(f.astype(np.int32) << k for k, f in enumerate(failed))


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(doc_id, part, mask, digest) of each whole text; digest is its SHA-256."""
    classes = byte_classes()

    def run(rows):
        for batch in common.batches(rows, "text", most=4 << 20):
            m = measured(batch.column(2), classes)
            raw, ends = memoryview(m["data"]), m["ends"].tolist()
            digest = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(masks(m), pa.int32()), pa.array(digest, pa.binary())], ["doc_id", "part", "mask", "digest"])

    own = docs.select(
        common.named(id_col).cast("long").alias("doc_id"), F.coalesce(common.named(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(common.named(text_col).cast("string"), F.lit("")).alias("text")
    )
    return own.mapInArrow(run, "doc_id long, part string, mask int, digest binary")


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, good, toxic, n): how many rows of each part fail which filters, by label."""
    rows = common.written(scanned(docs, id_col, text_col, part_col).groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n")))
    first = rows.where("doc_id IS NOT NULL").groupBy(F.col("digest").alias("d")).agg(F.min("doc_id").alias("low"))
    # One row of the right side for a digest, met by those of its own id only: copies never meet in a task.
    placed = rows.join(first, (F.col("digest") == F.col("d")) & (F.col("doc_id") == F.col("low")), "left")
    repeats = (F.col("doc_id").isNotNull() & F.col("low").isNull()).cast("int")
    of = labels.select(F.col("doc_id").cast("long").alias("of"), F.col("quality"), F.col("toxic")).groupBy("of").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = placed.select("doc_id", "part", "n", (F.col("mask") + repeats * 16).alias("mask")).join(of, F.col("doc_id") == F.col("of"), "left")
    return known.groupBy("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")).agg(F.sum("n").alias("n"))


def orders(spark) -> DataFrame:
    """(filter_order, step, bit, seen): each filter of each order, and the filters before it."""
    made = []
    for order in itertools.permutations(range(len(LETTERS))):
        for step, k in enumerate(order):
            made.append(("".join(LETTERS[x] for x in order), step + 1, 1 << k, sum(1 << x for x in order[:step])))
    return spark.createDataFrame(made, "filter_order string, step int, bit int, seen int")


def settings() -> list[tuple[int, int, int]]:
    """(bit, seen, weight): each filter after each set of others, and in how many orders it comes so."""
    n = len(LETTERS)
    return [(1 << k, seen, math.factorial(seen.bit_count()) * math.factorial(n - 1 - seen.bit_count())) for k in range(n) for seen in range(1 << n) if not seen >> k & 1]


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """A row for each part, order of the filters and step: what is kept and removed there, and what the filter does by itself."""
    spark = docs.sparkSession
    table = common.written(cells(docs, labels, id_col, text_col, part_col))
    # At most 128 cells a part, against 80 settings.
    each = F.array(*[F.struct(*(F.lit(v).alias(c) for c, v in zip(("bit", "seen", "weight"), x, strict=True))) for x in settings()])
    met = table.select("*", F.inline(each))
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    before = F.col("mask").bitwiseAND(F.col("seen")) != 0
    total = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0))
    each = met.groupBy("part", "bit", "seen", "weight").agg(
        total(~fails & ~before).alias("kept"), total(fails & ~before).alias("removed"), total(fails & before).alias("redundant"), total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(fails & ~before & (F.col("good") == 1)).alias("good_lost"), total(fails & ~before & (F.col("toxic") == 1)).alias("toxic_lost"),
    )
    shares = each.groupBy("part", "bit").agg(F.sum(F.col("weight") * F.col("removed")).alias("shapley"))
    out = each.join(shares, ["part", "bit"]).join(F.broadcast(orders(spark)), ["bit", "seen"])
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
