"""Exact removal of repeated byte strings by column-wise construction of a collection's suffix order.

Every window of `length` bytes has an anchor: the leftmost position in it whose short gram has the
smallest hash. Equal windows have equal anchors at equal offsets, so runs of windows with one anchor
(segments) need comparing only with segments of the same anchor, aligned there. Segments whose anchor
occurs once go no further. The others meet by anchor, and their suffix order is built column by column
from the right: each round inserts one symbol per segment, the symbols in suffix order being the round's
part of the collection's Burrows-Wheeler transform, and updates the common prefixes of neighbours. A
window is repeated where a neighbour in that order shares `length` bytes or more with it.

The rounds are at most 2 * length - gram, whatever the texts' lengths; each bucket's columns are held
in memory, as a bucket is bounded. Anchors with more than MOST different segments are split further, by the
whole window's 128-bit hash, which pre-aggregates; nothing is dropped or capped.

Defined results: null and empty texts, and those shorter than a window, keep everything; equal texts and
repeated rows (also those that share an id) repeat each other; null ids are kept; an empty table gives an
empty result; other columns are ignored.
Very long texts are taken in whole, two mebibytes of anchors and SLICE segments at a time, whatever their entropy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from tessera.llm import common

GRAM = 24
MOST = 1 << 16
CHUNK = 2 << 20
#: Segments whose bytes are put out at a time.
SLICE = 1 << 14
LOW = np.uint64((1 << 24) - 1)
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9)]
SEGMENT = "anchor long, content long, start int, count int, at int"


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, kid, th, text): kid and th name a row by id and text, with an id for those that have none."""
    return common.slim(docs, id_col, text_col).select("doc_id", F.coalesce("doc_id", F.lit(-(2**63))).alias("kid"), F.xxhash64("text").alias("th"), "text")


def anchored(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, content hash, start, count of windows, anchor's offset) of the segments of texts that lie end to end."""
    width = length - GRAM + 1
    found: list[list[np.ndarray]] = [[] for _ in range(5)]
    raw = memoryview(data)
    for at in range(0, max(0, len(data) - length + 1), CHUNK):
        part = data[at : at + CHUNK + length - 1]
        windows, grams = len(part) - length + 1, len(part) - GRAM + 1
        eight = np.ndarray((len(part) - 7,), "<u8", buffer=np.ascontiguousarray(part), strides=(1,))
        h = eight[:grams] * MIX[0]
        h ^= eight[8 : 8 + grams] * MIX[1]
        h += eight[16 : 16 + grams] * MIX[2]
        h ^= h >> np.uint64(29)
        h *= MIX[3]
        h ^= h >> np.uint64(32)
        h *= MIX[0]
        key = np.full(-(-grams // width) * width, ~np.uint64(0))
        key[:grams] = (h & ~LOW) | np.arange(grams, dtype=np.uint64)
        grid = key.reshape(-1, width)
        before = np.minimum.accumulate(grid, axis=1).reshape(-1)
        after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        place = (np.minimum(after[:windows], before[width - 1 : width - 1 + windows]) & LOW).astype(np.int64)
        del key, grid, before, after
        # A window lies in one text; where it does not, it belongs to no segment.
        mine = np.searchsorted(ends, np.arange(at, at + windows), side="right")
        valid = np.arange(at, at + windows) + length <= ends[mine]
        change = np.flatnonzero(np.diff(np.where(valid, place, -1), prepend=-2))
        stop = np.append(change[1:], windows)
        keep = valid[change]
        first, stop = change[keep], stop[keep]
        place = place[first]
        begin, end = (first + at).tolist(), (stop + at + length - 1).tolist()
        for k, x in enumerate((h[place].view(np.int64), np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(begin, end, strict=True)], np.uint64).view(np.int64), first + at, stop - first, place - first)):
            found[k].append(x)
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in found)


def flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw])


def marked(docs: DataFrame, length: int) -> DataFrame:
    """A row for each document, with its segments."""

    def run(rows):
        for batch in common.batches(rows, most=CHUNK):
            texts = batch.column(3).to_pylist()
            data, ends = flat(texts)
            anchor, content, start, count, at = anchored(data, ends, length)
            mine = np.searchsorted(ends, start, side="right")
            begins = np.concatenate(([0], ends[:-1]))
            rows_of = np.searchsorted(mine, np.arange(len(texts) + 1)).astype(np.int32)
            segments = pa.StructArray.from_arrays([pa.array(anchor), pa.array(content), pa.array((start - begins[mine]).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(at.astype(np.int32))], ["anchor", "content", "start", "count", "at"])
            sha = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(ends - begins, pa.int64()), pa.array(sha), pa.ListArray.from_arrays(pa.array(rows_of), segments)], ["doc_id", "kid", "th", "n_bytes", "sha", "segments"])

    return docs.mapInArrow(run, f"doc_id long, kid long, th long, n_bytes long, sha string, segments array<struct<{SEGMENT.replace(' long', ':long').replace(' int', ':int')}>>")


def shared_windows(group: np.ndarray, texts: list[bytes], at: np.ndarray, length: int) -> np.ndarray:
    """Whether each window of each segment is also in another segment of its group: a row for each segment, a column for each offset before the anchor.

    Segments are sorted by group. Round by round, from the rightmost column to the left, one symbol per segment is
    put before its suffix: a stable sort by (group, symbol) of the last round's order is the new suffix order.
    """
    n, reach = len(texts), length - GRAM
    sizes = np.array([len(t) for t in texts])
    grid = np.zeros((n, reach + length), np.int16)
    data = np.frombuffer(b"".join(texts), np.uint8)
    row = np.repeat(np.arange(n), sizes)
    inside = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    grid[row, inside - at[row] + reach] = data.astype(np.int16) + 1
    columns = np.ascontiguousarray(grid.T)
    del grid, row, inside, data
    base = np.cumsum(np.diff(group, prepend=group[0] - 1 if n else 0) != 0).astype(np.int64) * 512
    order, common_prefix = np.arange(n), np.zeros(n, np.int64)
    out = np.zeros((n, reach + 1), bool)
    for column in range(reach + length - 1, -1, -1):
        symbol = columns[column][order].astype(np.int64)
        if not symbol.any():
            continue
        key = base + symbol
        if (key[1:] >= key[:-1]).all():
            fresh = np.where(np.diff(key, prepend=-1) == 0, common_prefix + 1, 0)
            fresh[symbol == 0] = 0
        else:
            moved = np.argsort(key, kind="stable")
            same = np.flatnonzero((np.diff(key[moved], prepend=-1) == 0) & (symbol[moved] > 0))
            left, right = moved[same - 1] + 1, moved[same]
            low = common_prefix[right]
            apart = np.flatnonzero(left < right)
            if len(apart):
                # The least common prefix between two that were not neighbours.
                bounds = np.stack([left[apart], right[apart] + 1], 1).reshape(-1)
                low[apart] = np.minimum.reduceat(np.append(common_prefix, 0), bounds)[::2]
            fresh = np.zeros(n, np.int64)
            fresh[same] = low + 1
            order = order[moved]
        common_prefix = np.minimum(fresh, length)
        if column <= reach:
            met = common_prefix >= length
            met[:-1] |= met[1:]
            if met.any():
                out[order[met], column] = True
    return out


def spans_of(hit: np.ndarray) -> list[tuple[int, int]]:
    """Runs of true places, ends exclusive."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


RUNS = "anchor long, content long, runs array<struct<lo:int,hi:int>>"


def compared(segments: DataFrame, length: int) -> DataFrame:
    """(anchor, content, runs): the runs of windows, from the segment's start on, that other segments of its anchor have too."""

    def work(table: pa.Table):
        anchor = table["anchor"].to_numpy()
        at = table["at"].to_numpy().astype(np.int64)
        texts = table["bytes"].to_pylist()
        hits = shared_windows(anchor, texts, at, length)
        made = []
        for a, c, hit, off, t in zip(anchor.tolist(), table["content"].to_pylist(), hits, at.tolist(), texts, strict=True):
            # A segment's first window lies `off` before the anchor, which is column length - GRAM.
            own = hit[length - GRAM - off :][: len(t) - length + 1]
            if own.any():
                made.append((a, c, [{"lo": x, "hi": y} for x, y in spans_of(own)]))
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))
        return pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds)], ["anchor", "content", "runs"])

    def run(rows: Iterator[pa.RecordBatch]):
        held: list[pa.RecordBatch] = []
        for batch in rows:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) >= 8192:
                table = pa.Table.from_batches(held)
                anchor = table["anchor"].to_numpy()
                cut = int(np.searchsorted(anchor, anchor[-1]))
                if cut:
                    yield work(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
        if held:
            yield work(pa.Table.from_batches(held))

    return segments.repartition("anchor").sortWithinPartitions("anchor").select("anchor", "content", "at", "bytes").mapInArrow(run, RUNS)


def compared_by_window(segments: DataFrame, length: int) -> DataFrame:
    """As compared(), for anchors with very many segments: windows are counted by their own hash."""

    def run(rows):
        for batch in rows:
            for a, c, t in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(t[k : k + length]) for k in range(len(t) - length + 1)), "<i8").reshape(-1, 2)
                n = len(h)
                yield pa.RecordBatch.from_arrays([pa.array([a] * n, pa.int64()), pa.array([c] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(h[:, 0]), pa.array(h[:, 1])], ["anchor", "content", "k", "h", "g"])

    each = segments.select("anchor", "content", "bytes").mapInArrow(run, "anchor long, content long, k int, h long, g long")
    twice = each.groupBy("h", "g").agg(F.count("*").alias("n")).where("n > 1").select("h", "g")
    return each.join(twice, ["h", "g"]).groupBy("anchor", "content").agg(F.transform(F.collect_list("k"), lambda k: F.struct(k.alias("lo"), (k + 1).alias("hi"))).alias("runs"))


def repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All documents (doc_id, kid, th, n_bytes, sha), and those with repeats (kid, th, spans, kept, left): byte spans, the bytes left, and the text of the characters left whole."""
    source = keyed(docs, id_col, text_col)
    marks = common.written(marked(source, length))
    each = marks.select("kid", "th", F.inline("segments"))
    often = each.groupBy("anchor").agg(F.count("*").alias("n"), F.min("content").alias("low"), F.max("content").alias("high")).where("n > 1").select("anchor", (F.col("low") == F.col("high")).alias("alike"))
    often = common.written(often)  # both sides of the join are then exchanged, and Spark may split an anchor that very many segments have
    own = each.join(often, "anchor").groupBy("kid", "th").agg(F.collect_list(F.struct("anchor", "content", "start", "count", "at", "alike")).alias("segments"))
    # One row for each id and text; its repeats stay in the list of segments, and so in the counts.
    one = Window.partitionBy("kid", "th").orderBy("th")
    held = common.written(source.select("kid", "th", "text").join(own, ["kid", "th"]).withColumn("rn", F.row_number().over(one)).where("rn = 1").drop("rn"))

    # What the next steps need is in held; the segments may go.
    base = common.written(marks.drop("segments"))
    common.dropped(often)
    common.dropped(marks)

    def cut(rows):
        for batch in common.batches(rows, "text", CHUNK):
            data, ends = flat(batch.column(0).to_pylist())
            lists = batch.column(1)
            border = lists.offsets.to_numpy()
            first = np.repeat(np.concatenate(([0], ends[:-1])), np.diff(border))
            # A slice at a time: a text of low entropy has almost as many segments as bytes.
            for at in range(0, len(first), SLICE):
                n = min(SLICE, len(first) - at)
                anchor, content, start, count, place = lists.values.slice(border[0] + at, n).flatten()[:5]
                begin = start.to_numpy() + first[at : at + n]
                size = count.to_numpy().astype(np.int64) + length - 1
                upto = np.concatenate(([0], np.cumsum(size)))
                own = data[np.arange(upto[-1]) + np.repeat(begin - upto[:-1], size)]
                cut_out = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(upto.astype(np.int32)), pa.py_buffer(own)])
                yield pa.RecordBatch.from_arrays([anchor, content, place, cut_out], ["anchor", "content", "at", "bytes"])

    mixed = held.select("text", F.filter("segments", lambda s: ~s["alike"]).alias("segments")).where(F.size("segments") > 0)
    kinds = common.written(mixed.mapInArrow(cut, "anchor long, content long, at int, bytes binary").groupBy("anchor", "content").agg(F.first("at").alias("at"), F.first("bytes").alias("bytes"), F.count("*").alias("n")))
    crowded = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where(F.col("kinds") > MOST).select("anchor")
    if crowded.isEmpty():
        runs = compared(kinds, length)
    else:
        crowded = common.written(crowded)
        runs = compared(kinds.join(crowded, "anchor", "left_anti"), length).union(compared_by_window(kinds.join(crowded, "anchor", "left_semi"), length))
    # A segment that occurs as a whole elsewhere is repeated from end to end.
    whole = kinds.where("n > 1").select("anchor", "content", F.array(F.struct(F.lit(0).alias("lo"), F.lit(2**31 - 1).alias("hi"))).alias("runs"))
    runs = common.written(runs.union(whole))
    common.dropped(kinds)
    places = held.select("kid", "th", F.inline("segments"))
    alike = places.where("alike").select("kid", "th", "start", F.col("start").alias("lo"), (F.col("start") + F.col("count")).alias("hi"))
    met = places.where("NOT alike").join(runs, ["anchor", "content"]).select("kid", "th", "start", "count", F.inline("runs")).select("kid", "th", "start", F.col("start") + F.col("lo"), F.col("start") + F.least("count", "hi"))
    spans = alike.union(met).groupBy("kid", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("hits"))

    def remove(rows):
        for batch in common.batches(rows, "text", CHUNK):
            out = []
            for t, hits in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                raw, pairs = t.encode(), hits.values
                mark = np.zeros(len(raw) + 1, np.int32)
                np.add.at(mark, pairs.field(0).to_numpy(), 1)
                np.add.at(mark, np.minimum(pairs.field(1).to_numpy() + length - 1, len(raw)), -1)
                gone = np.cumsum(mark[:-1]) > 0
                data = np.frombuffer(raw, np.uint8)
                first = (data & 0xC0) != 0x80
                whole = np.logical_or.reduceat(gone, np.flatnonzero(first))[np.cumsum(first) - 1]
                out.append(([{"start": a, "end": b} for a, b in spans_of(gone)], data[~gone].tobytes(), data[~whole].tobytes().decode()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([o[0] for o in out], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.string())], ["kid", "th", "spans", "kept", "left"])

    found = held.select("kid", "th", "text").join(spans, ["kid", "th"]).mapInArrow(remove, "kid long, th long, spans array<struct<start:long,end:long>>, kept binary, left string")
    return base, found


def without(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns kept, less every character that a repeated string covers in part."""
    _, found = repeats(docs, length, id_col, text_col)
    own, text = common.plain(docs), common.spot(docs, text_col)
    keys = {"kid": F.coalesce(F.col(common.spot(docs, id_col)).cast("long"), F.lit(-(2**63))), "th": F.xxhash64(F.coalesce(F.col(text), F.lit("")))}
    joined = own.withColumns(keys).join(found.select("kid", "th", "left"), ["kid", "th"], "left")
    return joined.select(*[F.coalesce("left", c).alias(c) if c == text else c for c in own.columns]).toDF(*docs.columns)


def digests(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    marks, found = repeats(docs, length, id_col, text_col)
    short = found.select("kid", "th", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("removed"), F.size("spans").cast("long").alias("n"), F.sha2("kept", 256).alias("kept"))
    return marks.join(short, ["kid", "th"], "left").select("doc_id", "n_bytes", F.coalesce("removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept", "sha").alias("kept_sha256"))
