"""Token ids in compressed binary files: an adaptive context-mixing range coder over independent blocks.

An id is predicted from the two ids before it and from the one before it. How likely the prediction holds is mixed in
the logistic domain, with weights that each block learns, from three chances: adaptive ones by the order-2 and by the order-1
confidence, and the order-0 one of the predicted id. Where it does not hold, the order-0 model of the file codes the id. Both
drive one range coder. Every block starts from the file's order-0 model and fresh adaptive state and carries a checksum,
so that blocks can be read alone; all blocks of a file are coded side by side, an id of each at a time. All
arithmetic is on integers, so that every machine decodes alike.

A file holds at most IDS ids of whole documents (a longer document has a file of its own): a header, the
documents' ids and lengths, the blocks' sizes and checksums, the order-0 frequencies, then the blocks. Ids of 65,536 and over raise ValueError. Files are named by their place in
ascending order of documents. A task writes under a name of its own attempt and renames, so that a
repeated task leaves one whole file.

Defined results: a null or empty text is the end id alone; null ids come first and are kept; repeated
rows are stored each; an empty table writes no files and reads as an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import struct
import uuid
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tessera.llm import common, tokens

MAGIC = b"TIDS0002"
BLOCK = 2048
IDS = 12 << 20
#: Order-0 frequencies of a file add up to 2**SCALE.
SCALE = 18
SLOTS = 1024
U = np.uint64
#: A range below this puts a word out.
SMALL = U(1 << 48)
HEAD = struct.Struct("<8sQQIIII")
#: Logits in 1/256 of chances in 1/4096, and back; how fast weights learn, and how large they grow.
STRETCH = np.array([max(-2047, min(2047, round(256 * math.log((p + 0.5) / (4095.5 - p))))) for p in range(4096)], np.int32)
SQUASH = np.array([max(32, min(4064, round(4096 / (1 + math.exp(-x / 256))))) for x in range(-2047, 2048)], np.int32)
RATE, SHIFT, LARGEST = 3, 13, 1 << 18
#: What a chance moves to when its prediction holds, and when not.
TRUE, FALSE = np.int32(4064), np.int32(32)
HASHES = np.uint32(40503), np.uint32(27449)
#: The chance that a prediction of a confidence holds, at a block's start.
AT_FIRST = np.array([40, 1400, 2000, 2400, 2700, 2900, 3100, 3300] * 2, np.int32)


class Zero:
    """The order-0 model of a file: ids in ascending order, with frequencies."""

    def __init__(self, ids: np.ndarray, freq: np.ndarray):
        self.ids, self.freq = ids.astype("<u2"), freq.astype("<u4")
        self.low, self.size = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.uint64)
        self.size[ids] = freq
        self.low[ids] = np.cumsum(freq) - freq
        #: The id of each place in the total.
        self.named = np.repeat(ids.astype(np.int32), freq)
        self.logit = STRETCH[np.minimum((self.size >> U(SCALE - 12)).astype(np.int64), 4095)]

    @classmethod
    def of(cls, every: np.ndarray) -> Zero:
        counts = np.bincount(every, minlength=1)
        ids = np.flatnonzero(counts)
        freq = 1 + counts[ids] * ((1 << SCALE) - len(ids)) // max(1, len(every))
        freq[freq.argmax() if len(ids) else []] += (1 << SCALE) - freq.sum()
        return cls(ids, freq)


def chosen(which: np.ndarray, yes: np.ndarray, no: np.ndarray) -> np.ndarray:
    """np.where() of integers of one type without branches, which cannot be foreseen here and take most of its time."""
    out = yes ^ no
    out &= -which.astype(out.dtype)
    out ^= no
    return out


class Model:
    """The adaptive state of so many blocks. What belongs to the order-1 and to the order-2 context lies in one array, a row for each."""

    def __init__(self, lanes: int, zero: Zero):
        self.zero = zero
        # The slots of all lanes for one context lie side by side: frequent contexts stay in the processor's cache.
        self.base = np.arange(lanes, dtype=np.uint32) + np.array([[0], [lanes * SLOTS]], np.uint32)
        self.lanes = np.uint32(lanes)
        self.hits_at = np.arange(2 * lanes, dtype=np.int32).reshape(2, lanes) * np.int32(16)
        self.two = np.zeros(lanes, np.uint32)
        self.at = self.base.astype(np.int64)
        # A slot holds an id and, in the low three bits, its confidence.
        self.table = np.zeros(2 * lanes * SLOTS, np.int32)
        self.hit = np.tile(AT_FIRST, 2 * lanes)
        self.weights = np.repeat(np.array([[26000], [39000], [3000]], np.int32), lanes, axis=1)
        self.logits = np.zeros((3, lanes), np.int32)

    def predict(self) -> None:
        self.slot = self.table.take(self.at)
        self.conf = self.slot & 7
        one, two = self.slot
        differ = one ^ two
        self.guess = chosen(two > 0, two, one)
        self.guess >>= 3
        same = (differ < 8).astype(np.int32)
        same <<= 3
        by = self.conf + same
        by += self.hits_at
        self.by = by.astype(np.int64)
        self.likely = self.hit.take(self.by)
        self.logits[:2] = STRETCH.take(self.likely)
        self.logits[2] = self.zero.logit.take(self.guess)
        parts = self.weights * self.logits
        mixed = parts[0]
        mixed += parts[1]
        mixed += parts[2]
        mixed >>= 16
        mixed += 2047
        self.chance = SQUASH.take(mixed, mode="clip")

    def learn(self, ids: np.ndarray, held: np.ndarray) -> None:
        goal = held * (TRUE - FALSE)
        goal += FALSE
        step = goal - self.likely
        step >>= 4
        step += self.likely
        self.hit[self.by] = step
        goal -= self.chance
        goal *= RATE
        self.logits *= goal
        self.logits >>= SHIFT
        self.weights += self.logits
        np.minimum(self.weights, LARGEST, out=self.weights)
        np.maximum(self.weights, -LARGEST, out=self.weights)
        # A right prediction gains confidence; a wrong one is replaced.
        fresh = ids << 3
        fresh |= 1
        right = (self.slot ^ fresh) < 8
        self.slot += self.conf < 7
        self.table[self.at] = chosen(right, self.slot, fresh)
        # Where the contexts of the next id lie; the bits that count are the same in 32 bits.
        one = ids.astype(np.uint32)
        at = np.empty((2, len(ids)), np.uint32)
        np.multiply(one, HASHES[0], out=at[1])
        np.right_shift(at[1], 4, out=at[0])
        at[1] += self.two
        at[1] >>= 5
        at &= SLOTS - 1
        at *= self.lanes
        at += self.base
        self.at = at.astype(np.int64)
        one *= HASHES[1]
        self.two = one


class Sink:
    """Range encoders side by side: a 64-bit low whose overflow is carried at once, and 16-bit words out."""

    def __init__(self, lanes: int, words: int):
        self.low, self.range = np.zeros(lanes, U), np.full(lanes, 2**64 - 1, U)
        self.width = words + 8
        self.out, self.at = np.zeros(lanes * self.width, np.uint16), np.arange(lanes, dtype=np.int64) * self.width
        self.first = self.at.copy()

    def add(self, amount: np.ndarray) -> None:
        """Raise the low of all lanes, and carry where it overflows."""
        self.low += amount
        at = self.at[np.flatnonzero(self.low < amount)] - 1
        while len(at):
            word = self.out[at] + np.uint16(1)
            self.out[at] = word
            at = at[word == 0] - 1

    def normal(self) -> None:
        """Put out the top word of every lane whose range has become small."""
        small = self.range < SMALL
        self.out[self.at] = self.low >> U(48)
        step = small.astype(U)
        step <<= U(4)
        self.low <<= step
        self.range <<= step
        self.at += small
        # At most two words: a range of 48 bits and more keeps 23 at least.
        if len(left := np.flatnonzero(self.range < SMALL)):
            self.out[self.at[left]] = self.low[left] >> U(48)
            self.low[left] <<= U(16)
            self.range[left] <<= U(16)
            self.at[left] += 1

    def finish(self) -> list[bytes]:
        for _ in range(4):
            self.out[self.at] = self.low >> U(48)
            self.low <<= U(16)
            self.at += 1
        return [self.out[a:b].astype("<u2").tobytes() for a, b in zip(self.first.tolist(), self.at.tolist(), strict=True)]


def encode_blocks(ids: np.ndarray, zero: Zero) -> list[bytes]:
    """The coded form of each row of ids."""
    lanes, length = ids.shape
    model, sink = Model(lanes, zero), Sink(lanes, 2 * length)
    rows = ids.T.astype(np.int32, order="C")
    for now in rows:
        model.predict()
        held = model.guess == now
        part = sink.range >> U(12)
        part *= model.chance.astype(U)
        # What the prediction does not take goes to the order-0 model.
        unit = sink.range - part
        unit >>= U(SCALE)
        amount = unit * zero.low.take(now)
        amount += part
        missed = (~held).astype(U)
        amount *= missed
        sink.add(amount)
        unit *= zero.size.take(now)
        sink.range = chosen(held, part, unit)
        sink.normal()
        model.learn(now, held)
    return sink.finish()


def decode_blocks(coded: list[bytes], length: int, zero: Zero) -> np.ndarray:
    """The ids of blocks made by encode_blocks()."""
    lanes = len(coded)
    width = max(map(len, coded), default=0) // 2 + 8
    words = np.zeros((lanes, width), np.uint16)
    for k, x in enumerate(coded):
        words[k, : len(x) // 2] = np.frombuffer(x, "<u2")
    flat, at = words.reshape(-1), np.arange(lanes, dtype=np.int64) * width
    code, span = np.zeros(lanes, U), np.full(lanes, 2**64 - 1, U)
    for _ in range(4):
        code = code << U(16) | flat[at]
        at += 1
    model = Model(lanes, zero)
    out = np.empty((length, lanes), np.int32)
    for step in range(length):
        model.predict()
        part = span >> U(12)
        part *= model.chance.astype(U)
        held = code < part
        # As for what the prediction did not take; where it did, the numbers mean nothing and are not used.
        mine = code - part
        unit = span - part
        unit >>= U(SCALE)
        own = zero.named.take((mine // unit).view(np.int64), mode="clip")
        mine -= unit * zero.low.take(own)
        unit *= zero.size.take(own)
        now = chosen(held, model.guess, own)
        code = chosen(held, code, mine)
        span = chosen(held, part, unit)
        small = span < SMALL
        more = small.astype(U)
        next_ = flat.take(at) * more
        more <<= U(4)
        code <<= more
        code |= next_
        span <<= more
        at += small
        if len(low := np.flatnonzero(span < SMALL)):
            code[low] = code[low] << U(16) | flat[at[low]]
            span[low] <<= U(16)
            at[low] += 1
        out[step] = now
        model.learn(now, held)
    return out.T.astype("<u4", order="C")


def file_of(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """A file with so many documents."""
    every = np.concatenate(ids)
    if len(every) and every.max() >= 1 << 16:
        raise ValueError("this format holds ids below 65,536")
    blocks = -(-len(every) // BLOCK)
    grid = np.full(blocks * BLOCK, every[-1] if len(every) else 0, "<u4")
    grid[: len(every)] = every
    zero = Zero.of(grid)
    grid = grid.reshape(blocks, BLOCK)
    coded = encode_blocks(grid, zero)
    table = zlib.compress(np.diff(zero.ids, prepend=np.uint16(0)).astype("<u2").tobytes() + zero.freq.tobytes())
    index = b"".join((
        np.array([d is not None for d in doc_ids], np.uint8).tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([len(x) for x in ids], "<u8").tobytes(),
        np.array([len(x) for x in coded], "<u4").tobytes(), np.array([zlib.crc32(g.tobytes()) for g in grid], "<u4").tobytes(), table,
    ))
    return HEAD.pack(MAGIC, len(doc_ids), len(every), BLOCK, len(zero.ids), len(table), zlib.crc32(index)) + index + b"".join(coded)


def file_ids(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, lengths, all ids) of a file; raises ValueError where a checksum fails."""
    magic, docs, n, length, kinds, stored, crc = HEAD.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("not a token file")
    blocks = -(-n // length)
    at, parts = HEAD.size, []
    for kind, count in (("u1", docs), ("<i8", docs), ("<u8", docs), ("<u4", blocks), ("<u4", blocks)):
        parts.append(np.frombuffer(raw, kind, count, at))
        at += parts[-1].nbytes
    if zlib.crc32(raw[HEAD.size : at + stored]) != crc:
        raise ValueError("the index is damaged")
    table = zlib.decompress(raw[at : at + stored])
    zero = Zero(np.cumsum(np.frombuffer(table, "<u2", kinds), dtype=np.int64), np.frombuffer(table, "<u4", kinds, 2 * kinds).astype(np.int64))
    there, doc_ids, lengths, sizes, sums = parts
    ends = at + stored + np.cumsum(sizes, dtype=np.int64)
    ids = decode_blocks([raw[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)], length, zero) if blocks else np.empty((0, length), "<u4")
    if [zlib.crc32(g.tobytes()) for g in ids] != sums.tolist():
        raise ValueError("a block is damaged")
    return [d if t else None for d, t in zip(doc_ids.tolist(), there.tolist(), strict=True)], lengths.astype(np.int64), ids.reshape(-1)[:n]


def write(docs: DataFrame, folder: str, encode: Callable[[], Callable[[str], np.ndarray]], end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all texts' ids, each followed by end_id, to files in folder in ascending order of ids; (file, n_ids, place) of each file."""

    def run(rows):
        from pyarrow import fs

        to_ids, place, nth = encode(), TaskContext.get().partitionId(), 0
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        doc_ids, ids, held = [], [], 0

        def flush():
            nonlocal doc_ids, ids, held, nth
            name = f"part-{place:06d}-{nth:06d}.tids"
            own = f"{root}/.{name}-{uuid.uuid4().hex}"
            with store.open_output_stream(own) as f:
                f.write(file_of(doc_ids, ids))
            store.move(own, f"{root}/{name}")
            row = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([held], pa.int64()), pa.array([place], pa.int32()), pa.array([nth], pa.int32())], ["file", "n_ids", "place", "nth"])
            doc_ids, ids, held, nth = [], [], 0, nth + 1
            return row

        for batch in common.batches(rows, most=tokens.SLICE):
            found = tokens.every(to_ids, batch.column(1).to_pylist())
            if max(end_id, int(np.concatenate(found).max(initial=0))) >= 1 << 16:
                raise ValueError("this format holds ids below 65,536")
            for d, own in zip(batch.column(0).to_pylist(), found, strict=True):
                x = np.empty(len(own) + 1, np.uint16)
                x[:-1], x[-1] = own, end_id
                if held and held + len(x) > IDS:
                    yield flush()
                doc_ids.append(d)
                ids.append(x)
                held += len(x)
        if doc_ids:
            yield flush()

    # nth lets a range end between rows that share an id, or repeat a row.
    keyed = common.slim(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("th"), F.monotonically_increasing_id().alias("nth"), "text")
    ordered = keyed.repartitionByRange("doc_id", "th", "nth").sortWithinPartitions("doc_id", "th", "nth").select("doc_id", "text")
    return common.written(ordered.mapInArrow(run, "file string, n_ids long, place int, nth int"))


def read(spark, folder: str, files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the listed files, decoded and verified."""
    inside = Window.partitionBy("place").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each of the writers' partitions.
    across = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    ahead = files.groupBy("place").agg(F.sum("n_ids").alias("n")).select("place", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("ahead"))
    starts = files.withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(ahead, "place").select("file", (F.col("ahead") + F.col("inside")).alias("before"))

    def run(rows):
        for batch in rows:
            for file, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc_ids, lengths, ids = file_ids(raw.as_py())
                ends = np.cumsum(lengths)
                data = memoryview(ids.tobytes())
                crc = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(crc)), pa.array(doc_ids, pa.int64()), pa.array(ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())], ["file", "doc_id", "within", "n_tokens", "ids_crc32"])

    held = spark.read.format("binaryFile").option("pathGlobFilter", "*.tids").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return held.mapInArrow(run, "file string, doc_id long, within long, n_tokens long, ids_crc32 long").join(starts, "file").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = 2, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files of all documents under a vocabulary file of the tokenizers library, and read them back."""
    spark = docs.sparkSession
    folder = folder or common.scratch(spark, "tids")
    # Named by the file system that Spark would take for it: a folder without a scheme need not be local.
    store, at = common.place_of(spark, folder)
    folder = store.makeQualified(at).toString()
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder.removeprefix("file:")
    files = write(docs, folder, lambda: tokens.encoder(vocabulary), end_id, id_col, text_col)
    if files.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read(spark, folder, files)
