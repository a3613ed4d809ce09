"""Exact Jaccard join of word n-gram sets by partitions of the universe, and the components of its links.

Sets are dealt into bands of sizes, so wide that a set's smaller partners lie in its own band or in the one before. A band's
limit is the largest symmetric difference that a linked pair can have whose smaller set is in it. The band cuts the universe of
shingles into segments by hash; a segment with allocation 1 is indexed by the subset that a set has there, one with allocation 2 also by
that subset less any one shingle, and one with allocation 0 not at all. Where the allocations add up to more than the limit, a linked pair cannot
differ in every segment by as much as its allocation, so that it agrees in one: both subsets are equal, or one becomes the other
by a deletion. Which allocation a band has is chosen by cost: the rows that it emits and the pairs that would meet by chance, counted in
a bounded sample of the documents. The choice changes the work and never the result.

Equal sets are one class from the start. Sets that share an indexed subset meet in its bucket. First every member is compared with the member of most company
there; then every member with the nearest one of another component; then all pairs of different components, in blocks. Before a pair is
listed, bit parities of both sets by bin bound their symmetric difference from below, so that no linked pair is lost; all listed pairs
are verified on the whole sets.

Defined results: a null, empty or wordless text has an empty set, is linked with nothing and its own component; a text with fewer words than a
shingle is one shingle; repeated rows and equal sets are one class; a null id names no component, but its text links others, and its row has
the component of its set, or null where no row of it has an id; an empty table gives an empty result; other columns are ignored.
Very long texts are taken in whole: a set needs some 40 bytes a shingle in its task. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tessera.llm import common
from tessera.llm.components import smallest_reachable
from tessera.llm.simhash import shingle_hashes

U = np.uint64
#: Documents of the sample that costs are counted in, the largest limit of a band whose allocation is chosen by them, and the cost of a pair met against that of a row emitted.
TOLD, LIMIT, MEETING = 4000, 64, 0.2
#: Members of a bucket that meet each other in one task, and bytes of parities compared at a time.
BLOCK, BYTES = 1024, 16 << 20
#: Bits of parity for each shingle of the limit, and at most.
BITS, MOST = 16, 4096
NO_ID = -(2**63)


def spread(h: np.ndarray, salt: int) -> np.ndarray:
    """Hashes mixed anew."""
    x = (h ^ (h >> U(31))) * U(0x9E3779B97F4A7C15 + 2 * salt)
    x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


class Bands:
    """Bands of set sizes for a similarity in per cent."""

    def __init__(self, percent: int):
        if not 0 < percent <= 100:
            raise ValueError("percent lies above 0 and up to 100")
        self.percent, self.low = percent, [1]

    def largest(self, band: int) -> int:
        while len(self.low) <= band + 1:
            self.low.append(100 * self.low[-1] // self.percent + 1)
        return self.low[band + 1] - 1

    def of(self, size: int) -> int:
        while self.low[-1] <= size:
            self.largest(len(self.low) - 1)
        return int(np.searchsorted(self.low, size, side="right")) - 1

    def limit(self, band: int) -> int:
        """The largest symmetric difference of a linked pair whose smaller set is in the band."""
        small = self.largest(band)
        return (100 - self.percent) * (small + 100 * small // self.percent) // (100 + self.percent)


def segments(mixed: np.ndarray, n: int) -> np.ndarray:
    """The segment of each hash; hashes in ascending order have segments in ascending order."""
    return ((mixed >> U(32)) * U(n) >> U(32)).astype(np.int64)


def keys_of(mixed: np.ndarray, band: int, allocation: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a set's subsets by segment, and of the subsets less a shingle; mixed: the set's mixed hashes, ascending."""
    n = len(allocation)
    segment = segments(mixed, n)
    own = spread(mixed, 1)
    upto = np.concatenate((np.zeros(1, U), np.cumsum(own, dtype=U)))
    borders = np.searchsorted(segment, np.arange(n + 1))
    base = (np.arange(n, dtype=U) + U(1)) * U(0xD6E8FEB86659FD93) + U(((band + 1) * 0xC2B2AE3D27D4EB4F + n * 0xA0761D6478BD642F) % 2**64)
    sums = upto[borders[1:]] - upto[borders[:-1]] + base
    twice = (allocation == 2)[segment] if len(segment) else np.zeros(0, bool)
    return spread(sums[allocation > 0], 2).view(np.int64), spread(sums[segment[twice]] - own[twice], 2).view(np.int64)


def parities(mixed: np.ndarray, limit: int) -> bytes:
    """A bit for each bin, set where the set has an odd number of shingles in it."""
    bits = min(MOST, 1 << max(6, (BITS * (limit + 1) - 1).bit_length()))
    odd = np.bincount((mixed & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def hashed(text: str, words: int) -> tuple[np.ndarray, bytes]:
    """The distinct shingles of a text, mixed and ascending, and a name of the set."""
    h = np.unique(spread(shingle_hashes(text, words), 0))
    return h, xxhash.xxh3_128_digest(h.tobytes())


def allocated(counts: list[tuple[int, int, float, float, float, float]], limit: int) -> tuple[float, np.ndarray]:
    """The cheapest allocation of segments (option, segment, rows1, pairs1, rows2, pairs2 in rising order of segments) that adds up to more than a limit."""
    table = np.array(counts, float)[:, 2:]
    one, two = table[:, 0] + MEETING * table[:, 1], table[:, 2] + MEETING * table[:, 3]
    need = limit + 1
    # best[k][j]: the least cost of the first k segments where their allocations add up to j, or to need and more.
    best = np.full((len(table) + 1, need + 1), np.inf)
    best[0, 0] = 0
    reach = [np.minimum(np.arange(need + 1) + v, need) for v in range(3)]
    prices = np.stack([np.zeros(len(table)), one, two], 1)
    for k, price in enumerate(prices):
        for v in range(3):
            np.minimum.at(best[k + 1], reach[v], best[k] + price[v])
    out, at = np.zeros(len(table), np.int8), need
    for k in range(len(table) - 1, -1, -1):
        v, at = min(((v, j) for v in range(3) for j in range(need + 1) if reach[v][j] == at), key=lambda x: best[k, x[1]] + prices[k, x[0]])
        out[k] = v
    return float(best[-1, need]), out


def allocations(docs: DataFrame, words: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> dict[int, np.ndarray]:
    """The allocation of each band that the sample has sets of, where it is not 1 throughout."""
    texts = common.slim(docs, id_col, text_col)
    every = texts.count()
    step = max(1, -(-every // TOLD))

    def emit(rows):
        bands = Bands(percent)
        for batch in common.batches(rows):
            out = []
            for text in batch.column(1).to_pylist():
                h, _ = hashed(text, words)
                band = bands.of(len(h)) if len(h) else 0
                limit = bands.limit(band)
                if not len(h) or not 0 < limit <= LIMIT:
                    continue
                for n in {limit + 1, limit // 2 + 1}:
                    exact, less = keys_of(h, band, np.full(n, 2, np.int8))
                    out.append((band, n, np.arange(n), exact, False))
                    out.append((band, n, segments(h, n), less, True))
            if not out:
                continue
            size = [len(o[2]) for o in out]
            columns = [np.repeat([o[k] for o in out], size) for k in (0, 1)] + [np.concatenate([o[k] for o in out]) for k in (2, 3)] + [np.repeat([o[4] for o in out], size)]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["band", "n", "segment", "key", "less"])

    some = texts.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(step)) == 0).dropDuplicates(["text"])
    met = some.mapInArrow(emit, "band int, n int, segment long, key long, less boolean").groupBy("band", "n", "segment", "key").agg(F.count_if(~F.col("less")).alias("e"), F.count_if("less").alias("d"))
    of = met.groupBy("band", "n", "segment").agg(
        F.sum("e").alias("rows1"), F.sum(F.col("e") * (F.col("e") - 1) / 2).alias("pairs1"), F.sum(F.col("e") + F.col("d")).alias("rows2"), F.sum(F.col("e") * (F.col("e") - 1) / 2 + F.col("e") * F.col("d")).alias("pairs2")
    )
    found: dict[int, dict[int, list]] = {}
    for r in of.orderBy("band", "n", "segment").collect():  # at most two rows a segment of the bands up to LIMIT
        found.setdefault(r["band"], {}).setdefault(r["n"], []).append((r["n"], r["segment"], step * r["rows1"], step**2 * r["pairs1"], step * r["rows2"], step**2 * r["pairs2"]))
    bands, out = Bands(percent), {}
    for band, options in found.items():
        made = [allocated(counts, bands.limit(band)) for counts in options.values()]
        best = min(made, key=lambda m: m[0])[1]
        if (best != 1).any():
            out[band] = best
    return out


def indexed(docs: DataFrame, words: int, percent: int, chosen: dict[int, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, same, size, parity, exact, less) of each document: the name of its set, its number of shingles, parities, and its keys."""

    def one(text, bands):
        h, same = hashed(text, words)
        if not len(h):
            return same, 0, b"", [], []
        own = bands.of(len(h))
        exact, less = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for band in (own, own - 1):
            if band >= 0 and (limit := bands.limit(band)) and 100 * bands.largest(band) >= percent * len(h):
                e, d = keys_of(h, band, chosen[band] if band in chosen else np.ones(limit + 1, np.int8))
                exact.append(e)
                less.append(d)
        return same, len(h), parities(h, bands.limit(own)), np.concatenate(exact), np.concatenate(less)

    def run(rows):
        bands = Bands(percent)
        kinds = (pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        for batch in common.batches(rows, "text", most=4 << 20):
            made = [one(t, bands) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds))], ["doc_id", "th", "same", "size", "parity", "exact", "less"])

    return common.slim(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, "doc_id long, th long, same binary, size long, parity binary, exact array<long>, less array<long>")


def folded(raw: list[bytes], width: int) -> np.ndarray:
    """Parities of one width, a row each: halves of wider ones are added up."""
    out = np.zeros((len(raw), width // 8), U)
    for k, x in enumerate(raw):
        out[k] = np.bitwise_xor.reduce(np.frombuffer(x, U).reshape(-1, width // 8), axis=0)
    return out


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bins each row of x and each of y differ: no more than their sets do."""
    return np.bitwise_count(x[:, None, :] ^ y[None, :, :]).sum(2, dtype=np.int64)


def near(same: list[bytes], comp: np.ndarray, size: np.ndarray, less: np.ndarray, parity: list[bytes], percent: int, nearest: bool) -> list[tuple[bytes, bytes]]:
    """The pairs of different components of a bucket that can be linked; or, for each member, the nearest of them."""
    flat = folded(parity, min(map(len, parity)))
    n, step = len(same), max(1, BYTES // max(1, flat.nbytes))
    out = []
    for at in range(0, n, step):
        rows = slice(at, at + step)
        gap = apart(flat[rows], flat)
        can = (100 + percent) * gap <= (100 - percent) * (size[rows, None] + size[None, :])
        can &= (100 * np.minimum(size[rows, None], size[None, :]) >= percent * np.maximum(size[rows, None], size[None, :])) & (comp[rows, None] != comp[None, :]) & ~(less[rows, None] & less[None, :])
        if nearest:
            gap[~can] = np.iinfo(np.int64).max
            other = gap.argmin(1)
            a = np.flatnonzero(can[np.arange(len(other)), other])
            b = other[a]
        else:
            a, b = np.nonzero(can)
            a, b = a[a + at < b], b[a + at < b]
        out += [(min(same[i], same[j]), max(same[i], same[j])) for i, j in zip((a + at).tolist(), b.tolist(), strict=True)]
    return out


def met(held: DataFrame, label: DataFrame, reps: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """(a, b): pairs of sets of different components that meet in a bucket and can be linked, each once."""
    rows = held.join(label.withColumnRenamed("node", "same"), "same", "left").select("key", "same", "less", F.coalesce("component", "same").alias("comp"))
    mixed = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    each = rows.join(mixed, "key").join(reps.select("same", "size", "parity"), "same").withColumn("x", F.pmod(F.xxhash64("same"), F.col("blocks")).cast("int"))
    each = each.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sides = each.groupBy("key", F.least("x", "y").alias("p"), F.greatest("x", "y").alias("q")).agg(F.collect_list(F.struct("same", "comp", "size", "less", "parity")).alias("m")).where(F.size("m") > 1)

    def run(batches):
        for batch in batches:
            found = set()
            column = batch.column(0)
            ends = column.offsets.to_numpy()
            members = column.values
            same, parity = members.field("same"), members.field("parity")
            comp = members.field("comp").dictionary_encode().indices.to_numpy()
            size, less = members.field("size").to_numpy(), members.field("less").to_numpy(zero_copy_only=False)
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                if (comp[a:b] != comp[a]).any():
                    found.update(near(same[a:b].to_pylist(), comp[a:b], size[a:b], less[a:b], parity[a:b].to_pylist(), percent, nearest))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)], ["a", "b"])

    return sides.select("m").mapInArrow(run, "a binary, b binary").distinct()


def possible(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of pairs that sizes and parities leave room for."""
    left, right = (reps.select(F.col("same").alias(k), F.col("size").alias(f"size_{k}"), F.col("parity").alias(f"parity_{k}")) for k in "ab")

    def run(batches):
        for batch in batches:
            keep = []
            for sa, pa_, sb, pb in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True):
                width = min(len(pa_), len(pb))
                gap = int(np.bitwise_count(folded([pa_], width) ^ folded([pb], width)).sum())
                keep.append(100 * min(sa, sb) >= percent * max(sa, sb) and (100 + percent) * gap <= (100 - percent) * (sa + sb))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "size_a", "parity_a", "size_b", "parity_b").mapInArrow(run, "a binary, b binary")


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, words: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The (a, b) of pairs whose whole sets are linked, as a written table."""
    pairs = common.written(pairs)
    names = pairs.select(F.col("a").alias("same")).union(pairs.select("b")).distinct()
    # Written, so that Spark knows its size and spares the texts a shuffle where it is small.
    wanted = common.written(reps.select("same", "slot", "th").join(names, "same", "left_semi"))
    own = common.slim(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("slot"), F.xxhash64("text").alias("th"), "text").join(wanted.select("slot", "th"), ["slot", "th"], "left_semi")

    def run(rows):
        for batch in common.batches(rows):
            sets = [hashed(t, words) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([s for _, s in sets], pa.binary()), pa.array([h.view(np.int64) for h, _ in sets], pa.list_(pa.int64()))], ["same", "shingles"])

    sets = common.written(own.select("text").mapInArrow(run, "same binary, shingles array<long>").dropDuplicates(["same"]))
    left, right = (sets.select(F.col("same").alias(k), F.col("shingles").alias(f"set_{k}")) for k in "ab")
    shared = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    linked = 100 * shared >= percent * (F.size("set_a") + F.size("set_b") - shared)
    out = common.written(pairs.join(left, "a").join(right, "b").where(linked).select("a", "b"))
    for table in (pairs, wanted, sets):
        common.dropped(table)
    return out


def components(docs: DataFrame, words: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): the size of each text's set and the smallest doc_id that it reaches over links."""
    chosen = allocations(docs, words, percent, id_col, text_col)
    own = common.written(indexed(docs, words, percent, chosen, id_col, text_col).withColumn("slot", F.coalesce("doc_id", F.lit(NO_ID))))
    classes = own.where("size > 0").groupBy("same").agg(F.min("doc_id").alias("first"))
    of = classes.select("same", F.coalesce("first", F.lit(NO_ID)).alias("slot"))
    # The row of a class's first id; a join by id too, so that copies never meet in a task.
    reps = common.written(own.join(of, ["same", "slot"]).dropDuplicates(["same", "slot"]).select("same", "slot", "th", "size", "parity", "exact", "less"))
    exact = F.transform("exact", lambda k: F.struct(k.alias("key"), F.lit(False).alias("less")))
    less = F.transform("less", lambda k: F.struct(k.alias("key"), F.lit(True).alias("less")))
    each = reps.select("same", F.inline(F.concat(exact, less)))
    shared = each.groupBy("key").agg(F.count("*").alias("n"), F.count_if(~F.col("less")).alias("e")).where("n > 1 AND e > 0").select("key", "n")
    held = common.written(each.join(shared, "key"))
    # The set that others were edited from meets more of them than they meet each other: it has the most company.
    company = held.groupBy("same").agg(F.sum("n").alias("company"))
    lead = held.join(company, "same").groupBy("key").agg(F.max(F.struct("company", "same")).alias("lead")).select("key", F.col("lead.same").alias("lead"))
    pairs = held.join(lead, "key").where("same <> lead").select(F.least("same", "lead").alias("a"), F.greatest("same", "lead").alias("b")).distinct()
    links = verified(possible(pairs, reps, percent), reps, docs, words, percent, id_col, text_col)
    held = held.select("key", "same", "less")
    for nearest in (True, False):
        label = common.written(smallest_reachable(links))
        more = verified(met(held, label, reps, percent, nearest), reps, docs, words, percent, id_col, text_col)
        links = links.union(more)
    label = smallest_reachable(links)
    named = common.written(classes.join(label.withColumnRenamed("node", "same"), "same", "left").select("same", "first", F.coalesce("component", "same").alias("component")))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    known = named.join(smallest, "component").select("same", "component_id")
    rest = own.where("size = 0").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return own.where("size > 0").select("doc_id", F.col("size").alias("n_shingles"), "same").join(known, "same").select("doc_id", "n_shingles", "component_id").union(rest)
