"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has a bit set where over half of a text's shingle hashes have it. Every distinct
fingerprint emits all variants within half the radius; two fingerprints within the radius meet
in a variant between them. A variant's bucket holds distinct fingerprints only, at most as many
as the ball has points, and any two of them lie within the radius, so each is tied to the
bucket's smallest one and no pairs are listed. Links are verified bit by bit.

Defined results: null and empty texts have fingerprint zero and are linked like any other; texts
with fewer words than a shingle are one shingle; repeated rows and equal texts share a fingerprint;
an empty table gives an empty result; null ids are kept; other columns are ignored.
Very long texts are taken in whole: a text's shingles need some 100 bytes each in its task, and bits are counted in slices.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from tessera.llm import common
from tessera.llm.components import smallest_reachable

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
BITS = 64
#: Bins of the sketch that sorts out unlike pairs before their sets are compared, and the fingerprints over a few sampled shingles each.
BINS, TABLES, SAMPLED = 512, 8, 3
#: Centres of a bucket, and the documents of a bucket that one task puts in order.
CENTRES, PART = 3, 4096
#: Documents that tell which shingles are frequent, in how many of them one must be, and how many such shingles are put last;
#: they only set the order of a text's shingles, which prefixes need but no result depends on.
TOLD, OFTEN, LAST = 60000, 4, 1 << 19
#: Members of a prefix bucket that meet the bucket's others in one task.
BLOCK = 1024
ODD = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1)) % 2**64 | 1 for k in range(1, TABLES + 1)], np.uint64)


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64, seed 42, of each run of so many lower-cased words, repeats included."""
    parts = text.encode().translate(LOWER).split()
    if not parts:
        return np.empty(0, np.uint64)
    flat, n = b" ".join(parts), len(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    span = min(words, n)
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(flat[a:b], 42) for a, b in zip(starts[: n - span + 1].tolist(), ends[span - 1 :].tolist(), strict=True)], np.uint64, n - span + 1)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint as a signed long."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)]).astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text."""

    def run(rows):
        for batch in common.batches(rows):
            fp = [majority(shingle_hashes(t, words)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return common.slim(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def ball_links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b): links that tie together all distinct fingerprints of the column fp within an even radius of each other."""
    if radius < 0 or radius % 2:
        raise ValueError("radius must be even")
    masks = [sum(1 << k for k in flips) for n in range(radius // 2 + 1) for flips in itertools.combinations(range(BITS), n)]
    signed = [m - 2**64 if m >= 2**63 else m for m in masks]
    variants = fps.select("fp").distinct().select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(m)) for m in signed])).alias("variant"))
    met = variants.withColumn("low", F.min("fp").over(Window.partitionBy("variant"))).where("fp <> low")
    return met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("low"))) <= radius).select(F.col("low").alias("a"), F.col("fp").alias("b")).distinct()


def components(docs: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id that a document's fingerprint reaches over links."""
    own = common.written(fingerprints(docs, words, id_col, text_col))
    classes = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
    label = smallest_reachable(ball_links(own, radius))
    joined = common.written(classes.join(label, classes.fp == label.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("component")))
    smallest = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    return own.join(joined.join(smallest, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def frequent(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """The shingles that many of a bounded sample of documents have, the rarest first."""
    texts = common.slim(docs, id_col, text_col)
    step = max(1, -(-texts.count() // TOLD))
    some = shingle_sets(texts.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(step)) == 0).dropDuplicates(["text"]), words)
    counted = some.select(F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    top = counted.orderBy(F.desc("n"), "shingle").limit(LAST).select("shingle").toArrow()
    return top.column(0).to_numpy()[::-1].astype(np.int64).view(np.uint64)


def sketched(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, last: np.ndarray = np.empty(0, np.uint64)) -> DataFrame:
    """(doc_id, same, fps, sketch, size, prefix): `same` names the set of shingles; fps are the whole set's fingerprint and those of TABLES samples of it;
    sketch has the number of shingles in each bin of their hashes, in a byte; prefix has the set's first shingles, those in `last` being put last, one of which any set with that similarity shares."""
    order = np.argsort(last)
    known = last[order]

    def one(text):
        h = np.unique(shingle_hashes(text, words))
        same = xxhash.xxh3_128_digest(h.tobytes())
        fps = [majority(h)]
        mixed = h[:, None] * ODD[None, :]
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        k = min(SAMPLED, len(h))
        if len(h) > k:
            mixed = np.partition(mixed, k - 1, axis=0)[:k]
        for t in range(TABLES):
            fps.append(int(np.frombuffer(xxhash.xxh3_64_digest(np.sort(mixed[:, t]).tobytes()), "<i8")[0]) if k < SAMPLED else majority(mixed[:, t]))
        m = h * np.uint64(0xD6E8FEB86659FD93)
        m ^= m >> np.uint64(32)
        counts = np.bincount((m >> np.uint64(3)).astype(np.int64) % BINS, minlength=BINS)
        first = h
        if len(known):
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            late = known[at] == h
            first = np.concatenate((h[~late], h[late][np.argsort(order[at[late]])]))
        prefix = first[: probed(len(h), similarity)].view(np.int64)
        return same, fps, np.minimum(counts, 255).astype(np.uint8).tobytes(), len(h), prefix

    def run(rows):
        for batch in common.batches(rows):
            made = [one(t) for t in batch.column(1).to_pylist()]
            cols = [pa.array([m[k] for m in made], kind) for k, kind in enumerate((pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", "same", "fps", "sketch", "size", "prefix"])

    return common.slim(docs, id_col, text_col).mapInArrow(run, "doc_id long, same binary, fps array<long>, sketch binary, size int, prefix array<long>")


def probed(size: int, similarity: float) -> int:
    """How many of a set's shingles hold one that any set of that Jaccard similarity shares, whatever their order."""
    return size - math.ceil(similarity * size - 1e-9) + 1 if size else 0


def crossing(reps: DataFrame, label: DataFrame, similarity: float) -> DataFrame:
    """(a, b): all pairs of different components that can have the similarity, by prefixes of their sets in one order.

    Of two sets, the larger one's prefix and a shorter one of the smaller's have a shingle in common, and the first
    such leaves enough after it on both sides. Members of one component never meet, however many share a shingle;
    large buckets meet in blocks.
    """
    both = similarity / (1 + similarity)
    own = reps.join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("comp"), "size", "prefix")
    each = own.select("doc_id", "comp", "size", F.posexplode("prefix").alias("at", "shingle"))
    indexed = lambda size, at: at <= size - F.ceil(2 * both * size - F.lit(1e-9))
    mixed = each.groupBy("shingle").agg(F.count("*").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.max(indexed(F.col("size"), F.col("at"))).alias("any"))
    mixed = common.written(mixed.where("low <> high AND any").select("shingle", F.ceil(F.col("n") / BLOCK).alias("blocks")))
    held = each.join(mixed, "shingle").withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks"))
    held = common.written(held.groupBy("shingle", "blocks", "block", "comp").agg(F.collect_list(F.struct("doc_id", "size", "at")).alias("m"), F.min("size").alias("low"), F.max("size").alias("high")))
    # The smaller set of a pair has the shingle among its first ones, which few members of a large bucket do.
    least, most = F.array_min(F.transform("ms", lambda x: x["size"])), F.array_max(F.transform("ms", lambda x: F.least(x["size"] / similarity, (x["size"] - x["at"]) / both - x["size"])))
    left = held.select("shingle", "block", F.col("comp").alias("c"), F.filter("m", lambda x: indexed(x["size"], x["at"])).alias("ms")).where(F.size("ms") > 0).withColumns({"least": least, "most": most})
    right = held.select("shingle", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.col("comp").alias("d"), F.col("m").alias("ns"), "low", "high")
    met = left.join(right, ["shingle", "block"]).where((F.col("c") != F.col("d")) & (F.col("high") >= F.col("least")) & (F.col("low") <= F.col("most") + 1e-9))

    def reach(x, y):
        """x, the smaller set, and y can have the similarity when the shared shingle is their first."""
        rest = F.least(x["size"] - x["at"], y["size"] - y["at"])
        smaller = (x["size"] < y["size"]) | ((x["size"] == y["size"]) & (x["doc_id"] < y["doc_id"]))
        return smaller & (x["size"] >= similarity * y["size"] - 1e-9) & (rest >= both * (x["size"] + y["size"]) - 1e-9)

    pair = lambda x, y: F.struct(F.least(x["doc_id"], y["doc_id"]).alias("a"), F.greatest(x["doc_id"], y["doc_id"]).alias("b"))
    found = F.flatten(F.transform("ms", lambda x: F.transform(F.filter("ns", lambda y: reach(x, y)), lambda y: pair(x, y))))
    out = common.written(met.select(F.inline(found)).distinct())
    common.dropped(mixed)
    common.dropped(held)
    return out


def reachable(pairs: DataFrame, reps: DataFrame, similarity: float) -> DataFrame:
    """The (a, b) of pairs whose sketches leave room for that similarity: two sets share no more of a bin than either has in it, so that no pair is lost."""
    left, right = (reps.select(F.col("doc_id").alias(k), F.col("sketch").alias(f"sketch_{k}")) for k in "ab")

    def run(rows):
        for batch in rows:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, BINS) for k in (2, 3))
                shared = np.minimum(x, y)
                sizes = x.sum(1, dtype=np.int64) + y.sum(1, dtype=np.int64)
                # A bin that is full on both sides may hold any number.
                room = (shared.sum(1, dtype=np.int64) * (1 + similarity) >= similarity * sizes - 1e-9) | (shared == 255).any(1)
                yield batch.select([0, 1]).filter(pa.array(room))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long")


def shingle_sets(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, same, shingles): the whole set of shingle hashes; `same` as in sketched()."""

    def run(rows):
        for batch in common.batches(rows):
            sets = [np.unique(shingle_hashes(t, words)) for t in batch.column(1).to_pylist()]
            same = pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), same, pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))], ["doc_id", "same", "shingles"])

    return common.slim(docs, id_col, text_col).mapInArrow(run, "doc_id long, same binary, shingles array<long>")


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, words: int, similarity: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The (a, b) of pairs whose whole shingle sets have that Jaccard similarity; reps (doc_id, same) names the text of an id."""
    pairs = common.written(pairs)
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    # Written, so that Spark knows its size and spares the texts and sets a shuffle where it is small.
    wanted = common.written(reps.select("doc_id", "same").join(ids, "doc_id", "left_semi"))
    named = common.named(id_col).cast("long")
    some = docs.select(named.alias("doc_id"), common.named(text_col).alias("text")).join(wanted, "doc_id", "left_semi")
    sets = common.written(shingle_sets(some, words).join(wanted, ["doc_id", "same"], "left_semi"))
    # Rows that repeat an id and its text.
    if sets.count() > wanted.count():
        once = common.written(sets.dropDuplicates(["doc_id"]))
        common.dropped(sets)
        sets = once
    left, right = (sets.select(F.col("doc_id").alias(k), F.col("shingles").alias(f"set_{k}")) for k in "ab")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    out = common.written(pairs.join(left, "a").join(right, "b").where(shared / (F.size("set_a") + F.size("set_b") - shared) >= similarity).select("a", "b"))
    common.dropped(pairs)
    common.dropped(sets)
    return out


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) by Jaccard similarity of whole shingle sets; sketches only sort out pairs that cannot have it.

    First candidates meet in ball-hashing buckets of the whole set's fingerprint, radius 2. Texts of that similarity
    mostly differ in more bits, so that they also meet in min-hash bands: TABLES fingerprints of the SAMPLED shingles
    with the smallest hashes each, radius 0, which survive edits elsewhere in the text. In each
    bucket a document is compared with three centres, which share most buckets with others, and with two neighbours in an order by hash.
    These give first components, so that the many copies of a text need not meet each other. Then every pair of different
    components that can have the similarity meets by prefixes of the whole sets, so that no link between components is missed.
    Equal shingle sets are one class from the start, so copies never meet in a bucket.
    """
    own = common.written(sketched(docs, words, id_col, text_col, similarity, frequent(docs, words, id_col, text_col)))
    classes = own.groupBy("same").agg(F.min("doc_id").alias("first"))
    # The class's own row: ids are compared as such, and a null id takes no part in links.
    reps = common.written(own.join(classes.where("first IS NOT NULL"), ["same"]).where("doc_id = first").dropDuplicates(["doc_id"]).select("doc_id", "same", "fps", "sketch", "size", "prefix"))
    whole = ball_links(reps.select(F.col("fps")[0].alias("fp")), 2)
    by_fp = reps.groupBy(F.col("fps")[0].alias("fp")).agg(F.min("doc_id").alias("doc_id"))
    ball = whole.join(by_fp.select(F.col("fp").alias("a"), F.col("doc_id").alias("x")), "a").join(by_fp.select(F.col("fp").alias("b"), F.col("doc_id").alias("y")), "b").select("x", "y")
    rows = reps.select("doc_id", F.posexplode("fps").alias("t", "fp"))
    # Buckets are counted and their centres found with map-side limits, and joined back, so that no task holds a large one.
    sizes = common.written(rows.groupBy("t", "fp").agg(F.count("*").alias("size")).where("size > 1"))
    # The text that copies were edited from meets more of them than they meet each other: it has the most company.
    company = common.written(rows.join(sizes, ["t", "fp"]).withColumn("company", F.sum("size").over(Window.partitionBy("doc_id"))))
    first = F.row_number().over(Window.partitionBy("t", "fp").orderBy(F.desc("company"), "doc_id"))
    centres = common.written(company.select("t", "fp", F.col("doc_id").alias("y"), first.alias("rank")).where(F.col("rank") <= CENTRES).drop("rank"))
    part = Window.partitionBy("t", "fp", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("size") / PART))).orderBy(F.xxhash64("doc_id", "t"), "doc_id")
    beside = company.select(F.col("doc_id").alias("x"), F.lag("doc_id", 1).over(part).alias("one"), F.lag("doc_id", 2).over(part).alias("two"))
    near = company.select("t", "fp", F.col("doc_id").alias("x")).join(centres, ["t", "fp"]).select("x", "y").union(beside.select("x", F.explode(F.array("one", "two"))))
    pairs = near.union(ball).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    links = verified(reachable(pairs, reps, similarity), reps, docs, words, similarity, id_col, text_col)
    for table in (sizes, company, centres):
        common.dropped(table)
    label = smallest_reachable(links)
    met = crossing(reps, label, similarity)
    more = verified(reachable(met, reps, similarity), reps, docs, words, similarity, id_col, text_col)
    common.dropped(met)
    label = smallest_reachable(links.union(more))
    named = classes.join(label, classes["first"] == label.node, "left").select("same", F.coalesce("component", "first").alias("component_id"))
    return own.select("doc_id", "same").join(named, "same").select("doc_id", "component_id")


def representatives(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns kept, less all but the smallest id of each near-duplicate group; of rows that repeat an id and its text one stays, and rows without an id all do."""
    stay = near_duplicates(docs, words, similarity, id_col, text_col).where("doc_id = component_id").select(F.col("doc_id").alias("stay")).distinct()
    own, key = common.plain(docs), common.spot(docs, id_col)
    keyed = own.withColumn("th", F.xxhash64(F.coalesce(F.col(common.spot(docs, text_col)), F.lit(""))))
    kept = keyed.join(stay, F.col(key).cast("long") == F.col("stay"))
    kept = kept.withColumn("rn", F.row_number().over(Window.partitionBy("stay", "th").orderBy("th"))).where("rn = 1").select(*own.columns)
    return kept.union(own.where(F.col(key).isNull())).toDF(*docs.columns)
