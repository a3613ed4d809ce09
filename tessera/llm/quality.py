"""Quality scores from weak labels: overlapping heuristics, their accuracies by EM, a hashed linear scorer.

Each heuristic votes good, bad or abstains. The counts of vote patterns over all documents (a bounded
number, whatever the corpus) go to the driver, where expectation-maximisation estimates how often each heuristic
votes what on good and on bad texts; a pattern's posterior labels its documents. A linear scorer over hashed
byte n-grams and hashed shape buckets is fitted to those labels, on about SAMPLE documents chosen by a hash
of the text (fewer where they would be over SAMPLED_BYTES together), and scores every whole text. The sample's features, at most
2 * SPACE of a text, are counted on executors; no texts reach the driver.

Defined results: a null or empty text, or one without words, has score 0 and is rejected; equal texts get
equal scores; repeated rows and null ids are kept; a score of just the threshold is kept; an empty table gives an empty
result; other columns are ignored.
Very long texts are taken in whole, in pieces of bounded size for their n-grams.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm import common, grams

SAMPLE, SAMPLED_BYTES = 4000, 8 << 20
ABSTAIN, BAD, GOOD = 0, 1, 2
#: (name, bad from or below, good from or below, whether large is bad).
HEURISTICS = (
    ("symbols", 0.12, 0.06, True), ("upper", 0.4, 0.15, True), ("repeats", 0.12, 0.04, True), ("top", 0.3, 0.15, True), ("lines", 0.4, 0.2, True),
    ("bare", 0.2, 0.05, True), ("short", 0.08, 0.2, False), ("unique", 0.15, 0.3, False), ("stops", 0.3, 0.6, False),
)
NAMES = [h[0] for h in HEURISTICS]
BUCKETS = 16


def shapes(texts: list[str]) -> np.ndarray:
    """A row of shares for each text, in the order of HEURISTICS; a text without words is a row of NaN."""
    data, starts = grams.laid(texts)
    upper = (data >= 65) & (data <= 90)
    letter = upper | ((data >= 97) & (data <= 122)) | (data >= 128)
    digit = (data >= 48) & (data <= 57)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    dark = np.maximum(1, np.add.reduceat(~blank, starts[:-1], dtype=np.int64))
    letters = np.maximum(1, np.add.reduceat(letter, starts[:-1], dtype=np.int64))
    capitals = np.add.reduceat(upper, starts[:-1], dtype=np.int64)
    symbols = np.add.reduceat(~(letter | digit | blank), starts[:-1], dtype=np.int64)
    out = np.full((len(texts), len(HEURISTICS)), np.nan)
    for k, text in enumerate(texts):
        words = text.split()
        n = len(words)
        if not n:
            continue
        seen = Counter(words)
        lines = [x for x in text.split("\n") if x.strip()]
        sizes = list(map(len, words))
        bare = sum(c for w, c in seen.items() if not any(map(str.isalnum, w)))
        out[k] = (
            # In a short text a full stop and a capital say nothing yet.
            (symbols[k] if dark[k] >= 40 else max(0, symbols[k] - 3)) / dark[k], capitals[k] / letters[k] if letters[k] >= 40 else 0.1, sum(map(eq, words, words[1:])) / n, max(seen.values()) / n if n >= 20 else 0.0, 1 - len(set(lines)) / len(lines),
            bare / n if n >= 20 else 0.0, sum(s <= 3 for s in sizes) / n if n >= 20 else 0.25, len(seen) / n if n >= 50 else 1.0, sum(x.rstrip()[-1:] in ".!?" for x in lines) / len(lines),
        )
    return out


def votes(shape: np.ndarray) -> np.ndarray:
    out = np.zeros(shape.shape, np.int8)
    for k, (_, bad, good, large) in enumerate(HEURISTICS):
        x = shape[:, k]
        out[:, k] = np.where((x >= bad) if large else (x <= bad), BAD, np.where((x <= good) if large else (x >= good), GOOD, ABSTAIN))
    out[np.isnan(shape[:, 0])] = BAD
    return out


def accuracies(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """(share of good texts, vote probabilities [class, heuristic, vote], posterior of good by pattern), by EM from a start in which heuristics are mostly right."""
    m = patterns.shape[1]
    table = np.full((2, m, 3), 1 / 3)
    table[0, :, BAD], table[0, :, GOOD], table[0, :, ABSTAIN] = 0.35, 0.45, 0.2
    table[1, :, BAD], table[1, :, GOOD], table[1, :, ABSTAIN] = 0.05, 0.8, 0.15
    prior, hot = 0.8, np.eye(3)[patterns]
    weight = counts / counts.sum()
    for _ in range(rounds):
        log = np.einsum("pmv,cmv->pc", hot, np.log(table)) + np.log([1 - prior, prior])
        good = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
        prior = float(np.clip((weight * good).sum(), 0.01, 0.99))
        for c, p in enumerate((1 - good, good)):
            mass = (weight * p) @ hot.reshape(len(hot), -1)
            table[c] = mass.reshape(m, 3) + 1e-3
            table[c] /= table[c].sum(1, keepdims=True)
    return prior, table, good


def buckets(shape: np.ndarray) -> np.ndarray:
    """The slot of each share's bucket, after those of the n-grams."""
    level = np.minimum(BUCKETS - 1, np.sqrt(np.clip(np.nan_to_num(shape, nan=1.0), 0, 1)) * BUCKETS).astype(np.int64)
    return 2 * grams.SPACE + np.arange(shape.shape[1]) * BUCKETS + level


def features(text: str, shape: np.ndarray) -> tuple[bytes, bytes]:
    """(slots, values) of a text: its n-grams' relative frequencies, and its shape buckets."""
    slot, value = grams.shares(text)
    own = buckets(shape[None])[0]
    return np.append(slot, own).astype("<i4").tobytes(), np.append(value, np.full(len(own), 0.3)).astype("<f4").tobytes()


def trained(rows: list[tuple[bytes, bytes]], good: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weights (and the bias last) of a logistic scorer on soft labels, by AdaGrad over the whole sample of features(), some rows at a time."""
    width = 2 * grams.SPACE + len(HEURISTICS) * BUCKETS
    parts = []
    for at in range(0, len(rows), 256):
        some = rows[at : at + 256]
        slot, value = (np.frombuffer(b"".join(r[k] for r in some), kind) for k, kind in ((0, "<i4"), (1, "<f4")))
        parts.append((good[at : at + 256], np.cumsum([0] + [len(r[0]) // 4 for r in some[:-1]]), np.array([len(r[0]) // 4 for r in some]), slot, value))
    w, total, bias = np.zeros(width), np.full(width, 1e-8), 0.0
    for _ in range(rounds):
        slope, off = 1e-7 * w, 0.0
        for mine, starts, sizes, slot, value in parts:
            p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(value * w[slot], starts) + bias, -30, 30)))
            slope += np.bincount(slot, value * np.repeat(p - mine, sizes), width) / len(rows)
            off += (p - mine).sum()
        total += slope**2
        w -= 0.3 * slope / np.sqrt(total)
        bias -= 2 * off / len(rows)
    return np.append(w, bias)


def probabilities(texts: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores, votes) of texts."""
    data, starts = grams.laid(texts)
    shape = shapes(texts)
    total = grams.summed(data, starts, weights[: 2 * grams.SPACE, None])[:, 0] / grams.sizes(starts) + 0.3 * weights[buckets(shape)].sum(1) + weights[-1]
    return np.where(np.isnan(shape[:, 0]), 0.0, 1 / (1 + np.exp(-np.clip(total, -30, 30)))), votes(shape)


def posteriors(source: DataFrame) -> tuple[dict[str, float], int, int]:
    """(posterior of good by vote pattern, number of texts, their characters) over all rows of a table with the column text."""

    def vote(rows):
        for batch in common.batches(rows, most=4 << 20):
            texts = batch.column(0).to_pylist()
            v = votes(shapes(texts))
            yield pa.RecordBatch.from_arrays([pa.array(["".join(map(str, x)) for x in v.tolist()]), pa.array(map(len, texts), pa.int64())], ["votes", "size"])

    counted = source.select("text").mapInArrow(vote, "votes string, size long").groupBy("votes").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()  # at most 3 ** len(HEURISTICS) rows
    if not counted:
        return {}, 0, 0
    patterns = np.array([[int(c) for c in r["votes"]] for r in counted])
    _, _, good = accuracies(patterns, np.array([r["n"] for r in counted], float))
    return {r["votes"]: float(g) for r, g in zip(counted, good, strict=True)}, sum(r["n"] for r in counted), sum(r["size"] for r in counted)


def fitted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> np.ndarray | None:
    """The scorer's weights (as many as slots, whatever the corpus); None of an empty table."""
    source = common.slim(docs, id_col, text_col).select("text")
    label, n, size = posteriors(source)
    if not n:
        return None
    rate = min(1.0, sample / n, SAMPLED_BYTES / max(1, size))
    picked = source.withColumn("th", F.xxhash64("text")).where(F.pmod(F.xxhash64("th"), F.lit(1 << 30)) < F.lit(int(rate * (1 << 30)))).dropDuplicates(["th"]).select("text")

    def count(rows):
        for batch in common.batches(rows, most=1 << 20):
            texts = batch.column(0).to_pylist()
            shape = shapes(texts)
            made = [features(t, x) for t, x in zip(texts, shape, strict=True)]
            marks = [label.get("".join(map(str, v)), 0.5) for v in votes(shape).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(marks), *(pa.array([m[k] for m in made], pa.binary()) for k in range(2))], ["good", "slots", "shares"])

    rows = picked.mapInArrow(count, "good double, slots binary, shares binary").limit(2 * sample).toArrow()
    if not rows.num_rows:
        return trained([features("", np.full(len(HEURISTICS), np.nan))], np.array([0.0]))
    return trained(list(zip(rows["slots"].to_pylist(), rows["shares"].to_pylist(), strict=True)), rows["good"].to_numpy())


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, least: float = 0.5) -> DataFrame:
    """(doc_id, votes, score, keep) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, id_col, text_col, sample))

    def score(rows):
        for batch in common.batches(rows, most=2 << 20):
            p, v = probabilities(batch.column(1).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(["".join(map(str, x)) for x in v.tolist()]), pa.array(p), pa.array(p >= least)], ["doc_id", "votes", "score", "keep"])

    return common.slim(docs, id_col, text_col).mapInArrow(score, "doc_id long, votes string, score double, keep boolean")


def filtered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, least: float = 0.5) -> DataFrame:
    """The documents that the scorer keeps, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, id_col, text_col, sample))
    own = common.plain(docs)  # mapInArrow resolves names, dots and all
    at = docs.columns.index(text_col)

    def keep(rows):
        for batch in common.batches(rows, f"c{at}", most=2 << 20):
            p, _ = probabilities([t or "" for t in batch.column(at).to_pylist()], shared.value)
            yield batch.filter(pa.array(p >= least))

    return own.mapInArrow(keep, own.schema).toDF(*docs.columns)
