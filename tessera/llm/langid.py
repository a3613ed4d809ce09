"""Language identification by error-correcting output codes.

Each language has a codeword; for each bit a binary classifier over hashed byte n-grams tells the languages with a
one from those with a zero by its grams' log-odds, averaged over the text and scaled to a log-probability. A text gets the
language whose codeword has the least logistic loss, weighted by the bits' reliability on the training rows;
near ties are flagged as ambiguous.

All training rows are used. Executors count n-grams by language, and then the training rows' margins by bit in
histograms; only these sums, whose size depends on the number of languages alone, reach the driver. More than
LANGUAGES different labels raise ValueError, as the broadcast model grows with them.

Defined results: a null text, or one without a letter, is `und` with score 0; equal texts get equal
predictions; repeated rows and null ids are kept (a null id is not held out, nor trained on); of languages with equal losses
the first by name is taken and marked ambiguous; an empty table gives an empty result, and without labelled rows everything
is `und`; columns other than text never enter a prediction.
Very long texts are taken in whole, a mebibyte of n-grams at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from tessera.llm import common, grams

#: The most labels that a model may have, and the bits of its codewords at that number.
LANGUAGES = 64
LETTER = regex.compile(r"\p{L}")
CLOSE = 0.5
#: The bins of margins, from -SPREAD to SPREAD.
BINS, SPREAD = 2048, 4.0


def codewords(languages: int, seed: int = 7) -> np.ndarray:
    """A row of -1 and 1 for each language: all splits of up to six languages, else the best of random codes."""
    if languages < 2:
        return np.ones((languages, 1), np.int8)
    if languages <= 6:
        bits = np.arange(1, 2 ** (languages - 1))
        rows = np.vstack([np.ones(len(bits), int)] + [1 - 2 * (bits >> k & 1) for k in range(languages - 1)])
        return rows.astype(np.int8)
    rng, width, best = np.random.default_rng(seed), int(np.ceil(10 * np.log2(languages))), None
    for _ in range(500):
        code = rng.choice(np.array([-1, 1], np.int8), (languages, width))
        if (np.abs(code.sum(0, dtype=int)) == languages).any():
            continue
        apart = ((code[:, None, :] != code[None, :, :]).sum(2) + width * np.eye(languages, dtype=int)).min()
        if best is None or apart > best[0]:
            best = (apart, code)
    return best[1]


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    scale: np.ndarray
    shift: np.ndarray
    reliability: np.ndarray

    def margins(self, texts: list[str]) -> np.ndarray:
        """A row of the bits' uncalibrated margins for each text."""
        data, starts = grams.laid(texts)
        return grams.summed(data, starts, self.weights) / grams.sizes(starts)[:, None]

    def losses(self, texts: list[str]) -> np.ndarray:
        margin = self.margins(texts) * self.scale + self.shift
        each = np.logaddexp(0, -margin[:, None, :] * self.code[None])
        return (each * self.reliability).sum(2)


COUNTS = "name string, slot int, n long"


def sparse(names: list[str], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The counts above zero of a row for each name."""
    for name, row in zip(names, counts, strict=True):
        there = np.flatnonzero(row)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(there), pa.string()), pa.array(there, pa.int32()), pa.array(row[there], pa.int64())], ["name", "slot", "n"])


def gathered(rows: DataFrame, names: list[str], width: int) -> np.ndarray:
    """A row of summed counts for each name: at most names times width numbers."""
    out = np.zeros((len(names), width), np.int64)
    for batch in rows.groupBy("name", "slot").agg(F.sum("n").alias("n")).toArrow().to_batches():
        name = batch.column(0).dictionary_encode()
        row = np.array([names.index(x) for x in name.dictionary.to_pylist()], np.int64)
        out[row[name.indices.to_numpy()] if len(row) else [], batch.column(1).to_numpy()] = batch.column(2).to_numpy()
    return out


def training(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(text, lang) of the rows that may be learnt from."""
    rows = docs.select(common.named(id_col).cast("long").alias("doc_id"), common.named(text_col).cast("string").alias("text"), common.named(lang_col).cast("string").alias("lang"))
    return rows.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")


def by_language(rows: DataFrame, names: list[str]) -> np.ndarray:
    """How often each n-gram is in the training texts of each language."""

    def run(batches):
        counts = np.zeros((len(names), 2 * grams.SPACE), np.int64)
        for batch in common.batches(batches, most=2 << 20):
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in set(langs):
                counts[names.index(lang)] += grams.totals([t for t, x in zip(texts, langs, strict=True) if x == lang])
        yield from sparse(names, counts)

    return gathered(rows.mapInArrow(run, COUNTS), names, 2 * grams.SPACE)


def uncalibrated(names: list[str], counts: np.ndarray) -> Model:
    """The bits' log-odds of each n-gram; a margin needs no calibration yet."""
    code = codewords(len(names))
    share = (counts + 0.5) / (counts.sum(1, keepdims=True) + grams.SPACE)
    weights = np.stack([np.log(share[bit > 0].mean(0)) - np.log(share[bit < 0].mean(0)) if (bit < 0).any() else np.zeros(2 * grams.SPACE) for bit in code.T], 1)
    bits = code.shape[1]
    return Model(names, code, weights.astype(np.float32), np.ones(bits), np.zeros(bits), np.ones(bits))


def spread(rows: DataFrame, model: Model) -> np.ndarray:
    """Histograms of the training rows' margins: (bits, right side of the bit, bins)."""
    shared, bits = rows.sparkSession.sparkContext.broadcast(model), model.code.shape[1]

    def run(batches):
        own, counts = shared.value, np.zeros(bits * 2 * BINS, np.int64)
        side = {name: (code > 0).astype(np.int64) for name, code in zip(own.languages, own.code, strict=True)}
        for batch in common.batches(batches, most=2 << 20):
            level = np.clip((own.margins(batch.column(0).to_pylist()) + SPREAD) * (BINS / (2 * SPREAD)), 0, BINS - 1).astype(np.int64)
            which = np.stack([side[x] for x in batch.column(1).to_pylist()])
            counts += np.bincount(((np.arange(bits) * 2 + which) * BINS + level).reshape(-1), minlength=len(counts))
        yield from sparse(["margins"], counts[None])

    return gathered(rows.mapInArrow(run, COUNTS), ["margins"], bits * 2 * BINS).reshape(bits, 2, BINS)


def calibrated(model: Model, histograms: np.ndarray) -> Model:
    """The model with each bit's scale, shift and reliability, by logistic regression on its histogram (Newton's method, held back by a small ridge)."""
    centres = (np.arange(BINS) + 0.5) * (2 * SPREAD / BINS) - SPREAD
    x, y = np.tile(np.stack([centres, np.ones(BINS)], 1), (2, 1)), np.repeat([0.0, 1.0], BINS)
    scale, shift, reliability = (np.zeros(len(histograms)) for _ in range(3))
    for b, histogram in enumerate(histograms):
        weight, theta = histogram.reshape(-1).astype(float), np.array([1.0, 0.0])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
            theta = theta - np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), x.T @ (weight * (p - y)) + 0.1 * theta)
        scale[b], shift[b] = theta
        right = weight[(x @ theta > 0) == (y > 0)].sum() / max(1.0, weight.sum())
        reliability[b] = max(0.05, 2 * right - 1)
    return Model(model.languages, model.code, model.weights, scale, shift, reliability / reliability.mean())


def fitted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model of all training rows, None where there are none."""
    rows = training(docs, id_col, text_col, lang_col)
    names = sorted(r["lang"] for r in rows.select("lang").distinct().limit(LANGUAGES + 1).collect())
    if len(names) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} labels")
    if not names:
        return None
    model = uncalibrated(names, by_language(rows, names))
    return calibrated(model, spread(rows, model))


def decoded(model: Model, losses: np.ndarray, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score, whether a second one is close) of each text."""
    order = np.sort(losses, 1)
    close = (order[:, 1] - order[:, 0] < CLOSE) if losses.shape[1] > 1 else np.zeros(len(texts), bool)
    score = 1 / np.exp(losses.min(1, keepdims=True) - losses).sum(1)
    lettered = np.array([LETTER.search(t) is not None for t in texts], bool)
    best = [model.languages[k] if there else "und" for k, there in zip(losses.argmin(1).tolist(), lettered.tolist(), strict=True)]
    return best, np.where(lettered, score, 0.0), close & lettered


def predicted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, id_col, text_col, lang_col))  # 2 * SPACE weights a bit, whatever the corpus

    def run(rows):
        own = shared.value
        for batch in common.batches(rows, most=2 << 20):
            texts = batch.column(1).to_pylist()
            if own is None:
                best, score, close = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            else:
                best, score, close = decoded(own, own.losses(texts), texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best), pa.array(score), pa.array(close)], ["doc_id", "lang_pred", "score", "ambiguous"])

    made = common.slim(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return made.select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")
