"""Fill-in-the-middle: a text is cut in three at code points and put together anew around three marks.

A Split pre-tokenizer of the tokenizers library, which needs no training, isolates every match of a regular
expression and says at which code points it lies. Runs of UNIT code points are isolated first; only the runs that hold a cut, and the
last one, are isolated point by point. The runs before the last and the points of the last make the offset array, whose
length is n; the offset at a cut's rank is where the text is sliced. Texts go through the library in pieces of PIECE code
points, so that memory is bounded by the piece, however long a text is.

Where the cuts lie and which form a text takes follow from a hash of its id alone, so that any task makes the same output.

Defined results: a null or empty text is plain and stays empty; so is a text that holds one of the marks, which could not be told
from those put in; a null id counts as no digits; equal texts under different ids are cut apart differently; repeated rows are kept; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm import common

UNIT = 64
PIECE = 1 << 16
#: Marks before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
FORMS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class Offsets:
    """Code-point offsets of texts, by isolated matches."""

    def __init__(self):
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        self.runs = Split(Regex(r"[\s\S]{1,%d}" % UNIT), "isolated")
        self.points = Split(Regex(r"[\s\S]"), "isolated")

    def __call__(self, text: str) -> OffsetArray:
        starts = []
        for at in range(0, len(text), PIECE):
            starts += [at + begin for _, (begin, _) in self.runs.pre_tokenize_str(text[at : at + PIECE])]
        return OffsetArray(self, text, starts)


class OffsetArray:
    """Where each code point of a text begins, run by run."""

    def __init__(self, of: Offsets, text: str, starts: list[int]):
        self.of, self.text, self.starts = of, text, starts
        self.known: dict[int, list[int]] = {}

    def run(self, k: int) -> list[int]:
        """The offsets of the points of a run."""
        if k not in self.known:
            begin = self.starts[k]
            self.known[k] = [begin + at for _, (at, _) in self.of.points.pre_tokenize_str(self.text[begin : begin + UNIT])]
        return self.known[k]

    def __len__(self) -> int:
        return (len(self.starts) - 1) * UNIT + len(self.run(len(self.starts) - 1)) if self.starts else 0

    def __getitem__(self, rank: int) -> int:
        """The offset of the point of a rank; that of the rank after the last is the text's end."""
        if rank == len(self):
            return self.run(len(self.starts) - 1)[-1] + 1 if self.starts else 0
        return self.run(rank // UNIT)[rank % UNIT]


def cut(text: str, offsets: Offsets, draws: tuple[int, int, int, int], plain_from: int, spm_below: int, marks: tuple[str, str, str]) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of a text under four numbers drawn for it."""
    every = offsets(text)
    n = len(every)
    one, two = draws[0] % (n + 1), draws[1] % (n + 1)
    if not text or any(m in text for m in marks) or draws[2] % 100 >= plain_from:
        return n, "plain", None, None, text
    low, high = min(one, two), max(one, two)
    a, b = every[low], every[high]
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = marks
    if draws[3] % 100 < spm_below:
        return n, "spm", low, high - low, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", low, high - low, f"{p}{prefix}{s}{suffix}{m}{middle}"


def drawn(doc_id: Column, seed: int = 1) -> list[Column]:
    """Four unsigned 32-bit numbers from the hash of an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def transformed(docs: DataFrame, seed: int = 1, plain_from: int = 90, spm_below: int = 20, marks: tuple[str, str, str] = MARKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each whole text.

    Of a hundred texts about plain_from are cut, and of those about spm_below have the suffix first.
    """

    def run(rows):
        offsets = Offsets()
        for batch in common.batches(rows, most=4 << 20):
            draws = zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True)
            made = [cut(t, offsets, d, plain_from, spm_below, marks) for t, d in zip(batch.column(1).to_pylist(), draws, strict=True)]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds))], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return common.slim(docs, id_col, text_col).select("doc_id", "text", *drawn(F.col("doc_id"), seed)).mapInArrow(run, FORMS)


def restored(made: DataFrame, marks: tuple[str, str, str] = MARKS, name: str = "restored") -> DataFrame:
    """The text rebuilt from output and form alone: a mark cannot overlap one that was put in, so that each is found where it stands."""
    prefix, suffix, middle = (F.lit(m) for m in marks)
    quote = functools.partial("\\Q{}\\E".format)
    psm = F.split("output", f"{quote(marks[1])}|{quote(marks[2])}", -1)
    spm = F.split("output", f"{quote(marks[0])}|{quote(marks[2])}", -1)
    after = lambda first, mark: F.substr(first, F.length(mark) + 1)
    text = (
        F.when(F.col("form") == "psm", F.concat(after(psm[0], prefix), psm[2], psm[1]))
        .when(F.col("form") == "spm", F.concat(spm[1], spm[2], after(spm[0], suffix))).otherwise(F.col("output"))
    )
    return made.withColumn(name, text)
