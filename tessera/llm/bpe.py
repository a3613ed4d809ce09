"""BPE encoding and decoding for a lower-casing word vocabulary with end-of-word tokens.

Each distinct word is merged with a contiguous rank array: a row holds the word's
parts and the ranks of its adjacent pairs; the row's minimum is found by a scan,
that boundary is deleted, and the two neighbouring ranks are looked up anew. Words
of like length share one matrix, so that a scan runs over thousands of words.

No word spans white space, so texts are cut there and each distinct chunk is encoded once a while. ASCII chunks are split here;
all others by the vocabulary file's own normalizer and pre-tokenizer in the tokenizers library, so that
letters are what that library holds for letters.

Defined results: a null or empty text has no ids and decodes to the empty text; a null
id is kept; words of over LONG bytes are merged by a heap of their pairs, some 60 bytes of memory a byte; equal
texts have equal ids; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array
from collections.abc import Iterable
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import common

#: ASCII words of the vocabulary's pre-tokenizer, in lower case.
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)
CHUNK = re.compile(r"[^\t-\r ]+")
NONE = np.iinfo(np.int32).max
LONG = 48
#: Bits of a place in a long word.
PLACE = 40
CACHED = 150_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it is printable Latin-1, else the next one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class WordBpe:
    """A vocabulary file's encoder and decoder."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.normal, self.split = library.normalizer, library.pre_tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, self.end = spec["model"]["vocab"], spec["model"].get("end_of_word_suffix") or ""
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *added.values()]) + 1
        self.tokens: list[str] = [""] * self.size
        for token, i in [*vocab.items(), *added.items()]:
            self.tokens[i] = token
        self.added = {t: np.array([i], "<u4").tobytes() for t, i in added.items()}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        letters = byte_letters()
        self.bytes_of = {c: b for b, c in enumerate(letters)}
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + self.end] for c in letters], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.rank_of, self.made_by = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True)), self.made.tolist()
        self.known: dict[bytes, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where it never merges or one side is missing (-1)."""
        keys = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (left >= 0) & (right >= 0), self.ranks[at], NONE)

    def merge_rows(self, parts: np.ndarray) -> list[bytes]:
        """Merge the words of a matrix, a word a row and -1 after its end."""
        n, width = parts.shape
        out: list[bytes] = [b""] * n
        row = np.arange(n)
        right = np.full_like(parts, -1)
        right[:, :-1] = parts[:, 1:]
        ranks = self.pair_ranks(parts, right)
        places = np.arange(width)
        while len(row):
            at = ranks.argmin(1)
            here = np.arange(len(row))
            best = ranks[here, at]
            over = best == NONE
            if over.any():
                ids = parts[over].astype("<u4")
                for k, tokens, n_parts in zip(row[over].tolist(), ids, (parts[over] >= 0).sum(1).tolist(), strict=True):
                    out[k] = tokens[:n_parts].tobytes()
                live = ~over
                row, parts, ranks, at, best = row[live], parts[live], ranks[live], at[live], best[live]
                if not len(row):
                    break
                here = np.arange(len(row))
            parts[here, at] = self.made[best]
            # Delete the boundary: what stands right of it moves one place to the left.
            take = np.minimum(places + (places > at[:, None]), width - 1)
            parts = np.take_along_axis(parts, take, 1)
            ranks = np.take_along_axis(ranks, np.minimum(places + (places >= at[:, None]), width - 1), 1)
            parts[:, -1], ranks[:, -1] = -1, NONE
            # Refresh the ranks on either side of the new part.
            after = np.where(at + 1 < width, parts[here, np.minimum(at + 1, width - 1)], -1)
            ranks[here, at] = self.pair_ranks(parts[here, at], after)
            left = at > 0
            ranks[here[left], at[left] - 1] = self.pair_ranks(parts[here[left], at[left] - 1], parts[here[left], at[left]])
        return out

    def merge_long(self, raw: bytes) -> bytes:
        """One very long word: a heap of its pairs by rank and place over a linked list of its parts, so that time hardly grows faster than the word."""
        first = self.inner[np.frombuffer(raw, np.uint8)].copy()
        first[-1] = self.last[raw[-1]]
        n = len(first)
        ranks = self.pair_ranks(first[:-1], first[1:]).astype(np.int64)
        there = np.flatnonzero(ranks != NONE)
        heap = np.sort(ranks[there] << PLACE | there).tolist()  # in order, so a heap
        parts, after, before = (array("q", x.astype(np.int64).tobytes()) for x in (first, np.arange(1, n + 1), np.arange(-1, n - 1)))
        rank_of, size = self.rank_of, self.size
        while heap:
            top = heappop(heap)
            at, rank = top & (1 << PLACE) - 1, top >> PLACE
            right = after[at]
            # The pair may have gone meanwhile, or be another one.
            if parts[at] < 0 or right >= n or rank_of.get(parts[at] * size + parts[right]) != rank:
                continue
            parts[at], parts[right] = self.made_by[rank], -1
            end = after[at] = after[right]
            if end < n:
                before[end] = at
                if (fresh := rank_of.get(parts[at] * size + parts[end])) is not None:
                    heappush(heap, fresh << PLACE | at)
            if (left := before[at]) >= 0 and (fresh := rank_of.get(parts[left] * size + parts[at])) is not None:
                heappush(heap, fresh << PLACE | left)
        out = np.frombuffer(parts, np.int64)
        return out[out >= 0].astype("<u4").tobytes()

    def learn(self, words: set[bytes]) -> None:
        """Encode the words that are not known yet."""
        if len(self.known) > CACHED:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        sizes = np.array([len(w) for w in new], np.int64)
        for lo, hi in ((1, 4), (5, 8), (9, 12), (13, 18), (19, 30), (31, LONG)):
            picked = np.flatnonzero((sizes >= lo) & (sizes <= hi))
            for start in range(0, len(picked), 20_000):
                part = picked[start : start + 20_000]
                self.known.update(zip((new[k] for k in part.tolist()), self.merge_rows(self.laid([new[k] for k in part.tolist()], hi)), strict=True))
        for k in np.flatnonzero(sizes > LONG).tolist():
            self.known[new[k]] = self.merge_long(new[k])

    def laid(self, words: list[bytes], width: int) -> np.ndarray:
        """The words' bytes as parts, a word a row."""
        sizes, rows = np.array([len(w) for w in words]), np.arange(len(words))
        grid = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
        parts = np.where(np.arange(width) < sizes[:, None], self.inner[grid], -1)
        parts[rows, sizes - 1] = self.last[grid[rows, sizes - 1]]
        return parts.astype(np.int32)

    def words(self, chunk: str) -> list[bytes]:
        """A chunk's words as bytes."""
        if chunk.isascii():
            return [w.encode() for w in WORDS.findall(chunk.lower())]
        return [bytes(map(self.bytes_of.__getitem__, w)) for w, _ in self.split.pre_tokenize_str(self.normal.normalize_str(chunk))]

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.chunks) > CACHED:
            self.chunks.clear()
        cut: list[list] = []
        for text in texts:
            if self.marks is not None and "<|" in text:
                cut.append([x if k % 2 else CHUNK.findall(x) for k, x in enumerate(self.marks.split(text))])
            else:
                cut.append([CHUNK.findall(text)])
        new = {c: () for parts in cut for chunks in parts if isinstance(chunks, list) for c in chunks if c not in self.chunks}
        new = {c: self.words(c) for c in new}
        self.learn({w for words in new.values() for w in words})
        self.chunks.update((c, b"".join(map(self.known.__getitem__, words))) for c, words in new.items())
        known = self.chunks.__getitem__
        out = [b"".join([self.added[p] if isinstance(p, str) else b"".join(map(known, p)) for p in parts]) for parts in cut]
        for of in (self.known, self.chunks):
            for w in [w for w in of if len(w) > LONG]:
                del of[w]
        return out

    def decode(self, ids: bytes) -> str:
        """Tokens joined by a space: the vocabulary names no decoder of its own."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=4)
def loaded(path: str) -> WordBpe:
    return WordBpe(path)


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): each whole text's ids, a binary of little-endian unsigned 32-bit integers."""

    def run(rows):
        bpe = loaded(vocabulary)
        for batch in common.batches(rows, most=3 << 20):
            ids = bpe.encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return common.slim(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids, decoded) of a table with doc_id and ids."""

    def run(rows):
        bpe = loaded(vocabulary)
        for batch in common.batches(rows, "ids", most=3 << 20):
            text = [bpe.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded string")
