"""Whole-text encoding with a byte-level BPE vocabulary file of the tokenizers library.

The file's vocabulary drives a tiktoken encoder, which gives the same ids several times faster, where the vocabulary's
ids rise with its merges, so that they serve as ranks; any other vocabulary, and a text that holds one of the
file's added tokens, goes through the tokenizers library itself. So does a text with a run of BLANK blanks or more, whose
backtracking would exhaust the other encoder's stack.

Words recur, and ids never cross them: many texts at once are cut into words as the vocabulary's pattern cuts them, by classes of their
code points, and each different word is encoded once for all of them; some are kept for later texts. This holds for
texts whose code points have had one general category since Unicode 3.2; others are encoded whole.
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessera.llm.bpe import byte_letters

BLANK = 50_000
#: So many code points are cut into words at a time; so many words are kept, of so many bytes together.
SLICE, WORDS, LETTERS = 1 << 21, 1 << 17, 1 << 22
#: The pattern that starts_of() follows, the blanks that it means by \s, and the classes of code points.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLANKS = {*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
OTHER, LETTER, DIGIT, SPACE, UNSETTLED = range(5)


def ranked(model: dict) -> bool:
    """Whether a vocabulary's ids rise with its merges, all after the single bytes."""
    vocab = model["vocab"]
    made = [vocab["".join(m.split(" ")) if isinstance(m, str) else "".join(m)] for m in model["merges"]]
    return all(a < b for a, b in zip(made, made[1:])) and max(vocab[c] for c in byte_letters()) < min(made, default=len(vocab)) and not model.get("ignore_merges") and not model.get("end_of_word_suffix")


@functools.lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of each code point of the basic plane; unsettled are those whose category Unicode 3.2 and this Python's version do not agree on."""
    made = np.full(1 << 16, UNSETTLED, np.uint8)
    for k in range(1 << 16):
        kind = unicodedata.category(chr(k))
        if kind not in ("Cn", "Cs") and kind == unicodedata.ucd_3_2_0.category(chr(k)) and (k in BLANKS or kind[0] != "Z"):
            made[k] = SPACE if k in BLANKS else {"L": LETTER, "N": DIGIT}.get(kind[0], OTHER)
    return made


def starts_of(points: np.ndarray, kinds: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The places where PATTERN's matches start, over texts that lie one after the other; first marks the texts' first places, and the end."""
    n = len(points)
    blank = kinds == SPACE
    start = first[:n].copy()
    start[1:] |= kinds[1:] != kinds[:-1]
    # The last blank before a word stands apart from those before it, and a space belongs to the word.
    last = blank[:-1] & ~blank[1:] & ~first[1:n]
    start[:-1] |= last
    start[1:] &= ~(last & (points[:-1] == 32))
    # Short forms, only where no space or mark before them has taken the apostrophe.
    at = np.flatnonzero(start & (points == 39))
    near = lambda k: np.where(at + k < n, points[np.minimum(at + k, n - 1)], 0)
    one, two = near(1), near(2)
    inside = ~first[np.minimum(at + 1, n)]
    short = inside & np.isin(one, [ord(c) for c in "stmd"])
    long = inside & ~first[np.minimum(at + 2, n)] & np.isin(one * 256 + two, [ord(a) * 256 + ord(b) for a, b in ("re", "ve", "ll")])
    start[at[short | long] + 1] = False
    for found, size in ((short, 2), (long, 3)):
        after = at[found] + size
        start[after[after < n]] = True
    return np.flatnonzero(start)


class Words:
    """The ids of words: those of the first ones that were met are kept, WORDS of LETTERS bytes at most."""

    def __init__(self, encode: Callable[[str], np.ndarray], newline: int):
        self.encode, self.newline = encode, newline
        self.words, self.ids, self.length, self.held = pa.array([], pa.string()), np.zeros(0, "<u4"), np.zeros(0, np.int64), 0

    def fresh(self, words: pa.StringArray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of words, one word's after the other's but the blank ones' last, and how many each has. Words that are not blank go in one
        text, a line each: its line ends are words of their own."""
        lines = words.filter(pa.array(~blank))
        ids = self.encode(pc.binary_join(pa.ListArray.from_arrays([0, len(lines)], lines), "\n")[0].as_py())
        line_end = ids == self.newline
        ends = np.append(np.flatnonzero(line_end), len(ids))
        if len(ends) != max(1, len(lines)):
            raise ValueError("a line end is not a word of its own")
        others = [self.encode(w) for w in words.filter(pa.array(blank)).to_pylist()]
        length = np.append(np.diff(ends, prepend=-1)[: len(lines)] - 1, [len(x) for x in others]).astype(np.int64)
        return np.concatenate([ids[~line_end], *others]), length

    def of(self, words: pa.StringArray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, and for each word where its own start there, and how many they are)."""
        place = pc.fill_null(pc.index_in(words, self.words), -1).to_numpy()
        new = np.flatnonzero(place < 0)
        new = np.concatenate((new[~blank[new]], new[blank[new]]))
        own = words.take(pa.array(new))
        ids, length = self.fresh(own, blank[new])
        all_ids, all_length = np.concatenate((self.ids, ids)), np.concatenate((self.length, length))
        place = place.astype(np.int64)
        place[new] = len(self.words) + np.arange(len(new))
        room = WORDS - len(self.words)
        if room > 0:
            sizes = np.cumsum(pc.binary_length(own).to_numpy())
            keep = min(room, int(np.searchsorted(sizes, LETTERS - self.held, side="right")))
            self.held += int(sizes[keep - 1]) if keep else 0
            self.words = pa.concat_arrays([self.words, own.slice(0, keep)])
            self.ids, self.length = all_ids[: len(self.ids) + int(length[:keep].sum())].copy(), all_length[: len(self.words)].copy()
        return all_ids, (np.cumsum(all_length) - all_length).take(place), all_length.take(place)


def by_words(known: Words, texts: list[str]) -> list[np.ndarray | None]:
    """The ids of each text, None where it has unsettled code points."""
    joined = "".join(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    if not len(points):
        return [np.zeros(0, "<u4")] * len(texts)
    kinds = classes().take(points, mode="clip")
    first = np.zeros(len(points) + 1, bool)
    first[ends - sizes] = first[-1] = True
    place = starts_of(points, kinds, first)
    data, at = joined.encode(), place
    if len(data) > len(points):
        wide = (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
        at = place + (np.cumsum(wide, dtype=np.int32) - wide)[place]
    cut = pa.StringArray.from_buffers(len(place), pa.py_buffer(np.append(at, len(data)).astype("<i4")), pa.py_buffer(data)).dictionary_encode()
    which = cut.indices.to_numpy()
    blank = np.zeros(len(cut.dictionary), bool)
    blank[which[kinds[np.append(place[1:], len(points)) - 1] == SPACE]] = True
    ids, from_, length = known.of(cut.dictionary, blank)
    own = length.take(which)
    upto = np.cumsum(own)
    flat = ids.take(np.repeat(from_.take(which) - (upto - own), own) + np.arange(upto[-1]))
    cuts = np.append(0, upto)[np.searchsorted(place, ends[:-1])]
    odd = np.append(0, np.cumsum(kinds == UNSETTLED, dtype=np.int32))
    return [None if bad else x for x, bad in zip(np.split(flat, cuts), (odd[ends] > odd[ends - sizes]).tolist(), strict=True)]


@functools.lru_cache(maxsize=4)
def encoder(path: str):
    """A function from a text to its ids, a numpy array of unsigned 32-bit integers."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import json

    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = [t["content"] for t in spec["added_tokens"]]
    exact = Tokenizer.from_file(path)
    exact.no_truncation()
    exact.no_padding()
    byte_of = {c: b for b, c in enumerate(byte_letters())}
    if not ranked(spec["model"]):
        return lambda text: np.array(exact.encode(text, add_special_tokens=False).ids, "<u4")
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
    import public_tokenizers

    blank = re.compile(r"\s{%d}" % BLANK)
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    # The same as encode_ordinary(), without a list: there are no special tokens.
    whole = lambda text: fast.encode_to_numpy(text, disallowed_special=())
    known = Words(whole, ranks[b"\n"]) if public_tokenizers.PATTERN == PATTERN else None

    def odd(text: str) -> bool:
        return any(a in text for a in added) or (len(text) >= BLANK and bool(blank.search(text)))

    def many(texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[np.ndarray | None] = [None] * len(texts)
        at = 0
        while known and at < len(texts):
            to, held, some = at, 0, []
            while to < len(texts) and (not held or held + len(texts[to]) <= SLICE):
                if not odd(texts[to]):
                    some.append(to)
                    held += len(texts[to])
                to += 1
            # One long text alone would take memory in proportion, for few repeated words.
            if some and held <= SLICE:
                for k, x in zip(some, by_words(known, [texts[k] for k in some]), strict=True):
                    out[k] = x
            at = to
        return [encode(t) if x is None else x for t, x in zip(texts, out, strict=True)]

    def encode(text: str) -> np.ndarray:
        if odd(text):
            return np.array(exact.encode(text, add_special_tokens=False).ids, "<u4")
        return whole(text).astype("<u4", copy=False)

    encode.many = many
    return encode


def every(encode, texts: list[str]) -> list[np.ndarray]:
    """The ids of each text by a function that encoder() gave, or by another one."""
    return encode.many(texts) if hasattr(encode, "many") else [encode(t) for t in texts]
