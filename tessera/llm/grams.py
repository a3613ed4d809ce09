"""Hashed byte n-grams of many texts at a time, in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SPACE = 1 << 16
PIECE = 1 << 20


def laid(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes, a space before and after each, and where each starts (with the end last)."""
    raw = [b" " + t.encode() + b" " for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)


def slots(data: np.ndarray) -> list[np.ndarray]:
    """For each byte but the last two, the slots of the pair and of the hashed triple that start there."""
    b = data.astype(np.uint32)
    pair = b[:-2] << np.uint32(8) | b[1:-1]
    triple = ((pair << np.uint32(8) | b[2:]) * np.uint32(2654435761)) >> np.uint32(16)
    return [pair.astype(np.int64), triple.astype(np.int64) + SPACE]


def pieces(data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Piece by piece: the slots of pairs and triples, the texts that have some, where each of them begins, and the places of grams that span two texts."""
    for at in range(0, max(0, len(data) - 2), PIECE):
        pair, triple = slots(data[at : at + PIECE + 2])
        end = at + len(pair)
        first, last = np.searchsorted(starts, [at, end - 1], side="right") - 1
        begins = np.maximum(starts[first : last + 1] - at, 0)
        edge = (starts[first + 1 : last + 2, None] - np.array([1, 2]) - at).reshape(-1)
        yield pair, triple, np.arange(first, last + 1), begins, edge[(edge >= 0) & (edge < len(pair))]


def summed(data: np.ndarray, starts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The sum over each text's n-grams of their weights, a row for each text; weights: (2 * SPACE, columns). Grams that span two texts count for none."""
    out = np.zeros((len(starts) - 1, weights.shape[1]))
    columns = [np.ascontiguousarray(w) for w in weights.T.astype(np.float32)]
    for pair, triple, mine, begins, edge in pieces(data, starts):
        for k, w in enumerate(columns):
            each = w[pair] + w[triple]
            each[edge] = 0
            out[mine, k] += np.add.reduceat(each, begins, dtype=np.float64)
    return out


def sizes(starts: np.ndarray) -> np.ndarray:
    """The number of places that a text's n-grams start at."""
    return np.maximum(1, np.diff(starts) - 2)


def totals(texts: list[str]) -> np.ndarray:
    """How often each slot is in the texts."""
    data, starts = laid(texts)
    out = np.zeros(2 * SPACE, np.int64)
    for pair, triple, _, _, edge in pieces(data, starts):
        for slot in (pair, triple):
            out += np.bincount(slot, minlength=2 * SPACE) - np.bincount(slot[edge], minlength=2 * SPACE)
    return out


def shares(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(slots, relative frequencies) of the distinct n-grams of a text, at most 2 * SPACE."""
    count = totals([text])
    slot = np.flatnonzero(count)
    return slot.astype(np.int32), (count[slot] / max(1, len(text.encode()))).astype(np.float32)
