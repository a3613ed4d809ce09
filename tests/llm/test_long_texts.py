"""Very long texts of low entropy through every corpus operator that reads texts token by token or byte by byte."""

import random
import time

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe, packing, pii, suffix, token_binary, tokens

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
LONG = {"blanks": " " * 2_000_000, "lines": "\n" * 2_000_000, "letters": "".join(random.Random(1).choices("abcdefghij", k=2_000_000)), "pairs": "ab " * 1_000_000, "same": "a" * 300_000}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(LONG.values())), "doc_id long, text string").repartition(len(LONG))


@pytest.mark.parametrize("name", LONG)
def test_encoders_match_the_library(name):
    text = LONG[name]
    began = time.monotonic()
    for path, own in ((BYTE, tokens.encoder(BYTE)), (WORD, lambda t: np.frombuffer(bpe.WordBpe(WORD).encode([t])[0], "<u4"))):
        exact = Tokenizer.from_file(path)
        assert own(text).tolist() == exact.encode(text, add_special_tokens=False).ids
    assert time.monotonic() - began < 120


def test_token_files(docs, tmp_path):
    exact = Tokenizer.from_file(BYTE)
    got = {r.doc_id: r.n_tokens for r in token_binary.round_trip(docs, BYTE, folder=str(tmp_path / "t")).collect()}
    assert got == {k: len(exact.encode(t, add_special_tokens=False).ids) + 1 for k, t in enumerate(LONG.values())}


def test_packing(docs):
    exact = Tokenizer.from_file(BYTE)
    made = packing.pack_texts(docs, BYTE).groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    want = {k: len(exact.encode(t, add_special_tokens=False).ids) + 1 for k, t in enumerate(LONG.values())}
    assert {r.doc_id: (r["sum(length)"], r["max(doc_tokens)"]) for r in made} == {k: (n, n) for k, n in want.items()}


def test_suffix(spark):
    rng = random.Random(4)
    free = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=100_000))
    given = [("blanks", " " * 300_000 + "x"), ("pairs", "ab " * 100_000), ("free", free), ("mixed", "x" * 150 + free[:500] + " " * 150)]
    frame = spark.createDataFrame(list(enumerate(t for _, t in given)), "doc_id long, text string")
    got = {given[r.doc_id][0]: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix.digests(frame).collect()}
    # A string of 200 blanks starts at many places; "mixed" shares 500 bytes with "free", and its blanks are too few.
    assert got == {"blanks": (300_001, 300_000, 1), "pairs": (300_000, 300_000, 1), "free": (100_000, 500, 1), "mixed": (800, 500, 1)}


def test_pii(spark):
    text = "call +1 555 010 9999 now " * 40_000
    assert pii.spans(spark.createDataFrame([(1, text), (2, " " * 1_000_000)], "doc_id long, text string")).selectExpr("sum(size(base))").first()[0] == 40_000
