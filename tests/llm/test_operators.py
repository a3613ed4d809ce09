"""Each corpus operator against brute force or an exact round trip, on rows with nulls, empties, ties, repeats, long texts and clashing columns."""

import hashlib
import json
import os
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe, common, langid, multiset, packing, pii, quality, simhash, suffix, token_binary, tokens, webp
from tessera.llm.components import smallest_reachable
from tessera.llm.tokens import encoder

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def rows():
    rng = random.Random(7)
    words = [w + s for w in ("alpha", "beta", "Gamma", "délta", "épsilon", "zeta", "eta.", "theta,") for s in ("", "s", "ing")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, block = text(80), "A passage that several documents share, " * 8
    out = [(k, text(rng.randint(1, 120))) for k in range(40)]
    out += [(100, base), (101, base), (102, base + " more"), (103, block + text(5)), (104, text(9) + "\n" + block), (105, None), (106, ""), (107, " \n\t"), (108, "word"), (109, "x" * 9000), (110, "ab " * 4000), (111, "é😀<|endoftext|> done <|startoftext|>")]
    return [*out, (112, text(30)), (112, out[0][1]), (100, base), (None, base), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, "en", "th", 1, 2) for d, t in rows()], "doc_id long, text string, lang string, th string, `a.b` int, ids int")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def key(r):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)


def test_bpe(docs, empty):
    exact = Tokenizer.from_file(WORD)
    got = sorted((tuple(r) for r in bpe.decode(bpe.encode(docs, WORD), WORD).collect()), key=key)
    want = []
    for d, t in rows():
        ids = exact.encode(t or "", add_special_tokens=False).ids
        want.append((d, bytearray(np.array(ids, "<u4").tobytes()), exact.decode(ids, skip_special_tokens=False)))
    assert [(d, bytes(i), t) for d, i, t in got] == sorted(((d, bytes(i), t) for d, i, t in want), key=key)
    assert bpe.encode(empty, WORD).count() == 0


def test_bpe_on_odd_letters():
    exact, own, rng = Tokenizer.from_file(WORD), bpe.WordBpe(WORD), random.Random(3)
    letters = [chr(c) for c in [*range(1, 0x180), 0x3A3, 0x3C2, 0x130, 0x212B, 0x2167, 0x4E00, 0x1100, 0x1161, 0x301, 0x2028, 0x85, 0x1C, 0x1F, 0xFEFF, 0x1F600]] + ["<|endoftext|>", "'LL", "a" * 60]
    for _ in range(1500):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 12)))
        assert own.encode([text])[0] == np.array(exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


@pytest.mark.parametrize("frame", ["a%sb", "A%sB", "%s"])
def test_bpe_on_every_code_point(frame):
    exact, own = Tokenizer.from_file(WORD), bpe.WordBpe(WORD)
    letters = [chr(c) for c in range(1, 0x110000 if frame == "a%sb" else 0x20000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(frame % c for c in letters[at : at + 500]) for at in range(0, len(letters), 500)]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids == np.array(exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text[:60]


def test_bpe_of_a_vocabulary_with_two_ways_to_a_token(tmp_path):
    """Where two merges make one token, long words are merged a boundary at a time."""
    letters = bpe.byte_letters()
    merges = [("a", "b"), ("ab", "a"), ("b", "a"), ("a", "ba")]
    tokens = [*letters, *(x + "</w>" for x in letters), "ab", "aba", "ba"]
    spec = {"version": "1.0", "added_tokens": [], "normalizer": {"type": "Lowercase"}, "decoder": None, "post_processor": None, "truncation": None, "padding": None}
    spec["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"\s+"}, "behavior": "Removed", "invert": False}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
    spec["model"] = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": "", "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "vocab": {t: i for i, t in enumerate(tokens)}, "merges": [" ".join(m) for m in merges]}
    (tmp_path / "own.json").write_text(json.dumps(spec))
    exact, own, rng = Tokenizer.from_file(str(tmp_path / "own.json")), bpe.WordBpe(str(tmp_path / "own.json")), random.Random(8)
    for k in range(60):
        text = "".join(rng.choice("ab") for _ in range(rng.randint(1, 150 if k < 40 else 3000)))
        assert own.encode([text])[0] == np.array(exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_token_files(spark, docs, empty, tmp_path):
    exact = Tokenizer.from_file(BYTE)
    got = token_binary.round_trip(docs, BYTE, folder=str(tmp_path / "t")).collect()
    order = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, np.int64(np.uint64(xxhash.xxh64_intdigest((r[1] or "").encode(), 42)))))
    at, want = 0, []
    for d, t in order:
        ids = [*exact.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert list((tmp_path / "t").glob("*.tids"))
    assert token_binary.round_trip(empty, BYTE, folder=str(tmp_path / "e")).count() == 0


def test_range_coder():
    rng = np.random.default_rng(1)
    for ids in (np.zeros(5000), np.full(3, 65535), rng.integers(0, 65536, 6000), np.array([]), np.arange(4500) % 3, rng.zipf(1.3, 5000) % 65536):
        raw = token_binary.file_of([None], [ids.astype(np.uint16)])
        assert (token_binary.file_ids(raw)[2] == ids).all()
    with pytest.raises(ValueError, match="damaged"):
        token_binary.file_ids(raw[: len(raw) // 2] + bytes([raw[len(raw) // 2] ^ 255]) + raw[len(raw) // 2 + 1 :])


def test_words_are_encoded_once():
    """Many texts at once give the tokenizers library's ids, and their words go to the encoder once."""
    exact, encode, rng = Tokenizer.from_file(BYTE), tokens.encoder(BYTE), random.Random(1)
    parts = [*" '\n\t!_asStlervdm²³é漢ⅷʼ🙂", "  ", "\u00a0", "\u3000", "\u0301", "\x1c", "\x85", "\u180e", "'ll", "'re", "'v", "'S", "bc", "1", "23", "..", "<|endoftext|>", "\U000e0001", "\u0378"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(20_000)] + ["", "x" * 3000, " " * 60_000 + "a"]
    settled = [chr(k) for k in np.flatnonzero(tokens.classes() != tokens.UNSETTLED).tolist()]
    texts += [f"a{c}a 1{c}1 !{c}! {c}{c} '{c}s {c}'s" for c in settled]
    wanted = exact.encode_batch(texts, add_special_tokens=False)
    assert all(got.tolist() == want.ids for got, want in zip(tokens.every(encode, texts), wanted, strict=True))
    asked = []
    known = tokens.Words(lambda text: asked.append(text) or encode(text), int(encode("\n")[0]))
    texts = [" ".join(rng.choices(["one", "two", "it's", "four,", "5\n\n"], k=500)) for _ in range(40)]
    for some in (texts[:20], texts[20:]):
        assert all((got == encode(t)).all() for got, t in zip(tokens.by_words(known, some), some, strict=True))
    assert sum(map(len, asked)) < 200


def test_range_coder_writes_the_same_files():
    """The bytes of a file, as the first form of this coder wrote them."""
    ids = np.random.default_rng(5).zipf(1.2, 200_000) % 50_000
    assert hashlib.sha256(token_binary.file_of([1, None], [ids[:70_000], ids[70_000:]])).hexdigest() == "73887aa7f0c8f3dff75f6b6dd12b13f2219a8dd931398d1161e5193c69570876"


def test_range_coder_takes_fewer_bits_than_zlib():
    """Ids with order-1 structure: the mixed predictions pay, and nothing is lost."""
    rng = np.random.default_rng(2)
    words = [rng.zipf(1.4, rng.integers(1, 5)) % 3000 for _ in range(2000)]
    ids = np.concatenate([words[k] for k in rng.zipf(1.2, 120_000) % 2000]).astype(np.uint16)
    raw = token_binary.file_of([1], [ids])
    assert (token_binary.file_ids(raw)[2] == ids).all() and len(raw) < len(zlib.compress(ids.tobytes(), 6))


def test_ids_that_do_not_fit_raise(spark, tmp_path):
    with pytest.raises(ValueError, match="65,536"):
        token_binary.file_of([1], [np.array([70_000])])
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(Exception, match="65,536"):
        token_binary.write(docs, f"file://{tmp_path}/t", lambda: lambda t: np.array([70_000], "<u4"), 2)


def finger(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    parts = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def united(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    return [find(k) for k in range(n)]


def test_simhash(docs, empty):
    data = rows()
    prints = [finger(t or "", 3) for _, t in data]
    group = united(len(data), [(i, j) for i in range(len(data)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 2])
    least = {g: min((data[k][0] for k in range(len(data)) if group[k] == g and data[k][0] is not None), default=None) for g in set(group)}
    want = Counter((d, f - 2**64 if f >= 2**63 else f, least[g]) for (d, _), f, g in zip(data, prints, group, strict=True))
    assert Counter(map(tuple, simhash.components(docs).collect())) == want
    assert simhash.components(empty).count() == 0


def test_ball_links_are_complete(spark):
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(20)]
    prints = {s ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for s in seeds for _ in range(15)} | set(seeds)
    signed = sorted(p - 2**64 if p >= 2**63 else p for p in prints)
    links = simhash.ball_links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()
    place = {p: k for k, p in enumerate(signed)}
    near = [(i, j) for i in range(len(signed)) for j in range(i) if bin((signed[i] ^ signed[j]) % 2**64).count("1") <= 2]
    same = lambda g: {(i, j) for i in range(len(g)) for j in range(i) if g[i] == g[j]}
    assert same(united(len(signed), [(place[r.a], place[r.b]) for r in links])) == same(united(len(signed), near))


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (101, 100)], "a long, b long")
    assert {r.node: r.component for r in smallest_reachable(edges).collect()} == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_near_duplicates(spark):
    rng = random.Random(9)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    data, groups = [], []
    for g in range(12):
        base = words(200)
        for _ in range(5):
            own = list(base)
            own[rng.randrange(200)] = "edited"
            data.append((len(data), " ".join(own)))
            groups.append(g)
    data += [(len(data) + k, " ".join(words(150))) for k in range(20)]
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert all(found[k] == 5 * groups[k] for k in range(60)) and all(found[k] == k for k in range(60, 80))


def test_many_copies_of_one_text(spark):
    """Copies with three edits each are alike to their source, not to each other."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(5000)}" for _ in range(250)]
    data = [(500, " ".join(base))]
    for k in range(300):
        own = list(base)
        for at in (20, 110, 200):
            own[at + rng.randrange(40)] = f"edit{rng.randrange(10**6)}"
        data.append((k if k < 150 else 600 + k, " ".join(own)))
    found = simhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"))
    assert {r.component_id for r in found.collect()} == {0}


def jaccard(s, t):
    of = lambda x: {tuple(w[k : k + 5]) for w in [x.split()] for k in range(len(w) - 4)}
    a, b = of(s), of(t)
    return len(a & b) / len(a | b)


def test_near_duplicates_at_the_threshold(spark):
    """Pairs just below and above 0.8, within a sketch's error of it: the whole sets decide."""
    rng = random.Random(13)
    data, want = [], {}
    for k in range(60):
        base = [f"w{rng.randrange(10**6)}" for _ in range(900)]
        own = list(base)
        for at in range(0, 5 * (19 + k % 2 * 2), 5):
            own[at + 200] = f"edit{rng.randrange(10**6)}"
        data += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(own))]
        want[2 * k + 1] = 2 * k + (jaccard(data[-2][1], data[-1][1]) < 0.8)
    assert 0 < sum(k == v for k, v in want.items()) < 60
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert {k: found[k] for k in want} == want


def test_near_duplicates_among_pages_of_one_template(spark):
    """Thousands of pages at about 0.7 to each other with pairs at about 0.85 among them, against brute force."""
    rng = random.Random(17)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    frame, data = fresh(250), []
    for k in range(3000):
        data.append(frame[:125] + fresh(50) + frame[125:])
        if k % 100 == 0:
            own = list(data[-1])
            for at in range(5):
                own[130 + 9 * at] = fresh(1)[0]
            data.append(own)
    rng.shuffle(data)
    sets = [frozenset(tuple(t[k : k + 5]) for k in range(len(t) - 4)) for t in data]
    holds = defaultdict(list)
    base = frozenset(tuple(frame[k : k + 5]) for k in range(246))
    for k, s in enumerate(sets):
        for g in s - base:
            holds[g].append(k)
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert max(like(0, k) for k in range(1, 200)) < 0.8
    # Without a shingle of their own in common, two pages have 242 of 350.
    want = {(a, b) for v in holds.values() for k, a in enumerate(v) for b in v[k + 1 :] if like(a, b) >= 0.8}
    assert len(want) == 30
    found = simhash.near_duplicates(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(data)], "doc_id long, text string"))
    assert {(r.component_id, r.doc_id) for r in found.where("doc_id <> component_id").collect()} == want


def test_prefixes_meet_all_pairs(spark, monkeypatch):
    """Without any first components and in small blocks, every pair that has the similarity is a candidate."""
    rng = random.Random(19)
    monkeypatch.setattr(simhash, "BLOCK", 3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    data = [(k, " ".join(base[rng.randrange(4) : 60 - rng.randrange(4)] + [f"x{rng.randrange(30)}"] * rng.randrange(9))) for k in range(60)]
    every = simhash.sketched(spark.createDataFrame(data, "doc_id long, text string"))
    reps = common.written(every.join(every.groupBy("same").agg(F.min("doc_id").alias("doc_id")), ["same", "doc_id"], "left_semi"))
    kept = sorted(r.doc_id for r in reps.select("doc_id").collect())
    found = {tuple(r) for r in simhash.crossing(reps, spark.createDataFrame([], "node long, component long"), 0.8).collect()}
    want = {(a, b) for k, a in enumerate(kept) for b in kept[k + 1 :] if jaccard(data[a][1], data[b][1]) >= 0.8}
    assert want and want <= found


def test_multiset(spark, docs, empty):
    data = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, np.int64(np.uint64(xxhash.xxh64_intdigest((r[1] or "").encode(), 42)))))
    want = Counter()
    for k, (d, t) in enumerate(data):
        t, after = t or "", data[(k + 1) % len(data)][1] or ""
        q = len(t) // 4
        want[(d, len(t), hashlib.sha256((t[: len(t) - q] + after[:q]).encode()).hexdigest())] += 1
    got = multiset.compared(docs).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got) and multiset.compared(empty).count() == 0
    prints = lambda texts: [r.fingerprint for r in multiset.compared(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    a, b, c, d = prints(["one two\nthree\nfour", "four\none two\nthree", "four\none two", "one two\nthree\nfour"])
    assert a == b == d != c


def multiset_vectors(spark, texts):
    table = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    return {r.k: (r.vector.wide, r.vector.counts, r.f) for r in multiset.vectors(table, ["k"]).select("k", "vector", multiset.shown(F.col("vector")).alias("f")).collect()}


def test_multiset_is_of_paragraphs(spark):
    """Over random texts with blank lines: any order of the same paragraphs has the same fingerprint, any other multiset another one."""
    rng = random.Random(14)
    parts = ["", "", "one two", "Three, four. five", "longerwords followed by others", "漢字かな交じり文", "a", " a", "a ", "tab\tand  spaces"]
    lists = [[rng.choice(parts) for _ in range(rng.randint(1, 6))] for _ in range(120)]
    texts = ["\n".join(x) for x in lists] + ["\n".join(rng.sample(x, len(x))) for x in lists]
    made = multiset_vectors(spark, texts)
    keys = [tuple(sorted(t.split("\n"))) for t in texts]
    of = defaultdict(set)
    for k, key_ in enumerate(keys):
        of[key_].add(made[k][2])
    assert all(len(v) == 1 for v in of.values()) and len({next(iter(v)) for v in of.values()}) == len(of)


def brute_vector(text):
    """Lanes by the stated rule in plain Python."""
    wide, counts = [0] * 3, [0] * 65
    digest = lambda t: xxhash.xxh64_intdigest(t.encode(), 42)
    for p in text.split("\n"):
        for k, seed in enumerate(multiset.SEEDS):
            wide[k] = (wide[k] + (xxhash.xxh64_intdigest(np.int32(seed).tobytes(), digest(p)) & multiset.MODULUS)) & multiset.MODULUS
        for phrase in re.split(r"(?:(?<=[!-/:-@\[-`{-~])|(?<=\S{6}))[^\S\n]+", p):
            h = digest(phrase)
            counts = [c + (h >> k & 1 if k < 64 else 1) for k, c in enumerate(counts)]
    return wide, counts


def test_multiset_vectors_by_brute_force(spark):
    rng = random.Random(15)
    words = ["one", "words,", "longest", "punctuation.", "a", "sentence;", "", "middle"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\t"]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    made = multiset_vectors(spark, texts)
    assert all((list(made[k][0]), list(made[k][1])) == brute_vector(t) for k, t in enumerate(texts))


def test_multiset_insertions_and_deletions(spark):
    rng = random.Random(16)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 9)))
    some = lambda n: ["".join(word() + rng.choice([" ", ". "]) for _ in range(rng.randint(0, 9))) for _ in range(n)]
    edits = [(some(rng.randint(1, 6)), some(rng.randint(1, 4))) for _ in range(40)]
    made = multiset_vectors(spark, ["\n".join(x) for a, b in edits for x in (a, b, a + b)])
    rows = [tuple(made[3 * k + j][:2] for j in range(3)) for k in range(len(edits))]
    kind = "struct<wide:array<bigint>,counts:array<bigint>>"
    t = spark.createDataFrame(rows, f"a {kind}, b {kind}, c {kind}")
    wrong = t.where((multiset.added(F.col("a"), F.col("b")) != F.col("c")) | (multiset.added(F.col("c"), F.col("b"), -1) != F.col("a")))
    assert wrong.count() == 0


def test_multiset_successors_over_odd_ids(spark):
    """Sparse ids, null ids, one repeated id and repeated rows: each row against brute force, and no partition holds most of the order."""
    rng = random.Random(18)
    ids = [rng.randrange(-(2**62), 2**62) for _ in range(60)] + [None] * 30 + [77] * 60 + [5] * 20
    data = [(d, f"text {rng.randrange(10**6)} of {rng.randrange(9)}\n{'x' * rng.randrange(9)}" if d != 5 else "the same") for d in ids]
    place = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, np.int64(np.uint64(xxhash.xxh64_intdigest(r[1].encode(), 42)))))
    want = Counter()
    for k, (d, t) in enumerate(place):
        q, after = len(t) // 4, place[(k + 1) % len(place)][1]
        want[(d, len(t), hashlib.sha256((t[: len(t) - q] + after[:q]).encode()).hexdigest())] += 1
    got = multiset.compared(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    assert sum(r.near_next == 1 for r in got if r.doc_id == 5) >= 19
    one = spark.createDataFrame([(7, f"t{k}") for k in range(4000)], "doc_id long, text string").select(F.lit(7).cast("long").alias("kid"), F.xxhash64("text").alias("th")).repartitionByRange(4, "kid", "th")
    assert one.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 2000


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def base_spans(t):
    kinds = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    out = []
    for k, p in enumerate(kinds):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if (True, k != 1 or all(int(x) <= 255 for x in m[0].split(".")), 14 <= len(d) <= 19 and luhn(d), 10 <= len(d) <= 15)[k]:
                out.append((m.start(), k, m.end()))
    return ",".join(f"{pii.NAMES[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_pii(spark, docs, empty):
    rng = random.Random(2)
    letters = list("0123456789") * 3 + list("..--  ++()@@ab_%é😀\n") + ["1.2.3.4", "256.1.1.1", "a@b.c", "a@b.c_d@e.f", "4152745565877212", "+1 (535) 555-5412", "0" * 14, "a@b.c@d.e"]
    data = [(k, "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))) for k in range(1500)] + [(1500, None), (1501, "1" * 20000), (1502, "a" * 20000), (1503, "+1" * 3000)]
    data += [(2000 + k, f"intro Server: 10.2.{k // 200}.{k % 200} outro") for k in range(150)] + [(3000 + k, f"intro Server: host{k}x outro") for k in range(10)]
    got = {r.doc_id: r for r in pii.spans(spark.createDataFrame(data, "doc_id long, text string")).select("doc_id", pii.listed(F.col("base")).alias("base"), pii.listed(F.col("spans")).alias("spans")).collect()}
    assert all(got[k].base == base_spans(t or "") for k, t in data)
    assert all(got[3000 + k].spans == f"ip:14:{19 + len(str(k))}" for k in range(10)), "patterns discover unseen identifiers"
    assert pii.spans(docs).count() == len(rows()) and pii.spans(empty).count() == 0
    text = F.lit("héllo a@b.co x +1 (535) 555-5412!")
    assert spark.range(1).select(pii.redacted(text, pii.base_spans(text)).alias("x")).first().x == "héllo [EMAIL] x [PHONE]!"


def found_spans(spark, texts):
    got = pii.spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", pii.listed(F.col("spans")).alias("spans"))
    return [r.spans for r in got.orderBy("doc_id").collect()]


def test_pii_without_digits(spark):
    """Addresses without a digit are seeds, and identifiers with an @ alone are found."""
    texts = [f"ask Contact: {a}.{b}@example.com now" for a in ("anna", "bert", "carl") for b in ("smith", "jones", "brown")]
    assert found_spans(spark, [*texts, "ask Contact: anna@intranet now", "ask Contact: user@localhost, now"])[-2:] == ["email:13:26", "email:13:27"]


def test_pii_in_generations(spark):
    """Instances that a pattern discovers induce another one; a pattern does not raise its own confidence."""
    texts = [f"intro Server: 10.3.0.{k} outro" for k in range(90)] + [f"intro Server: h{k} outro" for k in range(1, 10)]
    texts += [f"intro Node h{k} outro" for k in range(1, 10)] + ["intro Node h10 outro"]
    # Two of five occurrences are seeds: under 0.7.
    texts += [f"intro Weak: 10.4.0.{k} outro" for k in range(40)] + [f"intro Weak: q{k} outro" for k in range(60)] + [f"intro Weak q{k} outro" for k in range(60)]
    got = dict(zip(texts, found_spans(spark, texts), strict=True))
    assert all(got[f"intro Server: h{k} outro"] == "ip:14:16" and got[f"intro Node h{k} outro"] == "ip:11:13" for k in range(1, 10))
    assert got["intro Node h10 outro"] == "ip:11:14"
    assert not any(got[f"intro Weak: q{k} outro"] or got[f"intro Weak q{k} outro"] for k in range(60))


def test_pii_of_a_text_with_very_many_tokens(spark):
    """Time in proportion to the text; a word far ahead of a token introduces it still."""
    began = time.monotonic()
    text = " ".join(f"k {i}" for i in range(200_000))
    assert spark.createDataFrame([(text,)], "t string").select(F.size(pii.placed(F.col("t"), pii.TOKEN, -1))).first()[0] == 200_000
    text = " ".join(f"10.2.{i % 200}.{i % 250} x" for i in range(20_000))
    assert pii.without(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text == "[IP] x " * 19_999 + "[IP] x"
    assert time.monotonic() - began < 90
    texts = [f"intro Server: 10.3.0.{k} outro" for k in range(60)] + ["intro Server:" + " " * 400 + "h1 outro"]
    assert found_spans(spark, texts)[-1] == "ip:413:415"


def brute_bootstrap(texts, rounds=3, support=3, confidence=0.7):
    """The stated bootstrap in plain Python: all spans of each text."""
    each, total = [], Counter(w.lower() for t in texts for w in re.split(r"\s+", t))
    for k, t in enumerate(texts):
        spans = [(int(a), pii.NAMES.index(n), int(b)) for n, a, b in (x.split(":") for x in filter(None, base_spans(t).split(",")))]
        last = 0
        for m in re.finditer(r"(?<!\S)\S*?[0-9@]\S*", t):
            words = re.sub(r"\s+", " ", t[last : m.start()]).split(" ")[-4:]
            last = m.end()
            over = [s for s in spans if s[0] < m.end() and m.start() < s[2]]
            if over and m.start() > over[0][0]:
                continue
            back = next((b for b in (1, 2, 3) if b < len(words) and re.search(r"[^\W\d_]", words[-1 - b])), None)
            if back is None:
                continue
            core = m[0] if over else re.sub(r"^[^a-zA-Z0-9+]+|[^a-zA-Z0-9]+$", "", m[0])
            if re.search("[0-9@]", core):
                each.append((k, m.start() + len(re.match(r"[^a-zA-Z0-9+]*", m[0])[0]), core, words[-1 - back].lower(), " ".join(words[-1 - back :]).lower(), over[0][1] if over else None))
    seeds = {}
    for _, _, core, _, _, seed in each:
        if seed is not None:
            seeds[core] = max(seed, seeds.get(core, 0))
    edges, strong = Counter((p, w, c) for _, _, c, w, p, _ in each), {}
    for _ in range(rounds):
        votes = defaultdict(list)
        for (p, w, c), n in edges.items():
            if c in seeds:
                votes[p, w].append((n, 1.0, seeds[c]))
                continue
            mine = sorted(((weight, -kind, q) for (q, _, x) in edges if x == c and q in strong for weight, kind in [strong[q]]), reverse=True)[:2]
            other = [m for m in mine if m[2] != p]
            if other:
                votes[p, w].append((n, other[0][0], -other[0][1]))
        new = {}
        for (p, w), v in votes.items():
            if len(v) >= support:
                by = Counter()
                for n, _, kind in v:
                    by[kind] += n
                weight = round(min(1.0, sum(n * s for n, s, _ in v) / total[w]), 9)
                if weight >= confidence:
                    new[p] = weight, max(by, key=lambda kind: by[kind] * 8 - kind)
        if new == strong:
            break
        strong = new
    out = [{(int(a), pii.NAMES.index(n), int(b)) for n, a, b in (x.split(":") for x in filter(None, base_spans(t).split(",")))} for t in texts]
    for k, start, core, _, p, seed in each:
        if seed is None and p in strong:
            out[k].add((start, strong[p][1], start + len(core)))
    return [",".join(f"{pii.NAMES[kind]}:{a}:{b}" for a, kind, b in sorted(x)) for x in out]


def test_pii_bootstrap_by_brute_force(spark):
    rng = random.Random(21)
    labels = ["Server:", "Host", "Mail -", "Call", "Node", "(Ref:", "Seen"]
    names = [f"h{k}" for k in range(25)] + [f"n{k}x" for k in range(25)]
    def identifier(label):  # noqa: E306
        kind = rng.random()
        if label in ("Server:", "Host", "Node") and kind < 0.8:
            return f"10.{rng.randrange(2)}.0.{rng.randrange(40)}"
        if label == "Mail -" and kind < 0.85:
            return f"user{rng.randrange(30)}@site.org"
        return rng.choice(names)
    texts = [" ".join(f"{rng.choice(['so', 'then', 'we'])} {label} {identifier(label)}{rng.choice(['', ',', '.'])}" for label in rng.choices(labels, k=rng.randint(1, 5))) for _ in range(500)]
    got, want = found_spans(spark, texts), brute_bootstrap(texts)
    assert got == want and sum(g != base_spans(t) for g, t in zip(got, texts, strict=True)) > 20


def forward(pixels, t):
    parts = webp.parts_of(pixels).astype(np.int64)
    h, w = pixels.shape
    signed = lambda x: (x & 255).astype(np.uint8).astype(np.int8).astype(np.int64)
    if t.kind == webp.GREEN:
        parts[..., [0, 2]] -= parts[..., [1]]
    elif t.kind == webp.CROSS:
        wide = webp.parts_of(t.image)[(np.arange(h) >> t.bits)[:, None], (np.arange(w) >> t.bits)[None]].astype(np.int8).astype(np.int64)
        green, red = signed(parts[..., 1]), signed(parts[..., 2])
        parts[..., 2] -= wide[..., 0] * green >> 5
        parts[..., 0] -= (wide[..., 1] * green >> 5) + (wide[..., 2] * red >> 5)
    else:
        modes = (t.image >> np.uint32(8) & np.uint32(15)).astype(int)
        flat = parts.reshape(-1, 4)
        parts = np.array([flat[k] - webp.neighbours(flat, k, w, int(modes[k // w >> t.bits, k % w >> t.bits])) for k in range(len(flat))]).reshape(h, w, 4)
    return (parts & 255).astype(np.uint8).view(np.uint32).reshape(h, w)


def test_webp_images():
    rng = np.random.default_rng(1)
    for trial in range(40):
        h, w = int(rng.integers(1, 24)), int(rng.integers(1, 24))
        pixels = rng.integers(0, 2**32, (h, w), dtype=np.uint32) if trial % 3 else rng.choice(rng.integers(0, 2**32, 5, dtype=np.uint32), (h, w))
        left, transforms = pixels, []
        for kind in rng.permutation(3)[: rng.integers(0, 4)]:
            bits = int(rng.integers(2, 5))
            shape = webp.up(h, bits), webp.up(w, bits)
            image = rng.integers(0, 2**32, shape, dtype=np.uint32) if kind == webp.CROSS else rng.integers(0, 14, shape, dtype=np.uint32) << np.uint32(8)
            t = webp.Transform(webp.GREEN) if kind == webp.GREEN else webp.Transform(int(kind), bits, image)
            left = forward(left, t)
            transforms.append(t)
        block = int(rng.integers(2, 4))
        meta = (block, rng.integers(0, 3, (webp.up(h, block), webp.up(w, block)))) if trial % 4 == 1 else None
        raw = webp.image_file(left, w, transforms, cache_bits=int(rng.integers(0, 5)), references=bool(trial % 2), meta=meta)
        assert (webp.read_streams(webp.files_in(raw))[0] == pixels).all()
    assert len(webp.NEAR) == 120


def test_webp_writer_copies_what_recurs():
    rng = np.random.default_rng(3)
    letters = rng.integers(32, 96, 3000, dtype=np.uint8).tobytes()
    repeated = [(letters[:n] * 20000)[: 64 * m] for n, m in ((17, 1), (17, 40), (40, 300), (1000, 128), (3000, 129), (3000, 900))]
    mixed = [b"".join(letters[a : a + n] for a, n in rng.integers(0, 60, (200, 2)).tolist())[: 64 * 30] for _ in range(40)]
    payloads = [p + b"\0" * (-len(p) % 64) for p in [*repeated, *mixed, letters, b"\0" * 64]]
    media = webp.payload_files(payloads)
    assert webp.payloads_of(media) == payloads
    assert all(len(m) < len(p) / 3 for m, p in zip(media[1:4], payloads[1:4], strict=True))
    # Each payload's files are its own, whatever is written beside it.
    assert [webp.payload_files([p])[0] for p in payloads] == media


def test_webp_memory_of_a_slice():
    """What is held beside 4 MB of samples, as much as a task writes at a time, and their media."""
    rng = np.random.default_rng(4)
    words = [rng.integers(32, 96, n, dtype=np.uint8).tobytes() for n in rng.integers(1, 12, 3000)]
    payloads = [b" ".join(words[k] for k in rng.integers(0, 3000, 600))[: 64 * 48].ljust(64 * 48, b"\0") for _ in range(1366)]
    tracemalloc.start()
    try:
        media = webp.payload_files(payloads)
        writing = tracemalloc.get_traced_memory()[1]
        tracemalloc.reset_peak()
        back = webp.payloads_of(media)
        reading = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert back == payloads and writing < 80 << 20 and reading < 80 << 20, (writing >> 20, reading >> 20)


def test_webp_columns(docs, empty):
    got = Counter((r.doc_id, r.n_bytes, bytes(r.samples)) for r in webp.read_back(webp.stored(docs)).collect())
    raw = [(d, (t or "").encode()) for d, t in rows()]
    assert got == Counter((d, len(b), b + b"\0" * (-len(b) % 64 if b else 64)) for d, b in raw)
    assert webp.read_back(webp.stored(empty)).count() == 0


def test_language(spark, docs, empty):
    rng = random.Random(4)
    own = {"en": ["the", "of", "and", "thing", "with"], "de": ["der", "und", "nicht", "schön", "über"], "fr": ["le", "été", "quoi", "eau", "où"]}
    data = [(k, " ".join(rng.choice(own[lang]) for _ in range(40)), lang) for k in range(300) for lang in [rng.choice(list(own))]]
    data += [(900, None, "en"), (901, "", None), (902, "12 34 !", "de"), (None, "the thing of", "en")]
    got = {r.doc_id: r for r in langid.predicted(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()}
    assert all(got[d].held_out == (d is not None and zlib.crc32(str(d).encode()) % 4 == 2) for d, _, _ in data)
    assert [got[k].lang_pred for k in (900, 901, 902)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in got.values())
    held = [d for d, t, _ in data[:300] if got[d].held_out]
    assert np.mean([got[d].lang_pred == dict((d, x) for d, _, x in data)[d] for d in held]) > 0.95
    assert langid.predicted(empty).count() == 0 and langid.predicted(docs.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred <> 'und'").count() == 0


def test_language_decoding_by_brute_force(spark):
    """N-gram counts, margins and the choice of the codeword, one text and bit at a time."""
    data = [(k, t, lang) for k, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("le chat et le chien", "fr"), ("a the of", "en"), ("nicht schön", "de"), ("où est", "fr")] * 4)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = langid.fitted(docs)
    learnt = [(t, lang) for d, t, lang in data if zlib.crc32(str(d).encode()) % 4 != 2]

    def slots(text):
        b = b" " + text.encode() + b" "
        return [s for k in range(len(b) - 2) for s in (b[k] << 8 | b[k + 1], ((b[k] << 16 | b[k + 1] << 8 | b[k + 2]) * 2654435761 % 2**32 >> 16) + 65536)]

    counts = np.zeros((3, 131072))
    for t, lang in learnt:
        np.add.at(counts[model.languages.index(lang)], slots(t), 1)
    share = (counts + 0.5) / (counts.sum(1, keepdims=True) + 65536)
    for t, _ in [*learnt, ("cat dog chat", ""), ("é", "")]:
        losses = []
        for word in model.code:
            loss = 0.0
            for b, bit in enumerate(word):
                ones, zeros = model.code[:, b] > 0, model.code[:, b] < 0
                w = np.log(share[ones].mean(0)) - np.log(share[zeros].mean(0))
                margin = sum(w[s] for s in slots(t)) / len(t.encode()) * model.scale[b] + model.shift[b]
                loss += model.reliability[b] * np.log1p(np.exp(-bit * margin))
            losses.append(loss)
        assert np.allclose(losses, model.losses([t])[0], rtol=1e-4)
        assert langid.decoded(model, model.losses([t]), [t])[0] == [model.languages[int(np.argmin(losses))]]


def test_language_of_texts_without_letters(spark):
    data = [(k, "the cat", "en") for k in range(8)] + [(k, "der hund", "de") for k in range(8, 16)] + [(100 + k, t, None) for k, t in enumerate(["½", "²", "Ⅷ", "①", "12_3", "", "ª", "ʰ", "字"])]
    got = {r.doc_id: r for r in langid.predicted(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()}
    assert [got[100 + k].lang_pred == "und" for k in range(9)] == [True] * 6 + [False] * 3 and all(got[100 + k].score == 0 for k in range(6))
    many = spark.createDataFrame([(k, "a b", f"l{k}") for k in range(200)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="labels"):
        langid.predicted(many)


def test_grams_in_pieces(monkeypatch):
    """Sums do not depend on where the bytes are cut."""
    from tessera.llm import grams

    rng = np.random.default_rng(4)
    texts = ["".join(map(chr, rng.integers(97, 105, n))) for n in (0, 1, 2, 30, 0, 7, 55)]
    weights = rng.random((2 * grams.SPACE, 3))
    data, starts = grams.laid(texts)
    whole, counts = grams.summed(data, starts, weights), grams.totals(texts)
    for size in (3, 10, 64):
        monkeypatch.setattr(grams, "PIECE", size)
        assert np.allclose(grams.summed(data, starts, weights), whole) and (grams.totals(texts) == counts).all()
    assert counts.sum() == 2 * sum(len(t) for t in texts)


@pytest.mark.parametrize("n", [2, 3, 4, 6, 11])
def test_codewords_differ(n):
    code = langid.codewords(n)
    assert all((code[a] != code[b]).any() for a in range(n) for b in range(a))


def test_packing(spark, docs, empty):
    exact = Tokenizer.from_file(BYTE)
    got = packing.pack_texts(docs, BYTE).collect()
    by_text = defaultdict(list)
    for r in got:
        by_text[r.doc_id].append(r)
    spaces = defaultdict(list)
    for r in got:
        spaces[r.sequence_id].append((r.offset, r.length))
    for parts in spaces.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    want = Counter()
    for d, t in rows():
        want[d] += len(exact.encode(t or "", add_special_tokens=False).ids) + 1
    assert {d: sum(r.length for r in rs) for d, rs in by_text.items()} == dict(want)
    # Every piece of every row: rows that share an id are told apart by what their pieces hold.
    pieces = Counter((r.doc_id, r.doc_tokens, r.start, r.length, r.ids_crc32) for r in got)
    for d, t in rows():
        ids, at = np.array([*exact.encode(t or "", add_special_tokens=False).ids, 0], "<u4"), 0
        while at < len(ids):
            fit = [p for p in pieces if p[:3] == (d, len(ids), at) and p[4] == zlib.crc32(ids[at : at + p[3]].tobytes())]
            assert fit, (d, at)
            pieces[fit[0]] -= 1
            if not pieces[fit[0]]:
                del pieces[fit[0]]
            at += fit[0][3]
        assert at == len(ids)
    assert not pieces
    assert packing.pack_texts(empty, BYTE).count() == 0


def test_packing_fills_windows():
    rng = np.random.default_rng(2)
    histogram = np.bincount(rng.integers(1, 64, 5000), minlength=64)
    plan = packing.Plan(histogram, 64)
    used = defaultdict(int)
    for length in range(1, 64):
        for rank in range(int(histogram[length])):
            for sequence, _, n in plan.place(length, rank):
                used[sequence] += n
    assert sum(used.values()) == int((histogram * np.arange(64)).sum()) and sorted(used.values())[1] == 64 and plan.sequences > 0.5 * len(used)


def brute_repeats(data, size):
    seen = Counter(t[k : k + size] for t in data for k in range(len(t) - size + 1))
    out = []
    for t in data:
        gone, reach = [], -1
        for k in range(len(t)):
            if k + size <= len(t) and seen[t[k : k + size]] > 1:
                reach = k + size
            gone.append(k < reach)
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("most", [suffix.MOST, 1])
def test_suffix(spark, docs, empty, most, monkeypatch):
    monkeypatch.setattr(suffix, "MOST", most)
    data = rows() + [(500, "é" * 350), (501, "xyz" * 100), (502, "a" * 199)]
    own = spark.createDataFrame(data, "doc_id long, text string")
    got = Counter(map(tuple, suffix.digests(own).collect()))
    want = brute_repeats([(t or "").encode() for _, t in data], 200)
    assert got == Counter((d, *w) for (d, _), w in zip(data, want, strict=True))
    assert suffix.digests(empty).count() == 0


def test_suffix_keeps_whole_characters(docs):
    left = suffix.without(docs)
    assert left.columns == docs.columns and left.count() == docs.count()
    for kept in (pii.without(docs), simhash.representatives(docs)):
        assert kept.dtypes == docs.dtypes and 0 < kept.count() <= docs.count()


def test_quality(spark, docs, empty):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("aeiourstln") for _ in range(rng.randint(2, 9)))
    good = [" ".join(word() for _ in range(60)).capitalize() + "." for _ in range(200)]
    bad = [" ".join([word()] * 80) for _ in range(20)] + [" ".join(word().upper() + "!!" for _ in range(60)) for _ in range(20)] + [" ".join(word() + "%%%" for _ in range(60)) for _ in range(20)]
    data = list(enumerate([*good, *bad, None, "", " "]))
    got = {r.doc_id: r for r in quality.scored(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert np.mean([got[k].keep for k in range(200)]) > 0.98 and np.mean([got[k].keep for k in range(200, 260)]) < 0.1
    assert not any(got[k].keep or got[k].score for k in (260, 261, 262))
    assert quality.scored(empty).count() == 0 and quality.filtered(docs).columns == docs.columns and quality.filtered(empty).count() == 0


def test_quality_agrees_with_the_labels(spark):
    """The area under the curve of the scores against the labels that came with the documents, which training never sees."""
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("the test tables are not here")
    got = quality.scored(spark.read.parquet(f"{folder}/documents.parquet")).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").select("score", "quality").toPandas()
    rank, good = got["score"].rank(), got["quality"] == 1
    n, m = good.sum(), (~good).sum()
    assert m and (rank[good].sum() - n * (n + 1) / 2) / (n * m) > 0.97


def test_em_finds_the_accurate_labeller():
    rng = np.random.default_rng(3)
    truth = rng.random(4000) < 0.7
    votes = np.stack([np.where(rng.random(4000) < p, truth, ~truth) for p in (0.95, 0.8, 0.7, 0.6)], 1).astype(int) + 1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    prior, table, _ = quality.accuracies(patterns, counts.astype(float))
    right = (table[1, :, quality.GOOD] + table[0, :, quality.BAD]) / 2
    assert abs(prior - 0.7) < 0.1 and right[0] > right[1] > right[3]


def test_encoder_matches_library():
    exact, own, rng = Tokenizer.from_file(BYTE), encoder(BYTE), random.Random(1)
    letters = [chr(c) for c in [*range(1, 0x180), 0x4E00, 0x301, 0x2028, 0x85, 0x1F600]] + ["<|endoftext|>", "'s", "  ", "\n\n", "a" * 70]
    for _ in range(1500):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 14)))
        assert own(text).tolist() == exact.encode(text, add_special_tokens=False).ids


def test_ranked_vocabularies():
    from tessera.llm import tokens

    with open(BYTE, encoding="utf-8") as f:
        model = json.load(f)["model"]
    assert tokens.ranked(model) and not tokens.ranked({**model, "merges": model["merges"][::-1]})


def test_helper_columns_never_clash(spark):
    """Columns named as helpers once were, and are, keep their values."""
    names = ["__th", "__kid", "__rn", "__stay", "kid", "th", "rn", "stay", "spans", "left", "doc_id_", "c0", "same"]
    long = "a passage that is long enough to be removed from both documents that hold it, word by word and letter by letter, " * 3
    data = [(k, f"text {k} a@b{k}.co " + (long if k < 2 else f"only here {k} " * 9), *[f"{n}{k}" for n in names]) for k in range(6)]
    docs = spark.createDataFrame(data, ["doc_id", "text", *names])
    want = {d[0]: d[2:] for d in data}
    for made in (simhash.representatives(docs), pii.without(docs), suffix.without(docs), quality.filtered(docs)):
        assert made.dtypes == docs.dtypes
        assert all(tuple(r)[2:] == want[r.doc_id] for r in made.collect())


def test_nothing_is_left_in_the_shared_folder(spark, docs):
    common.tidy(spark)
    folder = common.shared_dir(spark).removeprefix("file://").removeprefix("file:")
    before = set(os.listdir(folder))
    for made in (simhash.components(docs), multiset.compared(docs), packing.pack_texts(docs, BYTE), token_binary.round_trip(docs, BYTE)):
        made.count()
    assert common.KEPT
    common.tidy(spark)
    assert not common.KEPT and set(os.listdir(folder)) <= before


def test_garbage_goes_between_steps(spark):
    """What no step holds any more is gone after a written table, at most once in CLEARED_EVERY seconds."""
    import gc

    def gone():
        ref = spark._jvm.java.lang.ref.WeakReference(spark._jvm.java.lang.Object())
        gc.collect()
        common.written(spark.range(3).toDF("x"))
        return ref.get() is None

    common.CLEARED.clear()
    assert gone()
    assert not common.cleared(spark)
