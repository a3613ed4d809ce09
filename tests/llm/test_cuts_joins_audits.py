"""Fill-in-the-middle, the n-gram join and the filter audit against brute force, on odd rows and very long texts."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import fim, filter_audit, ngram_join, simhash

WHITE = re.compile(r"[^\x20\x09-\x0D]+")


def rows():
    rng = random.Random(11)
    words = [a + b for a in ("Alpha", "beta", "GAMMA", "délta", "épsilon", "zeta", "eta.", "theta,", "😀") for b in ("", "s", "ing", "x" * 70)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    out = [(k, text(rng.randint(1, 300)), rng.choice(["web", "books", "", None])) for k in range(60)]
    odd = [None, "", " \n\t", "word", "two words", "three little words", "a<P>b", "<M>", "é" * 64, "é" * 65, "x" * 128, "a\x00b\x0bc d e", "A" * 30, "price $5", "<<S", "tail<"]
    out += [(100 + k, t, "odd") for k, t in enumerate(odd)]
    out += [(140, out[3][1], "web"), (141, out[3][1], "books"), (3, out[3][1], "web"), (3, text(40), "web"), (None, out[3][1], "web"), (None, None, None), (143, "ab " * 4000, "odd"), (144, "q" * 9000, "odd")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, s, "en", 1, "k") for d, t, s in rows()], "doc_id long, text string, source string, n string, `a.b` int, mask string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, int(k % 3 == 0)) for k in range(0, 150, 2)] + [(4, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")


def key(r):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)


def cut_plainly(d, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if d is None else d}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return d, n, "plain", None, None, text, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return d, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}", text
    return d, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}", text


def test_fim(docs):
    got = [tuple(r) for r in fim.restored(fim.transformed(docs)).collect()]
    want = [cut_plainly(d, t) for d, t, _ in rows()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fim.restored(fim.transformed(docs.limit(0))).count() == 0


def test_fim_on_very_long_texts(spark):
    long = [(k, t) for k, t in enumerate([" " * 2_000_000, "é" * 2_000_000, "ab " * 700_000 + "😀"])]
    got = [tuple(r) for r in fim.restored(fim.transformed(spark.createDataFrame(long, "doc_id long, text string"))).collect()]
    assert sorted(got) == [cut_plainly(d, t) for d, t in long]


def test_offsets_are_code_points():
    offsets, rng = fim.Offsets(), random.Random(5)
    for n in [*range(0, 140), 191, 192, 193, fim.PIECE - 1, fim.PIECE, fim.PIECE + 1]:
        text = "".join(rng.choice("aé😀\n\r\x00́ ") for _ in range(n))
        made = offsets(text)
        assert len(made) == n and all(made[k] == k for k in {0, n // 2, max(0, n - 1), n})


def shingles(text, words=3):
    parts = WHITE.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(parts[k : k + words]) for k in range(max(1, len(parts) - words + 1))} if parts else set()


def joined_plainly(given, percent):
    sets = [shingles(t) for _, t in given]
    up = list(range(len(given)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, j in itertools.combinations(range(len(given)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            up[root(i)] = root(j)
    least = defaultdict(list)
    for k, (d, _) in enumerate(given):
        least[root(k)].append(d)
    return [(d, len(s), (min((x for x in least[root(k)] if x is not None), default=None) if s else d)) for k, ((d, _), s) in enumerate(zip(given, sets, strict=True))]


def near_copies(rng, groups=6, each=25, edits=6):
    """Texts of many lengths with copies in which words were changed, dropped or added."""
    vocabulary = [f"w{k}" for k in range(400)]
    out = []
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range((4, 9, 14, 30, 80, 250)[g % 6])]
        for _ in range(each):
            words = list(base)
            for _ in range(rng.randint(0, edits)):
                at = rng.randrange(len(words))
                if (kind := rng.random()) < 0.4:
                    words[at] = rng.choice(vocabulary)
                elif kind < 0.7 and len(words) > 1:
                    del words[at]
                else:
                    words.insert(at, rng.choice(vocabulary))
            out.append(" ".join(words))
    return out


@pytest.mark.parametrize("percent", [90, 80, 60])
def test_ngram_join(spark, percent):
    given = [(k, t) for k, t in enumerate(near_copies(random.Random(percent)))] + [(d, t) for d, t, _ in rows() if t is None or len(t) < 5000]
    given = [(d if d is None else d + 1000 * (k >= 150), t) for k, (d, t) in enumerate(given)]
    frame = spark.createDataFrame([(d, t, "x", b"s") for d, t in given], "doc_id long, text string, same string, key binary")
    got = [tuple(r) for r in ngram_join.components(frame, 3, percent).collect()]
    want = joined_plainly(given, percent)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert max(Counter(c for _, _, c in want).values()) > 3
    assert ngram_join.components(frame.limit(0), 3, percent).count() == 0


def test_ngram_join_in_blocks_of_a_crowded_bucket(spark, monkeypatch):
    """Buckets in blocks give the same links; so do allocations with left-out segments."""
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(ngram_join, "allocations", lambda docs, words, percent, *_: {b: np.array([0, 2] + [1] * (ngram_join.Bands(percent).limit(b) - 1), np.int8) for b in range(60) if ngram_join.Bands(percent).limit(b) > 0})
    given = list(enumerate(near_copies(random.Random(2), groups=12, each=12)))
    frame = spark.createDataFrame(given, "doc_id long, text string")
    assert sorted(tuple(r) for r in ngram_join.components(frame, 3, 90).collect()) == sorted(joined_plainly(given, 90))


def test_ngram_join_on_very_long_texts(spark):
    rng = random.Random(3)
    words = [str(rng.randrange(10**6)) for _ in range(200_000)]
    edited = list(words)
    for k in range(0, 200_000, 90):
        edited[k] = "other"
    far = list(words)
    for k in range(0, 200_000, 40):
        far[k] = "other"
    given = [(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join(far)), (4, "a " * 1_000_000), (5, "a" * 2_000_000), (6, " " * 2_000_000)]
    got = {r.doc_id: r.component_id for r in ngram_join.components(spark.createDataFrame(given, "doc_id long, text string"), 3, 90).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}


def test_bands_leave_no_partner_out():
    """A partner of a size lies in its band or the next, and the limit bounds their difference."""
    for percent in (50, 80, 90, 99):
        bands = ngram_join.Bands(percent)
        for small in range(1, 400):
            for large in range(small, 100 * small // percent + 1):
                b = bands.of(small)
                assert bands.of(large) in (b, b + 1) and (bands.of(large) == b or 100 * bands.largest(b) >= percent * large)
                assert (100 - percent) * (small + large) // (100 + percent) <= bands.limit(b)


def test_allocations_exceed_the_limit():
    rng = np.random.default_rng(4)
    for limit in range(1, 40):
        for n in {limit + 1, limit // 2 + 1}:
            counts = [(n, k, *rng.random(4) * [1, 100, 10, 100]) for k in range(n)]
            cost, made = ngram_join.allocated(counts, limit)
            table = np.array(counts)[:, 2:]
            price = np.stack([np.zeros(n), table[:, 0] + ngram_join.MEETING * table[:, 1], table[:, 2] + ngram_join.MEETING * table[:, 3]])
            assert made.sum() >= limit + 1 and abs(price[made, np.arange(n)].sum() - cost) < 1e-6
            if n < 6:
                assert cost <= min(price[list(v), np.arange(n)].sum() for v in itertools.product(range(3), repeat=n) if sum(v) >= limit + 1) + 1e-9


def test_parities_bound_the_difference():
    rng = random.Random(8)
    for _ in range(200):
        a, b = ({rng.randrange(10**6) for _ in range(rng.randint(1, 300))} for _ in range(2))
        b |= set(rng.sample(sorted(a), len(a) // 2))
        x, y = (np.unique(ngram_join.spread(np.array(sorted(s), np.uint64), 0)) for s in (a, b))
        for la, lb in ((5, 5), (5, 80)):
            one, two = ngram_join.parities(x, la), ngram_join.parities(y, lb)
            width = min(len(one), len(two))
            assert ngram_join.apart(ngram_join.folded([one], width), ngram_join.folded([two], width))[0, 0] <= len(a ^ b)


def audited_plainly(given, labels):
    first = {}
    for d, t, _ in given:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, x in labels if x == 1}
    each = []
    for d, t, s in given:
        t = t or ""
        words = WHITE.findall(t)
        failed = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": d is not None and first[t] < d,
        }
        each.append((s or "", failed, d is not None and d in good, d is not None and d in toxic))
    out, shapley = [], Counter()
    for part in {e[0] for e in each}:
        mine = [e for e in each if e[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                there = [e for e in mine if not any(e[1][x] for x in order[: step - 1])]
                gone = [e for e in there if e[1][f]]
                shapley[part, f] += len(gone)
                out.append((part, order, step, len(there) - len(gone), len(gone), sum(e[1][f] for e in mine) - len(gone), sum(e[1][f] and sum(e[1].values()) == 1 for e in mine), sum(e[2] for e in gone), sum(e[3] for e in gone)))
    return [(*r, shapley[r[0], r[1][r[2] - 1]]) for r in out]


def test_audit(docs, labels):
    got = [tuple(r) for r in filter_audit.audit(docs, labels).collect()]
    assert sorted(got) == sorted(audited_plainly(rows(), [tuple(r) for r in labels.collect()]))
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    assert sum(r[3] + r[4] for r in filter_audit.audit(docs, labels.limit(0)).where("step = 1 AND filter_order = 'ABCDE'").collect()) == len(rows())


@pytest.mark.parametrize("hashes", ["own", "constant", "size"])
def test_words_are_counted_whatever_their_hashes(hashes, monkeypatch):
    """Words that share a hash are told apart by their bytes."""
    import pyarrow as pa

    if hashes != "own":
        monkeypatch.setattr(filter_audit, "word_hashes", lambda data, starts, sizes: sizes.astype(np.uint64) * np.uint64(hashes == "size"))
    texts = [t or "" for _, t, _ in rows()] + ["abcdefgh abcdefghi abcdefgh\x00 abcdefgh", "x" * 64 + " " + "x" * 65 + " " + "x" * 65]
    for column in (pa.array(texts), pa.array(["skipped", *texts])[1:], pa.array(texts, pa.large_string()), pa.array([""])):
        m = filter_audit.measured(column, filter_audit.byte_classes())
        for k, t in enumerate(column.to_pylist()):
            words = WHITE.findall(t)
            assert (m["words"][k], m["distinct"][k], m["points"][k], m["capitals"][k]) == (len(words), len(set(words)), len(t), len(re.findall("[A-Z]", t))), t[:50]


def test_audit_on_very_long_texts(spark, labels):
    given = [(1, " " * 2_000_000, "a"), (2, "x" * 2_000_000, "a"), (3, "ab " * 1_000_000, "a"), (4, "x" * 2_000_000, "a"), (5, " ".join(map(str, range(300_000))), "a")]
    got = [tuple(r) for r in filter_audit.audit(spark.createDataFrame(given, "doc_id long, text string, source string"), labels).collect()]
    assert sorted(got) == sorted(audited_plainly(given, [tuple(r) for r in labels.collect()]))


def test_prefix_sums_in_slabs(monkeypatch):
    monkeypatch.setattr(filter_audit, "SLAB", 7)
    rng = np.random.default_rng(1)
    flags = rng.random(100) < 0.3
    borders = np.sort(np.concatenate(([0, 0, 100, 100], rng.integers(0, 101, 40))))
    assert filter_audit.sums_at(flags, borders).tolist() == [int(flags[:b].sum()) for b in borders]


def test_shingles_agree_with_the_near_duplicate_operator():
    for _, t, _ in rows():
        assert len(np.unique(simhash.shingle_hashes(t or "", 3))) == len(shingles(t))
