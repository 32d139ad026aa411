"""Periodic runs against brute force."""
import hashlib
import random
import zlib

import numpy as np
import pytest

from logweave.llm import periodic_runs as runs

from llm_samples import WORD, prose


def brute(words):
    """All runs (start, length, period), by start, then period, from the definition."""
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - s
            own = words[s:s + length]
            if length >= max(24, 3 * q) and not any(own[d:] == own[:-d] for d in range(1, q)):
                out.append((s, length, q))
    return sorted(out)


def planted(doc, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc).encode())
    if doc is not None and h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def digest(doc, text):
    words = planted(doc, text)
    found = brute(words)
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    keep = [True] * len(words)
    for s, n, q in found:
        for k in range(s + q, s + n):
            keep[k] = False
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(w for w, k in zip(words, keep) if k)))


def noisy(rng, n):
    """Words with runs of many periods, nested, broken by single changes and side by side."""
    out = []
    while len(out) < n:
        root = [rng.choice("abc") for _ in range(rng.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 40]))]
        part = root * rng.randint(1, 30)
        if rng.random() < 0.5:
            part[rng.randrange(len(part))] = "x"
        if rng.random() < 0.3:
            part = part * 3
        out += part[:rng.randint(1, len(part))]
    return out[:n]


def solve_whole(words):
    ids = np.unique(words, return_inverse=True)[1].astype(np.uint64) if words else np.zeros(0, np.uint64)
    lo, hi = np.array([0]), np.array([len(words)])
    return runs.runs_of([f for _, *f in runs.solve(ids, lo, hi, lo, hi, lo)])


def test_whole_tiles_equal_brute_force():
    rng = random.Random(1)
    for k in range(250):
        words = noisy(rng, rng.randint(0, 260))
        assert solve_whole(words) == brute(words), k
    for words in (["a"] * 200, ["a", "b"] * 100, ["a"] * 23, ["a"] * 24, list("ab" * 11 + "a"), list("abcdefgh" * 3), list("abcdefgh" * 3)[:-1]):
        assert solve_whole(words) == brute(words)


def test_many_texts_in_one_buffer_do_not_mix():
    rng = random.Random(2)
    texts = [noisy(rng, rng.randint(0, 90)) for _ in range(40)]
    flat = [w for t in texts for w in t]
    ids = np.unique(flat, return_inverse=True)[1].astype(np.uint64)
    ends = np.cumsum([len(t) for t in texts])
    lo = np.concatenate([[0], ends[:-1]])
    found = [[] for _ in texts]
    for t, *f in runs.solve(ids, lo, ends, lo, ends, lo):
        found[t].append(f)
    assert [runs.runs_of(f) for f in found] == [brute(t) for t in texts]


@pytest.fixture
def small_tiles(monkeypatch):
    monkeypatch.setattr(runs, "TILE", 256)


def tiled(words):
    """Tiles solved one by one and stitched in plain Python."""
    ids = np.unique(words, return_inverse=True)[1]
    spans = {}
    one = lambda x: np.array([x], np.int64)
    for low, high, own, a, z in runs.tiles_of(len(words)):
        stop = min(len(words), own + max(runs.TILE, 4 * high))
        for _, q, s, e in runs.solve(ids[a:z], one(0), one(z - a), one(own - a), one(stop - a), one(-a), low, high):
            spans.setdefault(q, []).append((s + a, e + a))
    out = []
    for q, own in spans.items():
        at = None
        for s, e in sorted(own):
            if at and s <= at[1]:
                at[1] = max(at[1], e)
            else:
                at = [s, e]
                out.append((q, at))
    return runs.runs_of([(q, *span) for q, span in out])


def test_stitched_tiles_equal_the_whole(small_tiles):
    rng = random.Random(3)
    for k in range(25):
        n = rng.randint(200, 4000)
        words = noisy(rng, n)
        if k % 2:
            a, p = rng.randrange(n // 2), rng.randint(1, n // 6)
            words = [str(w) + str(i // 7 % 5) for i, w in enumerate(words)]
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        assert tiled(words) == solve_whole(words)
    assert tiled(["a"] * 3000) == [(0, 3000, 1)]


def test_documents(spark, docs, rows, empty):
    more = [(k, prose(40 + 3 * k, k)) for k in range(100, 160)] + [(None, "a b " * 40), (None, "a b " * 40), (161, "\x1c " * 30 + "x")]
    extra = spark.createDataFrame(more, "doc_id long, text string")
    every = docs.select("doc_id", "text", "id", "node").unionByName(extra, allowMissingColumns=True)
    texts = [(r[0], r[1]) for r in rows if r[0] != 9] + more
    every = every.filter("doc_id <> 9 OR doc_id IS NULL")
    want = sorted(((k is None, k or 0), digest(k, t)) for k, t in texts)
    assert sum(w[1][0] > 0 for w in want) > 5
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    for limit in (1 << 15, 100):
        got = runs.run_digest(runs.periodic_runs(runs.plant_periods(every), long_chars=limit)).collect()
        assert sorted(((r.doc_id is None, r.doc_id or 0), tuple(r[n] for n in names)) for r in got) == want
    assert runs.periodic_runs(empty).count() == 0


def test_long_documents_in_tiles(spark):
    """A text of many tiles gives the runs of the whole; a constant text is one run."""
    rng = random.Random(4)
    words = [str(rng.randrange(50)) for _ in range(5000)]
    words = words + (words[:3000] * 4)[:11_000] + noisy(rng, 6000)
    df = spark.createDataFrame([(1, " ".join(words)), (2, "a " * 40_000)], "doc_id long, text string")
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in runs.periodic_runs(df).collect()}
    assert got[1] == solve_whole(words) and any(q == 3000 for _, _, q in got[1]) and got[2] == [(0, 40_000, 1)]
