import random
from hashlib import sha256
from zlib import crc32

import numpy as np

from sitegauge.llm import periodic
from sitegauge.llm.wordarrays import mix64


def brute(word):
    """All runs by comparing every word with the one q places on, for every q."""
    n, found = len(word), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and word[j] == word[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i) + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def sequences(seed, count):
    rng = random.Random(seed)
    for _ in range(count):
        k = rng.choice([1, 2, 3, 60])
        out = [rng.randrange(k) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            piece = [rng.randrange(k) for _ in range(rng.choice([1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 32, 33, 64, 65]))]
            out = (out + piece * rng.randint(1, 7))[: len(out) + len(piece) * 7 - rng.randint(0, 3)]
            out += [rng.randrange(k) for _ in range(rng.randint(0, 5))]
        yield out


def test_runs_are_those_of_brute_force():
    texts = list(sequences(3, 600))
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    hashes = mix64(np.array([x for t in texts for x in t], np.uint64) + np.uint64(77))
    s, e, q = periodic.runs_of(hashes, first)
    got = sorted(zip(s.tolist(), (e - s).tolist(), q.tolist(), strict=True))
    assert got == sorted((a + int(f), n, p) for t, f in zip(texts, first, strict=False) for a, n, p in brute(t))


def test_long_period_and_long_run():
    rng = random.Random(1)
    piece = [rng.randrange(10**6) for _ in range(3001)]
    word = [7, 8] + piece * 5 + piece[:17] + [9] + [5] * 20000
    s, e, q = periodic.runs_of(mix64(np.array(word, np.uint64)), np.array([0, len(word)]))
    assert list(zip(s, e, q, strict=True)) == [(2, 2 + 3001 * 5 + 17, 3001), (len(word) - 20000, len(word), 1)]


def expected(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (
        doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2],
        sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest(),
        sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    )


def test_report_over_odd_rows_and_planted_runs(spark, documents, odd_rows):
    rng = random.Random(9)
    rows = [r for r in odd_rows if len(r[1] or "") < 9000]
    rows += [(i, " \t".join(rng.choice(["la", "le", "lié", "lo\u0085"]) for _ in range(rng.randint(0, 60)))) for i in range(100, 400)]
    rows += [(1000, "x " * 5), (1001, "x " * 6), (1002, "a b c d e " * 4), (1003, "\n".join(["a b c d e"] * 4) + " a b")]
    docs = documents(rows).repartition(3)
    got = periodic.run_report(periodic.with_planted_runs(docs))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted((expected(r[0], r[1]) for r in rows), key=key)


def test_very_long_text_and_empty_table(spark, documents):
    text = " ".join(f"w{i}" for i in range(30000)) + " again and" * 9000
    (row,) = periodic.periodic_runs(documents([(3, text)])).collect()
    assert [tuple(r) for r in row.runs] == [(30000, 18000, 2)] and row.n_words == 48000
    assert row.collapsed.endswith("w29999 again and")
    assert periodic.run_report(documents([])).collect() == []
