"""The sharded tries against a plain dictionary model."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from sitegauge.llm import ngram_trie as lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def brute(rows):
    """(doc_id, held_out, n_tokens, n_known, N, base_score, score without quantisation)."""
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    one, two, before = collections.Counter(), collections.Counter(), collections.Counter()
    for i, t in rows:
        if not held(i):
            w = tokens(t)
            one.update(w)
            two.update(zip(["<s>", *w], w))
            before.update(["<s>", *w[:-1]])
    n, v = sum(one.values()), len(one)
    out = []
    for i, t in rows:
        w = tokens(t)
        u = [(one[x] + 1) / (n + v + 1) for x in w]
        p = [(two[a, b] + lm.PRIOR * x) / (before[a] + lm.PRIOR) for (a, b), x in zip(zip(["<s>", *w], w), u)]
        out.append((i, held(i), len(w), sum(one[x] > 0 for x in w), n, sum(map(math.log10, u)), sum(map(math.log10, p))))
    return out


def check(docs, rows):
    got = sorted(lm.score(docs).collect(), key=lambda r: (str(r.doc_id), r.n_tokens, r.base_score))
    want = sorted(brute(rows), key=lambda r: (str(r[0]), r[2], r[5]))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert tuple(g)[:5] == w[:5]
        assert math.isclose(g.base_score, w[5], rel_tol=1e-9, abs_tol=1e-9)
        assert abs(g.score - w[6]) <= w[2] / lm._STEP, (g, w)
    return got


def texts(seed, n):
    rnd = random.Random(seed)
    names = [f"W{i}" for i in range(300)]
    return [(i, "".join(rnd.choice(names[: rnd.choice((3, 30, 300))]) + rnd.choice([" ", "\n", "  "]) for _ in range(rnd.randrange(0, 60)))) for i in range(n)]


@pytest.mark.parametrize("size", [(8 << 20, 500_000), (2000, 100)])
def test_equals_plain_model(documents, monkeypatch, size):
    monkeypatch.setattr(lm, "BLOCK_BYTES", size[0])
    monkeypatch.setattr(lm, "SHARD_TOKENS", size[1])
    check(documents(rows := texts(1, 200)), rows)


def test_hot_contexts_are_spread(documents, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 100)
    rows = [(i, " ".join(f"the w{i * 31 % 977 + k}" for k in range(25))) for i in range(100)]
    check(documents(rows), rows)


def test_odd_rows(documents, odd_rows):
    check(documents(odd_rows), [r[:2] for r in odd_rows])
    assert lm.score(documents([])).count() == 0


def test_held_out_texts_score_better_than_unigrams(documents):
    rnd = random.Random(3)
    follow = {f"a{i}": [f"a{(i * 7 + k) % 50}" for k in range(3)] for i in range(50)}
    rows = []
    for i in range(300):
        w = ["a1"]
        while len(w) < 40:
            w.append(rnd.choice(follow[w[-1]]))
        rows.append((i, " ".join(w)))
    held = [r for r in lm.score(documents(rows)).collect() if r.held_out]
    assert held and sum(r.score for r in held) > 0.6 * sum(r.base_score for r in held)


def test_elias_fano_round_trip():
    rnd = np.random.default_rng(2)
    for values in ([], [0], [2**64 - 1], [5, 5, 5], range(1000), rnd.integers(0, 2**63, 5000), rnd.integers(0, 99, 500), (np.arange(300) << 40) + rnd.integers(0, 2**40, 300)):
        values = np.sort(np.array(list(values), np.uint64))
        assert (lm.EliasFano(*lm.EliasFano.pack(values)).values() == values).all()


def test_trie_finds_what_it_holds():
    contexts = np.array([3, 9, 2**63], np.uint64)
    keys = np.array([(0 << 40) | 7, (0 << 40) | 8, (2 << 40) | 7], np.uint64)
    trie = lm.Trie(contexts, keys, np.array([1, 3, 6]), np.array([4, 0, 6]))
    backoff, codes = trie.ask(np.array([3, 4, 2**63], np.uint64), np.array([3, 1, 2]), np.array([7, 8, 9, 7, 7, 8], np.uint64))
    assert (backoff > 0).tolist() == [True, False, True] and (codes > 0).tolist() == [True, True, False, False, True, False]
    assert np.allclose(lm.probability(codes, 0.0), [1 / 8, 3 / 8, 0, 0, 6 / 10, 0], rtol=1e-3)
    assert np.allclose(lm.probability(backoff, 1.0), [4 / 8, 1, 4 / 10], rtol=1e-3)


def test_tries_are_searched_as_they_are_packed(monkeypatch):
    """Every value is found at its place, nothing else is, and no level is decoded."""
    rnd = np.random.default_rng(4)
    monkeypatch.setattr(lm, "_ASKED", 1000)
    packed = []
    for values in ([], [0], [2**64 - 1], range(1000), rnd.integers(0, 2**63, 5000), (np.arange(300) << 40) + rnd.integers(0, 2**40, 300), [*range(3000), 2**62]):
        values = np.unique(np.array(list(values), np.uint64))
        wanted = np.concatenate([values, values + np.uint64(1), values - np.uint64(1), rnd.integers(0, 2**63, 500).astype(np.uint64)])
        packed.append((lm.EliasFano(*lm.EliasFano.pack(values)), values, rnd.permutation(wanted)))
    monkeypatch.delattr(lm.EliasFano, "values")
    for held, values, wanted in packed:
        at = {int(v): i for i, v in enumerate(values)}
        assert held.find(wanted).tolist() == [at.get(int(w), -1) for w in wanted]
    trie = lm.Trie(np.array([3, 9], np.uint64), np.array([7, (1 << 40) | 7], np.uint64), np.array([1, 6]), np.array([4, 6]))
    backoff, codes = trie.ask(np.array([3, 4, 9], np.uint64), np.array([1, 1, 2]), np.array([7, 7, 7, 8], np.uint64))
    assert (backoff > 0).tolist() == [True, False, True] and (codes > 0).tolist() == [True, False, True, False]
