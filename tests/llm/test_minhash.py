"""Near-duplicates against brute force."""

import random
import re

import numpy as np
import pytest

from sitegauge.llm import minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def brute(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def variants(seed, n):
    """Groups of loosely and closely edited copies, on both sides of the threshold."""
    rnd = random.Random(seed)
    rows = []
    for base in range(n):
        words = [f"w{rnd.randrange(400)}" for _ in range(rnd.randrange(3, 160))]
        for _ in range(rnd.randrange(1, 9)):
            copy = list(words)
            for _ in range(rnd.randrange(0, 1 + len(words) // 20)):
                copy[rnd.randrange(len(copy))] = f"e{rnd.randrange(60)}"
            rows.append((" ".join(copy[: rnd.randrange(max(1, len(copy) - 3), len(copy) + 1)])))
    rnd.shuffle(rows)
    return list(enumerate(rows, 100))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, documents, seed):
    rows = variants(seed, 40)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(documents(rows)).collect()}
    assert got == brute(rows)


def test_a_chain_without_a_hub_is_one_component(documents):
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(12):
        rows.append((i, " ".join(words)))
        words[3 + 11 * i] = f"new{i}"
    assert {r.component_id for r in minhash.near_duplicates(documents(rows)).collect()} == {0} == {c for _, c, _ in brute(rows).values()}


def test_odd_rows(documents, odd_rows):
    got = minhash.near_duplicates(documents(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    want = brute([(r[0], r[1]) for r in odd_rows])
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == want[r.doc_id]


def test_rows_of_one_id_with_other_texts(documents):
    text = " ".join(map(str, range(50)))
    got = {(r.doc_id, r.n_shingles): r.component_id for r in minhash.near_duplicates(documents([(1, text), (3, text), (3, "other words")])).collect()}
    assert got[1, 46] == 1 and set(got) == {(1, 46), (3, 46), (3, 1)}


def test_without_duplicates(documents, odd_rows):
    docs = documents(odd_rows)
    left = minhash.without_duplicates(docs)
    assert left.columns == docs.columns
    ids = sorted((r.doc_id for r in left.collect()), key=lambda x: (x is None, x))
    assert ids == [1, 2, 3, 4, 6, 7, 9, 10, None, None]


def test_empty_table(documents):
    assert minhash.near_duplicates(documents([])).count() == 0
    assert minhash.without_duplicates(documents([])).count() == 0


def test_signature_estimates_similarity():
    rnd = np.random.default_rng(3)
    a = rnd.integers(0, 2**63, 5000, dtype=np.uint64)
    for share in (0.5, 0.8, 0.95):
        b = np.concatenate([a[: int(5000 * share)], rnd.integers(0, 2**63, 5000 - int(5000 * share), dtype=np.uint64)])
        true = share / (2 - share)
        assert abs((minhash.signature(a) == minhash.signature(b)).mean() - true) < 0.13


def test_permutations_are_bijective_on_a_range():
    x = np.arange(1 << 20, dtype=np.uint32)
    assert len(np.unique(minhash.order(x.copy()))) == len(x)
