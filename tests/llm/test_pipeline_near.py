"""The near-duplicate stage at similarities of 0.80 to 0.85, against brute force."""

import random

from test_minhash import shingles

import corpus_pipeline
from sitegauge.llm import minhash


def test_stage_links_from_four_fifths(spark, documents):
    rnd = random.Random(6)
    rows, want = [], set()
    for i in range(60):
        words = [f"w{rnd.randrange(10**6)}" for _ in range(100)]
        copy = list(words)
        # Each word changed changes five of 96 shingles: two leave 0.811, three 0.730.
        for at in (20, 50, 80)[: 2 + (i % 3 == 0)]:
            copy[at] = "new"
        a, b = " ".join(words), " ".join(copy)
        x, y = shingles(a), shingles(b)
        near = len(x & y) / len(x | y)
        assert 0.80 <= near < 0.85 or near < 0.75
        rows += [(i, a), (1000 + i, b)]
        want |= {i} if near >= 0.8 else {i, 1000 + i}
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, documents(rows), "").collect()} == want


def test_bands_follow_the_threshold():
    assert minhash.bands_for(85, 100) == minhash.BANDS
    assert (1 - 0.8**minhash.ROWS) ** minhash.bands_for(80, 100) <= minhash.MISSED
