import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from sitegauge.llm import suffixes


def brute(rows, length=200):
    raw = [(i, (t or "").encode()) for i, t, *_ in rows]
    seen = Counter(r[a : a + length] for _, r in raw for a in range(len(r) - length + 1))
    out = []
    for i, r in raw:
        gone = np.zeros(len(r) + 1, bool)
        for a in range(len(r) - length + 1):
            if seen[r[a : a + length]] > 1:
                gone[a : a + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone]).astype(int)) == 1)
        kept = bytes(b for b, g in zip(r, gone, strict=False) if not g)
        out.append((i, len(r), int(gone.sum()), len(edges), sha256(kept).hexdigest()))
    return out


def same(got, rows):
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
    key = lambda r: tuple(str(x) for x in r)
    taken = got.collect()
    assert sorted((tuple(r)[:5] for r in taken), key=key) == sorted(brute(rows), key=key)
    for r in taken:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans
    return taken


def prose(rng, n, letters="abcdefghij klmno é\n"):
    return "".join(rng.choice(letters) for _ in range(n))


def corpus(seed):
    """Passages of many lengths in many surroundings, near copies, copies, and periodic texts."""
    rng = random.Random(seed)
    passages = [prose(rng, n, "abcdefgh ") for n in (190, 199, 200, 201, 230, 260, 330, 400, 700, 2500)]
    rows = []
    for i in range(60):
        text = "".join(rng.choice([prose(rng, rng.randint(0, 300)), rng.choice(passages)]) for _ in range(rng.randint(0, 5)))
        rows.append((i, text))
    base = prose(rng, 5000)
    for i in range(12):
        cut = sorted(rng.sample(range(5000), 3))
        rows.append((100 + i, base[: cut[0]] + prose(rng, rng.randint(0, 9)) + base[cut[0] : cut[1]] + base[cut[1] + rng.randint(0, 3) :]))
    rows += [(200, "a" * 1000), (201, "b" + "a" * 199), (202, "a" * 199), (203, "ab" * 150 + "c" + "ab" * 99), (204, "xyz" * 66 + "xy")]
    rows += [(210 + i, passages[9][i * 7 : i * 7 + 200 + i]) for i in range(10)]
    rows += [(230, base), (231, base), (232, passages[2]), (233, passages[2]), (234, passages[0]), (235, passages[0])]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes_are_those_of_brute_force(spark, documents, seed):
    rows = corpus(seed)
    same(suffixes.repeated_bytes(documents(rows).repartition(4)), rows)


def test_crowds_are_compared_over_all_tasks(spark, documents, monkeypatch):
    monkeypatch.setattr(suffixes, "GROUP", 3)
    rows = corpus(3)
    same(suffixes.repeated_bytes(documents(rows).repartition(4)), rows)


def test_order_alone_finds_what_is_inside(spark, documents):
    """Neighbours in the suffix order share what two copies with one change have in common, but for its ends."""
    rng = random.Random(4)
    base = prose(rng, 6000, "abcdefgh ")
    docs = documents([(1, base), (2, base[:3000] + "CHANGED" + base[3000:])])
    parts = suffixes._anchors(docs.select("doc_id", "text").toArrow().to_batches(), 200)
    rows = [r for b in parts for r in b.to_pylist()]
    anchors = spark.createDataFrame(rows, "text_id long, at int, size int, phrase long, context long")
    found = suffixes.suffix_order(anchors.drop("context")).where("shared >= 200").collect()
    inside = {(r.text_id, p) for r in found for p in range(r["at"], r["at"] + r.shared)}
    assert len(inside) > 2 * 6000 * 0.9
    assert not any(i == 2 and 3000 <= p < 3007 for i, p in inside)


def test_odd_rows(spark, documents, odd_rows):
    same(suffixes.repeated_bytes(documents(odd_rows)), odd_rows)
    assert suffixes.repeated_bytes(documents([])).collect() == []
    rows = [(1, None), (2, "short"), (2, "short")]
    same(suffixes.repeated_bytes(documents(rows)), rows)
