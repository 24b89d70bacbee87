from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from sitegauge.llm import merkle
from sitegauge.llm.merkle import manifest


def digest(text):
    return sha256(text.encode()).hexdigest()


def leaf(row, damaged=False):
    doc_id, text, lang, source, n = row
    if damaged and text is not None and doc_id is not None and crc32(str(doc_id).encode()) % 2 == 0:
        text = text.replace("\n", "")
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n, text)))


def climb(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([digest("".join(low[i : i + 3])) for i in range(0, len(low), 3)])
    return levels


def path(levels, i):
    out = []
    for nodes in levels[:-1]:
        run, at = nodes[i - i % 3 : i - i % 3 + 3], i % 3
        out.append(("".join(run[:at]), "".join(run[at + 1 :])))
        i //= 3
    return out


def brute(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r[3], []).append(r)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r), leaf(r, True)))
        trees[s] = climb([leaf(r) for r in by_source[s]])
    top = climb([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, r in enumerate(by_source[s]):
            proof = path(trees[s], i) + path(top, k)
            node = leaf(r, True)
            for left, right in proof:
                node = digest(left + node + right)
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], digest("".join(a + b for a, b in proof)), node, node == top[-1][0]))
    return out


def same(got, want):
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("step", [1, 2, 4])
def test_trees_of_all_sizes(spark, documents, step):
    rows = []
    for k, n in enumerate([1, 2, 3, 4, 9, 10, 27, 28, 82]):
        rows += [(100 * k + i, f"line {i}\nnext {k}\n", "en", f"s{k}") for i in range(n)]
    got = manifest(documents(rows).repartition(5), merkle.damaged_text(), step)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    same(got, brute([(*r, len(r[1])) for r in rows]))


def test_odd_rows(spark, documents, odd_rows):
    rows = [(*r, *("en", "a")[len(r) - 2 :])[:4] for r in odd_rows]
    rows += [(50, "x\ny", "", ""), (51, "x\ny", "en", "é"), (52, "x\ny", "en", "z"), (52, "x\nz", "en", "z")]
    same(manifest(documents(rows), merkle.damaged_text()), brute([(*r, len(r[1] or "")) for r in rows]))


def test_stored_text_verifies_and_empty_table(spark, documents):
    docs = documents([(i, f"t{i}", "en", "ab"[i % 2]) for i in range(20)])
    assert manifest(docs).where("verified").count() == 20
    changed = manifest(docs, F.when(F.col("doc_id") == 3, "other").otherwise(F.col("text")))
    assert [r.doc_id for r in changed.where("not verified").collect()] == [3]
    assert manifest(documents([])).collect() == []


def test_one_document(spark, documents):
    (row,) = manifest(documents([(4, "only")])).collect()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.proof_sha256 == sha256(b"").hexdigest()
