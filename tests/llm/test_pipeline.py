"""The pipeline against brute force, and all queries of this subpackage on the small tables."""

import collections
import importlib
import inspect
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from test_minhash import brute as brute_components
from test_ngram_trie import brute as brute_scores
from test_pii import brute as brute_spans
from test_quality import base_failed
from test_quality import brute as brute_measures
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from sitegauge.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def corpus():
    """(documents, benchmark): plain texts, bad ones, copies, near copies, and questions inside texts."""
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdefghijk") for _ in range(rnd.randrange(3, 8))) for _ in range(3000)]
    plain = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    bench = [(i, " ".join(f"{rnd.choice(words)}q" for _ in range(20))) for i in range(10)]
    rows = [(i, plain(rnd.randrange(60, 200)), "en", f"s{i * i % 4}") for i in range(120)]
    rows += [(200, "too short", "en", "s0"), (201, None, "en", "s1"), (202, "", None, None), (203, "on and " * 100, "de", "s1")]
    rows += [(300 + i, rows[i][1], "en", "s2") for i in range(0, 40, 4)]
    rows += [(400 + i, rows[i][1] + " " + plain(3), "en", "s3") for i in range(1, 40, 4)]
    rows += [(500 + i, f"{plain(50)} {bench[i % 10][1]} {plain(50)}", "en", "s1") for i in range(15)]
    rnd.shuffle(rows)
    return [(*r, len(r[1] or "")) for r in rows], bench


def test_pipeline_equals_brute_force(spark, tmp_path, library):
    rows, bench = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    good = [r for r in rows if not base_failed(brute_measures(r[1]))]
    assert {r[0] for r in rows} - {r[0] for r in good} == {200, 201, 202, 203}
    kept = {i for i, (_, c, _) in brute_components([(r[0], r[1]) for r in good]).items() if c == i}
    left = [r for r in good if r[0] in kept and not any(q in r[1] for _, q in bench)]
    assert len(left) == 120

    tokens = collections.Counter()
    for r in left:
        tokens[r[3]] += len(r[1].split())
    sizes = np.array(list(tokens.values()), float)
    # No source more than twice as often as the largest, entropy at least 95 % of the greatest.
    p = sizes / sizes.sum()
    entropy = lambda a: -sum(w * np.log(w) for w in p**a / (p**a).sum()) / np.log(len(p))
    powers = [a for a in np.linspace(0, 1, 20001) if entropy(a) >= 0.95]
    power = max(max(powers), 1 - np.log(2) / np.log(p.max() / p.min()))
    quota = {s: n * (p.max() / x) ** (1 - power) for (s, n), x in zip(tokens.items(), p)}

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    copies = collections.Counter(r.doc_id for r in got)
    assert set(copies) == {r[0] for r in left}
    for source, n in tokens.items():
        mine = [r for r in left if r[3] == source]
        given = sum(copies[r[0]] * len(r[1].split()) for r in mine)
        assert quota[source] - 201 < given <= quota[source] + 1
        assert {copies[r[0]] for r in mine} <= {int(quota[source] / n + 1e-6), int(quota[source] / n + 1e-6) + 1}

    texts, start = {r[0]: r[1] for r in left}, 0
    for r in sorted(got, key=lambda r: r.start):
        ids = np.array([*library.encode(texts[r.doc_id], add_special_tokens=False).ids, 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == sorted(r.doc_id for r in got)


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "MinHash near-dedup", "benchmark decontamination", "mixing to target weights", "token-ID output"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).dtypes == docs.dtypes


def test_stages_of_odd_rows(spark, documents, odd_rows, tmp_path):
    spark.createDataFrame([(1, None), (None, "x"), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows in (odd_rows, []):
        docs = documents(rows)
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, str(tmp_path)).collect()


def test_registered():
    names = set(__spark_entry__.queries())
    assert {"pipeline", *queries.QUERIES} <= names
    assert sorted({int(n[2:].split("_")[0]) for n in queries.QUERIES}) == list(range(1, 14))


def test_nothing_else_imports_this():
    for name in ("registry", "rescore", "queries_pages", "queries_text", "queries_state", "queries_events", "inputs"):
        assert "llm" not in inspect.getsource(importlib.import_module(f"sitegauge.plans.{name}"))


@pytest.fixture(scope="module")
def small():
    return [tuple(r.values()) for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_on_the_small_tables(spark, small, library, name):
    got = queries.QUERIES[name](spark, SF).collect()
    ids = [i for i, _ in small]
    if name.startswith("op2"):
        assert {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got} == {
            (i, len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 1024) for i, t in small
        }
    elif name.startswith("op3"):
        start, want = 0, []
        for i, t in sorted(small):
            e = np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4")
            want.append((i, start, len(e), zlib.crc32(e.tobytes())))
            start += len(e)
        assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == want
    elif name.startswith("op4"):
        assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute_components(small)
    elif name.startswith("op7"):
        want = {i: brute_spans(t) for i, t in small}
        for r in got:
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in want[r.doc_id]) for n in range(4)]
        assert len(got) == len(ids)
    elif name.startswith("op9"):
        want = {i: brute_measures(t) for i, t in small}
        assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got} == want
    elif name.startswith("op10_"):
        for g, w in zip(sorted(got, key=lambda r: r.doc_id), sorted(brute_scores(small), key=lambda r: r[0]), strict=True):
            assert tuple(g)[:5] == w[:5] and abs(g.base_score - w[5]) < 1e-6 and abs(g.score - w[6]) < 0.001 * w[2]
    else:
        assert {r.doc_id for r in got} <= set(ids) and got
