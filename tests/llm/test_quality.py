"""Quality measures against brute force; the fences of the sketches; clean and bad texts."""

import collections
import random
import re

import numpy as np
import pytest

from sitegauge.llm import quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def base_failed(m):
    return m[0] < 50 or 100 * m[4] > 50 * m[0]


def random_text(rnd):
    alphabet = ["a", "b", "é", "#", "*", " ", " ", "\n", "\t", "\r", "ab", "中"]
    return "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(0, 400)))


def check(docs, rows):
    got = quality_rules.quality(docs).collect()
    key = lambda x: tuple(map(str, x))
    want = sorted(((i, *brute(t), base_failed(brute(t))) for i, t, *_ in rows), key=key)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=key) == want
    assert not any(r.kept and r.base_failed for r in got)
    return got


def test_measures(documents):
    rnd = random.Random(2)
    check(documents(rows := [(i, random_text(rnd)) for i in range(300)]), rows)


def test_odd_rows(documents, odd_rows):
    check(documents(odd_rows), odd_rows)
    docs = documents(odd_rows)
    left = quality_rules.passing(docs)
    assert left.columns == docs.columns
    assert quality_rules.quality(documents([])).count() == 0 and quality_rules.passing(documents([])).count() == 0


@pytest.fixture
def corpus():
    """Plain texts of two languages, with some of too many symbols, and a group where symbols are usual."""
    rnd = random.Random(7)
    plain = lambda n: " ".join("".join(rnd.choice("abcdefg") for _ in range(rnd.randrange(2, 9))) for _ in range(n))
    rows = [(i, plain(80), "en" if i % 2 else "de", f"s{i % 3}") for i in range(900)]
    rows += [(1000 + i, plain(40) + " # $" * 40, "en", "s1") for i in range(5)]
    rows += [(2000 + i, plain(40) + "".join(f" #{plain(1)}" for _ in range(40)), "en", "code") for i in range(300)]
    return rows


def test_thresholds_adapt_to_the_group(documents, corpus):
    kept = {r.doc_id for r in quality_rules.quality(documents(corpus)).collect() if r.kept}
    assert set(range(900)) <= kept, "clean documents stay"
    assert not kept & set(range(1000, 1005)), "far outside what is usual in the source"
    assert set(range(2000, 2300)) <= kept, "usual in this source"
    assert {r.doc_id for r in quality_rules.passing(documents(corpus)).collect()} == kept


def test_sketches_merge_and_are_close(spark, documents, corpus):
    """The sketch of all rows is the sum of the sketches of two halves, and its quantiles are right to 1 %."""
    measured = lambda rows: documents(rows).select("lang", "source", quality_rules.measures("text").alias("_m"))
    whole = collections.Counter()
    for part in (corpus[::2], corpus[1::2]):
        for r in quality_rules.sketches(measured(part)).collect():
            whole[r.lang, r.source, r.metric, r.bucket] += r.n
    assert whole == {(r.lang, r.source, r.metric, r.bucket): r.n for r in quality_rules.sketches(measured(corpus)).collect()}
    values = sorted(brute(t)[1] / brute(t)[0] for _, t, lang, source in corpus if (lang, source) == ("en", "code"))
    q10, q90 = (values[int(np.ceil(q * len(values))) - 1] for q in (0.1, 0.9))
    row = {(r.lang, r.source): r for r in quality_rules.thresholds(quality_rules.sketches(measured(corpus))).collect()}["en", "code"]
    spread = (row.high["word_length"] - row.low["word_length"] - 2 * quality_rules.SLACK["word_length"]) / (1 + 2 * quality_rules.SPREADS)
    assert abs(spread - (q90 - q10)) < 0.02 * q90
