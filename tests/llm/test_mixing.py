"""Temperature mixing: the power against plain numpy, exact epochs and budgets, odd rows."""

import collections
import math
import random

import numpy as np
import pytest

from sitegauge.llm import mixing
from sitegauge.llm.mixing import Target

SIZES = {"big": 3000, "mid": 700, "small": 90, "tiny": 12}


@pytest.fixture
def corpus():
    rnd, rows = random.Random(4), []
    for source, n in SIZES.items():
        rows += [(len(rows) + i, " ".join(["w"] * rnd.randrange(1, 12)), "en", source) for i in range(n // 6)]
    return rows


def totals(rows):
    out = collections.Counter()
    for _, t, _, source in rows:
        out[source] += len(t.split())
    return out


def weights(tokens, power):
    w = np.array(list(tokens.values()), float) ** power
    return dict(zip(tokens, w / w.sum()))


def entropy(w):
    return -sum(x * math.log(x) for x in w.values()) / math.log(len(w))


def test_entropy_is_met(documents, corpus):
    t = totals(corpus)
    got = mixing.schedule(documents(corpus), Target(entropy=0.9)).collect()
    w = {r.source: r.weight for r in got}
    assert abs(entropy(w) - 0.9) < 1e-6 and abs(sum(w.values()) - 1) < 1e-9
    # The same power in every source.
    powers = [math.log(w[s] / w["big"]) / math.log(t[s] / t["big"]) for s in t if s != "big"]
    assert max(powers) - min(powers) < 1e-6


def test_repeats_are_limited_and_nothing_is_left_out(documents, corpus):
    got = mixing.schedule(documents(corpus), Target(entropy=1.0, max_repeats=3.0)).collect()
    copies = collections.Counter(r.doc_id for r in got)
    assert set(copies) == {r[0] for r in corpus}
    by_source = collections.defaultdict(list)
    for i, _, _, s in corpus:
        by_source[s].append(copies[i])
    assert by_source["big"] == [1] * len(by_source["big"]) and max(copies.values()) == 3 and set(by_source["tiny"]) <= {2, 3}
    assert all(max(c) - min(c) <= 1 for c in by_source.values())


def test_budget(documents, corpus):
    t, budget = totals(corpus), 1500
    got = mixing.schedule(documents(corpus), Target(entropy=0.8, budget=budget)).collect()
    given = collections.Counter()
    for r in got:
        given[r.source] += r.n_tokens
    for s in t:
        quota = round(next(r.weight for r in got if r.source == s) * budget)
        assert quota - 12 < given[s] <= quota, s
    # Epochs are whole: nothing comes a second time before all has come once.
    seen = collections.Counter(r.doc_id for r in got if r.source == "tiny")
    assert max(seen.values()) - min(seen.get(i, 0) for i, _, _, s in corpus if s == "tiny") <= 1


def test_order_interleaves_epochs(documents, corpus):
    got = sorted(mixing.schedule(documents(corpus), Target(max_repeats=3.0, entropy=1.0)).collect(), key=lambda r: r.at)
    assert all(0 <= r.at < 1 for r in got)
    for s in SIZES:
        epochs = [r.epoch for r in got if r.source == s]
        assert epochs == sorted(epochs)


def test_same_every_time_and_blocks(documents, corpus, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 50)
    target = Target(entropy=0.95, budget=2500)
    runs = [sorted(map(tuple, mixing.schedule(documents(c), target).collect())) for c in (corpus, corpus[::-1])]
    assert runs[0] == runs[1]
    rows = mixing.mixed(documents(corpus), target).collect()
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(r[0] for r in runs[0])
    given = collections.Counter()
    for r in runs[0]:
        given[r[1]] += r[4]
    assert abs(sum(given.values()) - 2500) < 50


def test_odd_rows(documents, odd_rows):
    docs = documents(odd_rows)
    got = mixing.schedule(docs, Target(entropy=1.0, max_repeats=2.0)).collect()
    assert {r.doc_id for r in got} == {r[0] for r in odd_rows}
    mixed = mixing.mixed(docs, Target(entropy=1.0, max_repeats=2.0))
    assert mixed.columns == docs.columns and mixed.count() == len(got) >= len(odd_rows)
    assert mixing.schedule(documents([]), Target(entropy=1.0)).count() == 0 == mixing.mixed(documents([]), Target()).count()


def test_no_target_keeps_shares(documents, corpus):
    got = mixing.schedule(documents(corpus), Target()).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(r[0] for r in corpus)
