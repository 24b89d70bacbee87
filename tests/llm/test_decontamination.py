"""Benchmark decontamination: copies, re-parameterised questions, clean documents, odd rows."""

import random

import pytest
from pyspark.sql import types as T

from sitegauge.llm import decontamination as d

BENCH = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("coverage", T.StringType())])
QUESTION = (
    "A farmer called John Smith sells 12 kg of apples for 30 dollars and buys 4 baskets; if John Smith then gives 12 kg "
    "away, how many baskets of fruit are left for the market at noon"
)
OTHER = "the height of a tower is measured from its shadow when the sun stands at a known angle over the horizon"


@pytest.fixture
def bench(spark):
    return lambda rows: spark.createDataFrame([(*r, "x") for r in rows], BENCH)


def prose(rnd, n):
    return " ".join(rnd.choice("lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor".split()) for _ in range(n))


def found(docs, bench):
    return {(r.doc_id, r.item_id): r for r in d.contaminated(docs, bench).collect()}


def test_copies_and_new_parameters(documents, bench):
    rnd = random.Random(1)
    around = lambda x: f"{prose(rnd, 40)} {x} {prose(rnd, 40)}"
    changed = QUESTION.replace("John Smith", "Maria Anna Lopez").replace("12", "7.5").replace("30", "1,000").replace("kg", "lbs")
    rows = [
        (1, around(QUESTION)), (2, around(changed)), (3, around(QUESTION.upper().lower())), (4, prose(rnd, 300)), (5, around(OTHER)),
        (6, around(" ".join(QUESTION.split()[:9]))), (7, around(QUESTION + " " + OTHER)), (7, around(QUESTION + " " + OTHER)),
    ]
    got = found(documents(rows), bench([(1, QUESTION), (2, OTHER), (2, OTHER), (3, None), (4, ""), (5, "the"), (None, "of a")]))
    assert {(1, 1), (2, 1), (5, 2), (7, 1), (7, 2)} <= set(got)
    assert not {k for k in got if k[0] in (4, 6)}, "prose and a short beginning are clean"
    assert got[1, 1].verbatim and got[1, 1].coverage == 1.0 and not got[2, 1].verbatim


def test_slots_must_be_filled_consistently(documents, bench):
    """The same template, but one name of the question stands for many: not this question."""
    tale = "when {} met {} at the gate of {} and gave {} a coin for {} who then told {} about the sea"
    item = tale.format(*["Ann"] * 6)
    one, many = tale.format(*["Bob"] * 6), tale.format("Bob", "Cid", "Dan", "Eve", "Fay", "Gus")
    got = found(documents([(1, f"so {one} it is"), (2, f"so {many} it is"), (3, item)]), bench([(1, item)]))
    assert set(got) == {(1, 1), (3, 1)} and got[3, 1].verbatim and not got[1, 1].verbatim


def test_a_short_question_is_one_window(documents, bench):
    item = "how tall is the old tower"
    got = found(documents([(1, f"please say how tall is the old tower today"), (2, "how tall is a new tower"), (3, item)]), bench([(9, item)]))
    assert set(got) == {(1, 9), (3, 9)}


def test_edited_passage(documents, bench):
    words = OTHER.split()
    words[9] = "else"
    assert set(found(documents([(1, prose(random.Random(2), 30) + " " + " ".join(words))]), bench([(1, OTHER)]))) == {(1, 1)}


def test_filter_has_no_false_negatives(documents, bench):
    """Against brute force over exact copies: every planted question is found, nothing else is."""
    rnd = random.Random(3)
    items = [(i, " ".join(f"q{rnd.randrange(900)}x" for _ in range(rnd.randrange(10, 60)))) for i in range(60)]
    rows, want = [], set()
    for k in range(300):
        text = prose(rnd, rnd.randrange(10, 80))
        for i, t in rnd.sample(items, rnd.choice((0, 0, 1, 3))):
            text += f" {t} {prose(rnd, 5)}"
            want.add((k, i))
        rows.append((k, text))
    assert set(found(documents(rows), bench(items))) == want


def test_odd_rows(documents, bench, odd_rows):
    docs = documents([*odd_rows, (None, OTHER)])
    got = found(docs, bench([(1, OTHER)]))
    assert set(got) == {(None, 1)}
    left = d.clean(docs, bench([(1, OTHER)]))
    assert left.columns == docs.columns and left.where("doc_id is null").count() == 0 and left.count() == 12
    assert found(documents([]), bench([(1, OTHER)])) == {} == found(docs, bench([]))
    assert d.clean(docs, bench([])).count() == len(odd_rows) + 1


def test_template_classes():
    import numpy as np

    data = np.frombuffer("Élan Vital took 3.5 km and 7 hours, then km.".encode(), np.uint8)
    token, slot, start, end, first = d.template(data, np.array([0, len(data)]))
    words = [data[a:b].tobytes().decode() for a, b in zip(start, end)]
    assert words == ["Élan Vital", "took", "3.5", "km", "and", "7", "hours", "then", "km"]
    assert slot.tolist() == [True, False, True, True, False, True, True, False, False] and first.tolist() == [0, 9]
