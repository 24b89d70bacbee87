"""Copies in other cases, and questions of many numbers and names."""

import random

from test_decontamination import QUESTION, bench, found, prose  # noqa: F401

DENSE = ["What is 15% of 80?", "Solve 3x + 7 = 22.", "Is Paris in France or Germany?", "If A = 3, B = 4 and C = 5, what is A + B + C?"]


def test_copies_in_any_case(documents, bench):  # noqa: F811
    rnd = random.Random(1)
    rows = [(i, f"{prose(rnd, 40)} {change(QUESTION)} {prose(rnd, 40)}") for i, change in enumerate((str, str.lower, str.upper, str.title))]
    got = found(documents(rows), bench([(1, QUESTION)]))
    assert set(got) == {(i, 1) for i in range(4)} and all(r.coverage == 1.0 and r.verbatim for r in got.values())


def test_dense_questions(documents, bench):  # noqa: F811
    rnd = random.Random(2)
    rows = [(i, f"{prose(rnd, 30)} {q} {prose(rnd, 30)}") for i, q in enumerate(DENSE)]
    other = "Solve 4x + 9 = 21. Is Rome in Spain or Italy? The table has 15 80 3 4 5 7 22 and A B C."
    rows += [(10, f"{prose(rnd, 30)} {other} {prose(rnd, 30)}"), (11, " ".join(str(rnd.randrange(100)) for _ in range(400)))]
    assert set(found(documents(rows), bench(list(enumerate(DENSE))))) == {(i, i) for i in range(4)}


def test_a_long_part_of_a_longer_question(documents, bench):  # noqa: F811
    words = [f"q{i}x" for i in range(200)]
    rows = [(1, " ".join(words[40:100])), (2, " ".join(words[40:70]))]
    assert set(found(documents(rows), bench([(1, " ".join(words))]))) == {(1, 1)}
