"""Passages whose lines are all short."""

import random

from sitegauge.llm import repeats


def test_a_poem_of_short_lines(documents):
    rnd = random.Random(3)
    words = lambda n: " ".join(f"v{rnd.randrange(10**6)}" for _ in range(n))
    poem = "\n".join(words(6) for _ in range(20))
    refrain = "\n".join(words(5) for _ in range(3))
    rows = [(i, f"{words(30)}\n{poem}\n{words(30)}\n{refrain}\n{words(9)}") for i in (4, 2, 9)]
    got = repeats.repeated_spans(documents(rows)).collect()
    assert {(r.doc_id, r.n_units, r.n_words, r.first_doc_id) for r in got} == {(4, 20, 120, 2), (9, 20, 120, 2)}
    left = {r.doc_id: r.text for r in repeats.without_repeats(documents(rows)).collect()}
    assert poem in left[2] and poem[:20] not in left[4] and poem[-20:] not in left[9] and refrain in left[4]


def test_fifty_words_inside_other_sentences(documents):
    rnd = random.Random(4)
    words = lambda n: " ".join(f"v{rnd.randrange(10**6)}" for _ in range(n))
    passage = ". ".join([words(7)] + [words(6) for _ in range(6)] + [words(7)])
    rows = [(i, f"{words(20)} {passage} {words(20)}.") for i in (1, 2)]
    (r,) = repeats.repeated_spans(documents(rows)).collect()
    assert (r.doc_id, r.n_units, r.n_words) == (2, 6, 36)
