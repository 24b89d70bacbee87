"""Leaves of many templates: no line is left out of gathering because others of its leaf come first."""

import random

from sitegauge.llm import line_templates


def test_a_template_is_found_among_many_single_lines(documents):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(9))
    rows = [(i, f"2024-01-{i % 28} 12:{i} {i} user {word()} logged in from the web portal today") for i in range(40)]
    single = [(1000 + i, f"{i} {i} {i} " + " ".join(word() for _ in range(9))) for i in range(120)]
    # Others share words with many lines, but are like none.
    common = [(2000 + i, f"{i} {i} {i} user " + " ".join(word() for _ in range(7)) + " today") for i in range(60)]
    got = line_templates.recurring_lines(documents(rows + single + common)).collect()
    assert {r.doc_id for r in got} == {i for i, _ in rows} and {r.n_docs for r in got} == {40}


def gathered(lines):
    """Centres in order, as many as there are; each line joins the first that it is like."""
    template, centres = {}, []
    for key, w in lines:
        at = next((c for c, v in centres if sum(a == b for a, b in zip(v, w)) / len(w) >= 0.7), None)
        if at is None:
            centres.append((at := key, w))
        template[key] = at
    return template


def test_all_centres_equal_brute_force(spark):
    rnd = random.Random(5)
    for n in (5, 6, 7, 10, 13):
        lines = sorted({" ".join(["<*>"] * 3 + [rnd.choice("abcdefg") for _ in range(n - 3)]) for _ in range(150)})
        rows = [("leaf", f"{rnd.randrange(10**9):09d}", rnd.randrange(1, 4), x.split()) for x in lines]
        want = gathered([(r[1], r[3]) for r in sorted(rows, key=lambda r: (-r[2], r[1]))])
        got = line_templates._gathered(spark.createDataFrame(rows, "leaf string, line_id string, n_docs long, tokens array<string>")).collect()
        assert {r.line_id: r.template_id for r in got} == want and len(got) == len(rows)
        assert len(set(want.values())) > 4
