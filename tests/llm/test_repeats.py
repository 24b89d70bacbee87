"""Repeated units and line templates against brute force."""

import collections
import hashlib
import random
import re

import pytest

from sitegauge.llm import line_templates, repeats


def units(text):
    """(start, end, words) of the units of a text with a word."""
    out, start = [], 0
    stops = [m.start() for m in re.finditer(r"\n|[.!?](?=[\x20\x09-\x0D]|$(?![\n]))", text)] + [len(text)]
    for stop in stops:
        words = [(m.start() + start, m.end() + start, m[0]) for m in re.finditer(r"[0-9A-Za-z\u0080-\U0010ffff]+", text[start:stop])]
        if words:
            end = stop + (1 if stop < len(text) and text[stop] in ".!?" else 0)
            out.append((words[0][0], end, tuple(re.sub("[A-Z]", lambda m: m[0].lower(), w) for *_, w in words)))
        start = stop + 1
    return out


def brute(rows):
    first, every = {}, {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        for k, (a, b, w) in enumerate(units(t or "")):
            every[i, k] = (a, b, w, first.setdefault(w, (i, k)) != (i, k))
    out = []
    for i, t in rows:
        run = []
        for k in range(len(units(t or "")) + 1):
            a, b, w, again = every.get((i, k), (0, 0, (), False))
            if again:
                run.append((a, b, len(w)))
            elif run:
                if max(n for *_, n in run) >= 8 or sum(n for *_, n in run) >= 36:
                    out.append((i, run[0][0], run[-1][1], len(run), sum(n for *_, n in run)))
                run = []
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_spans_equal_brute_force(documents, seed):
    rnd = random.Random(seed)
    sentence = lambda: " ".join(f"Wö{rnd.randrange(50)}" for _ in range(rnd.randrange(1, 14))) + rnd.choice([". ", "! ", "\n", ".\n", "? ", " - "])
    pool = [sentence() for _ in range(60)]
    rows = [(i, "".join(rnd.choice(pool) if rnd.random() < 0.4 else sentence() for _ in range(rnd.randrange(0, 20))).strip()) for i in range(80)]
    got = sorted(((r.doc_id, r.start, r.end, r.n_units, r.n_words) for r in repeats.repeated_spans(documents(rows)).collect()), key=str)
    assert got == brute(rows)


def test_a_passage_inside_a_line(documents):
    rnd = random.Random(9)
    words = lambda n: " ".join(f"v{rnd.randrange(100000)}" for _ in range(n))
    passage = ". ".join(words(11).capitalize() for _ in range(6)) + "."
    rows = [(i, f"{words(30)} {passage} {words(30)}.") for i in (5, 3, 8)] + [(1, words(90)), (2, f"{words(9)}. All of it. {words(9)}. All of it.")]
    got = repeats.repeated_spans(documents(rows)).collect()
    assert {r.doc_id for r in got} == {5, 8} and {r.first_doc_id for r in got} == {3} and all(r.n_words >= 50 for r in got)
    cut = {r.doc_id: r for r in repeats.without_repeats(documents(rows)).collect()}
    assert passage in cut[3].text and passage[80:] not in cut[5].text and cut[1].text == rows[3][1]
    (s,) = cut[5].removed
    assert cut[5].text == rows[0][1][: s.start] + rows[0][1][s.end :]


def test_repeats_of_odd_rows(documents, odd_rows):
    got = repeats.repeated_spans(documents(odd_rows)).collect()
    assert {r.doc_id for r in got} == {4, 5}, "the null id ranks first and keeps the long text"
    assert repeats.repeated_spans(documents([])).count() == 0
    assert repeats.without_repeats(documents(odd_rows)).count() == len(odd_rows)


def brute_templates(rows, min_docs=3):
    lines = []
    for doc, text in rows:
        for no, line in enumerate((text or "").split("\n") if text is not None else []):
            w = ["<*>" if re.search("[0-9]", x) else x for x in re.split(r"[ \t\r\x0b\x0c]+", line) if x]
            if len(w) >= 4:
                lines.append((doc, no, tuple(w), hashlib.md5(" ".join(w).encode()).hexdigest()))
    docs_of, leaves = collections.defaultdict(set), collections.defaultdict(dict)
    for doc, _, w, key in lines:
        docs_of[key].add(doc)
        leaves[len(w), w[:3]][key] = w
    template = {}
    for leaf in leaves.values():
        rest = dict(leaf)
        for _ in range(4):
            if not rest:
                break
            centre = min(rest, key=lambda k: (-len(docs_of[k]), k))
            for k, w in list(rest.items()):
                if sum(a == b for a, b in zip(w, leaf[centre])) / len(w) >= 0.7:
                    template[k] = centre
                    del rest[k]
        template |= {k: k for k in rest}
    docs = collections.defaultdict(set)
    for doc, _, _, key in lines:
        docs[template[key]].add(doc)
    return sorted(((doc, no, template[key], len(docs[template[key]])) for doc, no, _, key in lines if len(docs[template[key]]) >= min_docs), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_templates_equal_brute_force(documents, seed):
    rnd = random.Random(seed)
    words = "user login failed from host page of the and next item saved".split()

    def line():
        if rnd.random() < 0.5:
            return f"user {rnd.choice(words)} failed from {rnd.randrange(99)} at host {rnd.choice(words)} today"
        return " ".join(rnd.choice(words[:5]) for _ in range(rnd.randrange(1, 9)))

    rows = [(i // 2 if i % 7 else None, "\n".join(line() for _ in range(rnd.randrange(0, 9)))) for i in range(60)]
    got = sorted(((r.doc_id, r.line_no, r.template_id, r.n_docs) for r in line_templates.recurring_lines(documents(rows)).collect()), key=str)
    assert got == brute_templates(rows)


def test_templates_of_odd_rows(documents, odd_rows):
    got = line_templates.recurring_lines(documents(odd_rows)).collect()
    assert {r.doc_id for r in got} == {4, 5, None}
    left = {r.doc_id: r.text for r in line_templates.without_recurring(documents(odd_rows)).collect()}
    assert len(left) == 12 and left[4] == "" and left[7] == "one two three" and left[1] is None
    assert line_templates.recurring_lines(documents([])).count() == 0


def test_templates_stay_in_the_jvm(documents):
    plan = line_templates.recurring_lines(documents([(1, "a b c d")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
