"""Base spans against the patterns as written; the field against brute force and on held-out variants."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from sitegauge.llm import pii
from sitegauge.llm.wordarrays import text_chunks


def brute(text):
    out = []
    for kind, pattern in enumerate((
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
    )):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(digits[::-1])]
            ok = (
                True, kind == 1 and all(int(x) <= 255 for x in m[0].split(".")), 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0, 10 <= len(digits) <= 15,
            )[kind]
            if ok:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def written(found):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in found)


def card(rnd, n=16):
    body = [rnd.randrange(10) for _ in range(n - 1)]
    return next(s for s in ("".join(map(str, [*body, c])) for c in range(10)) if pii.luhn(s.encode()))


def test_base_spans_of_random_texts():
    rnd = random.Random(11)
    pieces = ["@", "a", "b.c", "x_y", "-", ".", "+", " ", "\n", "é", "1", "22", "255", "256", "4111 1111 1111 1111", "1.2.3.4", "+1 (555) 123-4567", "%", "(", ")", "00"]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randrange(0, 22))) for _ in range(6000)]
    texts += [card(rnd, n) for n in range(13, 21)] + ["1" * 5000, "1." * 3000, "a" * 20000 + "@", "+1" * 2000, "+", "@", "12 ", "34", "+", "5 555 555 5555"]
    for limit in (200, 1 << 22):
        at = 0
        for _, end, data, offsets in text_chunks(pa.array(texts), limit):
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            got = [[] for _ in range(end - at)]
            for kind, a, b in pii.base_spans(data, offsets):
                t = int(np.searchsorted(offsets, a, "right")) - 1
                got[t].append((int(points[a] - points[offsets[t]]), kind, int(points[b] - points[offsets[t]])))
            for text, mine in zip(texts[at:end], got, strict=True):
                assert sorted(mine) == brute(text), text[:200]
            at = end


def small_field(seed):
    rnd = np.random.default_rng(seed)
    field = pii.Field(rnd.normal(size=(4 * pii.SHAPES, 9)), rnd.normal(size=(9, 9)))
    return field


def test_viterbi_is_the_best_path():
    field = small_field(1)
    for words in (["a"], ["a", "9", "b@c"], ["+1", "(22)", "3-4", "x"]):
        x = pii._features(words)
        e, m = field.emit[x].sum(axis=1), field.move + field.allowed
        score = lambda p: field.begin[p[0]] + sum(e[i, y] for i, y in enumerate(p)) + sum(m[a, b] for a, b in zip(p, p[1:]))
        assert tuple(field.decode([x])[0]) == max(itertools.product(range(9), repeat=len(words)), key=score)


def corpus():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 9)))
    phone = lambda: f"+1 ({rnd.randrange(100, 999)}) 555-{rnd.randrange(1000, 9999)}"
    mail = lambda: f"{word()}.{rnd.randrange(99)}@mail{rnd.randrange(9)}.example.com"
    ip = lambda: ".".join(str(rnd.randrange(1, 255)) for _ in range(4))
    plain = lambda: str(rnd.randrange(1000))
    rows = []
    for i in range(400):
        w = [word() for _ in range(30)]
        for _ in range(rnd.randrange(3)):
            w.insert(rnd.randrange(30), rnd.choice([phone, mail, ip, lambda: card(rnd), plain])())
        rows.append((i, " ".join(w)))
    return rows


@pytest.fixture(scope="module")
def trained(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    return pii.train(pii.labelled_table(docs))


def found_by(field, text):
    (_, _, data, offsets), = text_chunks(pa.array([text]))
    base = pii.base_spans(data, offsets)
    return [(pii.KINDS[k], text[a:b]) for k, a, b in pii._added(data, offsets, field, base)]


def test_the_field_finds_held_out_variants(trained):
    assert found_by(trained, "please call abcd (714) 555-9921 gefa bcde") == [("phone", "(714) 555-9921")]
    assert found_by(trained, "hgf abc efga.71[at]mail3.example.com, dabc") == [("email", "efga.71[at]mail3.example.com")]
    assert found_by(trained, "abc abc 4929/1182/7710/2284 abc ab") == [("card", "4929/1182/7710/2284")]


def test_written_out_addresses_in_text_without_digits(trained):
    assert found_by(trained, "please write to jane.doe[at]example.org for details about the course") == [("email", "jane.doe[at]example.org")]
    assert found_by(trained, "or ask jane.doe(AT)example.org about the course") == [("email", "jane.doe(AT)example.org")]
    assert found_by(trained, "please write to jane dot doe at example dot org for details about the course") == [("email", "jane dot doe at example dot org")]
    far = "call +1 (714) 555-9921 or write a few more words to jane.doe(at)example.org instead"
    assert found_by(trained, far) == [("email", "jane.doe(at)example.org")]


def test_words_at_and_dot_in_prose_stay(trained):
    for text in ("we met at noon and the rest of us went home", "look at the small blue line there", "the last dot of the row", "at home [at] (at) all"):
        assert not [f for f in found_by(trained, text) if "example" in f[1] or " " in f[1]]


def test_every_cue_is_in_a_segment():
    text = "x [AT] y " + "w " * 9 + "(aT)z " + "w " * 9 + "At a b c d e dot " + "w " * 9 + "at a b c d e f dot"
    (_, _, data, offsets), = text_chunks(pa.array([text, "at", "dot a"]))
    held = [data.tobytes()[s[0] : e[-1]].decode() for _, s, e in pii.segments(data, offsets)]
    assert held == ["x [AT] y w w", "w w w (aT)z w w w", "w w w At a b c d e dot w w w"]


def test_the_field_leaves_plain_numbers_alone(trained):
    rnd = random.Random(6)
    for _ in range(50):
        assert found_by(trained, f"abc def {rnd.randrange(2000)} gefa 3. abc 12:30 {rnd.randrange(30)}% of") == []


def test_accuracy_on_held_out_labels(trained):
    """Labels of segments that were not trained on, by the patterns."""
    rnd, right, total = random.Random(99), 0, 0
    for _ in range(200):
        text = f"abcd ef +1 ({rnd.randrange(100, 999)}) 555-{rnd.randrange(1000, 9999)} gh abc de fg hab {'.'.join(str(rnd.randrange(255)) for _ in range(4))} abc"
        (_, _, data, offsets), = text_chunks(pa.array([text]))
        base = pii.base_spans(data, offsets)
        for _, starts, ends in pii.segments(data, offsets):
            want = pii._labels(starts, ends, base)
            got = trained.decode([pii._features(pii._texts(data.tobytes(), starts, ends))])[0]
            right, total = right + int((want == got).sum()), total + len(want)
    assert right / total > 0.97


def test_results_and_odd_rows(documents, odd_rows):
    extra = [(20, "é mail a.b@c.de, +1 555 123 4567 and 10.0.0.1; 4111-1111-1111-1111"), (20, "é mail a.b@c.de"), (None, "1.2.3.4")]
    rows = [*corpus()[:150], *odd_rows, *extra]
    got = pii.personal_data(documents(rows)).collect()
    key = lambda x: tuple(map(str, x))
    want = []
    for i, t, *_ in rows:
        b = brute(t)
        want.append((i, *[sum(k == n for _, k, _ in b) for n in range(4)], hashlib.sha256(written(b).encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got), key=key) == sorted(want, key=key)
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(i, []).append(t)
    for r in got:
        spans = r.spans.split(",") if r.spans else []
        assert any(set(filter(None, written(brute(t)).split(","))) <= set(spans) for t in texts[r.doc_id])
        starts = [(int(s.split(":")[1]), pii.KINDS.index(s.split(":")[0])) for s in spans]
        assert starts == sorted(starts)
    assert pii.personal_data(documents([])).count() == 0
