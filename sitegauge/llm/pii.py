"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes that adds spans."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge.llm.common import with_package
from sitegauge.llm.wordarrays import SPACE, spans, text_chunks

KINDS = ("email", "ip", "card", "phone")
#: Segments of the labelled table at most; those of least hash are taken, so the sample is the same on every run.
SAMPLE = 3000
#: Words on either side of a word with a cue that belong to its segment.
CONTEXT = 3
#: Buckets for word shapes, and rounds and rate of the training.
SHAPES, TRAIN_ROUNDS, RATE, PENALTY = 2048, 80, 0.3, 1e-3

#: Words that stand for marks of an address, and how many words on from `at` a `dot` makes both a cue.
SPELLED, DOT_WITHIN = ("at", "dot"), 6

_LABELS = ["O", *[f"{p}-{k}" for k in KINDS for p in "BI"]]
_DIGIT, _LOCAL, _DIAL, _DOTTED = (np.zeros(256, bool) for _ in range(4))
_DIGIT[48:58] = True
_ALNUM = [*range(48, 58), *range(65, 91), *range(97, 123)]
_LOCAL[[*_ALNUM, *b"._%+-"]] = True
_DIAL[[*range(48, 58), *b" ().-"]] = True
_DOTTED[[*range(48, 58), 46]] = True
_DOMAIN = re.compile(rb"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_AT_SIGN = re.compile(r"\w(?:@|\[at\]|\(at\))\w", re.IGNORECASE)
_IP = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")


def luhn(digits: bytes) -> bool:
    values = [b - 48 for b in digits[::-1]]
    return (sum(values[0::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def base_spans(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) in bytes over all texts, by the fixed patterns; linear in the input, whatever it holds."""
    raw, out = data.tobytes(), []
    end_of = lambda p: int(offsets[np.searchsorted(offsets, p, "right")])

    starts, ends = spans(_LOCAL[data], offsets)
    done = 0
    for p in np.flatnonzero(data == 64).tolist():
        i = int(np.searchsorted(ends, p))
        if i == len(ends) or ends[i] != p or p in offsets or (s := max(int(starts[i]), done)) >= p:
            continue
        if m := _DOMAIN.match(raw, p + 1, end_of(p)):
            out.append((0, s, done := m.end()))

    starts, ends = spans(_DOTTED[data], offsets)
    for i in np.flatnonzero(ends - starts >= 7).tolist():
        for m in _IP.finditer(raw[starts[i] : ends[i]]):
            if all(len(part.lstrip(b"0")) <= 3 and int(part.lstrip(b"0") or b"0") <= 255 for part in m.group().split(b".")):
                out.append((1, int(starts[i]) + m.start(), int(starts[i]) + m.end()))

    digit = _DIGIT[data]
    joint = np.zeros(len(data), bool)
    joint[1:-1] = ((data[1:-1] == 32) | (data[1:-1] == 45)) & digit[:-2] & digit[2:]
    for cut in offsets[(offsets > 0) & (offsets < len(data))].tolist():
        joint[[cut - 1, cut]] = False
    starts, ends = spans(digit | joint, offsets)
    count = np.concatenate([[0], np.cumsum(digit)])
    n = count[ends] - count[starts]
    for i in np.flatnonzero((n >= 14) & (n <= 19)).tolist():
        if luhn(raw[starts[i] : ends[i]].translate(None, b" -")):
            out.append((2, int(starts[i]), int(ends[i])))

    starts, ends = spans(_DIAL[data], offsets)
    plus = np.flatnonzero(data[:-1] == 43) if len(data) else np.zeros(0, np.int64)
    for p in plus[digit[plus + 1]].tolist():
        if p + 1 in offsets:
            continue  # the digit is in the next text
        stop = int(ends[np.searchsorted(starts, p + 1, "right") - 1])
        last = p + 1 + max(raw[p + 1 : stop].rfind(d) for d in (b"0", b"1", b"2", b"3", b"4", b"5", b"6", b"7", b"8", b"9"))
        if last >= p + 3 and 10 <= count[last + 1] - count[p + 1] <= 15:
            out.append((3, p, last + 1))
    return out


def shape(word: str) -> str:
    """A word's letters as a and A, its digits as 9, runs of letters cut to one and of digits to five.

    The words that stand for an at sign or a point in a written-out address are shapes of their own, and so are all words
    with an at sign, in brackets or not, between letters or digits.
    """
    if word.lower() in SPELLED:
        return f"<{word.lower()}>"
    if _AT_SIGN.search(word):
        return "<address>"
    kinds = re.sub(r"[0-9]", "9", re.sub(r"[^\W\d_]", lambda m: "A" if m[0].isupper() else "a", word))
    return re.sub(r"9{6,}", "99999+", re.sub(r"([aA])\1+", r"\1", kinds))


def _features(words: list[str]) -> np.ndarray:
    """Four feature numbers for each word: its shape, the shapes beside it, and its digits by number.

    The digits of an address say nothing.
    """
    shapes = [shape(w) for w in words]
    bucket = [crc32(s.encode()) % SHAPES for s in shapes]
    digits = [SHAPES - 1 - (25 if s[:1] == "<" else min(sum(c.isdigit() for c in w), 24)) for w, s in zip(words, shapes, strict=True)]
    around = [0, *bucket, 0]
    return np.array([[b, SHAPES + around[i], 2 * SHAPES + around[i + 2], 3 * SHAPES + d] for i, (b, d) in enumerate(zip(bucket, digits, strict=True))])


def _core(word: bytes) -> tuple[int, int]:
    """Where a word begins and ends without punctuation around it; a leading plus or parenthesis stays."""
    a, b = 0, len(word)
    while a < b and not (chr(word[a]).isalnum() or word[a] >= 128 or word[a] in b"+("):
        a += 1
    while b > a and not (chr(word[b - 1]).isalnum() or word[b - 1] >= 128):
        b -= 1
    return a, b


def _bracketed(data: np.ndarray) -> np.ndarray:
    """Where `[at]` or `(at)` stands, in letters of any case."""
    marks = np.zeros(len(data), bool)
    if len(data) >= 4:
        low = data | np.uint8(32)
        square = (data[:-3] == 91) & (data[3:] == 93)
        marks[:-3] = (square | ((data[:-3] == 40) & (data[3:] == 41))) & (low[1:-2] == 97) & (low[2:-1] == 116)
    return marks


def _spelled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """Numbers of the words `at` that a `dot` follows within DOT_WITHIN words of the same text, and of those dots."""
    low = data | np.uint8(32)

    def places(word: bytes) -> np.ndarray:
        out = np.flatnonzero(ends - starts == len(word))
        for i, c in enumerate(word):
            out = out[low[starts[out] + i] == c]
        return out

    at, dot = places(b"at"), places(b"dot")
    if not len(at) or not len(dot):
        return np.zeros(0, np.int64)
    first = np.searchsorted(dot, at)
    next_dot = dot[np.minimum(first, len(dot) - 1)]
    near = (first < len(dot)) & (next_dot - at <= DOT_WITHIN) & (text_of[next_dot] == text_of[at])
    before = np.searchsorted(at[near], dot) - 1
    after_at = before >= 0
    after_at[after_at] = dot[after_at] - at[near][before[after_at]] <= DOT_WITHIN
    return np.concatenate([at[near], dot[after_at]])


def segments(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(text, word starts, word ends) of the runs of words near a cue: a digit, an at sign, or one written out.

    Every form that the field is trained on holds a cue, so no other word can get a label.
    """
    starts, ends = spans(~SPACE[data], offsets)
    if not len(starts):
        return
    cues = np.concatenate([[0], np.cumsum(_DIGIT[data] | (data == 64) | _bracketed(data))])
    near = np.zeros(len(starts), bool)
    text_of = np.searchsorted(offsets, starts, "right") - 1
    at = np.union1d(np.flatnonzero(cues[ends] > cues[starts]), _spelled(data, starts, ends, text_of))
    for shift in range(-CONTEXT, CONTEXT + 1):
        to = np.clip(at + shift, 0, len(starts) - 1)
        near[to[text_of[to] == text_of[at]]] = True
    chosen = np.flatnonzero(near)
    if len(chosen):
        breaks = np.flatnonzero((np.diff(chosen) > 1) | (np.diff(text_of[chosen]) > 0)) + 1
        for run in np.split(chosen, breaks):
            yield int(text_of[run[0]]), starts[run], ends[run]


class Field:
    """Linear-chain conditional random field: a weight for each (feature, label) and each (label, next label)."""

    def __init__(self, emit: np.ndarray | None = None, move: np.ndarray | None = None):
        k = len(_LABELS)
        self.emit = np.zeros((4 * SHAPES, k)) if emit is None else emit
        self.move = np.zeros((k, k)) if move is None else move
        self.allowed = np.zeros((k, k))
        for i, a in enumerate(_LABELS):
            for j, b in enumerate(_LABELS):
                if b[0] == "I" and a[2:] != b[2:]:
                    self.allowed[i, j] = -1e9
        self.begin = np.array([-1e9 if b[0] == "I" else 0.0 for b in _LABELS])

    def _padded(self, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(s) for s in sequences])
        x = np.zeros((len(sequences), size.max(), 4), np.int64)
        for i, s in enumerate(sequences):
            x[i, : len(s)] = s
        return x, size

    def fit(self, sequences: list[np.ndarray], labels: list[np.ndarray]) -> Field:
        """Maximum likelihood by gradient steps (Adagrad), forward and backward sums over all sequences at once."""
        if not sequences:
            return self
        x, size = self._padded(sequences)
        n, t, k = len(x), x.shape[1], len(_LABELS)
        y = np.zeros((n, t), np.int64)
        for i, s in enumerate(labels):
            y[i, : len(s)] = s
        mask = np.arange(t)[None] < size[:, None]
        features, width = x[mask], len(self.emit)

        def counted(p: np.ndarray) -> np.ndarray:
            """Sums of p (position, label) for each feature and label."""
            return sum(np.stack([np.bincount(features[:, f], p[:, j], width) for j in range(k)], axis=1) for f in range(4))

        seen_emit = counted(np.eye(k)[y[mask]])
        both = mask[:, 1:]
        seen_move = np.zeros((k, k))
        np.add.at(seen_move, (y[:, :-1][both], y[:, 1:][both]), 1.0)
        sums = [np.full_like(self.emit, 1e-8), np.full_like(self.move, 1e-8)]
        for _ in range(TRAIN_ROUNDS):
            e = self.emit[x].sum(axis=2)
            psi = np.exp(e - e.max(axis=2, keepdims=True))
            m = np.exp(self.move + self.allowed)
            alpha, beta, scale = np.zeros((n, t, k)), np.ones((n, t, k)), np.ones((n, t))
            for i in range(t):
                step = psi[:, i] * (np.exp(self.begin) if i == 0 else alpha[:, i - 1] @ m)
                scale[:, i] = np.where(mask[:, i], step.sum(axis=1), 1.0)
                alpha[:, i] = np.where(mask[:, i, None], step / scale[:, i, None], alpha[:, i - 1] if i else 0.0)
            want_move = np.zeros((k, k))
            for i in range(t - 1, 0, -1):
                on = mask[:, i]
                ahead = psi[on, i] * beta[on, i] / scale[on, i, None]
                want_move += (alpha[on, i - 1].T @ ahead) * m
                beta[on, i - 1] = ahead @ m.T
            want_emit = counted((alpha * beta)[mask])
            for w, seen, want, s in ((self.emit, seen_emit, want_emit, sums[0]), (self.move, seen_move, want_move, sums[1])):
                g = (seen - want) / n - PENALTY * w
                s += g * g
                w += RATE * g / np.sqrt(s)
        return self

    def decode(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """Best labels of each sequence (Viterbi), sequences of like length together."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(sequences)
        order = sorted(range(len(sequences)), key=lambda i: len(sequences[i]))
        m = self.move + self.allowed
        for at in range(0, len(order), 512):
            part = order[at : at + 512]
            x, size = self._padded([sequences[i] for i in part])
            score = self.emit[x[:, 0]].sum(axis=1) + self.begin
            back, ends = np.zeros((x.shape[1], len(part), len(_LABELS)), np.int8), [None] * len(part)
            for i in range(x.shape[1]):
                if i:
                    step = score[:, :, None] + m
                    back[i] = step.argmax(axis=1)
                    score = step.max(axis=1) + self.emit[x[:, i]].sum(axis=1)
                for j in np.flatnonzero(size == i + 1).tolist():
                    ends[j] = int(score[j].argmax())
            for j, i in enumerate(part):
                label, path = ends[j], []
                for k in range(int(size[j]) - 1, -1, -1):
                    path.append(label)
                    label = int(back[k, j, label])
                out[i] = np.array(path[::-1])
        return out


def _labels(starts: np.ndarray, ends: np.ndarray, base: list[tuple[int, int, int]]) -> np.ndarray:
    out = np.zeros(len(starts), np.int64)
    for kind, a, b in base:
        inside = np.flatnonzero((starts < b) & (ends > a))
        out[inside] = 2 + 2 * kind
        out[inside[:1]] = 1 + 2 * kind
    return out


def _texts(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, offsets in text_chunks(batch.column(0)):
            raw, base, rows = data.tobytes(), sorted(base_spans(data, offsets), key=lambda s: s[1]), []
            at = np.array([s[1] for s in base])
            for _, starts, ends in segments(data, offsets):
                if len(starts) <= 32:
                    mine = base[np.searchsorted(at, starts[0]) : np.searchsorted(at, ends[-1])] if base else []
                    rows.append((_texts(raw, starts, ends), _labels(starts, ends, mine).tolist()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.list_(pa.string())), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], ["words", "labels"]
            )


def labelled_table(docs: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """(words, labels): a small table to train on, at most `rows` segments of the documents, labelled by the patterns.

    Segments over 32 words are not taken. Equal segments count once; the choice is by hash and the same on every run.
    """
    found = docs.select(F.col("text").cast("string")).mapInArrow(_labelled, "words array<string>, labels array<long>")
    key = F.xxhash64("words")
    return found.dropDuplicates(["words"]).orderBy(key, F.col("words")).limit(rows)


def _variants(words: list[str], labels: list[int]) -> Iterator[tuple[list[str], list[int]]]:
    """The segment itself, and ways to write its data that the patterns don't know."""
    yield words, labels
    if any(x >= 7 for x in labels):  # telephone numbers without their country code, or with points
        first = labels.index(7)
        cut = [first] if labels[first + 1 : first + 2] == [8] else []
        if cut:
            rest = [(w, x) for i, (w, x) in enumerate(zip(words, labels, strict=True)) if i not in cut]
            at = next(i for i, (_, x) in enumerate(rest) if x == 8)
            rest[at] = (rest[at][0], 7)
            yield [w for w, _ in rest], [x for _, x in rest]
            yield [w.strip("()") for w, _ in rest], [x for _, x in rest]
            number = ".".join(w.strip("()").replace("-", ".") for w, x in rest if x in (7, 8))
            i, j = at, sum(x in (7, 8) for _, x in rest)
            yield [w for w, _ in rest[:i]] + [number] + [w for w, _ in rest[i + j :]], [x for _, x in rest[:i]] + [7] + [x for _, x in rest[i + j :]]
    for i, (w, x) in enumerate(zip(words, labels, strict=True)):
        if x == 5 and labels[i + 1 : i + 2] != [6] and len(digits := re.sub(r"\D", "", w)) == 16:  # cards in groups
            for mark in ("/", "."):
                yield [*words[:i], mark.join(digits[k : k + 4] for k in range(0, 16, 4)), *words[i + 1 :]], labels
        if x == 1 and "@" in w:  # addresses with the at sign in brackets
            for mark in ("[at]", "(at)"):
                yield [*words[:i], w.replace("@", mark), *words[i + 1 :]], labels
            spelled = w.replace("@", " at ").replace(".", " dot ").split()
            yield [*words[:i], *spelled, *words[i + 1 :]], [*labels[:i], 1, *[2] * (len(spelled) - 1), *labels[i + 1 :]]


def train(table: DataFrame, rows: int = SAMPLE) -> Field:
    """The field, trained on at most `rows` segments; the sample is small and is brought to the driver."""
    sample = [(list(r["words"]), list(r["labels"])) for r in table.limit(rows).collect()]
    each = [v for r in sorted(sample) for v in _variants(*r)]
    return Field().fit([_features(w) for w, _ in each], [np.array(x) for _, x in each])


def _plausible(kind: int, text: bytes) -> bool:
    digits = sum(48 <= b < 58 for b in text)
    return (digits >= 4, digits >= 4, 13 <= digits <= 19, 7 <= digits <= 15)[kind] if kind else b"@" in text or b"at" in text.lower()


def _added(data: np.ndarray, offsets: np.ndarray, field: Field, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    raw = data.tobytes()
    found = list(segments(data, offsets))
    paths = field.decode([_features(_texts(raw, s, e)) for _, s, e in found])
    taken = sorted((a, b) for _, a, b in base)
    begins = np.array([a for a, _ in taken])
    out = []
    for (_, starts, ends), path in zip(found, paths, strict=True):
        i = 0
        while i < len(path):
            j = i + 1
            if path[i]:
                kind = (int(path[i]) - 1) // 2
                while j < len(path) and path[j] == 2 + 2 * kind:
                    j += 1
                a, b = int(starts[i]), int(ends[j - 1])
                lead, _ = _core(raw[starts[i] : ends[i]])
                _, tail = _core(raw[starts[j - 1] : ends[j - 1]])
                a, b = a + lead, int(starts[j - 1]) + tail
                k = int(np.searchsorted(begins, b)) if len(begins) else 0
                if b > a and not (k and taken[k - 1][1] > a) and _plausible(kind, raw[a:b]):
                    out.append((kind, a, b))
            i = j
    return out


_NONE = hashlib.sha256(b"").hexdigest()
_COLUMNS = ("n_email", "n_ip", "n_card", "n_phone")
_FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _found(batches: Iterator[pa.RecordBatch], emit: np.ndarray, move: np.ndarray) -> Iterator[pa.RecordBatch]:
    field = Field(emit, move)
    for batch in batches:
        for row, end, data, offsets in text_chunks(batch.column(1)):
            base = base_spans(data, offsets)
            more = _added(data, offsets, field, base)
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)]) if base or more else None
            by_text: dict[int, tuple[list, list]] = defaultdict(lambda: ([], []))
            for which, found in enumerate((base, more)):
                for kind, a, b in found:
                    text = int(np.searchsorted(offsets, a, "right")) - 1
                    first = points[offsets[text]]
                    by_text[text][which].append((int(points[a] - first), kind, int(points[b] - first)))
            counts = np.zeros((4, end - row), np.int64)
            digests, all_spans = [_NONE] * (end - row), [""] * (end - row)
            written = lambda s: ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in sorted(s))
            for text, (own, added) in by_text.items():
                for _, kind, _ in own:
                    counts[kind, text] += 1
                digests[text] = hashlib.sha256(written(own).encode()).hexdigest()
                all_spans[text] = written(own + added)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[row:end], *[pa.array(c) for c in counts], pa.array(digests), pa.array(all_spans)],
                ["doc_id", *_COLUMNS, "base_sha256", "spans"],
            )


def personal_data(docs: DataFrame, table: DataFrame | None = None, rows: int = SAMPLE) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of docs (doc_id, text).

    The counts and the digest are of the fixed patterns' spans; `spans` also has those that the field adds, which
    overlap none of them. Offsets are code points, the end exclusive. table: rows (words, labels) to train on, by
    default :func:`labelled_table` of the documents. Null and empty texts have none; null ids and repeated rows keep a
    row each; other columns are ignored. With nothing to train on, the field adds nothing.

    The field's sequences are the runs of words within CONTEXT words of a cue: a digit, an at sign, `[at]` or `(at)`, or
    the words `at` and `dot` near each other. All that it is trained to label holds one, so no span is lost by that.
    """
    docs = with_package(docs)
    field = train(labelled_table(docs, rows) if table is None else table, rows)
    emit, move = field.emit, field.move
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(lambda batches: _found(batches, emit, move), _FOUND)
