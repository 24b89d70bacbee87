"""Periodic runs of words: lag scans for short periods, multi-scale minimizers for the others.

A run is a stretch of words that repeats with a period, at least LEAST words and EXPONENT periods long. At scale m (a
power of two) sequences of m words are hashed, and the least hash of every m/2 neighbours is kept: a minimizer. Inside a
run of period q, m/2 < q <= m, the windows a period apart hold the same sequences, so a minimizer comes back q words
later and not before. Neighbouring equal minimizers at such a distance are seeds; comparing words extends them both ways.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge.llm.common import with_package
from sitegauge.llm.wordarrays import mix64, span_hashes, text_chunks, tidy, words

LEAST = 6
EXPONENT = 4
#: Periods up to this one are looked for by comparing every word with the one so many places on.
SHORT = 4

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_NONE = np.zeros(0, np.int64)


def _stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], equal, [False]]).astype(np.int8)))
    return edges[::2], edges[1::2]


def _same_until(word: np.ndarray, i: int, j: int, end: int, step: int) -> int:
    """How many words from i and j on (step 1), or back from them (step -1), are the same, the later ones before `end`."""
    done, size = 0, 64
    total = (end - j) if step > 0 else (i - end + 1)
    while done < total:
        n = min(size, total - done)
        if step > 0:
            differs = word[i + done : i + done + n] != word[j + done : j + done + n]
        else:
            differs = (word[i - done - n + 1 : i - done + 1] != word[j - done - n + 1 : j - done + 1])[::-1]
        if differs.any():
            return done + int(differs.argmax())
        done, size = done + n, size * 2
    return done


def _sliding(values: np.ndarray, width: int, take) -> np.ndarray:
    """take (minimum or maximum) over values[i : i + width], for a width that is a power of two."""
    reach = 1
    while reach < width:
        values = take(values[:-reach], values[reach:]) if len(values) > reach else values[:0]
        reach *= 2
    return values


def _seeds(gram: np.ndarray, text: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, distances) of neighbouring equal minimizers, more than m / 2 and at most m words apart."""
    half = m // 2
    least = _sliding(gram, half, np.minimum)
    if not len(least):
        return _NONE, _NONE
    # Windows across two texts are left out; a gram is a minimizer if it is the least of some window that holds it.
    last = np.arange(len(least)) + half + m - 2
    whole = last < len(text)
    whole[whole] = text[np.flatnonzero(whole)] == text[last[whole]]
    least = np.where(whole, least, np.uint64(0))
    pad = np.zeros(half - 1, np.uint64)
    most = _sliding(np.concatenate([pad, least, pad]), half, np.maximum)
    at = np.flatnonzero(most == gram[: len(most)])
    at = at[np.lexsort((at, gram[at]))]
    near = (gram[at[1:]] == gram[at[:-1]]) & (text[at[1:]] == text[at[:-1]])
    gap = at[1:] - at[:-1]
    near &= (gap > half) & (gap <= m)
    return at[:-1][near], gap[near]


def runs_of(word: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, periods) of all runs, by start and then period; word: hashes; first: each text's first word, total last."""
    sizes = np.diff(first)
    text = np.repeat(np.arange(len(sizes)), sizes)
    found: dict[tuple[int, int], int] = {}

    def add(start: int, end: int, period: int) -> None:
        # The smallest period of a run divides every other one, and has the same ends.
        found[start, end] = min(period, found.get((start, end), period))

    for q in range(1, SHORT + 1):
        if len(word) > q:
            a, b = _stretches((word[:-q] == word[q:]) & (text[:-q] == text[q:]))
            long = b - a >= max(LEAST, EXPONENT * q) - q
            for s, e in zip(a[long].tolist(), b[long].tolist(), strict=True):
                add(s, e + q, q)
    # Hashes of m words, for the texts that are long enough for a period above m / 2; `place` leads back to `word`.
    place, gram, m = np.arange(len(word)), word, 1
    while True:
        m *= 2
        keep = sizes[text[place]] >= EXPONENT * (m // 2 + 1) if m > SHORT else np.ones(len(place), bool)
        if not keep.all():
            place, gram = place[keep], gram[keep]
        if len(place) < m:
            break
        text_here = text[place]
        longer = np.full(len(gram), np.uint64(2**64 - 1))
        here = np.arange(len(gram) - m + 1)
        here = here[text_here[here] == text_here[here + m - 1]]
        longer[here] = mix64(gram[here] * np.uint64(0x9E3779B97F4A7C15) + gram[here + m // 2])
        gram = longer
        if m <= SHORT:
            continue
        at, gaps = _seeds(gram, text_here, m)
        behind: dict[int, int] = {}
        order = np.argsort(at, kind="stable")
        for a, q in zip(place[at[order]].tolist(), gaps[order].tolist(), strict=True):
            if a < behind.get(q, 0):
                continue
            t = text[a]
            end = a + q + _same_until(word, a, a + q, int(first[t + 1]), 1)
            start = a - _same_until(word, a - 1, a + q - 1, int(first[t]), -1)
            behind[q] = end - q + 1
            if end - start >= max(LEAST, EXPONENT * q):
                add(start, end, q)
    keys = sorted((s, q, e) for (s, e), q in found.items())
    out = np.array(keys, np.int64).reshape(-1, 3)
    return out[:, 0], out[:, 2], out[:, 1]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, end_row, data, offsets in text_chunks(batch.column(1)):
            starts, ends, first = words(data, offsets)
            s, e, q = runs_of(span_hashes(data, starts, ends), first)
            text = np.searchsorted(first, s, "right") - 1
            gone = np.zeros(len(starts) + 1, np.int64)
            np.add.at(gone, s + q, 1)
            np.add.at(gone, e, -1)
            gone = np.cumsum(gone)[:-1] > 0
            raw = data.tobytes()
            collapsed, lists = [], []
            by_text = np.searchsorted(text, np.arange(end_row - row + 1))
            for i in range(end_row - row):
                each = raw[offsets[i] : offsets[i + 1]].split()
                a, b = by_text[i], by_text[i + 1]
                if b > a:
                    each = [w for w, dropped in zip(each, gone[first[i] : first[i + 1]].tolist(), strict=True) if not dropped]
                collapsed.append(b" ".join(each))
                lists.append([
                    {"start": x - int(first[i]), "length": y - x, "period": z}
                    for x, y, z in zip(s[a:b].tolist(), e[a:b].tolist(), q[a:b].tolist(), strict=True)
                ])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0)[row:end_row], pa.array(np.diff(first).astype(np.int64)), pa.array(lists, pa.list_(_RUN)),
                    pa.array(collapsed, pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "n_words", "runs", "collapsed"],
            )


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of each row of docs (doc_id, text); other columns are ignored.

    `runs`: array of (start, length, period), in words from 0, by start and then period; the period is the smallest one,
    the length at least max(LEAST, EXPONENT * period), and no neighbouring word goes on with the period. `collapsed`: the
    words, joined by one space, without those that a run holds after its first period. Null and empty texts have no
    words, no runs and an empty `collapsed`. Rows stand for themselves: ties and repeated rows give repeated results.
    Words are compared by 64-bit hashes. There is no shuffle; a text is worked on whole, about 100 bytes a word.
    """
    rows = with_package(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return rows.mapInArrow(lambda batches: tidy(_runs(batches)), schema)


def _planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            h = crc32(str(doc_id).encode())
            each = text.encode().split() if text and doc_id is not None and h % 10 == 0 else []
            if each:
                n, g = len(each), h // 10
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                each = each[:a] + (each[a : a + p] * (-(-(n - a) // p)))[: n - a]
                text = b" ".join(each).decode()
            texts.append(text)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the documents, told by the checksum of the doc_id, get a tail that repeats its beginning.

    With h = crc32(decimal doc_id) and g = h div 10: where h mod 10 = 0, words from a = g mod n on are those of the first
    1 + (n - a) div (3 + g mod 8) words there, over and over. Null ids and texts without words stay as they are.
    """
    rows = with_package(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: tidy(_planted(batches)), "doc_id long, text string")


def run_report(docs: DataFrame) -> DataFrame:
    """One row a document: n_runs, the longest run (ties: smallest start, then period), and checksums of runs and text."""
    found = periodic_runs(docs)
    order = F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))
    best = F.array_min(order)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "runs", "collapsed", best.alias("best"), lines.alias("lines")
    ).select(
        "doc_id", "n_runs", F.col("best.start").alias("start"), (-F.col("best.less")).alias("length"), F.col("best.period").alias("period"),
        F.floor(F.lit(-1000) * F.col("best.less") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.concat(F.array_join("lines", "\n"), F.when(F.size("lines") > 0, "\n").otherwise("")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
