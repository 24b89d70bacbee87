"""Repeated passages by unit hashing: sentences and lines are normalised and hashed, the earliest occurrence is kept."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sitegauge.llm.common import reliable, with_package
from sitegauge.llm.wordarrays import LOWER, SPACE, mix64, span_hashes, spans, text_chunks, tidy

#: A run of repeated units is removed if one of them has so many words; shorter ones repeat by chance.
ANCHOR_WORDS = 8
#: A run is removed as well if its units have so many words together. A passage of 50 words in units of fewer than
#: ANCHOR_WORDS has at least so many in whole units: its first and last unit may stand in longer ones of the document.
RUN_WORDS = 50 - 2 * (ANCHOR_WORDS - 1)

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True


def units_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, number within the text, start byte, end byte, words, digest a, digest b) of every unit with a word.

    A unit ends with its line, or after `.`, `!` or `?` before white space or the end. Its digests are of its words,
    A-Z lower-cased and without punctuation, so white space, case and punctuation don't tell units apart.
    """
    starts, ends = spans(_WORD[data], offsets)
    if not len(starts):
        return tuple(np.zeros(0, np.uint64 if i > 4 else np.int64) for i in range(7))
    after = np.ones(len(data), bool)
    after[:-1] = SPACE[data[1:]]
    stops = np.flatnonzero((data == 10) | (_STOP[data] & after))
    text_of = np.searchsorted(offsets, starts, "right") - 1
    unit = np.searchsorted(stops, starts)
    first = np.flatnonzero(np.concatenate([[True], (text_of[1:] != text_of[:-1]) | (unit[1:] != unit[:-1])]))
    size = np.diff(np.concatenate([first, [len(starts)]]))
    place = np.arange(len(starts)) - np.repeat(first, size)
    word = span_hashes(LOWER[data], starts, ends)
    digests = []
    for salt in (0x1F3D5B79, 0x2468ACE1):
        # Each word is mixed with its place, so order counts.
        each = mix64(word ^ mix64(place.astype(np.uint64) * np.uint64(2) + np.uint64(salt)))
        digests.append(mix64(np.add.reduceat(each, first) + size.astype(np.uint64)))
    text = text_of[first]
    stop = np.concatenate([stops, [len(data)]])[unit[first]]
    end = np.minimum(np.where(stop < len(data), stop + (_STOP[data[np.minimum(stop, len(data) - 1)]]), stop), offsets[text + 1])
    number = np.arange(len(first)) - np.searchsorted(text, text)
    return text, number, starts[first], np.maximum(end, ends[first + size - 1]), size, *digests


_UNIT = "doc_id long, unit int, start int, end int, n_words int, a long, b long"


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, end_row, data, offsets in text_chunks(batch.column(1)):
            text, number, start, end, n, a, b = units_of(data, offsets)
            # Code points, counted from the start of the text.
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            base = points[offsets[text]]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0)[row:end_row].take(pa.array(text)),
                    *[pa.array(c.astype(np.int32)) for c in (number, points[start] - base, points[end] - base, n)],
                    pa.array(a.view(np.int64)), pa.array(b.view(np.int64)),
                ],
                ["doc_id", "unit", "start", "end", "n_words", "a", "b"],
            )


def repeated_spans(docs: DataFrame, anchor_words: int = ANCHOR_WORDS) -> DataFrame:
    """(doc_id, start, end, n_units, n_words, first_doc_id): the runs of units to remove, one row each.

    docs: doc_id, text; other columns are ignored. A unit is repeated if the same unit stands earlier, by doc_id
    (null first) and then by place; neighbouring repeated units form a run, and a run goes if one of its units has
    `anchor_words` words or all together have RUN_WORDS. Offsets are in code points of the original text, the end exclusive. `first_doc_id` is the
    document that keeps the longest unit of the run. Null and empty texts have no units; rows of one id are one
    document, so a row that stands twice is not a repetition of itself.

    Digests (128 bits) are counted and ranked by partial aggregation; those that occur once go no further. The join
    back meets a frequent unit on one side only, where Spark can split it; a run is found within its document.
    """
    rows = with_package(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    units = rows.mapInArrow(lambda batches: tidy(_units(batches)), _UNIT)
    at = F.struct("doc_id", "unit")
    first = units.groupBy("a", "b").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first < last")
    # Stored: joined straight to its aggregation, a frequent unit would stay whole in one task.
    first = reliable(first.select("a", "b", "first"))
    later = units.join(first, ["a", "b"]).where(
        ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("unit") == F.col("first.unit")))
    ).select("doc_id", "unit", "start", "end", "n_words", F.col("first.doc_id").alias("first_doc_id"))
    later = reliable(later)
    # A document with too few words for either has no run to remove.
    of_doc = later.groupBy("doc_id").agg(F.max("n_words").alias("longest"), F.sum("n_words").alias("n_words"))
    anchored = of_doc.where((F.col("longest") >= anchor_words) | (F.col("n_words") >= RUN_WORDS)).select("doc_id")
    mine = later.alias("l").join(anchored.alias("r"), F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")), "left_semi").distinct()
    # Consecutive numbers less their rank are equal. Rows of one id may hold other texts: ranks are dense.
    rank = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("unit"))
    runs = mine.withColumn("run", F.col("unit") - rank).groupBy("doc_id", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_units"), F.sum("n_words").alias("n_words"),
        F.max("n_words").alias("longest"), F.max_by("first_doc_id", "n_words").alias("first_doc_id"),
    )
    return runs.where((F.col("longest") >= anchor_words) | (F.col("n_words") >= RUN_WORDS)).select("doc_id", "start", "end", "n_units", "n_words", "first_doc_id")


@F.arrow_udf(T.StringType())
def _without(text: pa.Array, cuts: pa.Array) -> pa.Array:
    out = []
    for t, spans_ in zip(text.to_pylist(), cuts.to_pylist(), strict=True):
        if t is not None:
            for s in sorted(spans_ or [], key=lambda s: -s["start"]):
                t = t[: s["start"]] + t[s["end"] :]
        out.append(t)
    return pa.array(out, pa.string())


def without_repeats(docs: DataFrame, anchor_words: int = ANCHOR_WORDS) -> DataFrame:
    """`docs` with the runs cut out of their texts, and `removed`: their offsets in the original text, in order."""
    gone = repeated_spans(docs, anchor_words).groupBy(F.col("doc_id").alias("_id")).agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_cuts")
    )
    joined = docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["_id"]), "left")
    columns = [_without(F.col("text").cast("string"), "_cuts").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c != "removed"]
    return joined.select(*columns, F.coalesce("_cuts", F.array()).alias("removed"))
