"""Benchmark decontamination by templates: numbers, units and names become typed slots before windows are compared.

A copied question is found even if its numbers and names were exchanged: the windows of its template are the same, and
the slots are filled consistently (one value of the question always stands for one value of the document).

Windows come in two forms. In the second, case is ignored and names are words like others, so a copy in another case is
found; where few plain words are left besides numbers and units, their values are part of the window.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge.llm.common import bounded, reliable, with_package
from sitegauge.llm.wordarrays import LOWER, sequence_hashes, span_hashes, spans, text_chunks, tidy

#: Template tokens in a window. A question of fewer tokens is one window of its own length.
WINDOW = 8
#: A question of fewer template tokens can't be told from ordinary prose and is compared with nothing.
LEAST_TOKENS = 5
#: Except that one with a number is compared from so many tokens on, by its values.
LEAST_WITH_NUMBER = 3
#: A window of the second form with fewer plain words than this is compared by its values.
PLAIN_WORDS = 4
#: Share of a question's template tokens that matching windows must cover.
COVERAGE = 0.6
#: Or so many of its tokens, covered in one alignment: a long part of a longer question.
LONG_RUN = 50
#: Share of an alignment's slot fillings that may contradict its usual substitution.
CONFLICTS = 0.2
#: Bits of the filter of window hashes that goes to every task: 8 MB, whatever the size of the benchmark.
FILTER_BITS = 26

# Words that make the token after a number a unit.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg gram grams kilogram kilograms lb lbs "
    "pound pounds oz ounce ounces ml l liter liters litre litres s sec second seconds min minute minutes h hr hour hours "
    "day days week weeks month months year years percent dollar dollars cent cents euro euros k c f v w kw hz mph kmh"
).split()

_DIGIT, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_DIGIT[48:58] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_POINT = np.zeros(256, bool)
_POINT[list(b".,")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_NUMBER, _UNIT, _NAME = (np.uint64(x) for x in (0xA5A5_0001, 0xA5A5_0002, 0xA5A5_0003))
_CASELESS, _VALUED = np.uint64(0x5C5C_0001_9E37), np.uint64(0x5C5C_0002_79B9)


def _unit_hashes() -> np.ndarray:
    data = np.frombuffer("".join(UNITS).encode(), np.uint8)
    ends = np.cumsum([len(u) for u in UNITS])
    return np.sort(span_hashes(data, np.concatenate([[0], ends[:-1]]), ends))


_UNIT_HASHES = _unit_hashes()


def folded(data: np.ndarray) -> np.ndarray:
    """`data` with A-Z and À-Þ in lower case."""
    out = LOWER[data]
    at = np.flatnonzero(data[:-1] == 0xC3) + 1
    at = at[(data[at] >= 0x80) & (data[at] <= 0x9E) & (data[at] != 0x97)]
    out[at] = data[at] + 32
    return out


def template(data: np.ndarray, offsets: np.ndarray, names: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token hash, is slot, start, end, index of each text's first token with the total last).

    names: whether names are slots; if not, they are words, whatever their case.
    """
    digit = _DIGIT[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = digit[:-1], digit[1:]
    starts, ends = spans(_LETTER[data] | digit | (_POINT[data] & before & after), offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, bool), starts, ends, np.zeros(len(offsets), np.int64)
    text_of = np.searchsorted(offsets, starts, "right")
    token = span_hashes(LOWER[data] if names else folded(data), starts, ends)
    lead, second = data[starts], data[np.minimum(starts + 1, len(data) - 1)]
    number = _DIGIT[lead]
    name = _UPPER[lead] | ((lead == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97))
    follows = np.concatenate([[False], text_of[1:] == text_of[:-1]])
    unit = follows & np.concatenate([[False], number[:-1]]) & np.isin(token, _UNIT_HASHES)
    name &= ~unit & names
    token = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, token)))
    # A run of names is one slot.
    kept = np.flatnonzero(~(name & follows & np.concatenate([[False], name[:-1]])))
    last = np.concatenate([kept[1:], [len(token)]]) - 1
    starts = starts[kept]
    return token[kept], (number | unit | name)[kept], starts, ends[last], np.searchsorted(starts, offsets)


def _windows(batch: pa.RecordBatch, widths: list[int], wanted: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Windows of every text in both forms: (id, hash, form, position, width, tokens of the text, slot values).

    wanted: a bit filter; windows that it doesn't hold are left out. Without it, every text gives all its windows of
    WINDOW tokens, or if it has fewer, one.
    """
    for (row, end, data, offsets), form in product(text_chunks(batch.column(1)), (0, 1)):
        token, slot, starts, ends, first = template(data, offsets, form == 0)
        text_of = np.repeat(np.arange(end - row), np.diff(first))
        slots = np.concatenate([[0], np.cumsum(slot)])
        read = folded(data) if form else data
        valued = span_hashes(read, starts, ends) if form and len(starts) else token
        for width in widths:
            hashes = sequence_hashes(token, width)
            n = len(hashes)
            ok = text_of[width - 1 :] == text_of[:n] if n else np.zeros(0, bool)
            filled = slots[width:] - slots[:-width] if n else np.zeros(0, np.int64)
            if form:
                hashes = np.where(width - filled < PLAIN_WORDS, sequence_hashes(valued, width) ^ _VALUED, hashes ^ _CASELESS)
                ok &= (width >= LEAST_TOKENS) | (filled > 0)
            else:
                ok &= (2 * filled <= width) & (width >= LEAST_TOKENS)
            if wanted is None:
                sizes = np.diff(first)[text_of[:n]] if n else np.zeros(0, np.int64)
                ok &= sizes >= width if width == WINDOW else sizes == width
            else:
                bit = hashes & np.uint64((1 << FILTER_BITS) - 1)
                ok &= (wanted[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) > 0
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            values = [
                [read[starts[i] : ends[i]].tobytes().decode("utf-8", "replace") for i in range(a, a + width) if slot[i]] for a in at.tolist()
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0)[row:end].take(pa.array(text_of[at])),
                    pa.array(hashes[at].view(np.int64)),
                    pa.array(np.full(len(at), form, np.int32)),
                    pa.array((at - first[:-1][text_of[at]]).astype(np.int32)),
                    pa.array(np.full(len(at), width, np.int32)),
                    pa.array(np.diff(first)[text_of[at]].astype(np.int32)),
                    pa.array(values, pa.list_(pa.string())),
                ],
                ["id", "window", "form", "at", "width", "size", "slots"],
            )


_SCHEMA = "id long, window long, form int, at int, width int, size int, slots array<string>"


def _bit_filter(windows: DataFrame) -> np.ndarray:
    """Fixed-size bit filter of the window hashes, as 64-bit words; at most 2 ** 20 rows reach the driver."""
    bit = F.col("window").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    word = windows.groupBy(F.shiftright(bit, 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))).alias("bits")
    ).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[word["word"].to_numpy()] = word["bits"].to_numpy().view(np.uint64)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, coverage, verbatim): the documents that hold a question, one row for each pair.

    docs (doc_id, text), benchmark (item_id, text); other columns are ignored. `coverage` is the share of the
    question's template tokens under consistent matching windows, in the form where it is greater, at least COVERAGE
    unless LONG_RUN tokens are covered in one alignment; `verbatim` says that no slot was filled differently there, case
    aside. Null and empty texts hold nothing; null ids are ids like others; repeated rows count once. An
    empty benchmark finds nothing.
    """
    spark = docs.sparkSession
    items = with_package(benchmark).select(F.col("item_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    short = list(range(LEAST_WITH_NUMBER, WINDOW + 1))
    of_items = reliable(items.mapInArrow(lambda batches: (x for b in batches for x in _windows(b, short, None)), _SCHEMA))
    widths = sorted({WINDOW, *[r[0] for r in of_items.select("width").distinct().collect()]})
    sent = spark.sparkContext.broadcast(_bit_filter(of_items))
    found = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(
        lambda batches: tidy(x for b in batches for x in _windows(b, widths, sent.value)), _SCHEMA
    )
    of_items = of_items.select(
        F.col("id").alias("item_id"), "window", "form", "width", F.col("at").alias("item_at"), F.col("size").alias("item_size"), F.col("slots").alias("asked")
    ).distinct()
    # A hot passage is many rows of one window on the documents' side only; Spark splits such a join.
    matches = reliable(
        found.join(of_items, ["window", "form", "width"]).select(
            F.col("id").alias("doc_id"), "item_id", "form", "item_at", "item_size", "width", (F.col("at") - F.col("item_at")).alias("shift"),
            F.arrays_zip(F.col("asked").alias("asked"), F.col("slots").alias("given")).alias("slots"),
        ).distinct()
    )
    # What it was needed for is stored; executors need not hold it for the rest of the session.
    sent.destroy()
    keys = ["doc_id", "item_id", "form", "shift"]
    filled = matches.select(*keys, F.explode("slots").alias("slot")).groupBy(*keys, "slot.asked", "slot.given").count()
    by_value = filled.groupBy(*keys, "asked").agg(F.sum("count").alias("n"), F.max("count").alias("usual"))
    by_given = filled.groupBy(*keys, "given").agg(F.sum("count").alias("n"), F.max("count").alias("usual"))
    wrong = by_value.select(*keys, "n", "usual").unionByName(by_given.select(*keys, "n", "usual")).groupBy(*keys).agg(
        (F.sum(F.col("n") - F.col("usual")) > CONFLICTS * F.sum("n")).alias("odd")
    ).where("odd")
    same = filled.groupBy(*keys).agg(F.min((F.col("asked") == F.col("given")).cast("int")).alias("same"))
    null_safe = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
    held = matches.join(wrong, null_safe(matches, wrong), "left_anti")
    held = held.join(same.select(*[F.col(k).alias(f"_{k}") for k in keys], "same"), [held[k].eqNullSafe(F.col(f"_{k}")) for k in keys], "left")
    tokens = F.explode(F.sequence(F.col("item_at"), F.col("item_at") + F.col("width") - 1))
    covered = held.select("doc_id", "item_id", "form", "shift", "item_size", F.coalesce("same", F.lit(1)).alias("same"), tokens.alias("t"))
    in_one = covered.groupBy("doc_id", "item_id", "form", "shift").agg(
        F.collect_set("t").alias("t"), F.max("item_size").alias("item_size"), F.min("same").alias("same")
    )
    every = F.array_distinct(F.flatten(F.collect_list("t")))
    by_form = in_one.groupBy("doc_id", "item_id", "form").agg(
        (F.size(every) / F.max("item_size")).alias("coverage"), F.max(F.size("t")).alias("run"), (F.min("same") == 1).alias("verbatim")
    )
    best = by_form.groupBy("doc_id", "item_id").agg(F.max(F.struct("coverage", "verbatim")).alias("best"), F.max("run").alias("run"))
    best = best.where((F.col("best.coverage") >= COVERAGE) | (F.col("run") >= LONG_RUN))
    return best.select("doc_id", "item_id", "best.coverage", "best.verbatim")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that hold no question of the benchmark, with all their columns.

    Rows whose doc_id is null go together: all, if one of them holds a question.
    """
    bad = bounded(reliable(contaminated(docs, benchmark).select(F.col("doc_id").alias("_bad")).distinct()))
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["_bad"]), "left_anti")
