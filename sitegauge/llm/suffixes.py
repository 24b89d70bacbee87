"""Repeated byte strings by a difference-cover suffix order over phrases, with an exact check of bytes at its borders.

A suffix order of single bytes would move some 16 bytes for each of two thirds of all positions. So the bytes are cut
into phrases first: every string of `length` bytes names an anchor, the place of the least hashed gram among its first
REACH, and a phrase goes from one anchor to the next, 64 bytes on average. Equal strings have their anchors at the same
place, so anchors whose next length - REACH bytes stand nowhere else are in no repetition and are left out.

Over the phrases left, the order is that of the difference cover modulo 3: triples at two of three places are sorted and
named by rank, triples of names again (nine phrases), and the places in between are merged with either class of the
sample by the keys (phrase, rank of the next) and (phrase, phrase, rank of the one after). Neighbours in the order
share the longest prefixes; strings within a prefix of `length` bytes or more are repeated. Where a repetition begins or
ends inside a phrase, strings with the same anchor are compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitegauge.llm.common import reliable, semi_join, stored, with_package
from sitegauge.llm.wordarrays import mix64, spans, text_chunks, tidy
from sitegauge.operators.ranking import global_row_number

LENGTH = 200
#: Places of a string among which its anchor is chosen, a power of two, and the bytes hashed for each.
REACH, GRAM = 128, 8
#: Phrases from a place on that are compared with those of its neighbours; a name of the second round stands for nine.
DEPTH = 6
#: Different surroundings of one anchor that are compared in one task; more of them are spread window by window.
GROUP = 20_000

_LOW = np.uint64(2**32 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD92)


def grams_of(data: np.ndarray) -> np.ndarray:
    """The GRAM bytes from every place on as one number; behind the end are zeros."""
    padded = np.concatenate([data, np.zeros(2 * GRAM, np.uint8)])
    out = np.empty(-(-len(data) // GRAM) * GRAM, np.uint64)
    for o in range(GRAM):
        out[o::GRAM] = np.frombuffer(padded, "<u8", len(out) // GRAM, o)
    return out[: len(data)]


def units_of(gram: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(text, anchor, first string, number of strings) of every anchor; strings that share one are neighbours."""
    n = len(gram)
    sizes = np.maximum(np.diff(offsets) - length + 1, 0)
    if not sizes.any():
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    # The leftmost of equal grams: the place stands in the lower half.
    key = ((gram * _MIX) & ~_LOW) | np.arange(n, dtype=np.uint64)
    reach = 1
    while reach < REACH:
        key = np.minimum(key[:-reach], key[reach:])
        reach *= 2
    some = np.flatnonzero(sizes)
    starts = np.repeat(offsets[some] - np.cumsum(sizes[some]) + sizes[some], sizes[some]) + np.arange(int(sizes.sum()))
    anchor = (key[starts] & _LOW).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(starts)))
    low = starts[first]
    return np.searchsorted(offsets, low, "right") - 1, anchor[first], low, count


def stretch_hashes(gram: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each (non-empty) stretch, GRAM at a time; the last piece overlaps the one before."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    pieces = -(-sizes // GRAM)
    first = np.cumsum(pieces) - pieces
    nth = np.arange(int(pieces.sum())) - np.repeat(first, pieces)
    at = np.repeat(starts, pieces) + np.minimum(nth * GRAM, np.repeat(np.maximum(sizes - GRAM, 0), pieces))
    value = gram[at]
    short = sizes < GRAM
    if short.any():
        value[first[short]] &= (np.uint64(1) << (sizes[short] * 8).astype(np.uint64)) - np.uint64(1)
    # An odd factor for each place; the products are mixed before they are added up.
    value *= nth.astype(np.uint64) * _STEP + _MIX
    value ^= value >> np.uint64(32)
    value *= _MIX
    return mix64(np.add.reduceat(value, first) ^ (sizes.astype(np.uint64) * _STEP))


def string_hashes(data: np.ndarray, length: int, salt: int) -> np.ndarray:
    """Hash of the `length` bytes from every place on, as many as bytes less length - 1."""
    h = mix64(data.astype(np.uint64) + np.uint64(salt))
    out, done, width = None, 0, 1
    size = length
    while size:
        if size & 1:
            part = h[done : done + len(data) - length + 1]
            out = part.copy() if out is None else mix64(out * _MIX + part)
            done += width
        size >>= 1
        if size:
            h = mix64(h[:-width] * _MIX + h[width:])
            width *= 2
    return out


def phrases_of(gram: np.ndarray, text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, hash) of the phrase from each anchor to the next one of its text; the last has none, of 0 bytes."""
    size, phrase = np.zeros(len(at), np.int64), np.zeros(len(at), np.uint64)
    if len(at):
        size[:-1] = np.where(text[1:] == text[:-1], at[1:] - at[:-1], 0)
        phrase[size > 0] = stretch_hashes(gram, at[size > 0], size[size > 0])
    return size, phrase


def echoes_of(size: np.ndarray, phrase: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, number) of the runs of two and more equal phrases that follow each other: stretches with a period."""
    if not len(size):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.concatenate([[True], (phrase[1:] != phrase[:-1]) | (size[1:] != size[:-1]) | (size[1:] == 0)])
    first = np.flatnonzero(new)
    many = np.diff(np.concatenate([first, [len(size)]]))
    return first[many > 1], many[many > 1]


def _anchors(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Anchors with what follows them. Inside a stretch with a period they stand for nothing that its two ends lack."""
    for batch in batches:
        for row, end_row, data, offsets in text_chunks(batch.column(1)):
            gram = grams_of(data)
            text, at, _, _ = units_of(gram, offsets, length)
            size, phrase = phrases_of(gram, text, at)
            keep = np.ones(len(at), bool)
            for first, many in zip(*echoes_of(size, phrase), strict=True):
                end = (length + REACH) // size[first] + 2
                keep[first + end : max(first + end, first + many - end)] = False
            text, at, size, phrase = text[keep], at[keep], size[keep], phrase[keep]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0)[row:end_row].take(pa.array(text)), pa.array((at - offsets[text]).astype(np.int32)),
                    pa.array(size.astype(np.int32)), pa.array(phrase.view(np.int64), mask=size == 0),
                    pa.array(stretch_hashes(gram, at, np.full(len(at), length - REACH)).view(np.int64)),
                ],
                ["text_id", "at", "size", "phrase", "context"],
            )


def _ranked(keys: DataFrame, columns: list[str]) -> DataFrame:
    """Different rows of `columns` (nulls first), with their global rank as `name`."""
    order = [F.col(c).asc_nulls_first() for c in columns]
    ranked = global_row_number(keys.select(F.lit(0).alias("_all"), *columns).distinct(), ["_all"], order, "name")
    return ranked.drop("_all")


def _named(places: DataFrame, columns: list[str], name: str) -> DataFrame:
    """`places` with the rank of their triple, for the sample."""
    triples = _ranked(places.where("n % 3 <> 0"), columns).withColumnsRenamed({c: f"_{c}" for c in columns})
    same = (F.col("n") % 3 != 0)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return places.join(triples, same, "left").withColumnRenamed("name", name).drop(*[f"_{c}" for c in columns], *columns)


def _shared(a: str, b: str) -> Column:
    """Bytes of the phrases that two sequences begin with in common."""
    each = F.zip_with(a, b, lambda x, y: F.when(x["phrase"] == y["phrase"], x["size"]).otherwise(-1))
    state = lambda n, ok: F.struct(n.alias("n"), ok.alias("ok"))
    start = state(F.lit(0), F.lit(True))
    step = lambda s, v: F.when(s["ok"] & (F.coalesce(v, F.lit(-1)) > 0), state(s["n"] + v, F.lit(True))).otherwise(state(s["n"], F.lit(False)))
    return F.coalesce(F.aggregate(each, start, step, lambda s: s["n"]), F.lit(0))


def _neighbours(places: DataFrame, columns: list[str]) -> DataFrame:
    """(text_id, at, shared, later): bytes that a suffix shares with its neighbours in the order by `columns`.

    Equal suffixes are one row in the order; `later` says that an equal one stands before this one.
    """
    keys = places.groupBy(*columns).agg(F.count("*").alias("many"), F.min(F.struct("text_id", "at")).alias("first"), F.first("seq").alias("seq"))
    order = [F.col(c).asc_nulls_first() for c in columns]
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(keys.repartitionByRange(n, *order).sortWithinPartitions(*order).select(
        "*", F.spark_partition_id().alias("slice"), F.monotonically_increasing_id().alias("place")
    ))
    # One row for each slice: what stands before and behind it.
    ends = ranged.groupBy("slice").agg(F.min_by("seq", "place").alias("head"), F.max_by("seq", "place").alias("tail"))
    over = Window.orderBy("slice")
    ends = ends.select("slice", F.lag("tail").over(over).alias("before"), F.lead("head").over(over).alias("behind"))
    inside = Window.partitionBy("slice").orderBy("place")
    beside = ranged.withColumns({"up": F.lag("seq").over(inside), "down": F.lead("seq").over(inside)}).join(F.broadcast(ends), "slice")
    whole = F.aggregate("seq", F.lit(0), lambda s, v: s + v["size"])
    shared = F.when(F.col("many") > 1, whole).otherwise(
        F.greatest(_shared("seq", F.coalesce("up", "before")), _shared("seq", F.coalesce("down", "behind")))
    )
    found = reliable(beside.select(*[F.col(c).alias(f"_{c}") for c in columns], shared.alias("shared"), "many", "first"))
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    later = (F.col("many") > 1) & (F.struct("text_id", "at") != F.col("first"))
    return places.drop("seq").join(found, same).select("text_id", "at", "shared", later.alias("later"))


def suffix_order(anchors: DataFrame) -> DataFrame:
    """(text_id, at, shared, later) for anchors (text_id, at, size, phrase), from the difference-cover order of phrases.

    Anchors that follow each other (the next `at` is `at` + `size`) form a string. `shared`: bytes of the whole phrases,
    up to DEPTH, that the suffix from there on has in common with another one. A place comes once for each list it is
    in: the sample, and its own class merged with another.
    """
    along = Window.partitionBy("text_id").orderBy("at")
    cut = F.coalesce(F.col("at") != F.lag(F.col("at") + F.col("size")).over(along), F.lit(True))
    strings = anchors.withColumn("_cut", cut.cast("int")).withColumn("run", F.sum("_cut").over(along))
    inside = Window.partitionBy("text_id", "run").orderBy("at")
    places = strings.withColumn("n", F.row_number().over(inside)).select("text_id", "run", "n", "at", "size", "phrase")
    triple = lambda c, by: {"a": F.col(c), "b": F.lead(c, by).over(inside), "c": F.lead(c, 2 * by).over(inside)}
    first = stored(_named(places.withColumns(triple("phrase", 1)), ["a", "b", "c"], "name1"))
    second = stored(_named(first.withColumns(triple("name1", 3)), ["a", "b", "c"], "rank"))
    ahead = F.collect_list(F.struct("phrase", "size")).over(inside.rowsBetween(0, DEPTH - 1))
    ready = second.select(
        "text_id", "n", "at", "phrase", "rank", F.lead("phrase").over(inside).alias("phrase2"), F.lead("rank").over(inside).alias("rank2"),
        F.lead("rank", 2).over(inside).alias("rank3"), F.filter(ahead, lambda p: p["phrase"].isNotNull()).alias("seq"),
    ).where("phrase is not null")
    sample = _neighbours(ready.where("n % 3 <> 0"), ["rank"])
    with_first = _neighbours(ready.where("n % 3 <> 2"), ["phrase", "rank2"])
    with_second = _neighbours(ready.where("n % 3 <> 1"), ["phrase", "phrase2", "rank3"])
    return sample.unionByName(with_first).unionByName(with_second)


def _ranges(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end of the runs of consecutive numbers."""
    if not len(starts):
        return starts, starts
    new = np.flatnonzero(np.concatenate([[True], starts[1:] != starts[:-1] + 1]))
    return starts[new], starts[np.concatenate([new[1:] - 1, [len(starts) - 1]])] + 1


_PIECE = "text_id long, low int, n int, context long, at int, open boolean, content binary"


def _flat(column: pa.Array, row: int, end_row: int) -> tuple[np.ndarray, pa.Array]:
    """(row of each entry, entries) of a list column, for the rows from `row` on; rows without a list have no entries."""
    part = column.slice(row, end_row - row)
    sizes = np.array(pa.compute.list_value_length(part).fill_null(0))
    return np.repeat(np.arange(len(part)), sizes), part.flatten()


def _numbers(entries: pa.Array, name: str) -> np.ndarray:
    return entries.field(name).to_numpy(zero_copy_only=False)


def _add_ranges(counts: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
    np.add.at(counts, starts, 1)
    np.add.at(counts, ends, -1)


def _pieces(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Strings known to be repeated (rows without context), and the surroundings of anchors that are still to be compared."""
    names = [c.split()[0] for c in _PIECE.split(", ")]
    for batch in batches:
        ids, places, found = (batch.column(c) for c in ("text_id", "places", "found"))
        for row, end_row, data, offsets in text_chunks(batch.column("text")):
            gram = grams_of(data)
            text, at, low, count = units_of(gram, offsets, length)
            known, covered = np.zeros(len(data) + 1, np.int64), np.zeros(len(data) + 1, np.int64)
            size, phrase = phrases_of(gram, text, at)
            first, many = echoes_of(size, phrase)
            s, period = at[first], size[first]
            e = s + many * period
            long = e - s >= length + period
            _add_ranges(known, s[long], e[long] - length + 1)
            _add_ranges(covered, s[long] + period[long], e[long] - length + 1)
            of, entries = _flat(found, row, end_row)
            if len(of):
                s = offsets[of] + _numbers(entries, "at")
                e = s + _numbers(entries, "shared") - length + 1
                later = _numbers(entries, "later").astype(bool)
                _add_ranges(known, s, e)
                _add_ranges(covered, s[later], e[later])
            known, covered = np.cumsum(known) > 0, np.cumsum(covered) > 0
            starts, ends = _ranges(np.flatnonzero(known))
            of = np.searchsorted(offsets, starts, "right") - 1
            none = [pa.nulls(len(starts), t) for t in (pa.int64(), pa.int32(), pa.bool_(), pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(row + of)), pa.array((starts - offsets[of]).astype(np.int32)), pa.array((ends - starts).astype(np.int32)), *none], names
            )
            of, entries = _flat(places, row, end_row)
            unit = np.searchsorted(at, offsets[of] + _numbers(entries, "at"))
            context = _numbers(entries, "context")
            upto = np.concatenate([[0], np.cumsum(covered)])
            some = upto[low[unit] + count[unit]] - upto[low[unit]] < count[unit]
            unit, context = unit[some], context[some]
            upto = np.concatenate([[0], np.cumsum(known)])
            s, k, t = low[unit], count[unit], text[unit]
            raw = data.tobytes()
            contents = [raw[a : a + n + length - 1] for a, n in zip(s.tolist(), k.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(row + t)), pa.array((s - offsets[t]).astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(context),
                    pa.array((at[unit] - s).astype(np.int32)), pa.array(upto[s + k] - upto[s] < k), pa.array(contents, pa.binary()),
                ],
                names,
            )


def _windows(contents: list[bytes], length: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of its content) of all strings of the contents."""
    sizes = np.array([len(c) for c in contents])
    hashes = string_hashes(np.frombuffer(b"".join(contents), np.uint8), length, salt)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    n = sizes - length + 1
    which = np.repeat(np.arange(len(sizes)), n)
    place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return hashes[first[which] + place], which


_KEY = "d1 long, d2 long"
_FOUND = f"{_KEY}, starts array<int>, ends array<int>"


def _compared(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Strings that two contents of one context hold at the same place before their anchor; contexts come together."""
    held: list[tuple] = []
    size = 0

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        hashes, which = _windows([r[3] for r in rows], length, 1)
        context = np.array([r[2] for r in rows], np.int64).view(np.uint64)[which]
        _, group, many = np.unique(mix64(hashes * _MIX + context), return_inverse=True, return_counts=True)
        twice = many[group] > 1
        first = np.searchsorted(which, np.arange(len(rows) + 1))
        runs = [_ranges(np.flatnonzero(twice[a:b]).astype(np.int32)) for a, b in zip(first[:-1], first[1:], strict=True)]
        lists = [pa.array([r[i] for r in runs], pa.list_(pa.int32())) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), *lists], ["d1", "d2", "starts", "ends"])

    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in ("d1", "d2", "context", "content")], strict=True):
            if size > 1 << 19 and row[2] != held[-1][2]:
                yield flush(held)
                held, size = [], 0
            held.append(row)
            size += len(row[3])
    if held:
        yield flush(held)


def _spread(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            contents = part.column("content").to_pylist()
            (h1, which), (h2, _) = _windows(contents, length, 1), _windows(contents, length, 2)
            at = np.arange(len(which)) - np.searchsorted(which, which)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(which)), part.column(1).take(pa.array(which)), pa.array(at.astype(np.int32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))],
                ["d1", "d2", "start", "h1", "h2"],
            )


def _borders(pieces: DataFrame, length: int) -> DataFrame:
    """(text_id, low, starts, ends): repeated strings by comparing those around the open anchors, as ranges from `low` on."""
    units = pieces.where("context is not null").select(
        "*", F.xxhash64("content", "at").alias("d1"), F.xxhash64(F.lit(1), "content", "at").alias("d2")
    )
    contexts = reliable(units.where("open").select("context").distinct())
    classes = stored(semi_join(units, contexts, "context").groupBy("context", "d1", "d2").agg(
        F.count("*").alias("many"), F.first("content").alias("content"), F.first("n").alias("n")
    ))
    twice = classes.where("many > 1").select("d1", "d2", F.array(F.lit(0)).alias("starts"), F.array("n").alias("ends"))
    crowds = reliable(classes.groupBy("context").count().where(F.col("count") > GROUP).select("context"))
    few = classes.join(crowds, "context", "left_anti").select("d1", "d2", "context", "content")
    few = few.repartition("context").sortWithinPartitions("context").mapInArrow(lambda b: tidy(_compared(b, length)), _FOUND)
    many = classes.join(crowds, "context", "left_semi").select("d1", "d2", "content")
    each = many.mapInArrow(lambda b: tidy(_spread(b, length)), f"{_KEY}, start int, h1 long, h2 long")
    again = each.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2")
    crowded = each.join(again, ["h1", "h2"]).groupBy("d1", "d2").agg(F.collect_list("start").alias("starts"))
    crowded = crowded.select("d1", "d2", "starts", F.transform("starts", lambda s: s + 1).alias("ends"))
    found = few.unionByName(crowded).unionByName(twice).where(F.size("starts") > 0)
    open_units = units.where("open").select("text_id", "low", "d1", "d2")
    # An open unit may be in two of the lists; strings marked twice are marked once.
    return open_units.join(reliable(found), ["d1", "d2"]).select("text_id", "low", "starts", "ends")


_CUT = "text_id long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: bigint, end: bigint>>"


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """What is left of each text when its repeated strings are gone."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        for row, end_row, data, offsets in text_chunks(batch.column("text")):
            of, entries = _flat(batch.column("strings"), row, end_row)
            base = offsets[of] + _numbers(entries, "low")
            gone = np.zeros(len(data) + 1, np.int64)
            lists = entries.field("starts")
            base = np.repeat(base, np.array(pa.compute.list_value_length(lists)))
            starts, ends = (pa.compute.list_flatten(entries.field(c)).to_numpy(zero_copy_only=False) for c in ("starts", "ends"))
            _add_ranges(gone, base + starts, base + ends + length - 1)
            starts, ends = spans(np.cumsum(gone)[:-1] > 0, offsets)
            first = np.searchsorted(starts, offsets)
            total = np.concatenate([[0], np.cumsum(ends - starts)])
            raw, kept, lists = data.tobytes(), [], []
            for i in range(end_row - row):
                left, at = sha256(), int(offsets[i])
                mine = list(zip(starts[first[i] : first[i + 1]].tolist(), ends[first[i] : first[i + 1]].tolist(), strict=True))
                for s, e in mine:
                    left.update(raw[at:s])
                    at = e
                left.update(raw[at : offsets[i + 1]])
                kept.append(left.hexdigest())
                lists.append([{"start": s - int(offsets[i]), "end": e - int(offsets[i])} for s, e in mine])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("text_id").slice(row, end_row - row), pa.array(total[first[1:]] - total[first[:-1]]), pa.array(np.diff(first)),
                    pa.array(kept), pa.array(lists, span),
                ],
                ["text_id", "n_removed", "n_spans", "kept_sha256", "spans"],
            )


def repeated_bytes(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) of each row of docs (doc_id, text).

    A byte goes if a string of `length` bytes (REACH + 8 at least) that covers it also starts anywhere else, in the same
    text or another; strings are judged on the input and overlaps count. `spans`: what goes, in bytes, the end
    exclusive; `kept_sha256` is of the bytes left. Null texts are empty; texts shorter than `length` stay whole; of
    texts that stand twice or more all bytes go, in each row. Ties don't matter: no occurrence is kept. An empty table has
    no rows. Other columns are ignored.

    Texts are told by 64-bit hashes (copies by 128 bits), and equal texts are worked on once. Contexts, names and
    surroundings are counted by partial aggregation before they are joined, and surroundings in crowds of more than GROUP
    are compared string by string over all tasks, so no group lands in one task.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = with_package(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_id"))
    facts = reliable(rows.select(
        "doc_id", "text_id", F.xxhash64(F.lit(1), "text").alias("text_id2"), F.octet_length("text").cast("long").alias("n_bytes"),
        F.sha2(F.col("text").cast("binary"), 256).alias("sha"),
    ))
    anchors = rows.where(F.octet_length("text") >= length).select("text_id", "text").mapInArrow(
        lambda b: tidy(_anchors(b, length)), "text_id long, at int, size int, phrase long, context long"
    )
    place = F.xxhash64("text_id", "at")
    contexts = anchors.groupBy("context").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a < b").select("context")
    places = stored(semi_join(anchors, reliable(contexts), "context").dropDuplicates(["text_id", "at"]))
    shared = suffix_order(places.select("text_id", "at", "size", "phrase")).where(F.col("shared") >= length)
    found = shared.groupBy("text_id").agg(F.collect_set(F.struct("at", "shared", "later")).alias("found"))
    of_text = stored(places.groupBy("text_id").agg(F.collect_list(F.struct("at", "context")).alias("places")).join(found, "text_id", "left"))
    texts = stored(semi_join(rows.select("text_id", "text"), of_text.select("text_id"), "text_id").groupBy("text_id").agg(F.first("text").alias("text")))
    pieces = stored(texts.join(of_text, "text_id").mapInArrow(lambda b: tidy(_pieces(b, length)), _PIECE))
    inside = pieces.where("context is null").select("text_id", "low", F.array(F.lit(0)).alias("starts"), F.array("n").alias("ends"))
    strings = inside.unionByName(_borders(pieces, length))
    of_text = strings.groupBy("text_id").agg(F.collect_list(F.struct("low", "starts", "ends")).alias("strings"))
    cut = reliable(texts.join(of_text, "text_id").mapInArrow(lambda b: tidy(_cut(b, length)), _CUT))
    copies = reliable(facts.groupBy("text_id", "text_id2").agg(F.count("*").alias("many")).where("many > 1"))
    copied = F.col("many").isNotNull() & (F.col("n_bytes") >= length)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    return facts.join(copies, ["text_id", "text_id2"], "left").join(cut, "text_id", "left").select(
        "doc_id", "n_bytes", F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copied, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copied, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(copied, whole).otherwise(F.coalesce("spans", F.slice(whole, 1, 0))).alias("spans"),
    )
