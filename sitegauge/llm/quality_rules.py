"""Quality rules with adaptive thresholds: quantile sketches per language and source instead of fixed cut-offs."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sitegauge.llm.common import bounded, reliable, with_package
from sitegauge.llm.wordarrays import SPACE, give_back, mix64, sequence_hashes, span_hashes, spans, text_chunks, words

#: Relative width of a sketch bucket: quantiles are right to 1 %.
GAMMA = 1.02
#: Groups of fewer rows use the merged sketch of their language; languages of fewer, that of all rows.
MIN_ROWS = 200
#: Words a text must have, and the share of words in repeated windows (percent) it may have, whatever its group.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: metric -> slack: distance beyond the fences that is always allowed; one line of three may be a repetition.
SLACK = {"word_length": 1.5, "symbols": 0.1, "dup_lines": 0.35, "repeat_words": 0.3}
#: Fences lie this many inter-quantile spreads outside the 10 % and 90 % quantiles.
SPREADS = 2.0
_ZERO = -100_000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(occurs more than once, occurs earlier) for each key."""
    at = np.argsort(keys, kind="stable")
    equal = keys[at][1:] == keys[at][:-1]
    many, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[at[1:][equal]] = True
    many[at[1:][equal]] = True
    many[at[:-1][equal]] = True
    return many, later


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[bounds[1:]] - total[bounds[:-1]]


def measures_of(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The columns of MEASURES for texts given as bytes and offsets."""
    starts, ends, first = words(data, offsets)
    n_words = np.diff(first)
    rows = np.arange(len(n_words), dtype=np.uint64)
    chars = _per_text(~SPACE[data] & ((data & 0xC0) != 0x80), offsets)
    symbols = _per_text(_SYMBOL[data], offsets)

    line_starts, line_ends = spans(data != 10, offsets)
    solid = np.concatenate([[0], np.cumsum(~SPACE[data])])
    with_word = solid[line_ends] > solid[line_starts]
    line_starts, line_ends = line_starts[with_word], line_ends[with_word]
    line_first = np.searchsorted(line_starts, offsets)
    lines = np.diff(line_first)
    line_keys = mix64(span_hashes(data, line_starts, line_ends) + np.repeat(mix64(rows + np.uint64(1)), lines))
    dup_lines = _per_text(_repeated(line_keys)[1], line_first)

    text_of = np.repeat(rows, n_words)
    covered = np.zeros(len(starts), bool)
    if len(starts) >= 3:
        within = text_of[2:] == text_of[:-2]
        keys = mix64(sequence_hashes(span_hashes(data, starts, ends), 3) + mix64(text_of[:-2] + np.uint64(1)))
        at = np.flatnonzero(within)
        many = np.zeros(len(keys), bool)
        many[at] = _repeated(keys[at])[0]
        for j in range(3):
            covered[j : j + len(many)] |= many
    return [n_words, chars, symbols, dup_lines, _per_text(covered, first), lines]


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in MEASURES]))
def measures(text: pa.Array) -> pa.Array:
    parts = [measures_of(data, offsets) for _, _, data, offsets in text_chunks(text)]
    columns = [np.concatenate([np.zeros(0, np.int64), *[p[i] for p in parts]]).astype(np.int64) for i in range(len(MEASURES))]
    give_back()
    return pa.StructArray.from_arrays([pa.array(c) for c in columns], list(MEASURES))


def _ratios(m: str) -> dict[str, Column]:
    n = F.greatest(F.col(f"{m}.n_words"), F.lit(1))
    return {
        "word_length": F.col(f"{m}.word_chars") / n,
        "symbols": F.col(f"{m}.n_symbols") / n,
        "dup_lines": F.col(f"{m}.n_dup_lines") / F.greatest(F.col(f"{m}.n_lines"), F.lit(1)),
        "repeat_words": F.col(f"{m}.n_repeat_words") / n,
    }


def _group(name: str) -> Column:
    """Null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n): counts in buckets that grow by GAMMA. Sketches merge by adding counts.

    Rows without words say nothing about their group and are left out.
    """
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("x")) for k, v in _ratios("_m").items()]))
    rows = measured.where("_m.n_words > 0").select(_group("lang").alias("lang"), _group("source").alias("source"), each.alias("v"))
    bucket = F.when(F.col("v.x") > 0, F.ceil(F.log("v.x") / math.log(GAMMA))).otherwise(F.lit(_ZERO)).cast("int")
    return rows.groupBy("lang", "source", F.col("v.metric").alias("metric"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row for each (lang, source), with `low` and `high` maps of metric to fence."""
    levels = []
    for depth, keys in enumerate(((), ("lang",), ("lang", "source"))):
        kept = [F.col(k) if k in keys else F.lit(None).cast("string").alias(k) for k in ("lang", "source")]
        levels.append(sketch.select(F.lit(depth).alias("depth"), *kept, "metric", "bucket", "n"))
    merged = levels[0].unionByName(levels[1]).unionByName(levels[2]).groupBy("depth", "lang", "source", "metric", "bucket").agg(F.sum("n").alias("n"))
    # At most one row for each bucket of a group: a few thousand, whatever the input.
    group = Window.partitionBy("depth", "lang", "source", "metric")
    cum = F.sum("n").over(group.orderBy("bucket")) / F.sum("n").over(group)
    value = F.when(F.col("bucket") > _ZERO, F.pow(F.lit(GAMMA), F.col("bucket") - 0.5)).otherwise(F.lit(0.0))
    quantiles = merged.select("depth", "lang", "source", "metric", "n", cum.alias("cum"), value.alias("x")).groupBy(
        "depth", "lang", "source", "metric"
    ).agg(F.sum("n").alias("rows"), *[F.min(F.when(F.col("cum") >= q, F.col("x"))).alias(f"q{i}") for i, q in ((10, 0.1), (90, 0.9))])
    slack = F.create_map(*[F.lit(x) for kv in SLACK.items() for x in kv])[F.col("metric")]
    reach = SPREADS * (F.col("q90") - F.col("q10")) + slack
    fences = quantiles.groupBy("depth", "lang", "source").agg(
        F.max("rows").alias("rows"),
        F.map_from_entries(F.collect_list(F.struct("metric", F.col("q10") - reach))).alias("low"),
        F.map_from_entries(F.collect_list(F.struct("metric", F.col("q90") + reach))).alias("high"),
    )
    fences = reliable(fences)
    own, lang = (
        fences.where(F.col("depth") == d).select(
            *[F.col(k) for k in ("lang", "source")[:d]], *[F.col(c).alias(f"{c}_{d}") for c in ("rows", "low", "high")]
        )
        for d in (2, 1)
    )
    every = fences.where("depth = 0").first()  # one row: two maps of four numbers
    if every is None:
        return own.select("lang", "source", F.col("low_2").alias("low"), F.col("high_2").alias("high"))
    joined = own.join(lang, "lang", "left")
    literal = lambda values: F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    pick = lambda c: F.when(F.col("rows_2") >= MIN_ROWS, F.col(f"{c}_2")).when(F.col("rows_1") >= MIN_ROWS, F.col(f"{c}_1")).otherwise(literal(every[c]))
    return joined.select("lang", "source", pick("low").alias("low"), pick("high").alias("high"))


def _base_failed(m: str) -> Column:
    return (F.col(f"{m}.n_words") < MIN_WORDS) | (100 * F.col(f"{m}.n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{m}.n_words"))


def _decided(measured: DataFrame, fences: DataFrame) -> DataFrame:
    """`measured` with _kept: within the fences of its group and not failed by the base rules."""
    fences = bounded(reliable(fences).select(
        F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.col("low").alias("_low"), F.col("high").alias("_high")
    ))
    with_fences = measured.join(fences, (_group("lang") == F.col("_lang")) & (_group("source") == F.col("_source")), "left")
    inside = F.lit(True)
    for name, x in _ratios("_m").items():
        inside = inside & (x <= F.col("_high")[name]) & (x >= F.col("_low")[name])
    kept = F.coalesce(inside, F.lit(False)) & ~_base_failed("_m")
    return with_fences.withColumn("_kept", kept).drop("_lang", "_source", "_low", "_high")


def quality(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines), one row each.

    Words are `[^\\x20\\x09-\\x0D]+`. A null or empty text has no words and fails. Null languages and sources form
    groups like any other (null and empty are one). Ties and repeated rows each get their own, equal, answer. Other
    columns are ignored. The texts are read once; the measures, a few numbers a row, are stored.
    """
    narrow = with_package(docs).select("doc_id", "lang", "source", measures(F.col("text").cast("string")).alias("_m"))
    narrow = reliable(narrow)
    decided = _decided(narrow, thresholds(sketches(narrow)))
    return decided.select(
        "doc_id", *[F.col(f"_m.{c}").alias(c) for c in MEASURES[:-1]], _base_failed("_m").alias("base_failed"),
        F.col("_kept").alias("kept"), F.col("_m.n_lines").alias("n_lines"),
    )


def passing(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that :func:`quality` keeps, with all their columns; texts stay where they are read."""
    text = measures(F.col("text").cast("string"))
    # Only a few numbers a row are stored for the thresholds; the texts are read a second time for the verdict. The array of
    # one keeps filters and projections on the measures above them: each text is measured once in either pass.
    once = lambda *kept: with_package(docs).select(*kept, "lang", "source", F.explode(F.array(text)).alias("_m"))
    fences = thresholds(sketches(reliable(once())))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    return _decided(once(row), fences).where("_kept").select("_row.*")
