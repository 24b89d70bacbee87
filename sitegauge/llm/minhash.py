"""Circulant MinHash: near-duplicate groups over distinct word shingles.

Two fixed permutations of the 32-bit integers make a whole signature: the first scatters a document's shingles, the
second, shifted circularly by k, orders them anew for coordinate k; the coordinate is the least value. Bands of
coordinates give candidates; every link is confirmed by the exact Jaccard similarity of the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.llm.common import bounded, components, reliable, semi_join, with_package
from sitegauge.llm.wordarrays import mix64, shingle_sets, text_chunks, tidy

SHINGLE_WORDS = 5
BANDS, ROWS = 25, 6
#: A link at the threshold is missed by all bands with this probability at most.
MISSED = 1e-5
#: Fixed odd distance between neighbouring shifts.
_SHIFT = np.uint64(2654435761)
_WIDE = 4096
_SALTS = 8


def scatter(shingles: np.ndarray) -> np.ndarray:
    """First permutation, after folding 64-bit hashes to 32 bits."""
    x = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0xD168AAAD)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0xAF723597)
    x ^= x >> np.uint32(15)
    return x


def order(x: np.ndarray) -> np.ndarray:
    """Second permutation, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def bands_for(num: int, den: int) -> int:
    """Bands of ROWS that a threshold of num / den needs: 25 for 0.85, 38 for 0.8."""
    return max(1, int(np.ceil(np.log(MISSED) / np.log1p(-((num / den) ** ROWS))))) if num < den else 1


def signature(shingles: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """All coordinates of one non-empty set, any size, as 32-bit integers."""
    places = scatter(shingles)
    shifts = (np.arange(1, bands * ROWS + 1, dtype=np.uint64) * _SHIFT).astype(np.uint32)
    least = np.full(len(shifts), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(places), _WIDE):
        np.minimum(least, order(places[None, at : at + _WIDE] - shifts[:, None]).min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of a signature."""
    rows = least.reshape(-1, ROWS).astype(np.uint64)
    return sequence_hashes_by_row(rows, np.arange(len(rows), dtype=np.uint64))


def sequence_hashes_by_row(rows: np.ndarray, salt: np.ndarray) -> np.ndarray:
    out = mix64(salt + np.uint64(1))
    for j in range(rows.shape[1]):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
    return out


def set_digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that tell two sets apart."""
    d = blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


_SETS = "doc_id long, digest_a long, digest_b long, shingles array<long>"
_PROFILE = "doc_id long, n_shingles long, digest_a long, digest_b long, bands array<long>"


def _profiles(batches: Iterator[pa.RecordBatch], n_bands: int) -> Iterator[pa.RecordBatch]:
    none: np.ndarray = np.zeros(0, np.int64)
    for batch in batches:
        for row, end, data, offsets in text_chunks(batch.column(1)):
            sizes, digests, bands = [], [], []
            for s in shingle_sets(data, offsets, SHINGLE_WORDS):
                sizes.append(len(s))
                digests.append(set_digest(s) if len(s) else (None, None))
                bands.append(band_keys(signature(s, n_bands)).view(np.int64) if len(s) else none)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0)[row:end],
                    pa.array(sizes, pa.int64()),
                    pa.array([a for a, _ in digests], pa.int64()),
                    pa.array([b for _, b in digests], pa.int64()),
                    pa.ListArray.from_arrays(np.cumsum([0, *map(len, bands)]).astype(np.int32), np.concatenate(bands)),
                ],
                ["doc_id", "n_shingles", "digest_a", "digest_b", "bands"],
            )


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, end, data, offsets in text_chunks(batch.column(1)):
            sets = list(shingle_sets(data, offsets, SHINGLE_WORDS))
            digests = [set_digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0)[row:end],
                    pa.array([a for a, _ in digests], pa.int64()),
                    pa.array([b for _, b in digests], pa.int64()),
                    pa.ListArray.from_arrays(np.cumsum([0, *map(len, sets)]).astype(np.int32), np.concatenate(sets).view(np.int64)),
                ],
                ["doc_id", "digest_a", "digest_b", "shingles"],
            )


def _reaches(common: Column, a: str, b: str, num: int, den: int) -> Column:
    """den * intersection >= num * union, for an intersection (or an upper bound of one)."""
    return F.lit(den) * common >= F.lit(num) * (F.col(a) + F.col(b) - common)


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with the size of their intersection and their own sizes, from the full sets."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("of_b"))
    common = F.size(F.array_intersect("of_a", "of_b"))
    return pairs.join(right, "b").join(left, "a").select(
        "a", "b", common.alias("common"), F.size("of_a").alias("n_a"), F.size("of_b").alias("n_b")
    )


def near_duplicates(docs: DataFrame, num: int = 85, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of `docs` (doc_id, text, any others).

    Links: den * |A & B| >= num * |A | B| over sets of lower-cased (A-Z) five-word shingles; a shorter text is one
    shingle. A null or empty text has no shingles and no links. `component_id` is the smallest doc_id reachable;
    `kept` says that it is the row's own. Repeated rows get equal answers; if rows of one doc_id differ in text, the text
    of least digest stands for it and the others are linked with nothing. A null doc_id takes part in nothing: its
    component is null, and it is kept. Other columns, whatever their names, are not looked at.

    1. One pass makes signatures; equal sets (128-bit digests) become one class, so copies go no further.
    2. In each bucket every class is compared with the most central one (the least share of shingles that no other
       open set has), and links are contracted to components.
    3. What is left to compare is a pair of one bucket in two components. Exact bounds of a pair's intersection, from
       the comparisons with the hub and the shingles that no other open set has, are part of the join, so a large
       group of loose variants doesn't come out as pairs. Pairs that pass are confirmed on their full sets.
    A link at exactly 0.85 is missed by all 25 bands of 6 with probability 8e-6, and at other thresholds, which take as
    many bands as that needs, with at most MISSED; nothing else is left out.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n_bands = bands_for(num, den)
    profiles = reliable(with_package(docs).mapInArrow(lambda b: tidy(_profiles(b, n_bands)), _PROFILE))
    known, repeats = profiles.where("doc_id is not null and n_shingles > 0"), False
    if not known.groupBy("doc_id").count().where("count > 1").isEmpty():
        first = F.min(F.struct("digest_a", "digest_b")).alias("d")
        known = known.dropDuplicates(["doc_id", "digest_a", "digest_b"]).join(known.groupBy("doc_id").agg(first), "doc_id")
        known, repeats = known.where("digest_a = d.digest_a and digest_b = d.digest_b").drop("d"), True
    classes = reliable(known.groupBy("digest_a", "digest_b").agg(F.min("doc_id").alias("class_id")))
    one = known.join(classes.select(F.col("class_id").alias("doc_id"), "digest_a", "digest_b"), ["doc_id", "digest_a", "digest_b"])
    members = one.select(F.explode("bands").alias("bucket"), F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"))
    shared = members.groupBy("bucket").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
    open_ = reliable(members.join(shared.select("bucket"), "bucket"))
    wanted = reliable(open_.select(F.col("id").alias("doc_id")).distinct())
    sets = reliable(semi_join(docs, wanted, "doc_id").mapInArrow(lambda b: tidy(_full_sets(b)), _SETS))
    if repeats:
        named = classes.select(F.col("class_id").alias("doc_id"), "digest_a", "digest_b")
        sets = sets.join(named, ["doc_id", "digest_a", "digest_b"], "left_semi").dropDuplicates(["doc_id"])
    # The member with the smallest share of shingles of its own is the most central.
    share = F.coalesce("own", F.lit(0)) / F.col("n")
    ranked = open_.join(_own(sets), "id", "left").select("bucket", F.struct(share.alias("share"), "id", "n").alias("m"))
    hubs = ranked.groupBy("bucket").agg(F.min("m").alias("hub"))
    placed = reliable(ranked.join(hubs, "bucket").select(
        "bucket", F.col("m.id").alias("id"), F.col("m.n").alias("n"), F.col("hub.id").alias("hub"), F.col("hub.n").alias("n_hub")
    ))
    star = (
        placed.where("id <> hub").where(_reaches(F.least("n", "n_hub"), "n", "n_hub", num, den))
        .select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    )
    close = _reaches(F.col("common"), "n_a", "n_b", num, den)
    stars = reliable(_compared(star, sets))
    links = reliable(stars.where(close).select("a", "b"))
    found = components(links)
    links_2 = reliable(_compared(_open_pairs(placed, found, stars, sets, num, den), sets).where(close).select("a", "b"))
    if not links_2.isEmpty():
        found = components(links.unionByName(links_2))
    of_class = classes.join(found.withColumnRenamed("node", "class_id"), "class_id", "left").select(
        "digest_a", "digest_b", F.coalesce("component", "class_id").alias("of_class")
    )
    linked = F.col("doc_id").isNotNull() & F.col("digest_a").isNotNull()
    with_class = profiles.where(linked).join(of_class, ["digest_a", "digest_b"], "left")
    columns = ("doc_id", "n_shingles", "of_class")
    # Rows that no class can hold stay out of the join, where their null keys would meet in one task.
    out = with_class.select(*columns).unionByName(profiles.where(~linked).withColumn("of_class", F.lit(None).cast("long")).select(*columns))
    component = F.when(F.col("doc_id").isNotNull(), F.least("doc_id", "of_class"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def _own(sets: DataFrame) -> DataFrame:
    """(id, own): how many shingles of a set are in no other of these sets, where there are any."""
    each = sets.select("doc_id", F.explode("shingles").alias("s"))
    alone = each.groupBy("s").agg(F.count("*").alias("k"), F.min("doc_id").alias("id")).where("k = 1")
    return alone.groupBy("id").agg(F.count("*").alias("own"))


def _open_pairs(placed: DataFrame, found: DataFrame, stars: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct pairs of one bucket in different components that the exact bounds don't rule out.

    An upper bound of the intersection of x and y, h being the hub of their bucket, both compared with it before:
    what each shares with h, and what each has besides h and not for itself alone, the lesser of the two in each case.
    """
    at = placed.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("component", "id"))
    split = at.groupBy("bucket").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least < most").select("bucket")
    at = reliable(at.join(split, "bucket").select("bucket", "id", "n", "c", "hub"))
    own = _own(sets.join(at.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi"))
    with_hub = stars.select("a", "b", "common")
    at = (
        at.join(own, "id", "left").withColumn("shared", F.col("n") - F.coalesce("own", F.lit(0)))
        # No partner can help a set whose own shingles alone are too many.
        .where(F.lit(den) * F.col("shared") >= F.lit(num) * F.col("n"))
        .withColumn("a", F.least("id", "hub")).withColumn("b", F.greatest("id", "hub")).join(with_hub, ["a", "b"], "left")
    )
    # Sets that weren't compared with the hub, their sizes being too far apart, are bounded by themselves.
    inside = F.when(F.col("id") == F.col("hub"), F.col("n")).otherwise(F.coalesce("common", "n"))
    besides = F.when(F.col("id") == F.col("hub"), F.lit(0)).otherwise(F.col("shared") - F.coalesce("common", F.lit(0)))
    at = reliable(at.select("bucket", "id", "n", "c", "shared", inside.alias("inside"), F.greatest(besides, F.lit(0)).alias("besides")))
    sides = [
        at.select("bucket", *[F.col(x).alias(f"{x}_{side}") for x in ("id", "n", "c", "shared", "inside", "besides")]) for side in ("a", "b")
    ]
    # One side is dealt out by a salt, so a large bucket is compared in many tasks.
    a = sides[0].withColumn("salt", F.pmod(F.xxhash64("id_a"), F.lit(_SALTS)))
    b = sides[1].withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))))
    most = F.least(F.least("shared_a", "shared_b"), F.least("inside_a", "inside_b") + F.least("besides_a", "besides_b"))
    bound = _reaches(most, "n_a", "n_b", num, den)
    pairs = a.join(b, ["bucket", "salt"]).where((F.col("id_a") < F.col("id_b")) & (F.col("c_a") != F.col("c_b")) & bound)
    return pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def without_duplicates(docs: DataFrame, num: int = 85, den: int = 100) -> DataFrame:
    """The rows of `docs` that :func:`near_duplicates` keeps, all columns, one row for a repeated doc_id.

    The texts are not shuffled unless the list of ids that go is too long to broadcast.
    """
    found = reliable(near_duplicates(docs, num, den).where("doc_id is not null").select(F.col("doc_id").alias("_id"), "kept"))
    gone = reliable(found.where(~F.col("kept")).select("_id").distinct())
    twice = bounded(reliable(found.where("kept").groupBy("_id").count().where("count > 1").select(F.col("_id").alias("_twice"))))
    gone = bounded(gone)
    id_ = docs["doc_id"].cast("long")
    left = docs.join(gone, id_ == gone["_id"], "left_anti")
    repeated = left.join(twice, id_ == twice["_twice"], "left_semi")
    columns = docs.columns
    # Rows of one id that differ in text: one of them stays as well, the least.
    text = F.col("text").cast("string")
    one = repeated.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in columns])).groupBy(id_.alias("_key")).agg(F.min_by("_row", F.coalesce(text, F.lit(""))).alias("_row"))
    return left.join(twice, id_ == twice["_twice"], "left_anti").unionByName(one.select("_row.*"))
