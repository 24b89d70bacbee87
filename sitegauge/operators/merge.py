"""State changes as whole-table recomputation: merge of sightings, upserts, decisions.

Plain Parquet has no ``MERGE``: each operator returns the next version of a table,
which the caller writes beside the old one.  Merging is an aggregation, so copies
of one key are combined before the shuffle however many there are.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.session import reliable

CONTEXT = ("metro_key", "hood_name", "niche_key", "tier", "found_via")


def merge_sightings(sightings: DataFrame, key: str, at: Sequence[str], context: Sequence[str],
                    facts: Sequence[str]) -> DataFrame:
    """One row per key: context of the first sighting, facts of the newest.

    ``at`` orders the sightings; it should be unique per key.
    """
    order = F.struct(*at)
    merged = sightings.groupBy(key).agg(
        F.min_by(F.struct(*context), order).alias("_context"),
        F.max_by(F.struct(*facts), order).alias("_facts"),
        F.min(at[0]).alias("created_at"),
        F.max(at[0]).alias("updated_at"),
        F.count("*").alias("sightings"),
    )
    return merged.select(
        key, *[F.col("_context")[c].alias(c) for c in context], *[F.col("_facts")[c].alias(c) for c in facts],
        "created_at", "updated_at", "sightings",
    )


#: A change of so many keys at most goes to where the state is; a larger one is joined by shuffle.
CHANGE_ROWS = 1_000_000


def changed(state: DataFrame, change: DataFrame, key: str, most_rows: int = CHANGE_ROWS) -> list[DataFrame]:
    """Parts that together are the full outer join of ``state`` (alias ``o``) and ``change`` (``n``) on ``key``.

    Both have one row a key. A short change is broadcast: the rows of the state stay in their tasks, and only the keys
    that the change has are looked up, to tell which of its rows are new. A long one shuffles both sides once.
    """
    change = reliable(change)
    on = F.col(f"o.{key}") == F.col(f"n.{key}")
    if change.limit(most_rows + 1).count() > most_rows:
        return [state.alias("o").join(change.alias("n"), on, "full_outer")]
    known = reliable(state.select(key).join(F.broadcast(change.select(key)), key, "left_semi"))
    fresh = change.join(F.broadcast(known), key, "left_anti")
    nobody = state.sparkSession.createDataFrame([], state.schema)
    return [
        state.alias("o").join(F.broadcast(change).alias("n"), on, "left"),
        F.broadcast(nobody).alias("o").join(fresh.alias("n"), on, "right"),
    ]


def _combined(parts: list[DataFrame], columns: list[Column]) -> DataFrame:
    out = parts[0].select(*columns)
    for part in parts[1:]:
        out = out.unionByName(part.select(*columns))
    return out


def upsert_places(state: DataFrame, sightings: DataFrame, at: Sequence[str], context: Sequence[str] = CONTEXT,
                  facts: Sequence[str] = (), most_rows: int = CHANGE_ROWS) -> DataFrame:
    """Next version of the places: known ones keep context and bucket and get new facts;
    unknown ones are added with stage ``discovered``.  ``is_new`` tells which is which.
    The state is not shuffled while the sightings are of ``most_rows`` places at most."""
    merged = merge_sightings(sightings, "place_id", at, context, facts)
    known = F.col("o.place_id").isNotNull()
    seen = F.col("n.place_id").isNotNull()
    kept = [c for c in state.columns if c not in ("place_id", "is_new", *context, *facts)]
    defaults = {"stage": F.lit("discovered"), "bucket": F.lit("pending")}
    return _combined(changed(state, merged, "place_id", most_rows), [
        F.coalesce("o.place_id", "n.place_id").alias("place_id"),
        *[F.when(known, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in context],
        *[F.when(seen, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in facts],
        *[
            F.when(known, F.col(f"o.{c}")).otherwise(defaults[c]).alias(c) if c in defaults else F.col(f"o.{c}").alias(c)
            for c in kept
        ],
        (~known).alias("is_new"),
    ])


def _replaced(old: DataFrame, new: DataFrame, key: str, columns: list[str], sticky: str | None, most_rows: int) -> DataFrame:
    seen = F.col(f"n.{key}").isNotNull()
    picked = [F.when(seen, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in columns]
    if sticky:
        picked.append(F.coalesce(f"n.{sticky}", f"o.{sticky}").alias(sticky))
    return _combined(changed(old, new, key, most_rows), [F.coalesce(f"o.{key}", f"n.{key}").alias(key), *picked])


def upsert_newest(old: DataFrame, new: DataFrame, key: str, at: str, most_rows: int = CHANGE_ROWS) -> DataFrame:
    """Next version of a one-row-per-key table: a new row replaces the old one.

    Copies inside ``new`` are settled by ``at``. The old rows are not shuffled, see :func:`changed`.
    """
    cols = [c for c in old.columns if c != key]
    picked = new.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(at)).alias("_row"))
    return _replaced(old, picked.select(key, *[F.col("_row")[c].alias(c) for c in cols]), key, cols, None, most_rows)


def upsert_audits(old: DataFrame, new: DataFrame, key: str = "place_id", at: str = "audited_at",
                  sticky: str = "version_evidence", most_rows: int = CHANGE_ROWS) -> DataFrame:
    """As :func:`upsert_newest`, but a null ``sticky`` value does not wipe the old one."""
    cols = [c for c in old.columns if c not in (key, sticky)]
    picked = new.groupBy(key).agg(
        F.max_by(F.struct(*cols), F.col(at)).alias("_row"),
        F.max(F.when(F.col(sticky).isNotNull(), F.struct(F.col(at).alias("o"), F.col(sticky).alias("v")))).alias("_sticky"),
    )
    settled = picked.select(key, *[F.col("_row")[c].alias(c) for c in cols], F.col("_sticky")["v"].alias(sticky))
    return _replaced(old, settled, key, cols, sticky, most_rows)


def derive_stage(places: DataFrame, audits: DataFrame, reviews: DataFrame, psi: DataFrame,
                 placement: DataFrame) -> DataFrame:
    """Furthest stage of each place, told by the tables that hold its key.

    One aggregation over tagged keys instead of four joins.
    """
    tagged = places.select("place_id", F.lit(0).alias("_s"))
    for i, table in enumerate((audits, reviews, psi, placement), start=1):
        tagged = tagged.unionByName(table.select("place_id", F.lit(i).alias("_s")))
    stage = F.max("_s")
    return (
        tagged.groupBy("place_id")
        .agg(stage.alias("_top"), F.min("_s").alias("_low"))
        .where(F.col("_low") == 0)
        .select(
            "place_id",
            F.element_at(
                F.array(*[F.lit(s) for s in ("discovered", "audited", "reviewed", "enriched", "exported")]),
                F.col("_top") + 1,
            ).alias("stage"),
        )
    )


def set_pins(pins: DataFrame, decisions: DataFrame, at: Column) -> DataFrame:
    """Next version of the pins: decisions ``(place_id, verdict, reason)`` replace older ones."""
    return upsert_newest(pins, decisions.withColumn("at", at), "place_id", "at")


def clear_pins(pins: DataFrame, keys: DataFrame) -> DataFrame:
    return pins.join(keys.select("place_id"), "place_id", "left_anti")


@dataclass(frozen=True)
class Decision:
    name: str
    verdict: str
    why: str
    place_id: str | None = None


def by_prefix(rows: DataFrame, name: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """Rows joined to the prefixes that their name begins with, in lower case.

    A name is asked for at each length that a prefix has, and the whole prefix is the key of the join: what is joined is
    what matches, however common a beginning is, and the plan is the same for any number of prefixes.
    """
    wanted = prefixes.withColumn("_p", F.lower(prefix)).where("_p is not null")
    lengths = wanted.agg(F.collect_set(F.length("_p")).alias("_lengths"))  # one row, of no more numbers than a name has letters
    low = F.lower(F.col(name))
    fits = F.filter("_lengths", lambda n: n <= F.length(low))
    keyed = rows.join(F.broadcast(lengths)).withColumn("_n", F.explode(fits)).withColumn("_p", F.left(low, F.col("_n")))
    return keyed.drop("_lengths", "_n").join(wanted, "_p").drop("_p")


def resolve_decisions(places: DataFrame, decisions: Sequence[Decision]) -> DataFrame:
    """Hand decisions to place keys: by key if given, else by name prefix.

    Every decision comes back once: ``matches`` tells how many places it fits and only
    those with exactly one carry a ``place_id``; ambiguous ones are left to a person.
    """
    rows = [(i, d.name, d.verdict, d.why, d.place_id) for i, d in enumerate(decisions)]
    listed = places.sparkSession.createDataFrame(rows, "idx int, name string, verdict string, reason string, _key string")
    by_key = places.select("place_id").join(listed.select("idx", F.col("_key").alias("place_id")), "place_id").select("idx", "place_id")
    named = listed.where(F.col("_key").isNull()).select("idx", F.col("name").alias("prefix"))
    matched = by_key.unionByName(by_prefix(places, "name", named, "prefix").select("idx", "place_id"))
    per = matched.groupBy("idx").agg(F.count("*").alias("matches"), F.min("place_id").alias("_one"))
    return listed.join(per, "idx", "left").select(
        "idx", "name", "verdict", "reason",
        F.coalesce("matches", F.lit(0)).alias("matches"),
        F.when(F.col("matches") == 1, F.col("_one")).alias("place_id"),
    )


def transitions(before_after: DataFrame, old: str = "old_bucket", new: str = "bucket") -> DataFrame:
    """Counts of bucket changes."""
    return (
        before_after.where(~F.col(old).eqNullSafe(F.col(new)))
        .groupBy(F.col(old).alias("from_bucket"), F.col(new).alias("to_bucket"))
        .agg(F.count("*").alias("n"))
    )
