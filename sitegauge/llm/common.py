"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.session import ensure_checkpoint_dir, reliable, with_package

__all__ = ["bounded", "components", "read_table", "reliable", "semi_join", "stored", "with_package"]

#: A key list of so many rows at most is broadcast; a longer one is joined by shuffle.
BROADCAST_ROWS = 1_000_000


def read_table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """`df` written beside the checkpoints as a compressed table and read back; smaller than a checkpoint of the same rows."""
    folder = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` (narrow, already stored) marked for broadcast if it has at most `rows` rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def semi_join(df: DataFrame, ids: DataFrame, key: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of `df` whose key is in `ids`; wide rows stay where they are while the key list is short."""
    return df.join(bounded(ids, rows), key, "left_semi")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over the links (a, b), for every node that has a link.

    Alternating large-star and small-star steps; each is one aggregation and one join, both of which Spark can
    split on a hot node. The edges are stored in the checkpoint folder after every round.
    """
    edges = reliable(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    seen = None
    while True:
        # Large star: neighbours above a node move to the least node around it.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its lower neighbours move to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = reliable(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )


def same(a: str | Column, b: str | Column) -> Column:
    """Null-safe equality."""
    return (F.col(a) if isinstance(a, str) else a).eqNullSafe(F.col(b) if isinstance(b, str) else b)
