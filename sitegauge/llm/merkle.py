"""Merkle manifest of a document table: stored every few levels, the levels between regenerated for each proof.

The tree of a source is ternary over its documents in ascending order; the roots of the sources are the leaves of one
more tree. A layer of `step` levels is cut into aligned subtrees of 3**step nodes, one row each. Only the lowest nodes
of the layers are stored; a proof regenerates the nodes inside the subtrees on its path, takes the siblings and drops
the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitegauge.llm.common import reliable, with_package
from sitegauge.operators.ranking import global_row_number

ARITY = 3
#: Levels from one stored layer to the next: subtrees of 81 nodes.
STEP = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_PROOF = "array<struct<left: string, right: string>>"
_NODES = f"tree string, idx long, top string, root string, proof {_PROOF}"
_LEAVES = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(joined: str) -> str:
    return sha256(joined.encode()).hexdigest()


def levels_of(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of a subtree level by level, its own first; a last run of fewer nodes, even one, is hashed as well."""
    out = [nodes]
    for _ in range(levels):
        low = out[-1]
        out.append([digest("".join(low[i : i + ARITY])) for i in range(0, len(low), ARITY)])
    return out


def siblings(levels: list[list[str]], at: int) -> list[dict[str, str]]:
    """What stands left and right of the node on each level below the top of its subtree."""
    out = []
    for nodes in levels[:-1]:
        first = at - at % ARITY
        run = nodes[first : first + ARITY]
        out.append({"left": "".join(run[: at - first]), "right": "".join(run[at - first + 1 :])})
        at //= ARITY
    return out


def folded(node: str, proof: list[dict[str, str]]) -> str:
    """The root that a node and the siblings on its path give."""
    for level in proof:
        node = digest(level["left"] + node + level["right"])
    return node


@F.arrow_udf(T.StringType())
def _top(nodes: pa.Array, levels: pa.Array) -> pa.Array:
    return pa.array([levels_of(n, k)[-1][0] for n, k in zip(nodes.to_pylist(), levels.to_pylist(), strict=True)], pa.string())


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):  # one subtree at a time
            yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


def _node_proofs(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        levels = levels_of(row["nodes"], row["levels"])
        yield pa.RecordBatch.from_pylist(
            [
                {"tree": row["tree"], "idx": row["first"] + i, "top": row["top"], "root": row["root"], "proof": siblings(levels, i) + row["proof"]}
                for i in range(len(row["nodes"]))
            ],
            schema,
        )


def _leaf_proofs(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        levels = levels_of(row["nodes"], row["levels"])
        above = "".join(p["left"] + p["right"] for p in row["proof"])
        out = []
        for i, (leaf, doc_id, seen) in enumerate(zip(row["nodes"], row["doc_ids"], row["seen"], strict=True)):
            inside = siblings(levels, i)
            root = folded(seen, inside + row["proof"])
            out.append({
                "doc_id": doc_id, "leaf": leaf, "subroot": row["top"], "root": row["root"],
                "proof_sha256": digest("".join(p["left"] + p["right"] for p in inside) + above),
                "folded_root": root, "verified": root == row["root"],
            })
        yield pa.RecordBatch.from_pylist(out, schema)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(ddl))


def _subtrees(nodes: DataFrame, sizes: DataFrame, layer: int, step: int, *more: Column) -> DataFrame:
    """One row for each aligned subtree: its nodes in order, and how many levels it has below the tree's root."""
    width = ARITY**step
    # The least h with 3**h >= n, in exact integers.
    powers = F.array(*[F.lit(ARITY**k).cast("long") for k in range(40)])
    height = F.size(F.filter(powers, lambda p: p < F.col("n")))
    grouped = nodes.groupBy("tree", F.floor(F.col("idx") / width).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("idx", "node", *more))).alias("_all")
    )
    levels = F.greatest(F.lit(0), F.least(F.lit(step), height - layer * step)).alias("levels")
    return grouped.join(sizes, "tree").select(
        "tree", "block", (F.col("block") * width).alias("first"), levels, F.col("_all.node").alias("nodes"),
        *[F.col(f"_all.{c}").alias(f"{c}s" if c == "doc_id" else c) for c in ("doc_id", "seen") if more],
    )


def _layers(nodes: DataFrame, step: int, *more: Column) -> tuple[list[DataFrame], DataFrame]:
    """(stored subtrees of each layer, lowest first; the trees' roots (tree, node)) of nodes (tree, idx from 0, node)."""
    sizes = reliable(nodes.groupBy("tree").agg(F.count("*").alias("n")))
    largest = sizes.agg(F.max("n")).first()[0] or 1
    layers = [reliable(_subtrees(nodes, sizes, 0, step, *more))]
    while True:
        nodes = layers[-1].select("tree", F.col("block").alias("idx"), _top("nodes", "levels").alias("node"))
        largest = -(-largest // ARITY**step)
        if largest <= 1:
            return layers, reliable(nodes.select("tree", "node"))
        layers.append(reliable(_subtrees(nodes, sizes, len(layers), step)))


def _paths(layers: list[DataFrame], tops: DataFrame, leaves: bool) -> DataFrame:
    """Proofs of the lowest nodes, from the proofs `tops` (tree, idx 0, top, root, proof) of the trees' roots."""
    proofs = tops
    for layer in reversed(layers):
        above = proofs.withColumnRenamed("idx", "block")
        last = leaves and layer is layers[0]
        make, ddl = (_leaf_proofs, _LEAVES) if last else (_node_proofs, _NODES)
        schema = _arrow(ddl)
        proofs = layer.join(above, ["tree", "block"]).mapInArrow(lambda b, make=make, schema=schema: make(b, schema), ddl)
    return proofs


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_of(text: Column) -> Column:
    """SHA-256 of a document's fields, each with its length in bytes."""
    return F.sha2(F.concat(*[_field(F.col(c)) for c in FIELDS[:-1]], _field(text)).cast("binary"), 256)


def manifest(docs: DataFrame, seen_text: Column | None = None, step: int = STEP) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row of docs (FIELDS).

    `seen_text` is the text as it is found at verification (None: as stored): `folded_root` is computed from the leaf of
    that text and the stored siblings, and `verified` tells whether it is the root. Null fields and the empty text have
    different leaves. Rows of a source are in order of doc_id (null first), then of their leaves, so repeated rows are
    neighbours with equal leaves and proofs of their own. Sources are in bytewise order, null first. An empty table
    has no rows. Other columns are ignored.

    Texts are read once, for the leaves. A source of any size is numbered and cut into subtrees by range and by
    block, so no task holds more than a subtree of 3**step nodes at a time; a path is a few strings for each layer.
    """
    rows = with_package(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        # Null before all others, an empty source after it.
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("tree"),
        leaf_of(F.col("text")).alias("node"),
        leaf_of(F.col("text") if seen_text is None else seen_text).alias("seen"),
    )
    numbered = global_row_number(reliable(rows), ["tree"], [F.col("doc_id"), F.col("node"), F.col("seen")], "idx")
    leaves = numbered.withColumn("idx", F.col("idx") - 1)
    layers, subroots = _layers(leaves, step, F.col("doc_id"), F.col("seen"))
    forest = global_row_number(
        subroots.select(F.lit("").alias("all"), F.col("tree").alias("name"), "node"), ["all"], [F.col("name")], "idx"
    ).select(F.lit("").alias("tree"), F.col("name").alias("doc_name"), (F.col("idx") - 1).alias("idx"), "node")
    forest = reliable(forest)
    upper, root = _layers(forest.select("tree", "idx", "node"), step)
    start = root.select("tree", F.lit(0).cast("long").alias("block_idx"), F.col("node").alias("top"), F.col("node").alias("root"))
    start = start.select("tree", F.col("block_idx").alias("idx"), "top", "root", F.array().cast(_PROOF).alias("proof"))
    of_source = _paths(upper, start, leaves=False).join(forest.select("idx", "doc_name", "node"), "idx").select(
        F.col("doc_name").alias("tree"), F.lit(0).cast("long").alias("idx"), F.col("node").alias("top"), "root", "proof"
    )
    return _paths(layers, reliable(of_source), leaves=True)


def damaged_text() -> Column:
    """Where crc32 of the doc_id is even, the text without line feeds, else the text itself."""
    even = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.translate(F.col("text").cast("string"), "\n", "")).otherwise(F.col("text").cast("string"))
