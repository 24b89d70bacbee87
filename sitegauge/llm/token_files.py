"""Token ids in bit planes: fixed-size blocks of ids, transposed, each plane compressed by itself, with a chunk index.

A token folder is a Parquet table with one row for each block: `part` and `chunk` order the blocks, `first` and `n_ids`
place the ids within the part, `plane_at` is the chunk index (where each plane's frame starts in `payload`, the total
last), `spans` names the documents that the block holds, wholly or in part: doc_id, the place of its first id in the
part, and its number of ids. Planes of zeros only take no room.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sitegauge.llm.pretokens import of_file
from sitegauge.llm.wordarrays import text_chunks, tidy
from sitegauge.session import with_package

BLOCK_IDS = 65_536
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"
LEVEL = 3

_SPAN = pa.struct([("doc_id", pa.int64()), ("at", pa.int64()), ("n", pa.int64())])
_CHUNK = (
    "part int, chunk int, first long, n_ids int, plane_at array<int>, payload binary, "
    "spans array<struct<doc_id: bigint, at: bigint, n: bigint>>"
)


def planes_of(ids: np.ndarray) -> tuple[list[int], bytes]:
    """(start of each of the 32 bit planes, with the total last, and the compressed planes)."""
    padded = np.zeros(-(-len(ids) // 8) * 8, "<u4")
    padded[: len(ids)] = ids
    rows = padded.view(np.uint8).reshape(-1, 4)
    pack = zstandard.ZstdCompressor(level=LEVEL)
    at, out = [0], []
    for byte in range(4):
        column = np.ascontiguousarray(rows[:, byte])
        any_bit = int(np.bitwise_or.reduce(column)) if len(column) else 0
        for bit in range(8):
            if any_bit >> bit & 1:
                out.append(pack.compress(np.packbits(column >> np.uint8(bit) & np.uint8(1)).tobytes()))
                at.append(at[-1] + len(out[-1]))
            else:
                at.append(at[-1])
    return at, b"".join(out)


def ids_of(at: list[int], payload: bytes, n: int) -> np.ndarray:
    """What :func:`planes_of` was given."""
    rows = np.zeros((n, 4), np.uint8)
    unpack = zstandard.ZstdDecompressor()
    for plane in range(32):
        if at[plane + 1] > at[plane]:
            raw = np.frombuffer(unpack.decompress(payload[at[plane] : at[plane + 1]]), np.uint8)
            rows[:, plane // 8] |= np.unpackbits(raw, count=n) << np.uint8(plane % 8)
    return rows.reshape(-1).view("<u4")


def _chunks(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    part, chunk, first = TaskContext.get().partitionId(), 0, 0
    held, spans, done = [], [], 0  # ids not yet written, documents that reach beyond what is written, ids in all

    def block(size: int) -> pa.RecordBatch:
        nonlocal chunk, first, held, spans
        ids = np.concatenate(held)
        at, payload = planes_of(ids[:size])
        inside = [s for s in spans if s["at"] < first + size]
        row = pa.RecordBatch.from_arrays(
            [
                pa.array([part], pa.int32()), pa.array([chunk], pa.int32()), pa.array([first], pa.int64()), pa.array([size], pa.int32()),
                pa.array([at], pa.list_(pa.int32())), pa.array([payload], pa.binary()), pa.array([inside], pa.list_(_SPAN)),
            ],
            ["part", "chunk", "first", "n_ids", "plane_at", "payload", "spans"],
        )
        first, chunk, held = first + size, chunk + 1, [ids[size:]]
        spans = [s for s in spans if s["at"] + s["n"] > first]
        return row

    tokens = of_file(path)
    for batch in batches:
        names = batch.column(0)
        for row, _, data, offsets in text_chunks(batch.column(1)):
            ids, sizes = tokens.encode(data, offsets)
            ends = np.cumsum(sizes)
            held.append(np.insert(ids, ends, np.uint32(END_ID)))
            for i, n in enumerate((sizes + 1).tolist()):
                spans.append({"doc_id": names[row + i].as_py(), "at": done, "n": n})
                done += n
            while done - first >= BLOCK_IDS:
                yield block(BLOCK_IDS)
    tokens.forget()
    if done > first:
        yield block(done - first)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None) -> None:
    """Encode every whole text of docs (doc_id, text), each followed by END_ID, into a new token folder.

    Documents are in ascending order of doc_id, null first; rows of one id by their texts. A null text is empty. Other
    columns are ignored. An empty table gives an empty folder. The folder is written by Spark's own writer, so tasks
    may be tried again.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # The texts are moved, not the ids: finding the ranges reads the child twice, and encoding is the dear part.
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie, "text")
    with_package(ordered).mapInArrow(lambda batches: tidy(_chunks(batches, path)), _CHUNK).write.parquet(folder)


_PIECE = "part int, doc_id long, at long, n long, piece_at long, piece_n long, crc long"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The checksum of each document's ids within each block."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            ids = ids_of(row["plane_at"], row["payload"], row["n_ids"])
            first, end = row["first"], row["first"] + row["n_ids"]
            for s in row["spans"]:
                a, b = max(s["at"], first), min(s["at"] + s["n"], end)
                out.append((row["part"], s["doc_id"], s["at"], s["n"], a, b - a, zlib.crc32(ids[a - first : b - first].tobytes())))
        names = [x.split()[0] for x in _PIECE.split(", ")]
        kinds = [pa.int32()] + [pa.int64()] * 6
        columns = list(zip(*out, strict=True)) or [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


@lru_cache(64)
def _zeros(power: int) -> tuple[int, ...]:
    """What 2 ** power zero bytes do to each bit of a CRC-32."""
    if power == 0:
        out = []
        for bit in range(32):
            x = 1 << bit
            for _ in range(8):
                x = (x >> 1) ^ (0xEDB88320 if x & 1 else 0)
            out.append(x)
        return tuple(out)
    half = _zeros(power - 1)
    return tuple(_through(half, x) for x in half)


def _through(matrix: tuple[int, ...], x: int) -> int:
    out, bit = 0, 0
    while x:
        if x & 1:
            out ^= matrix[bit]
        x, bit = x >> 1, bit + 1
    return out


def crc_joined(a: int, b: int, bytes_b: int) -> int:
    """CRC-32 of two strings put together, from theirs."""
    power = 0
    while bytes_b:
        if bytes_b & 1:
            a = _through(_zeros(power), a)
        bytes_b, power = bytes_b >> 1, power + 1
    return a ^ b


@F.arrow_udf(T.LongType())
def _joined(pieces: pa.Array) -> pa.Array:
    out = []
    for row in pieces.to_pylist():
        crc = 0
        for p in row:
            crc = crc_joined(crc, p["crc"], 4 * p["piece_n"])
        out.append(crc)
    return pa.array(out, pa.int64())


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, part) of every document in a token folder, from the ids it holds.

    `start` counts the ids of all documents before; the checksum is of the ids as little-endian 32-bit integers.
    """
    chunks = spark.read.schema(_CHUNK).parquet(folder)
    # One row for each part: as many as the writer had tasks.
    sizes = chunks.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    pieces = with_package(chunks).select("part", "chunk", "first", "n_ids", "plane_at", "payload", "spans").mapInArrow(lambda batches: tidy(_pieces(batches)), _PIECE)
    whole = pieces.where("piece_n = n").select("part", "doc_id", "at", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    # Documents over several blocks: their pieces meet by document.
    cut = pieces.where("piece_n < n").groupBy("part", "doc_id", "at", F.col("n").alias("n_tokens")).agg(
        F.array_sort(F.collect_list(F.struct("piece_at", "piece_n", "crc"))).alias("pieces")
    )
    cut = cut.select("part", "doc_id", "at", "n_tokens", _joined("pieces").alias("ids_crc32"))
    return whole.unionByName(cut).join(bases, "part").select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "part"
    )


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = ids_of(row["plane_at"], row["payload"], row["n_ids"]).astype(np.int64)
            first, end = row["first"], row["first"] + row["n_ids"]
            ends = [(s["doc_id"], s["at"], max(s["at"], first), min(s["at"] + s["n"], end)) for s in row["spans"]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["part"]] * len(ends), pa.int32()), pa.array([e[0] for e in ends], pa.int64()),
                    pa.array([e[1] for e in ends], pa.int64()), pa.array([e[2] for e in ends], pa.int64()),
                    pa.array([ids[a - first : b - first] for *_, a, b in ends], pa.list_(pa.int64())),
                ],
                ["part", "doc_id", "at", "piece_at", "ids"],
            )


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(part, doc_id, at, piece_at, ids): the ids of every document, by block. For loaders that stream a part."""
    chunks = spark.read.schema(_CHUNK).parquet(folder)
    return with_package(chunks).mapInArrow(_ids, "part int, doc_id long, at long, piece_at long, ids array<long>")
