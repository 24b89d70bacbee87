"""Token counts without ids: pieces of each distinct pre-token, joined to every document's pre-token frequencies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge.llm.pretokens import of_file
from sitegauge.llm.wordarrays import text_chunks, tidy
from sitegauge.session import with_package

TOKENIZER = "byte_bpe_50k.json"
#: A document of more tokens is over the limit.
LIMIT = 1024


def _counted(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    tokens = of_file(path)
    for batch in batches:
        for row, end, data, offsets in text_chunks(batch.column(1)):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[row:end], pa.array(np.diff(offsets)), pa.array(tokens.counts(data, offsets))], ["doc_id", "n_bytes", "n_tokens"]
            )
    tokens.forget()


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs (doc_id, text); other columns are ignored.

    Null and empty texts have no bytes and no tokens; null ids and repeated rows each have their own row.

    Within a task, the texts of each batch are cut into pre-tokens by array operations; each distinct pre-token is
    given to the tokenizer's model once and remembered (a bounded number; the memory starts anew beyond it), the counts
    are joined to the frequencies (document, pre-token) and summed. Nothing is shuffled: a join over the whole corpus
    would move a row for each distinct pre-token of each document, several times the input.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = with_package(rows).mapInArrow(lambda batches: tidy(_counted(batches, path)), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
