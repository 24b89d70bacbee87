"""Scores of a bigram model kept in Elias-Fano tries, one for each shard of contexts.

A trie has two levels, each a monotone sequence in Elias-Fano form: the contexts of the shard, and (rank of the context,
successor), in which a successor is looked for relative to its context; the unary half of the second level is the
pointers of the first. Smoothed probabilities are quantised to 16 bits. The levels are written to a file, mapped into
memory, and queried there, undecoded, by all texts that need the shard.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge.llm.common import reliable, with_package
from sitegauge.llm.wordarrays import LOWER, mix64, span_hashes, text_chunks, words

#: Bytes of text in a block, the unit that asks, and tokens for each shard, the unit that answers.
BLOCK_BYTES, SHARD_TOKENS = 8 << 20, 500_000
#: Weight of the unigram distribution in every context, in occurrences.
PRIOR = 4.0
#: Contexts with more than one in so many of all tokens are spread over all shards; there are fewer of them than this.
HOT = 200
#: Every document whose crc32 of the id, as text, leaves HELD when divided by FOLDS is held out.
FOLDS, HELD = 7, 2

_BEGIN, _END = np.uint64(0x0B3617), np.uint64(0x0E4D)
_RANK = np.uint64(40)
_LOW = np.uint64((1 << 40) - 1)
_STEP = 4096.0


#: Bytes of the unary half for each count of its directory, and values that are looked up at once.
_GROUP, _ASKED = 16, 1 << 17
#: Zeros of each byte, and the place of its r-th zero from the left.
_ZEROS = np.array([8 - x.bit_count() for x in range(256)], np.uint8)
_ZERO_AT = np.array([([b for b in range(8) if not x >> (7 - b) & 1] + [0] * 8)[:8] for x in range(256)], np.int64)


class EliasFano:
    """A sorted array of 64-bit integers: low bytes as they are, the rest in unary, with a directory of the zeros there.

    Look-ups read both halves where they lie; :meth:`values` decodes all of them.
    """

    @staticmethod
    def pack(values: np.ndarray) -> list[np.ndarray]:
        n = len(values)
        top = int(values[-1]) if n else 0
        low = min(7, -(-max((top // max(n, 1)).bit_length(), 1) // 8))
        high = (values >> np.uint64(8 * low)).astype(np.int64)
        bits = np.zeros(n + (int(high[-1]) if n else 0) + 1, np.uint8)
        bits[high + np.arange(n)] = 1
        lows = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(n, 8)[:, :low])
        packed = np.packbits(bits)
        packed = np.concatenate([packed, np.full(-len(packed) % _GROUP, 255, np.uint8)])
        zeros = np.cumsum(_ZEROS[packed].reshape(-1, _GROUP).sum(axis=1, dtype=np.int64))
        return [np.array([n, low, len(bits)], np.int64), lows.reshape(-1), packed, np.concatenate([[0], zeros[:-1]])]

    def __init__(self, head: np.ndarray, lows: np.ndarray, bits: np.ndarray, zeros: np.ndarray):
        self.n, self.low, self.size = (int(x) for x in head)
        self.lows, self.bits, self.zeros = lows.reshape(self.n, self.low), bits, zeros

    def values(self) -> np.ndarray:
        out = np.zeros((self.n, 8), np.uint8)
        out[:, : self.low] = self.lows
        high = np.flatnonzero(np.unpackbits(self.bits, count=self.size)) - np.arange(self.n)
        return out.reshape(-1).view("<u8") | (high.astype(np.uint64) << np.uint64(8 * self.low))

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each value, -1 where it isn't held."""
        if not self.n:
            return np.full(len(wanted), -1)
        parts = [self._find(wanted[i : i + _ASKED]) for i in range(0, len(wanted), _ASKED)]
        return np.concatenate([np.zeros(0, np.int64), *parts])

    def _find(self, wanted: np.ndarray) -> np.ndarray:
        # Neighbours often have their high part in common, and so the stretch of the unary half that it points to.
        high = (wanted >> np.uint64(8 * self.low)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], high[1:] != high[:-1]]))
        runs = np.diff(np.concatenate([first, [len(high)]]))
        high = high[first]
        most = self.size - self.n - 1
        held = high <= most
        high = np.minimum(high, most)
        begin = np.where(high > 0, self._zero(np.maximum(high - 1, 0)) + 1, 0) - high
        end = self._zero(high) - high
        low, end = np.repeat(begin, runs), np.repeat(np.where(held, end, begin), runs)
        least = wanted & np.uint64((1 << 8 * self.low) - 1)
        high, at = end.copy(), np.flatnonzero(low < end)
        while len(at):
            middle = (low[at] + high[at]) >> 1
            below = self._low(middle) < least[at]
            low[at[below]] = middle[below] + 1
            high[at[~below]] = middle[~below]
            at = at[low[at] < high[at]]
        at = np.flatnonzero(low < end)
        out = np.full(len(wanted), -1)
        at = at[self._low(low[at]) == least[at]]
        out[at] = low[at]
        return out

    def _zero(self, nth: np.ndarray) -> np.ndarray:
        """Places of the zeros of these numbers in the unary half."""
        group = np.searchsorted(self.zeros, nth, "right") - 1
        rest = nth - self.zeros[group]
        bytes_ = self.bits.reshape(-1, _GROUP)[group]
        upto = np.cumsum(_ZEROS[bytes_], axis=1, dtype=np.uint8)
        byte, row = (upto <= rest[:, None]).sum(axis=1), np.arange(len(nth))
        value = bytes_[row, byte]
        return (group * _GROUP + byte) * 8 + _ZERO_AT[value, rest - (upto[row, byte] - _ZEROS[value])]

    def _low(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros((len(at), 8), np.uint8)
        out[:, : self.low] = self.lows[at]
        return out.reshape(-1).view("<u8")


def quantised(p: np.ndarray) -> np.ndarray:
    """Codes of probabilities: 1 + 4096ths of the negative log10; 0 means none."""
    return np.clip(np.round(-np.log10(p) * _STEP) + 1, 1, 65535).astype(np.uint16)


def probability(codes: np.ndarray, none: float) -> np.ndarray:
    return np.where(codes > 0, 10.0 ** ((1.0 - codes) / _STEP), none)


class Trie:
    """Two levels and their codes, in one memory-mapped file."""

    def __init__(self, contexts: np.ndarray, keys: np.ndarray, counts: np.ndarray, totals: np.ndarray):
        """contexts: sorted hashes; keys: sorted (rank << 40 | successor); counts of keys; totals of contexts."""
        rank = (keys >> _RANK).astype(np.int64)
        parts = [
            *EliasFano.pack(contexts), quantised(PRIOR / (totals + PRIOR)),
            *EliasFano.pack(keys), quantised(counts / (totals[rank] + PRIOR)),
        ]
        self.file = tempfile.TemporaryFile()  # noqa: SIM115  goes with this object
        places = []
        for p in parts:
            places.append((self.file.tell(), p.dtype, len(p)))
            self.file.write(p.tobytes())
            self.file.write(b"\0" * (-self.file.tell() % 8))
        self.file.flush()
        self.size = self.file.tell()
        mapped = [np.memmap(self.file, d, "r", at, (n,)) if n else np.zeros(0, d) for at, d, n in places]
        self.contexts, self.backoff = EliasFano(*mapped[:4]), mapped[4]
        self.keys, self.codes = EliasFano(*mapped[5:9]), mapped[9]

    def ask(self, contexts: np.ndarray, runs: np.ndarray, successors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(code of each context's weight of the unigrams, code of each successor), 0 where the trie has none."""
        rank = self.contexts.find(contexts)
        known = np.repeat(rank, runs)
        key = (np.maximum(known, 0).astype(np.uint64) << _RANK) | successors
        at = np.full(len(key), -1)
        at[known >= 0] = self.keys.find(key[known >= 0])
        return _take(self.backoff, rank), _take(self.codes, at)


def _find(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(values):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
    return np.where(values[at] == wanted, at, -1)


def _take(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.where(at >= 0, codes[np.maximum(at, 0)], 0).astype(np.uint16) if len(codes) else np.zeros(len(at), np.uint16)


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes of all texts in a row, each text closed by the end token; number of tokens of each text)."""
    hashes, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for _, _, data, offsets in text_chunks(column):
        data = LOWER[data]
        starts, ends, first = words(data, offsets)
        hashes.append(np.insert(span_hashes(data, starts, ends), first[1:], _END))
        sizes.append(np.diff(first) + 1)
    return np.concatenate(hashes), np.concatenate(sizes)


class Block:
    """The distinct words and bigrams of some texts, in the order in which shards are asked about them."""

    def __init__(self, column: pa.Array, shards: int, hot: np.ndarray):
        token, self.sizes = _tokens(column)
        self.text_of = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.word, unique = pd.factorize(token)
        begin = np.cumsum(self.sizes) - self.sizes
        names = np.concatenate([unique, [_BEGIN]])
        before = np.concatenate([[0], self.word[:-1]])
        before[begin] = len(unique)
        self.pair, pairs = pd.factorize(before * len(names) + self.word)
        context, self.pair_word = np.divmod(pairs, len(names))

        s = np.uint64(shards)
        self.words, self.word_shard = unique, (unique % s).astype(np.int64)
        self.word_order = np.lexsort((unique, self.word_shard))
        self.context, self.successor = names[context], names[self.pair_word] & _LOW
        spread = np.where(np.isin(self.context, hot), mix64(names[self.pair_word]), np.uint64(0))
        self.pair_shard = ((self.context % s + spread % s) % s).astype(np.int64)
        self.pair_order = np.lexsort((self.successor, self.context, self.pair_shard))

    def parts(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, words in its order, pairs in its order) for each shard that this block asks."""
        by_word, by_pair = self.word_shard[self.word_order], self.pair_shard[self.pair_order]
        for shard in np.unique(np.concatenate([by_word, by_pair])).tolist():
            w = slice(*np.searchsorted(by_word, [shard, shard + 1]))
            p = slice(*np.searchsorted(by_pair, [shard, shard + 1]))
            yield shard, self.word_order[w], self.pair_order[p]

    def runs(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct contexts of pairs in order, and how many pairs each has."""
        context = self.context[pairs]
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.zeros(0, np.int64)
        return context[first], np.diff(np.concatenate([first, [len(context)]]))


_ASK = "shard long, block long, words binary, counts binary, contexts binary, runs binary, successors binary, pair_counts binary"
_ANSWER = "block long, shard long, counts binary, backoff binary, codes binary"


def _five(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _of_five(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(x, np.uint8).reshape(-1, 5)
    return out.reshape(-1).view("<u8")


def _asked(table: pa.Table, shards: int, hot: np.ndarray) -> pa.Table:
    block = Block(table["text"], shards, hot)
    trained = (~table["held"].to_numpy(zero_copy_only=False)).astype(np.float64)[block.text_of]
    counts = np.bincount(block.word, trained, len(block.words)).astype(np.uint32)
    pair_counts = np.bincount(block.pair, trained, len(block.context)).astype(np.uint32)
    rows = []
    for shard, w, p in block.parts():
        contexts, runs = block.runs(p)
        rows.append((
            shard, table["block"][0].as_py(), block.words[w].tobytes(), counts[w].tobytes(), contexts.tobytes(),
            runs.astype(np.uint32).tobytes(), _five(block.successor[p]), pair_counts[p].tobytes(),
        ))
    kinds = [pa.int64()] * 2 + [pa.binary()] * 6
    names = [x.split()[0] for x in _ASK.split(", ")]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts; keys that were never counted are left out."""
    keys, counts = keys[counts > 0], counts[counts > 0]
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def _many(table: pa.Table, name: str, dtype: str) -> list[np.ndarray]:
    return [_of_five(x.as_py()) if dtype == "five" else np.frombuffer(x.as_py(), dtype) for x in table[name]]


def build(table: pa.Table, hot: dict[int, int]) -> tuple[np.ndarray, np.ndarray, Trie]:
    """(distinct training words of the shard, their counts, the trie of its contexts) from what all blocks sent."""
    keys = np.concatenate(_many(table, "words", "<u8"))
    words_, counts = _summed(keys, np.concatenate(_many(table, "counts", "<u4")).astype(np.int64))
    context = np.concatenate([np.repeat(c, r) for c, r in zip(_many(table, "contexts", "<u8"), _many(table, "runs", "<u4"), strict=True)])
    pair_counts = np.concatenate(_many(table, "pair_counts", "<u4")).astype(np.int64)
    # A hot context is known wherever it is asked about, even if none of its successors were counted here.
    contexts = np.unique(context[(pair_counts > 0) | np.isin(context, np.array(list(hot), np.uint64))])
    rank = np.searchsorted(contexts, context).astype(np.uint64)
    keys, n = _summed((rank << _RANK) | np.concatenate(_many(table, "successors", "five")), pair_counts)
    totals = np.bincount((keys >> _RANK).astype(np.int64), n, len(contexts))
    for c, n_c in hot.items():
        if (i := int(_find(contexts, np.array([c], np.uint64))[0])) >= 0:
            totals[i] = n_c  # the rest of it is in other shards
    return words_, counts, Trie(contexts, keys, n, totals)


def _answered(table: pa.Table, hot: dict[int, int]) -> pa.Table:
    words_, counts, trie = build(table, hot)
    rows = []
    for i in range(table.num_rows):
        part = table.slice(i, 1)
        at = _find(words_, _many(part, "words", "<u8")[0])
        own = np.where(at >= 0, counts[np.maximum(at, 0)], 0) if len(counts) else np.zeros(len(at), np.int64)
        backoff, codes = trie.ask(_many(part, "contexts", "<u8")[0], _many(part, "runs", "<u4")[0].astype(np.int64), _many(part, "successors", "five")[0])
        rows.append((part["block"][0].as_py(), part["shard"][0].as_py(), own.astype("<i8").tobytes(), backoff.tobytes(), codes.tobytes()))
    kinds = [pa.int64()] * 2 + [pa.binary()] * 3
    names = [x.split()[0] for x in _ANSWER.split(", ")]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _scored(texts: pa.Table, answers: pa.Table, shards: int, hot: np.ndarray, total: int, distinct: int) -> pa.Table:
    block = Block(texts["text"], shards, hot)
    count = np.zeros(len(block.words), np.int64)
    weight, share = np.ones(len(block.context)), np.zeros(len(block.context))
    at = {shard: i for i, shard in enumerate(answers["shard"].to_pylist())}
    for shard, w, p in block.parts():
        row = answers.slice(at[shard], 1)
        count[w] = _many(row, "counts", "<i8")[0]
        _, runs = block.runs(p)
        weight[p] = np.repeat(probability(_many(row, "backoff", "<u2")[0], 1.0), runs)
        share[p] = probability(_many(row, "codes", "<u2")[0], 0.0)
    unigram = (count + 1.0) / (total + distinct + 1.0)
    bigram = np.log10(share + weight * unigram[block.pair_word])
    n = len(block.sizes)
    return pa.table(
        [
            texts["doc_id"], texts["held"], pa.array(block.sizes), pa.array(np.bincount(block.text_of, (count > 0)[block.word], n).astype(np.int64)),
            pa.array(np.bincount(block.text_of, np.log10(unigram)[block.word], n)), pa.array(np.bincount(block.text_of, bigram[block.pair], n)),
        ],
        [x.split()[0] for x in _SCORED.split(", ")],
    )


def _counted(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """Training counts of the distinct words of each batch, packed by shard."""
    for batch in batches:
        token, _ = _tokens(batch.column(0))
        index, unique = pd.factorize(token)
        counts, shard = np.bincount(index, minlength=len(unique)), (unique % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        for run in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else []:
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(shard[run[0]])]), pa.array([unique[run].tobytes()], pa.binary()), pa.array([counts[run].astype(np.uint32).tobytes()], pa.binary())],
                ["shard", "words", "counts"],
            )


def _sizes(table: pa.Table) -> pa.Table:
    keys, counts = _summed(np.concatenate(_many(table, "words", "<u8")), np.concatenate(_many(table, "counts", "<u4")).astype(np.int64))
    top = np.argsort(-counts, kind="stable")[:HOT]
    return pa.table(
        [pa.array([len(keys)]), pa.array([int(counts.sum())]), pa.array([keys[top].view(np.int64)], pa.list_(pa.int64())), pa.array([counts[top]], pa.list_(pa.int64()))],
        ["distinct", "total", "words", "counts"],
    )


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row for every row of docs.

    docs: doc_id, text; other columns are ignored. Tokens are lower-cased (A-Z) words `[^\\x20\\x09-\\x0D]+` and an end.
    The model learns from the documents that aren't held out; a null id counts as the empty text there. base_score is
    the smoothed unigram score, score the log10 probability under
        p(w | v) = (c(v w) + PRIOR * u(w)) / (c(v) + PRIOR), u(w) = (c(w) + 1) / (N + V + 1),
    with both parts of the sum quantised. A null or empty text is its end alone. Repeated rows are scored, and counted,
    each for itself. Nothing is pruned.

    Texts are dealt into blocks of bounded size. A block asks each shard about its distinct words and bigrams, with
    their counts in its training texts; a shard adds the counts of all blocks, builds its trie, and answers every
    block in order. Only hashes and codes travel. A context with a large share of all tokens is spread over the shards
    by its successors; the list of those is bounded by its definition. Words are 64-bit hashes, successors 40 bits.
    """
    docs = with_package(docs)
    id_ = F.col("doc_id").cast("long")
    held = F.pmod(F.crc32(F.coalesce(id_.cast("string"), F.lit(""))), F.lit(FOLDS)) == HELD
    rows = docs.select(id_.alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), held.alias("held"))
    size, n = rows.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    shards = max(1, -(-int(size or 0) // (6 * SHARD_TOKENS)))
    blocks = max(1, -(-int(size or 0) // BLOCK_BYTES))

    counted = rows.where(~F.col("held")).select("text").mapInArrow(lambda b: _counted(b, shards), "shard long, words binary, counts binary")
    parts = reliable(counted.groupBy("shard").applyInArrow(_sizes, "distinct long, total long, words array<long>, counts array<long>"))
    distinct, total = (int(x or 0) for x in parts.agg(F.sum("distinct"), F.sum("total")).first())
    words_ = parts.select(F.explode(F.arrays_zip("words", "counts")).alias("w"))
    hot = {w % 2**64: c for w, c in words_.where(F.col("w.counts") * HOT > total).select("w.words", "w.counts").collect()}
    texts = rows.where(~F.col("held")).count()
    if texts * HOT > total:
        hot[int(_BEGIN)] = texts
    hot_words = np.array(sorted(hot), np.uint64)

    # The same exchange serves the asking and the scoring.
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    asked = dealt.groupBy("block").applyInArrow(lambda t: _asked(t, shards, hot_words), _ASK)
    answers = asked.groupBy("shard").applyInArrow(lambda t: _answered(t, hot), _ANSWER)
    scored = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        lambda t, a: _scored(t, a, shards, hot_words, total, distinct), _SCORED
    )
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
