"""Pre-tokens of byte-level BPE, found for many texts at once, and the pieces of each distinct one."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pandas as pd
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from sitegauge.llm.wordarrays import span_hashes

#: Distinct pre-tokens whose pieces a worker remembers before it starts anew.
MEMORY = 300_000

_LETTER, _DIGIT, _SPACE, _OTHER = 1, 2, 3, 4
# The endings that the pre-token pattern takes off after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point, as the library's own pre-tokenizer sees it.

    The code points in order, without blank and apostrophe, are texts of a few thousand; each of their pre-tokens is of
    one class.
    """
    out = np.full(0x110000, _OTHER, np.uint8)
    out[0x20] = _SPACE
    byte_level = ByteLevel(add_prefix_space=False)
    for low in range(0, 0x110000, 0x1000):
        at = np.arange(low, low + 0x1000, dtype=np.uint32)
        at = at[(at != 0x20) & (at != 0x27) & ((at < 0xD800) | (at >= 0xE000))]
        if not len(at):
            continue
        every = at.tobytes().decode("utf-32-le")
        for _, (a, b) in byte_level.pre_tokenize_str(every):
            for kind, before in ((_LETTER, "a"), (_DIGIT, "1"), (_OTHER, "!")):
                if len(byte_level.pre_tokenize_str(before + every[a])) == 1:
                    break
            else:
                kind = _SPACE
            out[at[a:b]] = kind
    return out


def starts_of(points: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Marks the first code point of each pre-token. cuts: where a text (or a part taken by itself) begins."""
    n = len(points)
    kind = classes()[points]
    first = np.zeros(n, bool)
    first[cuts[cuts < n]] = True
    last = np.zeros(n, bool)
    last[-1] = True
    last[cuts[(cuts > 0) & (cuts < n)] - 1] = True
    before = np.concatenate([[np.uint8(0)], kind[:-1]])
    before[first] = 0
    after = np.concatenate([kind[1:], [np.uint8(0)]])
    after[last] = 0
    space = kind == _SPACE
    blank = points == 0x20
    led = np.concatenate([[False], blank[:-1]]) & ~first  # the blank before goes with what follows
    starts = np.where(space, (before != _SPACE) | ((after != 0) & (after != _SPACE)), (before != kind) & ~led)
    # Endings after an apostrophe that begins a pre-token.
    mark = np.flatnonzero((points == 0x27) & starts & ~led)
    text = np.concatenate([points, np.zeros(2, points.dtype)])
    ends = np.concatenate([last, np.ones(2, bool)])
    for ending in ENDINGS:
        fits = ~ends[mark]
        for j, c in enumerate(ending, 1):
            fits &= text[mark + j] == ord(c)
            if j < len(ending):
                fits &= ~ends[mark + j]
        hit = mark[fits]
        starts[hit + 1] = False
        next_ = hit + len(ending) + 1
        inside = ~ends[hit + len(ending)]
        starts[next_[inside]] = True
        mark = mark[~fits]
    return starts


class Pretokens:
    """One tokenizer file: pre-tokens of texts, and their pieces as the file's own BPE model gives them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        known = {k: v for k, v in (spec["pre_tokenizer"] or {}).items() if k in plain}
        if spec["model"]["type"] != "BPE" or known != plain or spec["normalizer"] or any(
            t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")
        ):
            raise ValueError("only byte-level BPE with the default pattern and plain added tokens is supported")
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.model = Tokenizer.from_file(path).model
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.sizes, self.at, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def split(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start of each pre-token, special id or -1, index of each text's first pre-token with the total last)."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        raw = data.tobytes()
        at = np.flatnonzero((data & 0xC0) != 0x80)
        points = np.frombuffer(raw.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        special = []
        for content, id_ in self.special.items():
            i = raw.find(content)
            while i >= 0:
                # Not across two texts.
                if offsets[np.searchsorted(offsets, i, "right")] >= i + len(content):
                    special.append((i, i + len(content), id_))
                i = raw.find(content, i + len(content))
        cuts = np.unique(np.concatenate([offsets[:-1], [x for s in special for x in s[:2]]]).astype(np.int64))
        starts = starts_of(points, np.searchsorted(at, cuts[cuts < len(data)]))
        for a, b, _ in special:
            i, j = np.searchsorted(at, [a, b])
            starts[i + 1 : j] = False
        begin = at[starts]
        ids = np.full(len(begin), -1)
        for a, _, id_ in special:
            ids[np.searchsorted(begin, a)] = id_
        return begin, ids, np.searchsorted(begin, offsets)

    def distinct(self, data: np.ndarray, begin: np.ndarray, special: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in this object's memory of each distinct pre-token, index of each pre-token's distinct one).

        The pieces of a distinct pre-token that is not remembered are looked up once.
        """
        ends = np.concatenate([begin[1:], [len(data)]])
        hashes = span_hashes(data, begin, ends)
        hashes[special >= 0] ^= np.uint64(0x5555)
        index, unique = pd.factorize(hashes)
        where = np.empty(len(unique), np.int64)
        where[index[::-1]] = np.arange(len(index))[::-1]
        if len(self.known) > MEMORY:
            self.forget()
        keys = unique.tolist()
        place = np.array([self.known.get(k, -1) for k in keys])
        new = np.flatnonzero(place < 0)
        raw, tokenize, letters = data.tobytes(), self.model.tokenize, self.letters
        pieces = [
            [id_] if id_ >= 0 else [t.id for t in tokenize(raw[a:b].decode("latin-1").translate(letters))]
            for a, b, id_ in zip(begin[where[new]].tolist(), ends[where[new]].tolist(), special[where[new]].tolist(), strict=True)
        ]
        place[new] = np.arange(len(self.known), len(self.known) + len(new))
        self.known.update(zip(unique[new].tolist(), place[new].tolist(), strict=True))
        sizes = np.array([len(p) for p in pieces], np.int64)
        self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(sizes) - sizes])
        self.ids = np.concatenate([self.ids, np.array([i for p in pieces for i in p], np.uint32)])
        self.sizes = np.concatenate([self.sizes, sizes])
        return place, index

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text: the frequency of each distinct pre-token in it, times its number of pieces."""
        begin, special, first = self.split(data, offsets)
        if not len(begin):
            return np.zeros(len(offsets) - 1, np.int64)
        place, index = self.distinct(data, begin, special)
        text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        pairs, frequency = np.unique(text_of * len(place) + index, return_counts=True)
        text, distinct = np.divmod(pairs, len(place))
        return np.bincount(text, frequency * self.sizes[place][distinct], len(offsets) - 1).astype(np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        begin, special, first = self.split(data, offsets)
        if not len(begin):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        place, index = self.distinct(data, begin, special)
        size, at = self.sizes[place][index], self.at[place][index]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(at - total[:-1], size) + np.arange(total[-1])]
        return ids, total[first[1:]] - total[first[:-1]]


@lru_cache(2)
def of_file(path: str) -> Pretokens:
    """One for each worker, kept from task to task."""
    return Pretokens(path)
