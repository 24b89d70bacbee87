"""Token counts and token files against the tokenizers library, and exact round trips."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sitegauge.llm import pretokens, token_counts, token_files
from sitegauge.llm.wordarrays import text_chunks

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["'s", "'ll", "'", "s", "T", "re", " ", "  ", "\n", "\t", " ", "a", "É", "12", "²", "!?", "<|endoftext|>", "<|", "中", "😀", "́", "\x00", "\x85", "　", "﻿"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_counts_and_ids_of_random_texts(library):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 25))) for _ in range(4000)]
    p = pretokens.Pretokens(PATH)
    for limit in (300, 1 << 22):
        at = 0
        for _, end, data, offsets in text_chunks(pa.array(texts), limit):
            want = [library.encode(t, add_special_tokens=False).ids for t in texts[at:end]]
            assert p.counts(data, offsets).tolist() == [len(w) for w in want]
            assert p.encode(data, offsets)[0].tolist() == [i for w in want for i in w]
            at = end


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(pretokens, "MEMORY", 3)
    p = pretokens.Pretokens(PATH)
    for text in ("hello there you", "hello again, world", "hello there you"):
        (_, _, data, offsets), = text_chunks(pa.array([text]))
        assert p.encode(data, offsets)[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_token_counts_of_odd_rows(documents, odd_rows, library):
    got = token_counts.token_counts(documents(odd_rows)).collect()
    want = sorted(((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in odd_rows), key=str)
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=str) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got) and any(r.over_limit for r in got)
    assert token_counts.token_counts(documents([])).count() == 0


def test_planes_round_trip():
    rnd = np.random.default_rng(1)
    for ids in ([], [0], [50256], list(range(70000)), rnd.integers(0, 2**32, 1001).tolist(), [0] * 65536):
        ids = np.array(ids, np.uint32)
        at, payload = token_files.planes_of(ids)
        assert len(at) == 33 and at[-1] == len(payload)
        assert (token_files.ids_of(at, payload, len(ids)) == ids).all()


def test_joined_checksums():
    a, b = b"some bytes", b"and " * 5000
    assert token_files.crc_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert token_files.crc_joined(0, zlib.crc32(b), len(b)) == zlib.crc32(b)


def test_token_files(spark, documents, odd_rows, library, tmp_path, monkeypatch):
    rows = odd_rows + [(100 + i, f"text number {i} " * (i % 40)) for i in range(200)]
    folder = str(tmp_path / "tokens")
    monkeypatch.setattr(token_files, "BLOCK_IDS", 1000)  # on the driver only; blocks of tasks keep their size
    token_files.write_tokens(documents(rows), folder)
    got = sorted(token_files.read_tokens(spark, folder).collect(), key=lambda r: r.start)
    assert sorted(((r.doc_id is not None, r.doc_id or 0) for r in got)) == [(r.doc_id is not None, r.doc_id or 0) for r in got]
    start = 0
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(i, []).append([*library.encode(t or "", add_special_tokens=False).ids, 0])
    for r in got:
        assert r.start == start
        fits = [ids for ids in texts[r.doc_id] if zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32]
        assert fits and r.n_tokens == len(fits[0])
        start += r.n_tokens
    pieces = sorted(token_files.read_ids(spark, folder).where("doc_id = 4").collect(), key=lambda r: (r.part, r.at, r.piece_at))
    assert [i for p in pieces for i in p.ids] == texts[4][0]


def test_no_documents(spark, documents, tmp_path):
    folder = str(tmp_path / "none")
    token_files.write_tokens(documents([]), folder)
    assert token_files.read_tokens(spark, folder).count() == 0


def test_a_document_over_several_blocks(spark, documents, library, tmp_path):
    text = " ".join(f"w{i * 7919 % 10007}" for i in range(120_000))
    ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
    assert len(ids) > 2 * token_files.BLOCK_IDS
    folder = str(tmp_path / "long")
    token_files.write_tokens(documents([(1, "short"), (2, text), (3, "after")]), folder)
    got = {r.doc_id: r for r in token_files.read_tokens(spark, folder).collect()}
    assert got[2].ids_crc32 == zlib.crc32(ids.tobytes()) and got[2].n_tokens == len(ids) and got[3].start == got[2].start + len(ids)
