"""Byte-level BPE against the library, on random pre-tokens, awkward texts and whole documents."""

from __future__ import annotations

import base64
import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from quayline.llm import byte_bpe
from quayline.llm.queries import op13_byte_bpe

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id bigint, text string, ids string, n_tokens string"


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(MULTI), special_tokens={})


def test_pretokens_encode_as_in_the_library(library):
    r, tokens = random.Random(5), list(ranks(MULTI))
    parts = [bytes(r.choice(b"abtheing xx\xc3\xa9\xe6\x97") for _ in range(r.randint(1, 40))) for _ in range(4000)]
    parts += [b"".join(r.choice(tokens) for _ in range(r.randint(2, 6))) for _ in range(4000)] + [b"a" * k for k in range(1, 200)] + [b"ab" * k for k in range(1, 99)]
    got = byte_bpe.codec(MULTI).merges.encode(parts)
    assert all(g == library._encode_single_piece(p) for g, p in zip(got, parts, strict=True))


def test_memory_of_pairs_and_pretokens_is_bounded(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MOST_PAIRS", 50)
    monkeypatch.setattr(byte_bpe, "MOST_PRETOKENS", 20)
    coder, r = byte_bpe.Codec(MULTI), random.Random(1)
    for _ in range(20):
        text = " ".join("".join(r.choice("abcdeing") for _ in range(8)) for _ in range(15))
        assert coder.encode([text])[0].tolist() == library.encode_ordinary(text)
    assert len(coder.merges.memo) <= 50


def test_time_is_linear_in_long_pretokens():
    coder = byte_bpe.Codec(MULTI)
    for unit in ("x", "ab", " ", "é", "thethe"):
        begun = time.time()
        ids, _ = coder.encode([unit * 200_000])
        assert coder.decode(ids).decode() == unit * 200_000 and time.time() - begun < 8


def test_rank_files_without_all_bytes_are_refused(tmp_path):
    path = tmp_path / "few.tiktoken"
    path.write_bytes(base64.b64encode(b"a") + b" 0\n")
    with pytest.raises(ValueError, match="are no tokens"):
        byte_bpe.Merges(str(path))


def test_documents_with_awkward_rows(spark, library):
    odd = [None, "", " ", "\n\n \n", "it's 'LL 're 123abc", "日本語 テスト", "😀👩‍👩‍👧 é", "<|endoftext|>", "ᲉꟋ letters of Unicode 16 \U00010d40", "x" * 70_000, "same", "same", "\x00\x01�", "tab\tend ", "a b　c"]
    rows = [(i, t, "clash", "clash") for i, t in enumerate(odd)] + [(None, "no id", None, None), (3, " \n\n", None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)

    def wanted(text: str | None) -> tuple[int, str, str]:
        ids = library.encode_ordinary(text or "")
        return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode_bytes(ids)).hexdigest()

    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.bpe_digest(docs, MULTI).collect())
    assert got == sorted((str(i), *wanted(t)) for i, t, *_ in rows)
    encoded = byte_bpe.encode_documents(docs, MULTI)
    assert sorted((str(r.doc_id), r.ids) for r in encoded.collect()) == sorted((str(i), library.encode_ordinary(t or "")) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), bytes(r.data).decode()) for r in byte_bpe.decode_documents(encoded, MULTI).collect()) == sorted((str(i), t or "") for i, t, *_ in rows)
    assert byte_bpe.bpe_digest(docs.limit(0), MULTI).collect() == []


def test_query_on_whole_documents(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = {r.doc_id: r for r in op13_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    assert rows.keys() == texts.keys()
    for i, text in texts.items():
        ids = library.encode_ordinary(text)
        assert (rows[i].n_tokens, rows[i].ids_sha256, rows[i].decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
