from __future__ import annotations

import hashlib
import random
import struct
import sys
from pathlib import Path

import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
from rows import none, odd

from corpuscle.llm import bpe, queries

TEXTS = ["", "hello world", "<|endoftext|>", "a<|endoftext|>b <|startoftext|>", "  leading", "tabs\t\tand\n\nlines \r\n", "I'm you'll we've DON'T", "naïve café ÅÄÖ ß ŒΣΑΣ İstanbul ﬁ", "日本語のテキスト 한국어", "😀👍🏽", "1234567890 12,345.67", "x" * 5000, "   　z", "Áé", "\x00\x01\x7f", "don't  stop   ", "ΑΣ ΣΑΣ.", "ǅ Dž İı", "a�b"]


def library(name: str) -> Tokenizer:
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return t


@pytest.mark.parametrize("name", [queries.BYTE_BPE, queries.WORD_BPE])
def test_ids_are_the_library_s(name):
    path, own = public_tokenizers.path(name), library(name)
    rng = random.Random(2)
    odd_chars = [chr(c) for c in (*range(0x20, 0x250), *range(0x370, 0x400), 0x1E9E, 0x2126, 0x212A, 0x2028, 0x3042, 0x1F600, 0x301)]
    for text in [*TEXTS, *("".join(rng.choices(odd_chars, k=40)) for _ in range(300))]:
        ids = bpe.encode_text(path, text)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == own.encode(text, add_special_tokens=False).ids, repr(text)


def test_decoding_is_the_library_s_and_exact():
    path, own = public_tokenizers.path(queries.BYTE_BPE), library(queries.BYTE_BPE)
    for text in TEXTS:
        ids = bpe.encode_text(path, text)
        numbers = list(struct.unpack(f"<{len(ids) // 4}I", ids))
        assert bpe.decode_ids(path, ids) == own.decode(numbers, skip_special_tokens=False) == text
    assert bpe.decode_ids(path, struct.pack("<II", 4_000_000_000, 31373)) == own.decode([31373])


def test_whole_table_round_trip(spark, tiny):
    own = library(queries.BYTE_BPE)
    expected = []
    for r in spark.read.parquet(f"{tiny}/documents.parquet").collect():
        ids = own.encode(r["text"] or "", add_special_tokens=False).ids
        decoded = own.decode(ids, skip_special_tokens=False)
        expected.append((r["doc_id"], len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(tuple, queries.op4_bpe(spark, tiny).collect())) == sorted(expected)


def test_whole_table_counts(spark, tiny):
    own = library(queries.WORD_BPE)
    expected = []
    for r in spark.read.parquet(f"{tiny}/documents.parquet").collect():
        n = len(own.encode(r["text"] or "", add_special_tokens=False).ids)
        expected.append((r["doc_id"], len((r["text"] or "").encode()), n, n > 2048))
    assert sorted(map(tuple, queries.op7_token_counts(spark, tiny).collect())) == sorted(expected)


def test_whole_tokens_encode_alone_as_one():
    own = library(queries.WORD_BPE)
    whole = sorted(bpe.load(public_tokenizers.path(queries.WORD_BPE)).whole_tokens())
    assert len(whole) > 20_000
    for token in random.Random(1).sample(whole, 2000):
        assert len(own.encode(token, add_special_tokens=False).ids) == 1, token


def test_odd_rows(spark):
    path = public_tokenizers.path(queries.BYTE_BPE)
    docs = odd(spark)
    texts = sorted((str(r["doc_id"]), r["text"] or "") for r in docs.collect())
    assert sorted((str(r["doc_id"]), r["text"]) for r in bpe.decode(bpe.encode(docs, path), path).collect()) == texts
    assert bpe.count_tokens(docs, path).count() == docs.count()
    assert bpe.encode(none(spark), path).count() == bpe.count_tokens(none(spark), path).count() == 0
    nulls = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert bpe.decode(nulls, path).first()["text"] == ""


def test_round_trip_needs_one_python_worker_a_task(spark):
    path = public_tokenizers.path(queries.BYTE_BPE)
    docs = odd(spark)
    plan = queries.round_trip(docs.select("doc_id", "text"), path)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    own = bpe.encode(docs, path, decoded="back")
    two = bpe.decode(bpe.encode(docs, path), path, text_col="back")
    assert sorted(map(str, own.select(*two.columns).collect())) == sorted(map(str, two.collect()))
