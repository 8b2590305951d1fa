from __future__ import annotations

import math
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from rows import none, odd

from corpuscle.llm import bloom_lm, queries


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def brute(docs: list[tuple], prior: float = bloom_lm.PRIOR) -> list[tuple]:
    """Dictionaries instead of filters: the model's score by the levels of the true counts of words and pairs."""
    one, two, first = Counter(), Counter(), 0
    for i, t in docs:
        if not held_out(i):
            w = words_of(t) + [b""]
            one.update(w)
            two.update(zip([None, *w], w, strict=False))
            first += 1
    n, v = sum(one.values()), len(one)
    middle = lambda c: 0.0 if c == 0 else 1.0 if c == 1 else (3 * 2 ** (c.bit_length() - 1) - 1) / 2
    out = []
    for i, t in docs:
        w = words_of(t) + [b""]
        base = math.fsum(math.log10((one[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        total = 0.0
        for h, x in zip([None, *w], w, strict=False):
            p = min(1.0, (middle(one[x]) + 0.1) / (n + 0.1 * (v + 1)))
            before = middle(first if h is None else one[h])
            total += math.log10((min(middle(two[h, x]), before) + prior * p) / (before + prior))
        out.append((i, held_out(i), len(w), sum(one[x] > 0 for x in w), n, base, total))
    return out


def same(got: list[tuple], want: list[tuple], loose: float) -> None:
    key = lambda r: (str(r[0]), r[2], r[5])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)
    a, b, n = np.array([r[6] for r in got]), np.array([r[6] for r in want]), np.array([r[2] for r in want])
    assert np.abs(a - b).sum() <= loose * n.sum() + 1e-6


@pytest.mark.parametrize("way", ["broadcast", "shuffle"])
def test_against_true_counts(spark, tiny, monkeypatch, way):
    """A filter of many bits hardly ever errs, so the scores are those of the true counts; both ways."""
    monkeypatch.setattr(bloom_lm, "CELL_BYTES", 50_000)
    if way == "shuffle":
        monkeypatch.setattr(bloom_lm, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(bloom_lm, "BLOCK_ROWS", 16)
    table = spark.read.parquet(f"{tiny}/documents.parquet")
    docs = [tuple(r) for r in table.select("doc_id", "text").collect()]
    same([tuple(r) for r in queries.language_scores(table, 400).collect()], brute(docs), 1e-4)


def test_production_filter_and_held_out_texts(spark, tiny):
    docs = [tuple(r) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    out = queries.op11_bloom_lm(spark, tiny)
    assert out.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = [tuple(r) for r in out.collect()]
    same(got, brute(docs), 0.02)
    unseen = [r for r in got if r[1]]
    assert unseen and sum(r[6] for r in unseen) > sum(r[5] for r in unseen)  # the longer history helps


@pytest.mark.parametrize("limit", [bloom_lm.BROADCAST_BYTES, 0])
def test_odd_rows(spark, monkeypatch, limit):
    monkeypatch.setattr(bloom_lm, "BROADCAST_BYTES", limit)
    docs = odd(spark)
    same([tuple(r) for r in queries.language_scores(docs, 400).collect()], brute([(r["doc_id"], r["text"]) for r in docs.collect()]), 1e-3)
    assert queries.language_scores(none(spark)).count() == 0
    alone = spark.createDataFrame([(i, "only text held out") for i in range(200) if held_out(i)], "doc_id long, text string")
    got = [tuple(r) for r in queries.language_scores(alone).collect()]  # nothing to learn from
    assert got and all(r[3:5] == (0, 0) and abs(r[5]) < 1e-12 and abs(r[6]) < 1e-12 for r in got)


def test_levels_of_a_filter_err_upward_only():
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 1 << 63, 20_000).astype(np.uint64)
    counts = rng.zipf(1.5, 20_000).clip(1, 1 << 40)
    own = bloom_lm.Filter(words := bloom_lm.cell_filter(keys, counts), np.array([len(words)]))
    true, got = bloom_lm.levels(counts), own.level(keys)
    assert (got >= true).all() and (got > true).mean() < 0.02
    assert (own.level(rng.integers(0, 1 << 63, 20_000).astype(np.uint64)) > 0).mean() < 0.02


def test_longer_histories(spark):
    table = spark.createDataFrame([(k, "a b c a b d a b c") for k in range(6)] + [(9, None), (10, "c b a")], "doc_id long, text string")
    for limit in (bloom_lm.BROADCAST_BYTES, 0):
        scores = []
        for order in (1, 2, 3):
            old, bloom_lm.BROADCAST_BYTES = bloom_lm.BROADCAST_BYTES, limit
            rows = {r["doc_id"]: r for r in bloom_lm.score(table, bloom_lm.learn(table, order=order)).collect()}
            bloom_lm.BROADCAST_BYTES = old
            scores.append(rows[0]["score"])
            assert rows[10]["score"] < 0 and rows[9]["n_tokens"] == 1
        assert scores[0] < scores[1] < scores[2] < 0


def test_blocks_of_a_batch_have_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array([b"", b"12345678901", b"1234", b"123456", b"", b"1"], pa.binary())], names=["t"])
    assert [(a, b, len(t)) for a, b, t in bloom_lm._blocks(batch, 0, 10)] == [(0, 2, 2), (2, 4, 2), (4, 6, 2)]


def test_words_that_share_half_of_their_name():
    own = bloom_lm.Counts(np.array([5, 5, 5, 7], np.uint64), np.array([1, 2, 3, 1], np.uint32), np.array([10, 20, 40, 30]))
    assert own.of(np.array([5, 5, 5, 5, 7, 8], np.uint64), np.array([1, 2, 3, 4, 1, 1], np.uint32)).tolist() == [10, 20, 40, 0, 30, 0]
