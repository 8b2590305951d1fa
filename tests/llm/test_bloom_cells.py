"""The way by shuffle with as many cells as a large corpus has: work per row of text must not grow with their number."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from test_bloom_lm import brute, same

from corpuscle.llm import bloom_lm, queries


@pytest.mark.parametrize("cells", [1, 7, 1250, 1 << 20])
def test_rows_are_cut_at_the_ends_of_cells(cells):
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 64, 5000, np.uint64))
    own, parts = bloom_lm._by_cell(keys, keys, cells)
    cell = bloom_lm.cell_of(keys, cells)
    assert own == np.unique(cell).tolist()
    assert [np.frombuffer(p, "<u8").tolist() for p in parts] == [keys[cell == c].tolist() for c in own]
    assert bloom_lm._by_cell(keys[:0], keys[:0], cells) == ([], [])
    like = pa.chunked_array([pa.array(parts, pa.binary())])
    assert [len(x) for x in bloom_lm._cut(b"x" * len(keys), like, 8, 1).to_pylist()] == [len(p) // 8 for p in parts]


def test_cutting_takes_no_pass_over_the_keys_for_each_cell():
    keys = np.unique(np.random.default_rng(2).integers(0, 1 << 64, 300_000, np.uint64))
    took = []
    for cells in (50, 5000):
        began = time.process_time()
        for _ in range(5):
            bloom_lm._by_cell(keys, keys, cells)
        took.append(time.process_time() - began)
    assert took[1] < 20 * took[0]


def test_more_cells_than_rows_of_text(spark, tiny, monkeypatch):
    monkeypatch.setattr(bloom_lm, "CELL_BYTES", 500)
    monkeypatch.setattr(bloom_lm, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(bloom_lm, "BLOCK_ROWS", 16)
    table = spark.read.parquet(f"{tiny}/documents.parquet").limit(60).localCheckpoint()
    docs = [tuple(r) for r in table.select("doc_id", "text").collect()]
    same([tuple(r) for r in queries.language_scores(table, 400).collect()], brute(docs), 1e-4)
