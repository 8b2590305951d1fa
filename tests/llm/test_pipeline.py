from __future__ import annotations

import hashlib
import struct
import sys
from pathlib import Path

import public_tokenizers
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
import corpus_pipeline as pipeline
from rows import odd
from test_decontaminate import brute
from test_near_copies import brute_kept

from corpuscle.llm import pii, queries


def test_stages_against_brute_force(spark, tiny):
    items = [tuple(r) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").select("item_id", "text").collect()]
    read = spark.read.parquet(f"{tiny}/documents.parquet")
    stages = [f for _, f in pipeline.STAGES]
    good = stages[0](spark, read, tiny).cache()
    assert good.columns == read.columns
    docs = {r["doc_id"]: r["text"] for r in good.collect()}
    assert 0 < len(docs) < read.count()

    kept = {int(i) for i in brute_kept([*docs.items()])}
    assert len(kept) < len(docs)
    docs = {i: t for i, t in docs.items() if i in kept}
    bad = {int(i) for i, *_ in brute([*docs.items()], items, 0.8)}
    docs = {i: t for i, t in docs.items() if i not in bad}
    docs = {i: pii.redacted(t, pii.find(t)) for i, t in docs.items()}
    own = Tokenizer.from_file(public_tokenizers.path(queries.BYTE_BPE))
    expected = []
    for i, t in docs.items():
        ids = own.encode(t, add_special_tokens=False).ids
        expected.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(map(tuple, pipeline.run(spark, tiny).collect())) == sorted(expected)


def test_odd_rows_and_columns_pass_every_stage(spark, tiny):
    docs = odd(spark).withColumnRenamed("id", "n_chars").withColumnRenamed("words", "Words").withColumnRenamed("fp", "__Score")
    for _, stage in pipeline.STAGES[:-1]:
        docs2 = stage(spark, docs, tiny)
        assert docs2.columns == docs.columns
        docs2.collect()
        assert stage(spark, docs.where("false"), tiny).count() == 0
