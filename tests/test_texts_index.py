"""The index without its postings: searched where its texts are, made without a shuffle of them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from test_scores import physical, rows

from corpuscle.operators import bm25_scores, lexical_index, retrieval
from corpuscle.plans import q_quality
from corpuscle.plans import q_retrieval as q
from corpuscle.sources.chunks import from_documents


@pytest.mark.parametrize("block, shard, k", [(128, 1 << 16, 10), (4, 8, 3)])
def test_search_by_blocks_and_in_place(spark, tiny, monkeypatch, block, shard, k):
    monkeypatch.setattr(lexical_index, "BLOCK_ROWS", block)
    monkeypatch.setattr(lexical_index, "SHARD_ROWS", shard)
    chunks, questions = q.chunks(spark, tiny), q.benchmark_queries(spark, tiny).limit(15)
    index = lexical_index.build(chunks)
    for types in (None, ("summary", "title"), ("no such type",)):
        part = chunks if types is None else chunks.where(F.col("type").isin(*types))
        want = rows(retrieval.top_k(retrieval.bm25(questions, part, None).drop("rank"), k), "query_id", "rank", "pk", "score")
        assert rows(lexical_index.search(questions, index, k, types), "query_id", "rank", "pk", "score") == want
        monkeypatch.setattr(retrieval, "BROADCAST_TERMS", 0)
        assert rows(lexical_index.search(questions, index, k, types), "query_id", "rank", "pk", "score") == want
        monkeypatch.undo()


def test_postings_are_made_only_for_a_search_by_blocks(spark, tiny):
    index = lexical_index.build(q.chunks(spark, tiny))
    lexical_index.search(q.benchmark_queries(spark, tiny), index, 3).collect()
    assert "blocks" not in vars(index)


def test_texts_are_counted_where_they_are(spark, tiny):
    chunks = q.chunks(spark, tiny)
    own = bm25_scores.counted(chunks.select("pk", "doc_id", "type", lexical_index.text.tokens(F.col("content")).alias("t")), "t")
    assert "Exchange" not in physical(own)
    want = retrieval.postings(chunks)
    got = own.select("pk", "dl", F.explode("terms").alias("x"))
    assert rows(got, "pk", "x.term", "x.tf", "dl") == rows(want, "pk", "term", "tf", "dl")


def test_scopes_in_place_and_by_shuffle(spark, tiny, monkeypatch):
    chunks, questions, scope = q.chunks(spark, tiny), q.benchmark_queries(spark, tiny), q._named(spark, tiny)
    index = lexical_index.build(chunks)
    got = lexical_index.scoped_search(questions, index, scope, 4, ("text", "equation"))
    assert "askers" in physical(got)
    want = rows(got, "query_id", "rank", "pk", "score")
    monkeypatch.setattr(retrieval, "BROADCAST_TERMS", 0)
    assert rows(lexical_index.scoped_search(questions, index, scope, 4, ("text", "equation")), "query_id", "rank", "pk", "score") == want


def test_copies_of_a_document_count_once_each(spark):
    """Two rows with one key are one chunk with the words of both, and two for the statistics, as in the SQL."""
    docs = spark.createDataFrame([(1, "iron rusts\nrain", "en", "s"), (1, "iron rusts\nrain", "en", "s"), (2, "iron\n\nrain rain", "en", "s")], "doc_id long, text string, lang string, source string")
    chunks = from_documents(docs)
    index = lexical_index.build(chunks)
    assert index.sizes.agg(F.sum("n")).first()[0] == chunks.count() == 6 and index.texts.count() == 4
    questions = spark.createDataFrame([(1, "iron rain")], "query_id int, q string")
    want = retrieval.top_k(retrieval.bm25(questions, chunks, None).drop("rank"), 3)
    assert rows(lexical_index.search(questions, index, 3), "rank", "pk", "score") == rows(want, "rank", "pk", "score")


def test_hits_are_searched_for_once_in_a_rollup(spark, tiny, monkeypatch):
    seen = []
    found = q_quality.hits
    monkeypatch.setattr(q_quality, "hits", lambda *a: seen.append(1) or found(*a))
    assert q_quality.eval_rollup(spark, tiny).count() and len(seen) == 1
