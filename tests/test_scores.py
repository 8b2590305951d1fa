"""Scores where the chunks are, against those by shuffle."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuscle.operators import bm25_scores, retrieval
from corpuscle.plans import q_retrieval as q


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


RANKED = ("query_id", "rank", "pk", "score")


def by_shuffle(questions, chunks, k):
    return retrieval.top_k(retrieval.bm25(questions, chunks, None).drop("rank"), k)


@pytest.mark.parametrize("columns, cells, shared, k", [(256, 1 << 21, 8, 10), (7, 5000, 2, 3), (1, 1, 0, 60)])
def test_scores_in_place(spark, tiny, monkeypatch, columns, cells, shared, k):
    for name, value in (("COLUMNS", columns), ("CELLS", cells), ("SHARED", shared)):
        monkeypatch.setattr(bm25_scores, name, value)
    chunks, questions = q.chunks(spark, tiny).where("cast(doc_id AS long) % 4 = 0"), q.benchmark_queries(spark, tiny)
    questions = questions.limit(25).unionByName(q.DOC_NAMES.df(spark).selectExpr("query_id - 100 AS query_id", "q"))
    assert rows(retrieval.bm25(questions, chunks, k), *RANKED) == rows(by_shuffle(questions, chunks, k), *RANKED)


def test_odd_chunks(spark):
    """Copies, one key on several rows, null, empty and unknown texts; questions without words; text ids; ties at the cut."""
    own = [(f"d{i:03}", "iron rusts in rain") for i in range(100)] + [("d007", "iron rusts in rain"), ("e", None), ("f", ""), ("g", "图 iron 图 3"), (None, "rain rain"), ("h", "x")]
    chunks = spark.createDataFrame(own, "pk string, content string").repartition(5)
    questions = spark.createDataFrame([("a", "iron rain rain"), ("b", "图"), ("c", None), ("d", "nowhere")], "query_id string, q string")
    for k in (1, 5, 200):
        assert [str(r) for r in retrieval.bm25(questions, chunks, k).orderBy("query_id", "rank").collect()] == [str(r) for r in by_shuffle(questions, chunks, k).orderBy("query_id", "rank").collect()]
    assert retrieval.bm25(questions.where("query_id = 'c'"), chunks, 3).count() == 0
    assert retrieval.bm25(questions, chunks.where("false"), 3).count() == 0


def test_no_pair_is_shuffled(spark, tiny):
    """What meets the window that ranks is at most k rows for each question and task."""
    chunks, questions = q.chunks(spark, tiny).repartition(4), q.benchmark_queries(spark, tiny)
    plan = retrieval.bm25(questions, chunks, 5)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan.split("== Physical Plan ==")[1] and "HashAggregate" not in plan.split("== Physical Plan ==")[1]


def test_hits_go_to_their_chunks(spark, tiny):
    chunks = q.chunks(spark, tiny)
    hits = retrieval.bm25(q.benchmark_queries(spark, tiny), chunks, 5)
    both = retrieval.with_chunks(hits, chunks.select("pk", "content"))
    assert "BroadcastHashJoin" in both._jdf.queryExecution().toString() and both.count() == hits.count()
    assert both.where(F.col("content").isNull()).isEmpty()


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_of_chunks_with_vectors(spark, tiny, monkeypatch):
    """The rows of the chunks with vectors, without a shuffle of texts; also with ids that are not sent to the chunks."""
    want = rows(q.vector_chunks(spark, tiny), "pk", "content")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert "Exchange hashpartitioning" not in physical(q.worded_chunks(spark, tiny))
        assert rows(q.worded_chunks(spark, tiny), "pk", "content") == want
        monkeypatch.setattr(q, "BROADCAST_IDS", 0)
        assert rows(q.worded_chunks(spark, tiny), "pk", "content") == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("most", [1, 40, 1 << 19])
def test_words_taken_together(spark, tiny, monkeypatch, most):
    chunks, questions = q.chunks(spark, tiny).where("cast(doc_id AS long) % 9 = 0"), q.benchmark_queries(spark, tiny).limit(8)
    want = rows(by_shuffle(questions, chunks, 4), *RANKED)
    monkeypatch.setattr(bm25_scores, "WORDS", most)
    assert rows(retrieval.bm25(questions, chunks, 4), *RANKED) == want


def test_parts_have_all_rows():
    lists = pa.array([[1, 2, 3], [], [4], None, [5, 6, 7, 8], [9]], pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), lists], names=["n", "l"])
    assert [p.column(0).to_pylist() for p in bm25_scores._parts(batch, 1, 4)] == [[0, 1, 2, 3], [4], [5]]
    assert [p.num_rows for p in bm25_scores._parts(batch, 1, 100)] == [6] and not list(bm25_scores._parts(batch.slice(6), 1, 4))
