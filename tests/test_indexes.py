"""The stored indexes against the searches without one."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.operators import lexical_index, retrieval, vector_index
from corpuscle.plans import q_retrieval as q


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def made(spark, n=6000, size=16, clusters=30):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(clusters, size)) * 2
    own = centres[rng.integers(0, clusters, n)] + rng.normal(size=(n, size))
    own[::3] = own[0]  # a third is one vector
    return spark.createDataFrame([(i, [float(x) for x in v], int(i % 50)) for i, v in enumerate(own)], "pk long, embedding array<double>, label int")


@pytest.fixture(scope="module")
def vectors(spark):
    return made(spark).cache()


@pytest.fixture(scope="module")
def index(vectors):
    return vector_index.build(vectors)


@pytest.fixture(scope="module")
def asked(vectors):
    return vectors.where("pk % 40 = 1").selectExpr("pk AS query_id", "embedding AS q_vec")


def test_index_holds_every_row_in_the_partition_of_its_cell(spark, index, vectors):
    assert index.rows(spark).count() == vectors.count() == index.sizes.sum()
    assert index.probes < len(index.means)
    for r in index.rows(spark).select("__cell", "embedding").limit(300).collect():
        assert r["__cell"] == np.argmin(((index.means - np.array(r["embedding"])) ** 2).sum(axis=1))
    plan = index.rows(spark).where(F.col("__cell").isin([1, 2]))._jdf.queryExecution().toString()
    assert "PartitionFilters: [__cell" in plan


def test_recall_and_exact_answers(vectors, index, asked):
    true = retrieval.dense(asked, vectors, 10).cache()
    assert vector_index.recall(vector_index.search(asked, index, 10), true, "pk") >= 0.9
    columns = ("query_id", "rank", "pk", "score")
    for probes in (1, None):
        assert rows(vector_index.search(asked, index, 10, exact=True, probes=probes), *columns) == rows(true, *columns)


def test_filters_are_applied_before_the_best_are_taken(vectors, index, asked):
    few = F.col("label") == 7  # 120 rows, spread over all cells
    true = retrieval.dense(asked, vectors.where(few), 10).cache()
    got = vector_index.search(asked, index, 10, few).cache()
    assert got.count() == true.count()  # questions that find too few go on to all cells
    assert vector_index.recall(got, true, "pk") >= 0.9
    assert rows(vector_index.search(asked, index, 10, few, exact=True), "query_id", "pk", "rank") == rows(true, "query_id", "pk", "rank")
    assert vector_index.search(asked, index, 10, F.col("label") == 99).count() == 0


def test_questions_in_blocks(vectors, index, asked, monkeypatch):
    true = rows(retrieval.dense(asked, vectors, 5), "query_id", "rank", "pk")
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 40)
    assert rows(vector_index.search(asked, index, 5, exact=True), "query_id", "rank", "pk") == true


def test_odd_vectors(spark):
    table = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [0.0, 2.0]), (5, [1.0, 2.0, 3.0]), (6, [0.5, 0.0])], "pk long, embedding array<double>")
    ask = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id long, q_vec array<double>")
    got = rows(vector_index.search(ask, vector_index.build(table), 2, exact=True), "query_id", "rank", "pk", "score")
    assert got == [(1, 1, 1, 1.0), (1, 2, 6, 0.5)]
    assert vector_index.search(ask, vector_index.build(table.where("false")), 2).count() == 0


def test_recall_over_all_given_vectors(spark):
    """Vectors without clusters, as the given tables have them, and filters: measured on the largest table."""
    d = "/root/testdata/sf0.1"
    index, ask, own = q.vectors_index(spark, d), q.query_vectors(spark, d), q.table(spark, d, "embeddings")
    assert vector_index.recall(vector_index.search(ask, index, 10), retrieval.dense(ask, own, 10, "vec_id"), "vec_id") >= 0.9
    true = retrieval.dense(ask, own.where("label < 5"), 3, "vec_id")
    assert vector_index.recall(vector_index.search(ask, index, 3, F.col("label") < 5), true, "vec_id") >= 0.9


@pytest.mark.parametrize("block, shard, k", [(128, 1 << 16, 10), (4, 8, 3), (1, 1, 1)])
def test_pruned_search_gives_the_rows_of_the_plain_one(spark, tiny, monkeypatch, block, shard, k):
    monkeypatch.setattr(lexical_index, "BLOCK_ROWS", block)
    monkeypatch.setattr(lexical_index, "SHARD_ROWS", shard)
    chunks = q.chunks(spark, tiny)
    questions = q.benchmark_queries(spark, tiny).limit(40).unionByName(q.DOC_NAMES.df(spark).selectExpr("query_id - 100 AS query_id", "q"))
    index = lexical_index.build(chunks)
    for types in (None, ("summary", "title"), ("image",), ("no such type",)):
        part = chunks if types is None else chunks.where(F.col("type").isin(*types))
        want = retrieval.bm25(questions, part, k)
        columns = ("query_id", "rank", "pk", "score")
        assert rows(lexical_index.search(questions, index, k, types), *columns) == rows(want, *columns)


def test_pruning_leaves_most_of_the_pairs_out(spark, tiny):
    chunks, questions = q.chunks(spark, tiny), q.benchmark_queries(spark, tiny).where("query_id % 4 = 0")
    index = lexical_index.build(chunks)
    weights = lexical_index.weights(questions, index)
    assert lexical_index.candidates(index, weights, 3).count() < retrieval.bm25(questions, chunks, None).count() / 2


def test_scoped_search_takes_the_statistics_of_all(spark, tiny):
    chunks, questions = q.chunks(spark, tiny), q.benchmark_queries(spark, tiny)
    scope = q._named(spark, tiny)
    every = retrieval.bm25(questions, chunks, None).drop("rank").join(chunks.select("pk", "doc_id"), "pk").join(scope, ["query_id", "doc_id"], "left_semi")
    want = retrieval.top_k(every, 4)
    got = lexical_index.scoped_search(questions, lexical_index.build(chunks), scope, 4)
    assert rows(got, "query_id", "rank", "pk", "score") == rows(want, "query_id", "rank", "pk", "score")
