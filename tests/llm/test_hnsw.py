from __future__ import annotations

import numpy as np

from corpuscle.llm import hnsw, queries


def brute(rows, asked, k):
    ids = np.array([i for i, _ in rows])
    vectors = np.array([v for _, v in rows], np.float64)
    out = {}
    for q, v in asked:
        scores = vectors @ np.array(v, np.float64)
        own = np.flatnonzero(ids != q)
        by = own[np.lexsort((ids[own], -scores[own]))][:k]
        out[q] = [(int(ids[n]), float(scores[n])) for n in by]
    return out


def recall(got, want):
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got.get(q, [])}) for q in want)
    return hits / sum(map(len, want.values()))


def by_query(df):
    out: dict = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall_on_the_whole_table(spark, tiny):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{tiny}/embeddings.parquet").collect()]
    want = brute(rows, [x for x in rows if x[0] % 20 == 0], 20)
    got = by_query(queries.op5_hnsw(spark, tiny))
    assert {q: len(x) for q, x in got.items()} == {q: len(x) for q, x in want.items()}
    assert recall(got, want) >= 0.9
    vectors = dict(rows)
    for q, found in got.items():
        assert all(abs(s - float(np.dot(np.array(vectors[q], np.float64), np.array(vectors[i], np.float64)))) < 1e-12 for i, s in found)
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))


def test_recall_with_unequal_norms_and_several_shards(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD_ROWS", 700)
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(3000, 24)) * rng.uniform(0.2, 3, (3000, 1))).astype(np.float32)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = table.where("vec_id % 50 = 0")
    built = hnsw.build_index(table, "vec_id", "embedding", 700)
    assert built.count() > 1
    got = by_query(hnsw.search(built, asked, "vec_id", "embedding", 10, block_rows=20))
    assert recall(got, brute(rows, rows[::50], 10)) >= 0.9


def test_ties_copies_and_unusable_vectors(spark):
    v, w = [1.0, 2.0], [2.0, -1.0]
    rows = [(i, v, "x") for i in range(60)] + [(100, w, "x"), (101, None, "x"), (102, [0.0, 0.0], "x"), (103, [1.0, None], "x"), (104, [float("nan"), 1.0], "x"), (105, [float("inf"), 1.0], "x"), (None, v, "x"), (106, [1.0, 2.0, 3.0], "x"), (5, v, "x"), (107, [], "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = by_query(hnsw.nearest(table, table, k=20))
    assert sorted(got) == [*range(60), 100]
    assert [i for i, _ in got[3]] == [i for i in range(21) if i != 3]
    assert [i for i, _ in got[100]] == [*range(20)]
    assert hnsw.nearest(table.where("false"), table.where("false")).count() == 0
    few = table.where("vec_id in (1, 100)")
    assert by_query(hnsw.nearest(few, few, k=20)) == {1: [(100, 0.0)], 100: [(1, 0.0)]}
