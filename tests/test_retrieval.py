"""Dense retrieval against brute force where scores tie."""

from __future__ import annotations

import numpy as np
import pandas as pd

from corpuscle.operators import retrieval


def test_best_of_a_frame_with_many_copies_of_one_vector():
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(3000, 8))
    vectors[::3] = vectors[0] / np.linalg.norm(vectors[0]) * 9  # a third one vector
    vectors[1::7] += rng.normal(size=8) * 1e-9  # equal after rounding only
    keys = rng.permutation(3000)
    queries = np.r_[vectors[:1], rng.normal(size=(4, 8))]
    for own in (keys, np.array([f"k{x:04}" for x in keys], object)):
        got = pd.concat(retrieval._best(iter([pd.DataFrame({"pk": own, "v": list(vectors)})]), list(range(5)), queries, 10, "pk"))
        for q in range(5):
            scores = np.round(vectors @ queries[q], retrieval.DIGITS)
            by = sorted(range(3000), key=lambda r: (-scores[r], own[r]))[:10]
            assert sorted(got[got["query_id"] == q]["pk"]) == sorted(own[r] for r in by)


def test_dense_gives_the_smaller_keys_of_equal_vectors(spark):
    rows = [(i, [1.0, 0.0] if i % 3 == 0 else [0.5, 0.1]) for i in range(3000)]
    vectors = spark.createDataFrame(rows, "pk long, embedding array<double>").repartition(2, "pk")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], "query_id long, q_vec array<double>")
    got = sorted(map(tuple, retrieval.dense(queries, vectors, 10).select("query_id", "rank", "pk", "score").collect()))
    others = [i for i in range(20) if i % 3][:10]
    assert got == [(1, k + 1, 3 * k, 1.0) for k in range(10)] + [(3, k + 1, i, 0.1) for k, i in enumerate(others)]
