from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpuscle.llm import queries, vector_codes


def brute(rows: list[tuple], parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> dict:
    """Plain Python integers throughout. Rows (vec_id, vector, label); gives (vec_id, code, error, label_error) counted, and the digest."""
    good = [(i, v, k) for i, v, k in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    sizes = Counter(len(v) for _, v, _ in good)
    size = min(sizes, key=lambda s: (-sizes[s], s), default=0)
    good = [(i, [math.floor(scale * x) for x in v] + [0] * (-size % parts), k) for i, v, k in good if len(v) == size]
    width = (size + -size % parts) // parts
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for _, v, _ in good]
    order = sorted(range(len(good)), key=lambda n: (good[n][0] is None, good[n][0] or 0, good[n][1]))[:entries]
    books = [[cut[n][p] for n in order] for p in range(parts)]

    def pick(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds if good else 0):
        for p in range(parts):
            own = defaultdict(list)
            for v in cut:
                own[pick(v[p], books[p])[1]].append(v[p])
            books[p] = [tuple(sum(c) // len(c) for c in zip(*own[e], strict=True)) if e in own else c for e, c in enumerate(books[p])]
    found = [[pick(v[p], books[p]) for p in range(parts)] for v in cut]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = Counter()
    for (_, _, k), e in zip(good, errors, strict=True):
        by_label[k] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest() if good else None
    return Counter((i, "".join(f"{e:02x}" for _, e in f), err, by_label[k], digest) for (i, _, k), f, err in zip(good, found, errors, strict=True))


def got(df) -> Counter:
    assert df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return Counter(map(tuple, df.collect()))


def test_query_against_plain_integers(spark, tiny):
    rows = [tuple(r) for r in spark.read.parquet(f"{tiny}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert got(queries.op12_vector_codes(spark, tiny)) == brute(rows)


SCHEMA = "vec_id long, embedding array<double>, label int, code string, ID int, vec int, Error long, `a.b` string"


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    v = [float(x) for x in rng.normal(size=20)]
    rows = [(i, [float(x) for x in rng.normal(size=20)], i % 3) for i in range(100)]
    rows += [(200 + i, v, None) for i in range(30)] + [(5, v, 1), (5, v, 1), (None, v, 1), (300, None, 1), (301, [], 1), (302, [1.0, None] * 10, 1), (303, [float("nan")] * 20, 1), (304, [float("-inf")] * 20, None), (305, [1.0] * 7, 1), (306, [-0.001] * 20, 2)]
    table = spark.createDataFrame([(*r, "c", 1, 2, 3, "x") for r in rows], SCHEMA)
    assert got(queries.code_digests(table)) == brute(rows)
    few = [(i, [0.5 * i] * 16, None) for i in range(3)]
    assert got(queries.code_digests(spark.createDataFrame([(*r, "c", 1, 2, 3, "x") for r in few], SCHEMA))) == brute(few)
    assert queries.code_digests(table.where("false")).count() == 0
    assert queries.code_digests(table.where("vec_id = 300")).count() == 0


def test_huge_components_stay_exact(spark):
    rows = [(i, [float(x) for x in np.random.default_rng(i).normal(size=16) * (1e6 if i % 2 else 1)], 0) for i in range(80)]
    table = spark.createDataFrame([(*r, "c", 1, 2, 3, "x") for r in rows], SCHEMA)
    assert got(queries.code_digests(table)) == brute(rows)
    beyond = [(1, [1e300] * 16, 0), (2, [-1e300] * 16, 0), (3, [1.0] * 16, 0)]
    table = spark.createDataFrame([(*r, "c", 1, 2, 3, "x") for r in beyond], SCHEMA)
    assert {r["vec_id"] for r in queries.code_digests(table).collect()} == {1, 2, 3}


@pytest.mark.parametrize("reach", [3, 40, 3000, 1 << 25])
def test_screening_keeps_the_nearest_and_ties(reach):
    """Values of which float32 loses digits, and ties in plenty: the exact answer of int64 on every row."""
    rng = np.random.default_rng(reach)
    x, entries = rng.integers(-reach, reach, (3000, 4)), rng.integers(-reach, reach, (64, 4))
    entries[40:] = entries[:24]
    x[:500] = entries[rng.integers(0, 64, 500)] + rng.integers(-1, 2, (500, 4))
    all_distances = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
    index, distance = vector_codes.nearest(x, entries)
    assert (index == all_distances.argmin(axis=1)).all() and (distance == all_distances.min(axis=1)).all()
    row, _ = vector_codes.screened(x, entries)
    assert len(row) < 4 * len(x) or reach == 3  # most entries are left out without int64
