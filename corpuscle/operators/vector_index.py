"""An inverted-file index of vectors: coarse cells, one stored partition for each, searched by a few of them under filters.

Cells are the means of k-means, fitted on a bounded sample (at most SAMPLE_ROWS rows, by hash of the key); every row goes
to its nearest cell. How many cells a search looks at is measured on the sample when the index is built. A search reads
the partitions of these cells only, takes filters with it, and scores what it reads exactly. Questions that find too few
rows under a filter go on to all cells. The exact way goes on to all cells that can still hold one of the k best: no row of
a cell has a larger inner product with q than q.c + |q| r, where r is the distance of the cell's furthest row from c.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.sources.shared import new_folder

from . import retrieval as r

#: Rows that cells are fitted on, at most; cells at most; rounds of k-means.
SAMPLE_ROWS, MOST_CELLS, ROUNDS = 1 << 16, 1024, 8
#: Sampled rows that are asked for their neighbours to measure how many cells a search needs, neighbours of each, and the share of them to be found.
TRIALS, TRIAL_K, TARGET = 256, 10, 0.95


@dataclass(frozen=True)
class VectorIndex:
    """Rows below ``path``/rows, by cell; the cells' means, radii and numbers of rows; how many of them a search looks at."""

    path: str
    key: str
    vector: str
    means: np.ndarray
    radius: np.ndarray
    sizes: np.ndarray
    probes: int

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/rows")


def k_means(x: np.ndarray, cells: int) -> np.ndarray:
    """Means of Lloyd's rounds from the first rows; a cell that loses all rows keeps its mean."""
    means = x[:cells].copy()
    for _ in range(ROUNDS if len(x) else 0):
        nearest = np.argmin((means**2).sum(axis=1) - 2 * x @ means.T, axis=1)
        counts = np.bincount(nearest, minlength=len(means))
        sums = np.zeros_like(means)
        np.add.at(sums, nearest, x)
        means = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], means)
    return means


def needed_probes(x: np.ndarray, means: np.ndarray) -> int:
    """How many cells hold TARGET of the nearest rows of sampled rows, best cells first; all, if the sample is too small to tell."""
    asked = x[:TRIALS]
    if len(x) < 4 * TRIAL_K:
        return len(means)
    cell = np.argmin((means**2).sum(axis=1) - 2 * x @ means.T, axis=1)
    scores = asked @ x.T
    scores[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    near = np.argpartition(-scores, TRIAL_K, axis=1)[:, :TRIAL_K]
    place = np.argsort(np.argsort(-(asked @ means.T), axis=1), axis=1)  # of each cell in the order of a row's search
    found = np.sort(np.take_along_axis(place, cell[near], axis=1).ravel())
    return int(found[int(np.ceil(TARGET * len(found))) - 1]) + 1


def _usable(vectors: DataFrame, vector: str) -> Column:
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))


def build(vectors: DataFrame, key: str = "pk", vector: str = "embedding") -> VectorIndex:
    """Store all rows of ``vectors`` with their cell; other columns go along, for filters. Rows without a finite vector are left out, as are those of another than the commonest size of the sample."""
    spark = vectors.sparkSession
    rows = vectors.where(_usable(vectors, vector))
    n = rows.count()
    sample = rows.where(F.pmod(F.xxhash64(key), F.lit(max(1, -(-n // SAMPLE_ROWS)))) == 0).select(vector).limit(SAMPLE_ROWS).collect()
    path = new_folder(spark, "vector-index")
    size = Counter(len(s[0]) for s in sample).most_common(1)[0][0] if sample else 0
    x = np.array([s[0] for s in sample if len(s[0]) == size], np.float64).reshape(-1, max(1, size))
    x = x[np.random.default_rng(0).permutation(len(x))]
    means = k_means(x, min(MOST_CELLS, len(x), max(1, round(n**0.5 / 2))))

    @F.pandas_udf("cell int, far double")
    def assigned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            own = np.stack(s.to_numpy()).astype(np.float64) if len(s) else np.zeros((0, size))
            cell = np.argmin((means**2).sum(axis=1) - 2 * own @ means.T, axis=1) if len(own) else np.zeros(0, int)
            yield pd.DataFrame({"cell": cell.astype(np.int32), "far": np.linalg.norm(own - means[cell], axis=1)})

    placed = rows.where(F.size(vector) == size).withColumn("__at", assigned(vector)).select(*vectors.columns, F.col("__at.cell").alias("__cell"), F.col("__at.far").alias("__far"))
    placed.hint("rebalance", "__cell").write.partitionBy("__cell").parquet(f"{path}/rows")  # large cells are split, small ones are put together
    told = {t["__cell"]: t for t in spark.read.schema(placed.schema).parquet(f"{path}/rows").groupBy("__cell").agg(F.count("*").alias("n"), F.max("__far").alias("far")).collect()}
    sizes = np.array([told[c]["n"] if c in told else 0 for c in range(len(means))], np.int64)
    radius = np.array([told[c]["far"] if c in told else 0.0 for c in range(len(means))])
    return VectorIndex(path, key, vector, means, radius, sizes, needed_probes(x, means) if len(x) else 0)


def _first(index: VectorIndex, asked: np.ndarray, probes: int) -> np.ndarray:
    """Which cells each question looks at first: those whose means have the largest inner products with it."""
    out = np.zeros((len(asked), len(index.means)), bool)
    np.put_along_axis(out, np.argsort(-(asked @ index.means.T), axis=1, kind="stable")[:, :probes], True, axis=1)
    return out


def _further(index: VectorIndex, asked: np.ndarray, probes: int, found: np.ndarray, last: np.ndarray, k: int, exact: bool) -> np.ndarray:
    """Which cells it looks at after that: all where fewer than k rows were found, else (if exact) those that can hold a better row."""
    more = np.repeat((found < k)[:, None], len(index.means), axis=1)
    if exact:
        bound = asked @ index.means.T + np.linalg.norm(asked, axis=1)[:, None] * index.radius * (1 + 1e-9)
        more |= bound >= last[:, None] - 10.0**-r.DIGITS  # scores are rounded before they are ranked
    return more & ~_first(index, asked, probes)


def _scanned(spark: SparkSession, index: VectorIndex, ids: list, asked: np.ndarray, mask: np.ndarray, k: int, where: Column | None, schema: str) -> DataFrame:
    """The k best of each question in the cells it looks at: only their partitions are read."""
    cells = np.flatnonzero(mask.any(axis=0)).tolist()
    rows = index.rows(spark).where(F.col("__cell").isin(cells))
    rows = rows if where is None else rows.where(where)
    key, vector = index.key, index.vector

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for cell, part in frame.groupby("__cell"):
                own = np.flatnonzero(mask[:, cell])
                yield from r._best(iter([part[[key, vector]]]), [ids[i] for i in own], asked[own], k, key)

    return rows.select(key, vector, "__cell").mapInPandas(run, schema)


def search(queries: DataFrame, index: VectorIndex, k: int, where: Column | None = None, exact: bool = False, probes: int | None = None) -> DataFrame:
    """``(query_id, key, score, rank)`` of the k largest inner products of each query ``(query_id, q_vec)`` in the index.

    ``where`` is a filter over the columns of the indexed rows. Up to QUERY_BLOCK questions go to every task that reads
    their cells; more of them are taken block by block, each block with the cells that it needs.
    """
    spark = queries.sparkSession
    probes = min(len(index.means), index.probes if probes is None else probes)
    kinds = [queries.schema["query_id"].dataType.simpleString(), index.rows(spark).schema[index.key].dataType.simpleString()] if len(index.means) else ["long", "long"]
    schema = f"query_id {kinds[0]}, {index.key} {kinds[1]}, score double"
    own = queries.select("query_id", "q_vec").where("q_vec IS NOT NULL")
    n = own.count() if len(index.means) else 0
    if not n:
        return spark.createDataFrame([], f"{schema}, rank int")
    blocks = -(-n // r.QUERY_BLOCK)
    own = own.withColumn("__block", F.pmod(F.xxhash64("query_id"), F.lit(2 * blocks if blocks > 1 else 1)))
    out = None
    for b in range(2 * blocks if blocks > 1 else 1):
        rows = own.where(F.col("__block") == b).collect()
        if rows:
            hits = _block(spark, index, [x["query_id"] for x in rows], np.array([x["q_vec"] for x in rows], np.float64), k, where, exact, probes, schema)
            out = hits if out is None else out.unionByName(hits)
    return out


def _block(spark: SparkSession, index: VectorIndex, ids: list, asked: np.ndarray, k: int, where: Column | None, exact: bool, probes: int, schema: str) -> DataFrame:
    first = r.top_k(_scanned(spark, index, ids, asked, _first(index, asked, probes), k, where, schema), k, tie=index.key)
    if where is None and not exact:
        return first
    path = new_folder(spark, "vector-hits")
    first.write.parquet(path)
    first = spark.read.schema(first.schema).parquet(path)
    told = {t["query_id"]: t for t in first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("last")).collect()}  # a row for each question of the block
    found = np.array([told[q]["n"] if q in told else 0 for q in ids])
    last = np.array([told[q]["last"] if q in told else -np.inf for q in ids])
    mask = _further(index, asked, probes, found, last, k, exact)
    if not mask.any():
        return first
    more = _scanned(spark, index, ids, asked, mask, k, where, schema)
    return r.top_k(first.drop("rank").unionByName(more), k, tie=index.key)


def recall(found: DataFrame, true: DataFrame, key: str) -> float:
    """The share of the true hits (query_id, key) that were found."""
    hit = found.select("query_id", key).withColumn("hit", F.lit(1))
    row = true.join(hit, ["query_id", key], "left").agg((F.count("hit") / F.count("*")).alias("share")).first()
    return row["share"] or 0.0
