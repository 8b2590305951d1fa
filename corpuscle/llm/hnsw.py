"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard, results merged.

A shard's graph is one row of a table: its vectors, ids and neighbour lists as flat arrays. Searches join query blocks
with the shards, and a window merges what each shard finds. The largest inner product is turned into the least distance
by one more dimension, the square root of (greatest norm squared - own norm squared), in which queries have zero.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize

#: Vectors in a shard and queries in a block: bounds of what one task holds.
SHARD_ROWS, BLOCK_ROWS = 8_192, 20_000
#: Links of a node (twice as many on the lowest level), breadth of the search while building and while searching.
LINKS, BUILD_BREADTH, SEARCH_BREADTH = 16, 64, 96


class Graph:
    """A graph over distinct vectors; neighbours[level] is a flat array with a fixed number of places for each node."""

    def __init__(self, vectors: np.ndarray, neighbours: list[np.ndarray], levels: np.ndarray, entry: int):
        self.vectors, self.neighbours, self.levels, self.entry = vectors, neighbours, levels, entry

    @staticmethod
    def build(vectors: np.ndarray, seed: int = 7) -> Graph:
        n = len(vectors)
        draw = np.random.default_rng(seed).random(n)
        levels = np.minimum(np.floor(-np.log(np.maximum(draw, 1e-12)) / np.log(LINKS)), 8).astype(np.int64)
        width = [2 * LINKS] + [LINKS] * int(levels.max(initial=0))
        graph = Graph(vectors, [np.full((n, w), -1, np.int32) for w in width], levels, 0)
        graph.mark = np.zeros(n, np.int64)
        graph.turn = 0
        for i in range(1, n):
            graph._insert(i)
        return graph

    def _distances(self, vector: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        d = self.vectors[nodes] - vector
        return np.einsum("ij,ij->i", d, d)

    def _search(self, vector: np.ndarray, entries: list[tuple[float, int]], breadth: int, level: int) -> list[tuple[float, int]]:
        self.turn += 1
        mark, turn, links = self.mark, self.turn, self.neighbours[level]
        for _, node in entries:
            mark[node] = turn
        todo, found = list(entries), [(-d, node) for d, node in entries]
        heapq.heapify(todo)
        heapq.heapify(found)
        while todo:
            d, node = heapq.heappop(todo)
            if len(found) >= breadth and d > -found[0][0]:
                break
            near = links[node]
            near = near[near >= 0]
            near = near[mark[near] != turn]
            if not len(near):
                continue
            mark[near] = turn
            for x, k in zip(self._distances(vector, near).tolist(), near.tolist(), strict=True):
                if len(found) < breadth:
                    heapq.heappush(found, (-x, k))
                    heapq.heappush(todo, (x, k))
                elif x < -found[0][0]:
                    heapq.heapreplace(found, (-x, k))
                    heapq.heappush(todo, (x, k))
        return sorted((-d, node) for d, node in found)

    def _pick(self, base: np.ndarray, found: list[tuple[float, int]], most: int) -> list[int]:
        """Of the candidates in order those nearer to the base than to any picked before; then the nearest left."""
        nodes = np.array([k for _, k in found])
        if len(nodes) <= most:
            return nodes.tolist()
        vectors = self.vectors[nodes]
        norms = np.einsum("ij,ij->i", vectors, vectors)
        between = norms[:, None] + norms[None, :] - 2 * (vectors @ vectors.T)
        own = [d for d, _ in found]
        picked: list[int] = []
        least = np.full(len(nodes), np.inf)
        for k in range(len(nodes)):
            if own[k] < least[k]:
                picked.append(k)
                least = np.minimum(least, between[k])
                if len(picked) == most:
                    break
        taken = set(picked)
        for k in range(len(nodes)):
            if len(picked) == most:
                break
            if k not in taken:
                picked.append(k)
        return nodes[picked].tolist()

    def _insert(self, i: int) -> None:
        vector, top = self.vectors[i], int(self.levels[self.entry])
        at = [(float(self._distances(vector, np.array([self.entry]))[0]), self.entry)]
        for level in range(top, int(self.levels[i]), -1):
            at = self._search(vector, at, 1, level)
        for level in range(min(top, int(self.levels[i])), -1, -1):
            at = self._search(vector, at, BUILD_BREADTH, level)
            links = self.neighbours[level]
            own = self._pick(vector, at, LINKS)
            links[i, : len(own)] = own
            for k in own:
                row = links[k]
                free = np.flatnonzero(row < 0)
                if len(free):
                    row[free[0]] = i
                else:
                    rivals = np.r_[row, i]
                    d = self._distances(self.vectors[k], rivals)
                    by = np.lexsort((rivals, d))
                    kept = self._pick(self.vectors[k], [(float(d[x]), int(rivals[x])) for x in by], len(row))
                    row[:] = -1
                    row[: len(kept)] = kept
        if self.levels[i] > top:
            self.entry = i

    def nearest(self, vector: np.ndarray, breadth: int) -> list[int]:
        """About the ``breadth`` nodes nearest to the vector, nearest first."""
        at = [(float(self._distances(vector, np.array([self.entry]))[0]), self.entry)]
        for level in range(int(self.levels[self.entry]), 0, -1):
            at = self._search(vector, at, 1, level)
        return [k for _, k in self._search(vector, at, breadth, 0)]

    def packed(self) -> dict:
        return {"levels": self.levels.astype("<i8").tobytes(), "neighbours": [x.astype("<i4").tobytes() for x in self.neighbours], "entry": self.entry}

    @staticmethod
    def unpacked(vectors: np.ndarray, row: dict) -> Graph:
        neighbours = [np.frombuffer(x, "<i4").reshape(len(vectors), -1) for x in row["neighbours"]]
        graph = Graph(vectors, neighbours, np.frombuffer(row["levels"], "<i8"), int(row["entry"]))
        graph.mark, graph.turn = np.zeros(len(vectors), np.int64), 0
        return graph


def usable(vector: Column) -> Column:
    """Not null, not empty, not zero, and without null or non-finite components."""
    real = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(real, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(real, lambda x: x != 0), F.lit(False))


INDEX = "shard int, size int, ids binary, starts binary, vectors binary, levels binary, neighbours array<binary>, entry int"


def build_index(vectors: DataFrame, id_col: str, vector_col: str, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row for each shard of the usable vectors of one size: equal vectors are one node with all of their ids."""
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v")).where(usable(F.col("v")))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    stats = own.agg(F.count("*").alias("n"), F.max(norm).alias("m")).first()
    shards, most = max(1, -(-stats["n"] // shard_rows)), float(stats["m"] or 0.0)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[pd.DataFrame]] = {}
        for frame in frames:
            for shard, part in frame.groupby("shard"):
                held.setdefault(shard, []).append(part)
        for shard in sorted(held):
            yield pd.DataFrame([_built(int(shard), pd.concat(held.pop(shard)), most)])

    # row numbers would need one order of all rows; a hash of the id deals the shards evenly and the same way each time
    dealt = own.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    return materialize(dealt.repartition(shards, "shard").mapInPandas(run, INDEX), "hnsw")


def _built(shard: int, frame: pd.DataFrame, most: float) -> dict:
    ids = frame["id"].to_numpy(np.int64)
    vectors = np.stack(frame["v"].to_numpy()).astype(np.float64)
    by = np.lexsort((ids, *vectors.T[::-1]))
    ids, vectors = ids[by], vectors[by]
    first = np.flatnonzero(np.r_[True, (vectors[1:] != vectors[:-1]).any(axis=1)])
    own = vectors[first]
    extra = np.sqrt(np.maximum(most - np.einsum("ij,ij->i", own, own), 0.0))
    mix = np.random.default_rng(11).permutation(len(own))  # sorted vectors in a random order: better links
    place = np.empty(len(own), np.int64)
    place[mix] = np.arange(len(own))
    graph = Graph.build(np.c_[own, extra][mix])
    # ids of node k: ids[starts[k]:starts[k + 1]], in order
    sizes = np.diff(np.r_[first, len(ids)])[mix]
    starts = np.r_[0, np.cumsum(sizes)]
    ordered = np.concatenate([ids[first[k] : first[k] + s] for k, s in zip(mix, sizes, strict=True)])
    return {"shard": shard, "size": len(own), "ids": ordered.astype("<i8").tobytes(), "starts": starts.astype("<i8").tobytes(), "vectors": graph.vectors.astype("<f8").tobytes(), **graph.packed()}


def search(index: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int = 20, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest that the graphs give, the query's own id left out.

    score is the inner product of the vectors in double precision; ties go to the smaller id. Of equal vectors only the
    k + 1 smallest ids can be among a query's nearest, so no more of them are looked at. Unusable queries give no row.
    """
    own = queries.select(F.col(id_col).cast("long").alias("query_id"), F.transform(vector_col, lambda x: x.cast("double")).alias("q")).where(usable(F.col("q"))).distinct()
    blocks = max(1, -(-own.count() // block_rows))
    keyed = own.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    shards = index.select("shard").distinct()
    # each pair of a shard and a block is a task's work: the shard's row goes to each block, the queries to each shard
    pairs = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = keyed.join(shards.agg(F.sort_array(F.collect_list("shard")).alias("shards")).hint("broadcast"), how="inner").select("query_id", "q", "block", F.explode("shards").alias("shard"))

    def run(key: tuple, graphs: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, float]] = []
        if len(graphs) and len(asked):
            row = graphs.iloc[0]
            vectors = np.frombuffer(row["vectors"], "<f8").reshape(row["size"], -1)
            graph = Graph.unpacked(vectors, row)
            ids, starts = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["starts"], "<i8")
            for query, q in zip(asked["query_id"].to_numpy(), asked["q"].to_numpy(), strict=True):
                if len(q) + 1 != vectors.shape[1]:
                    continue
                nodes = graph.nearest(np.r_[q, 0.0], max(SEARCH_BREADTH, k + 1))
                found = [(-float(np.dot(q, vectors[n, :-1])), int(i)) for n in nodes for i in ids[starts[n] : min(starts[n + 1], starts[n] + k + 1)] if i != query]
                out += [(int(query), i, -s) for s, i in heapq.nsmallest(k, found)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = pairs.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(run, "query_id long, vec_id long, score double")
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return best.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20) -> DataFrame:
    """Build the index over all usable vectors and search it; see :func:`search`. Null ids take no part.

    An id on several rows keeps the row with the least vector. An empty table gives an empty result. Vectors whose size
    differs from the most frequent one take no part.
    """
    own = vectors.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(vector_col).alias(vector_col))
    sizes = own.where(usable(F.col(vector_col))).groupBy(F.size(vector_col).alias("size")).count().orderBy(F.desc("count"), "size").first()
    if sizes is None:
        return own.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    right = F.size(vector_col) == sizes["size"]
    asked = queries.where(F.col(id_col).isNotNull() & right).groupBy(id_col).agg(F.min(vector_col).alias(vector_col))
    return search(build_index(own.where(right), id_col, vector_col), asked, id_col, vector_col, k)
