"""SimHash near-duplicates: fingerprints, BK-trees per shard of the fingerprints, connected components.

A BK-tree keys the children of a node by their integer Hamming distance to it, so a search of radius r at distance d
follows the edges d-r to d+r only. Broadcasting the trees would bring the fingerprints of the whole corpus to the driver;
so the trees are built per shard, the shards are dealt out by a shuffle, and a shard's tree is searched where it is. A
shard holds fingerprints that agree on the first bits of one of three blocks of 21 or 22 bits: two fingerprints that
differ in at most two bits agree on a whole block at least, so each linked pair meets in a shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import free_prefix, join_uneven, materialize, text_bytes, text_id, without_uneven
from .components import connected_components

#: Fingerprints in a shard, about; shards of over SPLIT times as many are dealt out again by the bits they don't share.
SHARD_ROWS, SPLIT = 1 << 12, 4
#: Queries that go down a tree together: a bound of the pairs of query and node held at a time.
QUERIES = 1 << 11
#: Hashes whose bits are unpacked at a time (64 bytes each).
BLOCK = 1 << 16
MAX_RADIUS = 2


def fingerprint(text: bytes, words: int = 3) -> int:
    """The SimHash of a text's word shingles; 0 for a text without words."""
    tokens = text.lower().split()  # bytes: lowers A-Z alone, splits at 0x20 and 0x09-0x0D alone
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False))
    count, total = np.zeros(64, np.int64), 0
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at : at + BLOCK]
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        total += len(part)
    return int(np.packbits(count * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``(<id_col>, t1, t2, fp)`` for each row: the text's name, a signed 64-bit fingerprint; a null text counts as empty."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in ("t1", "t2", "fp"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py(), words) for x in batch.column(3)), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found.view(np.int64))], names=[id_col, "t1", "t2", "fp"])

    data = text_bytes(text_col)
    return docs.select(F.col(id_col), *text_id(data), data.alias("text")).mapInArrow(run, schema)


class BKTree:
    """A BK-tree over distinct 64-bit values: node k is ``values[k]``, and ``child`` lists the nodes in the order of ``key``.

    ``key`` is 65 times the parent plus the distance to it, so the edges of a node within a range are one slice. With
    ``root`` there are several trees: it has the node that each value's tree starts from, a tree's values are distinct, and
    the values themselves are the queries.
    """

    def __init__(self, values: np.ndarray, root: np.ndarray | None = None, block: int | None = None):
        self.values, self.block = values, block or QUERIES
        self.root = root
        parent, edge = np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
        inner = own = np.arange(1, len(values)) if root is None else np.flatnonzero(root != np.arange(len(values)))
        at = np.zeros(len(own), np.int64) if root is None else root[own]  # the node that each value not yet in the tree has come to
        while len(own):
            distance = np.bitwise_count(values[own] ^ values[at]).astype(np.int64)
            _, first, same = np.unique(at * 65 + distance, return_index=True, return_inverse=True)
            parent[own[first]], edge[own[first]] = at[first], distance[first]
            at = own[first][same]
            left = np.ones(len(own), bool)
            left[first] = False
            own, at = own[left], at[left]
        key = parent * 65 + edge
        self.child = inner[np.argsort(key[inner], kind="stable")]
        self.key = key[self.child]

    def pairs(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of (index of query, index of value) within the radius."""
        for at in range(0, len(queries) if len(self.values) else 0, self.block):
            query = np.arange(at, min(at + self.block, len(queries)))
            node = np.zeros(len(query), np.int64) if self.root is None else self.root[query]
            while len(query):
                distance = np.bitwise_count(queries[query] ^ self.values[node]).astype(np.int64)
                near = distance <= radius
                yield query[near], node[near]
                start = np.searchsorted(self.key, node * 65 + np.maximum(distance - radius, 1))
                count = np.searchsorted(self.key, node * 65 + np.minimum(distance + radius, 64), side="right") - start
                total = np.cumsum(count)
                query = np.repeat(query, count)
                node = self.child[np.repeat(start - total + count, count) + np.arange(len(query))]


def _join(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest label of each component once the pairs (a, b) are joined."""
    while True:
        least = np.minimum(labels[a], labels[b])
        before = labels.copy()
        np.minimum.at(labels, labels[a], least)
        np.minimum.at(labels, labels[b], least)
        while (labels[labels] != labels).any():
            labels = labels[labels]
        if (labels == before).all():
            return labels


def linked(values: np.ndarray, radius: int, root: np.ndarray | None = None, block: int | None = None) -> np.ndarray:
    """For each of the distinct values (of a tree) the index of its component's first value, links being at most radius bits."""
    labels, held, size = np.arange(len(values)), [], 0
    most = 1 << 21 if block is None else 1 << 18
    for i, j in BKTree(values, root, block).pairs(values, radius):
        keep = labels[i] != labels[j]
        held.append((i[keep], j[keep]))
        size += int(keep.sum())
        if size > most:
            labels, held, size = _join(labels, *map(np.concatenate, zip(*held, strict=True))), [], 0
    return _join(labels, *map(np.concatenate, zip(*held, strict=True))) if held else labels


def _links(frames: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """frames: (shard, fp) ordered by shard; a link from each fingerprint to the first of its component in its shard."""
    rest = None
    for last, frame in _last_flagged(frames):
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        shard, fp = frame["shard"].to_numpy(), frame["fp"].to_numpy()
        starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else np.array([], np.int64)
        stops = np.r_[starts[1:], len(shard)].astype(np.int64)
        whole = len(starts) if last else len(starts) - 1
        left, right = [], []
        for s, e in zip(starts[:whole], stops[:whole], strict=True):
            if e - s > 1:
                own = np.unique(fp[s:e])
                first = linked(own.view(np.uint64), radius)
                moved = first != np.arange(len(own))
                left.append(own[moved])
                right.append(own[first[moved]])
        rest = frame.iloc[starts[whole] :] if whole < len(starts) else None
        if left:
            yield pd.DataFrame({"a": np.concatenate(left), "b": np.concatenate(right)})


def _last_flagged(items: Iterator) -> Iterator[tuple[bool, object]]:
    held = None
    for item in items:
        if held is not None:
            yield False, held
        held = item
    if held is not None:
        yield True, held


def _masks(bits: list[int], parts: int) -> list[list[int]]:
    """The bits in runs as equal as can be."""
    return [list(map(int, part)) for part in np.array_split(bits, parts)]


def _at(bits: list[int]) -> int:
    mask = sum(1 << b for b in bits)
    return mask - (1 << 64) if mask >> 63 else mask


def links(fps: DataFrame, radius: int = MAX_RADIUS) -> DataFrame:
    """``(a, b)`` links between distinct fingerprints ``fp`` that give the components of "at most radius bits apart".

    The number of bits that make a shard grows with the table, up to the whole block. Fingerprints of a shard that is
    still too large meet by their whole block and one of three blocks of the other bits. Shards are hashes of bits, so
    a shard may hold two keys by chance: that costs time and no link, since each link is checked.
    """
    if not 0 <= radius <= MAX_RADIUS:
        raise ValueError(f"radius must be 0 to {MAX_RADIUS}: one of three blocks agrees only up to that distance")
    rows, blocks = fps.count(), _masks([*range(64)], 3)
    some = max(0, int(rows // SHARD_ROWS).bit_length())
    fp = F.col("fp")
    first = F.array(*(F.struct(F.xxhash64(F.lit(k), fp.bitwiseAND(_at(own[:some]))).alias("shard"), F.lit(k).alias("block")) for k, own in enumerate(blocks)))
    keyed = materialize(fps.select("fp", F.inline(first)), "shards")
    large = materialize(keyed.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > SPLIT * SHARD_ROWS), "large-shards")
    dealt = without_uneven(keyed, large, ["shard"], 3 * rows).select("shard", "fp")
    for k, own in enumerate(blocks):
        rest = _masks([b for b in range(64) if b not in own], 3)
        again = F.array(*(F.xxhash64("shard", fp.bitwiseAND(_at(own)), F.lit(j), fp.bitwiseAND(_at(part))) for j, part in enumerate(rest)))
        dealt = dealt.union(join_uneven(keyed.where(F.col("block") == k), large, ["shard"], 3 * rows).select(F.explode(again).alias("shard"), "fp"))
    dealt = dealt.repartition("shard").sortWithinPartitions("shard")
    found = dealt.mapInPandas(lambda frames: _links(frames, radius), "a long, b long")
    return found.distinct()


def _rooted(docs: DataFrame, id_col: str, text_col: str, words: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """``(id, t1, t2, fp)`` for each row, and ``(fp, least, root)`` for each fingerprint: its least id, its component."""
    own = materialize(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text", words), "fingerprints")
    distinct = materialize(own.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    roots = connected_components(links(distinct.select("fp"), radius), "a", "b")
    return own, distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = MAX_RADIUS) -> DataFrame:
    """``(<id_col>, fingerprint, component_id)``, a row for each row of ``docs``.

    component_id is the smallest id in the component of texts whose fingerprints are linked (null ids don't count, a
    component of null ids alone has null). Null and empty texts have fingerprint zero and are linked like any other;
    repeated rows come out as often as they came in. Other columns of ``docs`` play no part. An empty table gives an
    empty result.
    """
    own, rooted = _rooted(docs, id_col, text_col, words, radius)
    component = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.select("fp", "root").join(component, "root").select("fp", "component_id")
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return own.join(classes, "fp").select(F.col("id").alias(id_col), shown.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = MAX_RADIUS) -> DataFrame:
    """One row of ``docs`` for each component of texts, all columns as they were; see :func:`one_of_each`."""
    own, rooted = _rooted(docs, id_col, text_col, words, radius)
    return one_of_each(docs, own.select("t1", "t2", "fp").distinct().join(rooted.select("fp", "root"), "fp"), id_col, text_col)


def one_of_each(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of ``docs`` for each root of ``classes`` (t1, t2, root), which has a row for each text.

    It is the row with the smallest id; of rows with one id, the one with the least hash of all columns (maps aside). So
    a text stays if its id alone is also that of a copy, and repeated rows stay once. Rows with a null id are kept.
    """
    named = docs.where(F.col(id_col).isNotNull())
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    t1, t2, r1, r2 = own = [free_prefix(docs, "__one_") + k for k in ("t1", "t2", "r1", "r2")]
    values = [*text_id(text_bytes(text_col)), F.xxhash64(*hashed), F.xxhash64(F.lit(1), *hashed)]
    keyed = named.select("*", *(v.alias(n) for v, n in zip(values, own, strict=True)))
    best = F.struct(F.col(id_col).alias("id"), F.col(r1).alias("r1"), F.col(r2).alias("r2")).alias("best")
    of_text = keyed.select(F.col(t1).alias("t1"), F.col(t2).alias("t2"), best).groupBy("t1", "t2").agg(F.min("best").alias("best"))
    won = of_text.join(classes, ["t1", "t2"]).groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.r1").alias(r1), F.col("best.r2").alias(r2)).distinct()
    # joined by sort, so that the rows are where their repeats are
    kept = keyed.join(won.hint("merge"), [r1, r2]).dropDuplicates([r1, r2])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return kept.select(*columns).union(docs.where(F.col(id_col).isNull()))
