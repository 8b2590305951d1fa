"""Near copies by SimHash: fingerprints, BK-trees over shards of them, an exact check of what they find, components.

The rule is a Jaccard similarity of 0.8 or more of the sets of word shingles. At 0.8 about ten of 64 bits of two
fingerprints differ, give or take three, so blocks that agree for certain would be two or three bits wide. Hence a text
has WORDS fingerprints of 64 bits, each from other bits of its shingles' hashes, and is looked for in many tables. A
shard of a table holds the texts that agree on some bits of all fingerprints but one, and a BK-tree over that one finds
those at most RADIUS bits apart. The number of bits follows from the number of texts, so that about FILL that have
nothing in common share a shard; the number of tables follows from both, so that a pair of similarity 0.8 is in none
of them with a chance of about MISS, and more similar ones with less. Candidates are joined to clusters, and the whole
shingle sets of each cluster are compared: a link is never a matter of fingerprints alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb, log, log1p

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from ._common import join_uneven, materialize, text_bytes, text_id
from .components import connected_components
from .simhash import one_of_each

#: Fingerprints of a text, and the bits that may differ in the one that a table has a tree of.
WORDS, RADIUS = 16, 14
#: The chance that a bit differs at a similarity of 0.8 (for four shingles against five it is 0.1875, else 0.1615 at most),
#: and the chance that no table has such a pair.
DIFFER, MISS = 0.1615, 1e-7
#: Texts in a shard, about, and at most; more of them (near copies of each other) are dealt out as pairs of parts.
FILL, TREE_ROWS = 1 << 7, 1 << 12
#: Pairs of query and node held at a time.
VISITS = 1 << 18
#: Texts and shingles in one half of a cluster's shard; a larger cluster is dealt out as pairs of such parts.
SHARD_ROWS, SHARD_SHINGLES = 1 << 11, 1 << 21
#: Shingles whose bits are counted at a time: as many as a byte can count.
BLOCK = 255

_SEEDS = np.random.default_rng(17).integers(0, 1 << 64, WORDS, np.uint64) | np.uint64(1)


def shingle_set(text: bytes, words: int = 5) -> np.ndarray:
    """Sorted hashes of a text's distinct word shingles; fewer words make one shingle, and so do none."""
    tokens = text.lower().split()  # as in simhash.fingerprint
    shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False)) if len(tokens) >= words else [b" ".join(tokens)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64))


def fingerprints(own: np.ndarray) -> np.ndarray:
    """WORDS SimHash fingerprints of a set of hashes: a bit is 1 if set in over half of them."""
    ones = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(own), BLOCK):
        mixed = own[at : at + BLOCK, None] * _SEEDS
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        ones += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(own), bitorder="little").view("<u8")


def tables(rows: int) -> tuple[int, int]:
    """Bits that a shard's texts agree on, and tables, for so many texts."""
    bits = (rows // FILL).bit_length()
    near = sum(comb(64, d) * DIFFER**d * (1 - DIFFER) ** (64 - d) for d in range(RADIUS + 1))
    return bits, ceil(log(MISS) / log1p(-near * (1 - DIFFER) ** bits))


def _keys(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, rid, t1, t2, text) with 128 bits that name the text's shingle set, s1 and s2, its size and fingerprints."""
    names = ["id", "rid", "t1", "t2", "s1", "s2", "size", "fps"]
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = [shingle_set(x.as_py(), words) for x in part.column(4)]
            halves = np.frombuffer(b"".join(xxhash.xxh128_digest(s.astype("<u8").tobytes()) for s in sets), "<i8").reshape(-1, 2)
            fps = [fingerprints(s).tobytes() for s in sets]
            own = [pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array([len(s) for s in sets], pa.int64()), pa.array(fps, pa.binary())]
            yield pa.RecordBatch.from_arrays([*part.columns[:4], *own], names=names)


def _dealt(batches: Iterator[pa.RecordBatch], bits: int, count: int) -> Iterator[pa.RecordBatch]:
    """Rows (rid, fps) as (shard, fp, rid), one for each table."""
    rng, other = np.random.default_rng(19), np.arange(64 * (WORDS - 1))
    chosen = [(k % WORDS, rng.permutation(other)[:bits]) for k in range(count)]
    chosen = [(word, at + 64 * (at // 64 >= word)) for word, at in chosen]  # bits of the other fingerprints
    weight = 1 << np.arange(bits, dtype=np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            fps = np.frombuffer(b"".join(part.column(1).to_pylist()), "<u8").reshape(-1, WORDS)
            one = np.unpackbits(fps.view(np.uint8), axis=1, bitorder="little")
            shard = np.concatenate([(k << bits) + one[:, own] @ weight for k, (_, own) in enumerate(chosen)])
            fp = np.concatenate([fps[:, word] for word, _ in chosen]).view(np.int64)
            rid = np.tile(part.column(0).to_numpy(), count)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(fp), pa.array(rid)], names=["shard", "fp", "rid"])


def _near(shard: np.ndarray, fp: np.ndarray, rid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) between the rows of whole shards that give the components of "at most RADIUS bits apart" in each."""
    order = np.lexsort((rid, fp, shard))
    shard, fp, rid = shard[order], fp[order], rid[order]
    new = np.r_[True, (shard[1:] != shard[:-1]) | (fp[1:] != fp[:-1])]
    first = np.flatnonzero(new)
    values, starts = fp[first].view(np.uint64), np.flatnonzero(np.r_[True, np.diff(shard[first]) != 0])
    sizes = np.diff(np.r_[starts, len(first)])
    labels = simhash.linked(values, RADIUS, np.repeat(starts, sizes), min(simhash.QUERIES, max(1, VISITS // int(sizes.max()))))
    joined = labels[np.cumsum(new) - 1]
    hub = np.full(len(first), np.iinfo(np.int64).max)  # the least of a component: tables agree on it more often than not
    np.minimum.at(hub, joined, rid)
    to = hub[joined]
    moved = to != rid
    return rid[moved], to[moved]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, fp, rid) ordered by shard: links (a, b), and the rows of shards of over TREE_ROWS as (shard, fp, a)."""
    names = ["a", "b", "shard", "fp"]
    rest, over = [np.array([], np.int64)] * 3, None
    for last, batch in simhash._last_flagged(batches):
        shard, fp, rid = (np.r_[old, c.to_numpy()] for old, c in zip(rest, batch.columns, strict=True))
        if not len(shard):
            continue
        starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
        sizes = np.diff(np.r_[starts, len(shard)])
        large = np.repeat((sizes > TREE_ROWS) | (shard[starts] == over), sizes)
        open_ = np.arange(len(shard)) >= (len(shard) if last else starts[-1])
        over = shard[-1] if large[-1] else None
        rest = [c[open_ & ~large] for c in (shard, fp, rid)]
        if large.any():
            yield pa.RecordBatch.from_arrays([pa.array(rid[large]), pa.nulls(int(large.sum()), pa.int64()), pa.array(shard[large]), pa.array(fp[large])], names=names)
        whole = ~open_ & ~large
        if whole.any():
            a, b = _near(shard[whole], fp[whole], rid[whole])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *[pa.nulls(len(a), pa.int64())] * 2], names=names)


def _parts(members: DataFrame, key: str, parts: Column) -> DataFrame:
    """``members`` with p and q: each pair of parts of a key's rows (by ``rid``) comes together under one (key, p, q)."""
    sized = members.groupBy(key).agg(parts.cast("long").alias("parts"))
    dealt = members.join(sized, key).withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return dealt.withColumn("p", F.least("part", "other")).withColumn("q", F.greatest("part", "other")).drop("part", "other", "parts")


def candidates(keys: DataFrame) -> DataFrame:
    """``(a, b)`` links between the ``rid`` of texts (rid, fps) that join all texts that are near in some table."""
    bits, count = tables(keys.count())
    dealt = keys.select("rid", "fps").mapInArrow(lambda batches: _dealt(batches, bits, count), "shard long, fp long, rid long")
    dealt = dealt.repartition("shard").sortWithinPartitions("shard")
    found = materialize(dealt.mapInArrow(_search, "a long, b long, shard long, fp long"), "near")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        a, b = _near(np.zeros(len(frame), np.int64), frame["fp"].to_numpy(), frame["rid"].to_numpy())
        return pd.DataFrame({"a": a, "b": b})

    large = _parts(found.where("b is null").select("shard", "fp", F.col("a").alias("rid")), "shard", F.ceil(F.count("*") / TREE_ROWS))
    large = large.groupBy("shard", "p", "q").applyInPandas(run, "a long, b long")
    return found.where("b is not null").select("a", "b").union(large).distinct()


def linked(sets: list[np.ndarray], least: float) -> np.ndarray:
    """For each set the index of the first of its component, links being a Jaccard similarity of ``least`` or more."""
    sizes = np.array([len(s) for s in sets])
    starts = np.r_[0, np.cumsum(sizes)]
    vocabulary, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mark, labels = np.zeros(len(vocabulary), np.int64), np.arange(len(sets))
    for i in range(len(sets) - 1):
        own, rest = flat[starts[i] : starts[i + 1]], np.arange(i + 1, len(sets))
        fits = (labels[rest] != labels[i]) & (np.minimum(sizes[rest], sizes[i]) >= least * np.maximum(sizes[rest], sizes[i]) - 1e-9)
        rest = rest[fits]
        if not len(rest):
            continue
        mark[own] = 1
        shared = np.array([mark[flat[starts[j] : starts[j + 1]]].sum() for j in rest])
        mark[own] = 0
        near = rest[shared >= least * (sizes[rest] + sizes[i] - shared) - 1e-9]
        if len(near):
            joined = np.unique(np.r_[labels[near], labels[i]])
            labels[np.isin(labels, joined)] = joined[0]
    return labels


def links(texts: DataFrame, words: int, least: float) -> DataFrame:
    """``(a, b)`` links between the ``rid`` of texts (cluster, p, q, rid, text) that give the components of near copies."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rid")
        rid = frame["rid"].to_numpy()
        first = linked([shingle_set(x, words) for x in frame["text"]], least)
        moved = first != np.arange(len(rid))
        return pd.DataFrame({"a": rid[moved], "b": rid[first[moved]]})

    return texts.groupBy("cluster", "p", "q").applyInPandas(run, "a long, b long").distinct()


def _rooted(docs: DataFrame, id_col: str, text_col: str, words: int, least: float) -> tuple[DataFrame, DataFrame]:
    """``(id, t1, t2, s1, s2)`` for each row (the names of its text and of its set) and ``(s1, s2, least, root)`` for each set.

    Sets are as large as the texts and few texts have near copies; so all texts leave their fingerprints, and the sets
    are made again of the texts that are in a cluster.
    """
    if not 0.8 <= least <= 1:
        raise ValueError("least must be 0.8 to 1: tables miss less similar pairs")
    kind = docs.schema[id_col].dataType.simpleString()
    data = text_bytes(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("rid"), *text_id(data), data.alias("text"))
    schema = f"id {kind}, rid long, t1 long, t2 long, s1 long, s2 long, size long, fps binary"
    own = materialize(rows.mapInArrow(lambda batches: _keys(batches, words), schema), "fingerprints")
    first = F.min(F.struct("rid", "t1", "t2", "size", "fps")).alias("first")
    distinct = materialize(own.groupBy("s1", "s2").agg(first, F.min("id").alias("least")).select("s1", "s2", "least", "first.*"), "distinct-sets")
    clusters = connected_components(candidates(distinct), "a", "b").select(F.col("node").alias("rid"), F.col("root").alias("cluster"))
    members = distinct.select("rid", "t1", "t2", "size").join(clusters, "rid")
    parts = F.greatest(F.ceil(F.count("*") / SHARD_ROWS), F.ceil(F.sum("size") / SHARD_SHINGLES))
    shards = materialize(_parts(members, "cluster", parts), "clusters")
    texts = docs.select(*text_id(data), data.alias("text"))
    copies = own.groupBy("t1", "t2").agg(F.count("*").alias("n"))
    wanted = materialize(shards.select("rid", "t1", "t2").distinct().join(copies, ["t1", "t2"]), "near-texts")
    once = join_uneven(texts, wanted, ["t1", "t2"], own.count()).select("rid", "text").dropDuplicates(["rid"])
    found = links(shards.select("rid", "cluster", "p", "q").join(once, "rid"), words, least)
    roots = connected_components(found, "a", "b")
    return own, distinct.join(roots.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """``(<id_col>, component_id)``, a row for each row of ``docs``.

    component_id is the smallest id in the component of texts whose sets of word shingles have a Jaccard similarity of
    ``least`` or more (null ids don't count, a component of null ids alone has null). Texts of fewer words are one
    shingle; null, empty and wordless texts are copies of each other. Tables are made for ``least`` of 0.8 or more.
    """
    own, rooted = _rooted(docs, id_col, text_col, words, least)
    component = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.select("s1", "s2", "root").join(component, "root").select("s1", "s2", "component_id")
    return own.select("id", "s1", "s2").join(classes, ["s1", "s2"]).select(F.col("id").alias(id_col), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """One row of ``docs`` for each component of near copies; see :func:`simhash.one_of_each`."""
    own, rooted = _rooted(docs, id_col, text_col, words, least)
    classes = own.select("t1", "t2", "s1", "s2").distinct().join(rooted.select("s1", "s2", "root"), ["s1", "s2"])
    return one_of_each(docs, classes, id_col, text_col)
