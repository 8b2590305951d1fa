from __future__ import annotations

import random
import re
import sys
from pathlib import Path

import numpy as np
import xxhash

sys.path.insert(0, str(Path(__file__).parent))
from rows import none, odd

from corpuscle.llm import queries, simhash
from corpuscle.llm.components import connected_components


def brute_fingerprint(text: str | None, k: int = 3) -> int:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    parts = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(items: list[tuple[int | None, int]], radius: int = 2) -> dict[int, int | None]:
    """fingerprint -> smallest id of its component."""
    values = sorted({f for _, f in items})
    parent = {v: v for v in values}

    def top(v):
        while parent[v] != v:
            v = parent[v]
        return v

    array = np.array(values, np.uint64)
    for v in values:
        for w in array[np.bitwise_count(array ^ np.uint64(v)) <= radius].tolist():
            a, b = top(v), top(w)
            if a != b:
                parent[max(a, b)] = min(a, b)
    least: dict[int, int | None] = {}
    for i, f in items:
        t = top(f)
        least[t] = i if least.get(t) is None else least[t] if i is None else min(i, least[t])
    return {v: least[top(v)] for v in values}


def check(docs, out):
    items = [(r["doc_id"], brute_fingerprint(r["text"])) for r in docs.select("doc_id", "text").collect()]
    classes = brute_components(items)
    expected = sorted((str(i), f"{f:016x}", str(classes[f])) for i, f in items)
    assert sorted((str(r[0]), r[1], str(r[2])) for r in out.select("doc_id", "fingerprint", "component_id").collect()) == expected


def test_whole_table_against_brute_force(spark, tiny):
    check(spark.read.parquet(f"{tiny}/documents.parquet"), queries.op1_simhash(spark, tiny))


def test_odd_rows(spark):
    check(odd(spark), simhash.near_duplicates(odd(spark)))
    assert simhash.near_duplicates(none(spark)).count() == 0


def test_links_of_random_fingerprints_with_hot_shards(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_ROWS", 16)  # most shards are split a second time
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(20)] + [rng.getrandbits(16) for _ in range(60)]
    values = set(base)
    for v in base:
        for _ in range(6):
            v ^= 1 << rng.randrange(64)
            if rng.random() < 0.7:
                v ^= 1 << rng.randrange(64)
            values.add(v)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    fps = spark.createDataFrame(signed, "fp long")
    roots = {r["node"]: r["root"] for r in connected_components(simhash.links(fps), "a", "b").collect()}
    classes = brute_components([(k, v) for k, v in enumerate(sorted(values))])
    groups: dict = {}
    for v in values:
        s = v - (1 << 64) if v >> 63 else v
        groups.setdefault(roots.get(s, s), set()).add(classes[v])
    assert all(len(g) == 1 for g in groups.values())
    assert len(groups) == len(set(classes.values()))


def test_bk_tree_finds_all_pairs():
    rng = np.random.default_rng(3)
    values = np.unique(rng.integers(0, 2**14, 3000).astype(np.uint64))
    found = {(int(i), int(j)) for a, b in simhash.BKTree(values).pairs(values, 2) for i, j in zip(a, b, strict=True)}
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 2
    assert found == set(zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True))


def test_bk_tree_follows_edges_within_the_radius_only():
    values = np.unique(np.random.default_rng(4).integers(0, 1 << 64, 4000, np.uint64))
    tree = simhash.BKTree(values)
    assert sorted(tree.child.tolist()) == [*range(1, len(values))]
    parent, edge = tree.key // 65, tree.key % 65
    assert (np.bitwise_count(values[tree.child] ^ values[parent]) == edge).all()
    seen = sum(len(i) for i, _ in tree.pairs(values, 64))
    assert seen == len(values) ** 2  # all edges are within 64 bits
    flips = values ^ np.uint64(3 << 40)
    assert {(int(i), int(j)) for a, b in tree.pairs(flips, 2) for i, j in zip(a, b, strict=True)} >= {(i, i) for i in range(len(values))}


def test_links_come_from_the_trees(spark, monkeypatch):
    one = np.uint64(1) << np.uint64(5)
    values = np.random.default_rng(6).integers(0, 1 << 64, 300, np.uint64)
    fps = spark.createDataFrame([(int(v),) for v in np.unique(np.r_[values, values ^ one]).view(np.int64)], "fp long")
    assert simhash.links(fps).count() == 300
    frame = [__import__("pandas").DataFrame({"shard": 1, "fp": np.r_[values, values ^ one].view(np.int64)})]
    assert sum(len(x) for x in simhash._links(iter(frame), 2)) == 300
    monkeypatch.setattr(simhash.BKTree, "pairs", lambda self, queries, radius: iter(()))
    assert not sum(len(x) for x in simhash._links(iter(frame), 2))


def test_keep_one_loses_no_text(spark):
    text, other = "alpha beta gamma delta epsilon zeta eta theta", "quite another text that nothing here is like at all"
    docs = spark.createDataFrame([(3, text), (5, text), (5, other), (5, other), (9, other)], "doc_id long, text string")
    assert sorted(map(tuple, simhash.keep_one(docs).collect())) == [(3, text), (5, other)]


def test_keep_one_leaves_the_smallest_id(spark):
    docs = odd(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted((str(r["doc_id"]) for r in kept.collect()))
    items = [(r["doc_id"], brute_fingerprint(r["text"])) for r in docs.collect()]
    classes = brute_components(items)
    ids = {str(i) for i, f in items if i is not None and classes[f] == i}
    assert got == sorted([*ids, "None", "None"])


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1300)] + [(7, 7), (None, 3)]
    roots = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert {roots[i] for i in range(201)} == {0}
    assert {roots[i] for i in range(1000, 1300)} == {1000}
