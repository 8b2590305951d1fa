from __future__ import annotations

import random
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa

sys.path.insert(0, str(Path(__file__).parent))
import corpus_pipeline as pipeline
from rows import none, odd

from corpuscle.llm import near_copies, simhash


def shingles(text: str | None, k: int = 5) -> frozenset[bytes]:
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute_kept(docs: list[tuple[int | None, str | None]], least: float = 0.8) -> list[str]:
    """Ids that are the smallest of their component, each once, and every null id."""
    sets = [shingles(t) for _, t in docs]
    top = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if top[i] != top[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) - 1e-9:
                old, new = top[i], top[j]
                top = [new if t == old else t for t in top]
    smallest: dict[int, int] = {}
    for (i, _), t in zip(docs, top, strict=True):
        if i is not None:
            smallest[t] = min(i, smallest.get(t, i))
    gone = {i for (i, _), t in zip(docs, top, strict=True) if i is not None and i != smallest[t]}
    return sorted([str(i) for i in {i for i, _ in docs} if i is not None and i not in gone] + ["None" for i, _ in docs if i is None])


def planted() -> list[tuple[int, str]]:
    """Texts of 8 to 400 words, with copies that have up to 5 % of their words changed and others that only share a passage."""
    rng = random.Random(4)
    words = [f"w{k}" for k in range(3000)]
    passage = rng.choices(words, k=60)
    texts = []
    for _ in range(40):
        text = rng.choices(words, k=rng.choice([8, 30, 100, 400]))
        texts.append(text)
        for _ in range(rng.randrange(5)):
            copy = list(text)
            for _ in range(rng.randrange(1 + max(1, len(copy) // 20))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(copy + rng.choices(words, k=rng.randrange(3)))
        texts.append(passage + rng.choices(words, k=rng.choice([5, 12, 60])))
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_stage_on_planted_near_copies(spark, monkeypatch):
    docs = planted()
    table = spark.createDataFrame(docs, "doc_id long, text string")
    expected = brute_kept(docs)
    assert len(expected) < len(docs) - 40
    for rows in (near_copies.SHARD_ROWS, 2):  # whole buckets, and buckets dealt out in parts
        monkeypatch.setattr(near_copies, "SHARD_ROWS", rows)
        assert sorted(str(r["doc_id"]) for r in pipeline.keep_one_of_each(spark, table, "").collect()) == expected


def test_odd_rows(spark):
    docs = odd(spark)
    kept = near_copies.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == brute_kept([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert near_copies.keep_one(none(spark)).count() == 0


def test_no_text_is_lost_to_an_id_that_a_copy_has(spark):
    text, other = "alpha beta gamma delta epsilon zeta eta theta", "quite another text that nothing here is like at all"
    docs = spark.createDataFrame([(3, text), (5, text), (5, other), (9, other)], "doc_id long, text string")
    assert sorted(map(tuple, near_copies.keep_one(docs).collect())) == [(3, text), (5, other)]


def test_near_copies_come_from_fingerprints_and_trees(spark, monkeypatch):
    table = spark.createDataFrame([(1, "a b c d e f g h i"), (2, "a b c d e f g h i j")], "doc_id long, text string")
    assert [r["doc_id"] for r in near_copies.keep_one(table).collect()] == [1]
    one = near_copies.fingerprints(near_copies.shingle_set(b"a b c d e f g h i"))
    assert len(one) == near_copies.WORDS
    keys = [pa.RecordBatch.from_arrays([pa.array([7, 8, 9]), pa.array([one.tobytes(), one.tobytes(), (~one).tobytes()])], names=["rid", "fps"])]
    dealt = pa.Table.from_batches(near_copies._dealt(iter(keys), 4, 20)).sort_by("shard").to_batches()
    assert {(r["a"], r["b"]) for b in near_copies._search(iter(dealt)) for r in b.to_pylist()} == {(8, 7)}
    monkeypatch.setattr(simhash.BKTree, "pairs", lambda self, queries, radius: iter([(np.arange(0), np.arange(0))]))
    dealt = [b.take(pa.array([i for i, r in enumerate(b["rid"].to_pylist()) if r != 8])) for b in dealt]
    assert not [r for b in near_copies._search(iter(dealt)) for r in b.to_pylist()]


def test_many_tables_and_large_shards(spark, monkeypatch):
    docs = planted()
    table = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(near_copies, "FILL", 8)
    assert near_copies.tables(len(docs))[0] >= 4
    assert sorted(str(r["doc_id"]) for r in near_copies.keep_one(table).collect()) == brute_kept(docs)
    monkeypatch.setattr(near_copies, "FILL", 1 << 7)
    whole = near_copies.candidates(_keys(spark, docs))
    monkeypatch.setattr(near_copies, "TREE_ROWS", 16)  # shards are dealt out as pairs of parts
    parts = near_copies.candidates(_keys(spark, docs))
    assert _components(whole) == _components(parts) != set()


def _keys(spark, docs: list[tuple[int, str]]):
    return spark.createDataFrame([(i, near_copies.fingerprints(near_copies.shingle_set(t.encode())).tobytes()) for i, t in docs], "rid long, fps binary")


def _components(links) -> set[tuple[int, int]]:
    return {(r["node"], r["root"]) for r in near_copies.connected_components(links, "a", "b").collect()}


def test_least_similar_pairs_share_a_table():
    rng, bits, count = np.random.default_rng(3), *near_copies.tables(200_000)
    for shared, left, right in ((4, 0, 1), (12, 1, 2), (40, 5, 5), (400, 50, 50)):
        found = 0
        for _ in range(20):
            own = rng.integers(0, 1 << 64, shared + left + right, np.uint64)
            two = [near_copies.fingerprints(x).tobytes() for x in (own[: shared + left], np.r_[own[:shared], own[shared + left :]])]
            keys = pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array(two)], names=["rid", "fps"])
            dealt = pa.Table.from_batches(near_copies._dealt(iter([keys]), bits, count)).sort_by("shard").to_batches()
            found += any(b.num_rows for b in near_copies._search(iter(dealt)))
        assert found == 20


def test_links_of_a_group_have_few_hubs():
    rng = np.random.default_rng(5)
    own = rng.integers(0, 1 << 64, 200, np.uint64)
    fps = [near_copies.fingerprints(np.r_[own, rng.integers(0, 1 << 64, 10, np.uint64)]).tobytes() for _ in range(300)]
    keys = pa.RecordBatch.from_arrays([pa.array(np.arange(300)), pa.array(fps)], names=["rid", "fps"])
    dealt = pa.Table.from_batches(near_copies._dealt(iter([keys]), *near_copies.tables(45_000))).sort_by("shard").to_batches()
    links = {(r["a"], r["b"]) for b in near_copies._search(iter(dealt)) for r in b.to_pylist()}
    assert {a for a, _ in links} | {0} == set(range(300))
    assert all(a > b for a, b in links)
    assert len(links) < 300 * 25
