from __future__ import annotations

import hashlib
import random
import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from rows import none, odd

from corpuscle.llm import queries, suffix_dedup


def brute(texts: list[str | None], length: int) -> list[tuple[int, int, int, str]]:
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        mask = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                mask[i : i + length] = b"\x01" * length
        runs = sum(1 for i, m in enumerate(mask) if m and not (i and mask[i - 1]))
        out.append((len(d), sum(mask), runs, hashlib.sha256(bytes(b for b, m in zip(d, mask, strict=True) if not m)).hexdigest()))
    return out


def results(out):
    return sorted((str(r["doc_id"]), r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["spans"] or []), hashlib.sha256(r["kept"]).hexdigest()) for r in out.collect())


def test_whole_table_against_brute_force(spark, tiny):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    expected = sorted((i, *x) for (i, _), x in zip(docs, brute([t for _, t in docs], 400), strict=True))
    assert sorted(tuple(r) for r in queries.op3_suffix_dedup(spark, tiny).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()) == expected


@pytest.mark.parametrize("group", [1 << 15, 2])
def test_planted_repeats(spark, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)  # 2: nearly every shard is dealt out again
    monkeypatch.setattr(suffix_dedup, "TUPLES", 64)
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = [word(rng.choice([119, 120, 121, 150, 400])) for _ in range(12)]
    texts = ["".join(rng.choice(shared) if rng.random() < 0.5 else word(rng.randrange(5, 90)) for _ in range(rng.randrange(1, 8))) for _ in range(60)]
    texts += [texts[0], "x" * 1000, "ab" * 300, "é" * 200, "", None]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    expected = sorted((str(i), *x) for i, x in enumerate(brute(texts, 120)))
    assert results(suffix_dedup.remove_repeats(docs, 120)) == expected


def test_odd_rows(spark):
    docs = odd(spark)
    items = [(r["doc_id"], r["text"][:6000] if r["text"] else r["text"]) for r in docs.collect()]
    short = spark.createDataFrame(items, "doc_id long, text string")
    assert results(suffix_dedup.remove_repeats(short)) == sorted((str(i), *x) for (i, _), x in zip(items, brute([t for _, t in items], 400), strict=True))
    assert suffix_dedup.remove_repeats(docs).count() == docs.count()
    assert suffix_dedup.remove_repeats(none(spark)).count() == 0


def test_copies_of_a_text_give_each_context_once(spark, monkeypatch):
    kept, write = {}, suffix_dedup.materialize
    monkeypatch.setattr(suffix_dedup, "materialize", lambda df, name: kept.update({name: write(df, name)}) or kept[name])
    rng = random.Random(3)
    base = "".join(rng.choice("abcdefgh ") for _ in range(900))
    texts = [base] * 40 + [base[:500] + "#" + base[501:], "other words" + base[300:620]]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(4)
    assert results(suffix_dedup.remove_repeats(docs, 120)) == sorted((str(i), *x) for i, x in enumerate(brute(texts, 120)))
    assert 0 < kept["pieces-0"].count() == kept["pieces-0"].select("gram", "context").distinct().count()


def test_shared_grams_without_a_repeat(spark):
    docs = spark.createDataFrame([(1, "x" * 30_000), (2, "x" * 600 + "b"), (3, "y" * 399)], "doc_id long, text string")
    expected = sorted((str(i), *x) for i, x in enumerate(brute(["x" * 30_000, "x" * 600 + "b", "y" * 399], 400), 1))
    assert results(suffix_dedup.remove_repeats(docs)) == expected
    rng = random.Random(5)
    near = ["".join(rng.choice("abcdefgh ") for _ in range(300)) for _ in range(4)]  # a shared gram, no shared window
    texts = [near[0] + near[1], near[2] + near[1][:110] + near[3]]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    assert results(suffix_dedup.remove_repeats(docs)) == sorted((str(i), *x) for i, x in enumerate(brute(texts, 400)))
