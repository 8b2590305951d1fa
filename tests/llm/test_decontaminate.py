from __future__ import annotations

import math
import random
import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from rows import none, odd

from corpuscle.llm import decontaminate


def shingles(text: str | None, width: int = 5) -> set[tuple[str, ...]]:
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(docs, items, share: float) -> list[tuple]:
    out = set()
    short = {len(next(iter(shingles(item)))) for _, item in items if len(shingles(item)) == 1} & {1, 2, 3, 4}
    for i, text in docs:
        own = shingles(text).union(*(shingles(text, n) for n in short))
        for k, item in items:
            want = shingles(item)
            if want and len(own & want) >= math.ceil(share * len(want) - 1e-9):
                out.add((str(i), str(k), len(own & want), len(want), text))
    return sorted(x[:4] for x in out)


def test_random_containment(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(rng.choices(words, k=rng.choice([1, 3, 5, 6, 9, 20, 60])))) for k in range(40)] + [(None, "a null id item of some words here"), (41, None), (42, ""), (43, "--- ...")]
    docs = []
    for i in range(150):
        text = rng.choices(words, k=rng.randrange(0, 80))
        for _ in range(rng.randrange(3)):
            planted = (rng.choice(items[:40])[1] or "").split()
            for _ in range(rng.randrange(3)):
                planted[rng.randrange(len(planted))] = rng.choice(words)
            text[rng.randrange(len(text) + 1) :] += planted
        docs.append((i, " ".join(text)))
    docs += [(7, docs[7][1]), (8, items[0][1]), (None, items[5][1]), (None, None), (9, "a null id item of some words here")]
    tables = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for share in (0.5, 0.8, 1.0):
        for bound in (1_000_000, 0):  # with and without broadcast joins
            monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", bound)
            got = sorted((str(r[0]), str(r[1]), r[2], r[3]) for r in decontaminate.contaminated(*tables, share=share).collect())
            assert got == brute(docs, items, share)


def test_odd_rows_stay(spark):
    docs, items = odd(spark), spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta")], "item_id long, text string")
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in docs.collect() if not (r["text"] or "").startswith("alpha"))
    assert decontaminate.contaminated(none(spark), items).count() == 0
    assert decontaminate.contaminated(docs, items.where("false")).count() == 0
    assert decontaminate.drop_contaminated(docs, items.where("false")).count() == docs.count()


def test_short_items_are_found_inside_documents(spark):
    items = spark.createDataFrame([(1, "red rust"), (2, "Salt"), (3, "one two three four five six")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "all about Red, rust and more of it here"), (2, "salt"), (3, "rust red"), (4, "one two three four five"), (5, None), (6, "red rust salt")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items).collect())
    assert got == [(1, 1), (2, 2), (6, 1), (6, 2)]
    assert sorted(r["doc_id"] for r in decontaminate.drop_contaminated(docs, items).collect()) == [3, 4, 5]
