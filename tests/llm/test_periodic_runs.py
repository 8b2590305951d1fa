from __future__ import annotations

import hashlib
import random
import sys
import zlib
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from rows import none, odd

from corpuscle.llm import periodic_runs, queries


def brute(words: list) -> list[tuple[int, int, int]]:
    """Every stretch that matches itself q words on, whole, for every q; of one stretch the smallest q."""
    out: dict[tuple[int, int], int] = {}
    n = len(words)
    if n > 50_000:  # of rows.py: too long to try all periods
        assert all(w == words[i % 3] for i, w in enumerate(words)) and len(set(words)) == 3
        return [(0, n, 3)]
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if length >= max(24, 3 * q):
                out.setdefault((start, length), q)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def expected(doc_id, text: str | None) -> tuple:
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    four = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (doc_id, len(found), *four, sha("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def made(seed: int) -> list[str]:
    """Words with runs of many periods, nested, side by side and nearly periodic."""
    rng = random.Random(seed)
    letters = [f"w{k}" for k in range(rng.choice([1, 2, 3, 50]))]
    out: list[str] = []
    for _ in range(rng.randrange(1, 7)):
        unit = rng.choices(letters, k=rng.choice([1, 2, 3, 5, 8, 9, 13, 40]))
        if rng.random() < 0.3:
            unit = unit * 3 + ["x"]
        block = (unit * 30)[: rng.randrange(1, 4 * len(unit) + 40)]
        if rng.random() < 0.3:
            block[rng.randrange(len(block))] = "y"
        out += block + rng.choices(letters, k=rng.randrange(4))
    return out


@pytest.mark.parametrize("cells", [periodic_runs.CELLS, 7])
def test_runs_against_brute_force(monkeypatch, cells):
    monkeypatch.setattr(periodic_runs, "CELLS", cells)
    total = 0
    for seed in range(400):
        words = made(seed)
        own = [tuple(r) for r in periodic_runs.runs([w.encode() for w in words]).tolist()]
        assert own == brute(words), seed
        total += len(own)
    assert total > 400


def test_edges_of_length_and_periods():
    for n in (22, 23, 24, 25):
        assert len(periodic_runs.runs([b"a"] * n)) == (n >= 24)
    unit = [b"u%d" % k for k in range(20)]
    assert len(periodic_runs.runs((unit * 3)[:59])) == 0
    assert periodic_runs.runs(unit * 3).tolist() == [[0, 60, 20]]
    assert periodic_runs.runs([]).shape == (0, 3)


def test_long_texts_of_one_word_and_of_long_periods():
    assert periodic_runs.runs([b"a"] * 200_000).tolist() == [[0, 200_000, 1]]
    unit = [b"%d" % k for k in np.random.default_rng(3).integers(0, 5000, 30_000)]
    found = periodic_runs.runs(unit * 4)
    assert [0, 120_000, 30_000] in found.tolist()
    assert periodic_runs.kept(120_000, found).sum() == 30_000


def test_query_against_brute_force(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = queries.op13_periodic_runs(spark, tiny)
    assert got.columns == names
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(expected(r["doc_id"], r["text"]) for r in docs)
    assert sum(r[1] > 0 for r in rows) > 5


def test_odd_rows(spark):
    docs = odd(spark)
    key = lambda r: tuple(map(str, r))
    got = queries.periodic_digests(docs).collect()
    assert sorted(map(tuple, got), key=key) == sorted((expected(r["doc_id"], r["text"]) for r in docs.collect()), key=key)
    assert queries.periodic_digests(none(spark)).count() == 0


def test_operator_gives_runs_and_texts(spark):
    table = spark.createDataFrame([(1, "x " + "a b " * 12 + "y"), (2, "no runs here"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in periodic_runs.collapse(table).collect()}
    assert [tuple(r) for r in got[1]["runs"]] == [(1, 24, 2)] and tuple(got[1]["best"]) == (1, 24, 2) and got[1]["collapsed"] == "x a b y"
    assert got[2]["runs"] == [] and got[2]["best"] is None and got[2]["collapsed"] == "no runs here"
    assert got[3]["collapsed"] == ""
