"""Names inside each other, against every pair."""

from __future__ import annotations

import random

from corpuscle.operators import links


def test_contained_names_against_every_pair(spark):
    rng = random.Random(5)
    word = lambda k: "".join(rng.choices("abc", k=k))
    inner, outer = [word(rng.randrange(0, 12)) for _ in range(300)], [word(rng.randrange(0, 20)) for _ in range(300)]
    table = lambda names: spark.createDataFrame([(n,) for n in names], "s string")
    got = {tuple(r) for r in links.contained(table(inner), table(outer)).collect()}
    assert got == {(i, o) for i in inner for o in outer if len(i) >= 4 and i in o} and len(got) > 100


def test_registry_of_any_size(spark):
    rng = random.Random(6)
    word = lambda k: "".join(rng.choices("abcdefgh", k=k))
    registry = [(p, f"d{p}", word(rng.choice([3, 5, 6, 9]))) for p in range(12_000)] + [(12_001, "x1", None), (12_002, "x2", "")]
    names = [word(rng.choice([2, 4, 8, 14])) for _ in range(150)] + ["d7", registry[5][2], "", None]

    def meant(name):
        same = [(1, p, d) for p, d, r in registry if name == d or r is not None and name == r]
        part = [(2, p, d) for p, d, r in registry if r and min(len(name), len(r)) >= 4 and (r in name or name in r)]
        return min(same + part, default=None)

    got = {r["name"]: (r["tier"], r["doc_id"]) for r in links.registry_match(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(registry, "pos int, doc_id string, doc_name string")).collect()}
    want = {n: m for n in names if n and (m := meant(n))}
    assert got == {n: (m[0], m[2]) for n, m in want.items()} and len(got) > 20
