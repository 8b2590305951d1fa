"""The research loop against the same rules as a plain loop over each question."""

from __future__ import annotations

import math
import re
from collections import Counter

from corpuscle.operators import lexical_index, research

WORD = re.compile("[a-z][a-z0-9]+")


def words(s: str | None) -> list[str]:
    return WORD.findall((s or "").lower())


class Plain:
    def __init__(self, chunks: list[tuple[str, str, str]]):
        self.docs = {pk: doc for pk, doc, _ in chunks}
        self.counts = {pk: Counter(words(c)) for pk, _, c in chunks}
        self.df = Counter(t for c in self.counts.values() for t in c)
        self.mean = sum(sum(c.values()) for c in self.counts.values()) / len(chunks)

    def best(self, q: str, k: int) -> list[tuple[str, float]]:
        asked, n, out = Counter(words(q)), len(self.counts), {}
        for pk, c in self.counts.items():
            shared = [t for t in asked if t in c]
            if shared:
                size = sum(c.values())
                out[pk] = round(sum(asked[t] * math.log((n - self.df[t] + 0.5) / (self.df[t] + 0.5) + 1) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * size / self.mean)) for t in shared), 5)
        return sorted(out.items(), key=lambda x: (-x[1], x[0]))[:k]

    def run(self, q: str, k: int, floor: float, most: int) -> tuple:
        own, evidence, asked, past, stall, gap_stall, last = sorted(set(words(q))), {}, q, [], 0, 0, None
        for n in range(1, most + 1):
            new = [(pk, s) for pk, s in self.best(asked, k) if pk not in evidence]
            evidence |= dict(new)
            past.append(asked)
            told = {t for pk in evidence for t in self.counts[pk]}
            gaps = " ".join(w for w in own if w not in told)
            docs = len({self.docs[pk] for pk in evidence})
            stall = 0 if any(s >= floor for _, s in new) else stall + 1
            gap_stall = gap_stall + 1 if gaps and gaps == last else 0
            last = gaps
            if docs == 0 and n >= 2:
                verdict = "clarify"
            elif stall >= 2:
                verdict = "finish" if docs >= 3 else "clarify"
            elif n >= most:
                verdict = "finish" if docs else "clarify"
            elif gaps == "" or gaps in past or gap_stall >= 2 and docs >= 3:
                verdict = "finish"
            else:
                asked = gaps
                continue
            return (n, len(evidence), docs, gaps, verdict), set(evidence)
        raise AssertionError


TEXTS = ["iron rust grows in rain", "rain and salt on iron", "copper turns green", "zinc protects iron", "salt spray test of zinc", "green paint", "steel is iron and coal", "rain rain rain", "paint peels from steel", "the test of paint"]
ASKED = [(1, "why does iron rust in salt rain"), (2, "zinc copper paint coal green test spray"), (3, "xylophone qualia"), (4, ""), (5, None), (6, "unknown words beyond rain"), (7, "copper paint copper zinc steel salt coal rust spray")]


def check(spark, rows, questions, k, floor, most):
    table = spark.createDataFrame([(pk, d, "text", c) for pk, d, c in rows], "pk string, doc_id string, type string, content string")
    got = research.research(spark.createDataFrame(questions, "query_id long, q string"), lexical_index.build(table), k, floor, most)
    plain = Plain(rows)
    want = {i: plain.run(q or "", k, floor, most) for i, q in questions}
    assert {r["run_id"]: tuple(r)[1:] for r in got.runs.collect()} == {i: w[0] for i, w in want.items()}
    held: dict = {i: set() for i, _ in questions}
    for r in got.evidence.collect():
        assert r["pk"] not in held[r["run_id"]]  # held once
        held[r["run_id"]].add(r["pk"])
    assert held == {i: w[1] for i, w in want.items()}
    return want


def test_loop_on_few_texts(spark):
    want = check(spark, [(f"d{i // 2}::{i}", f"d{i // 2}", t) for i, t in enumerate(TEXTS)], ASKED, 2, 1.0, 4)
    assert {w[0][4] for w in want.values()} == {"finish", "clarify"}
    assert len({w[0][0] for w in want.values()}) > 1  # runs end in different rounds


def test_loop_on_the_given_tables(spark, tiny):
    from corpuscle.plans import q_retrieval as q

    rows = [tuple(r) for r in q.chunks(spark, tiny).select("pk", "doc_id", "content").collect()]
    check(spark, rows, [tuple(r) for r in q.benchmark_queries(spark, tiny).where("query_id % 10 = 0").collect()], 3, 8.0, 3)
