from __future__ import annotations

import hashlib
import random
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from rows import none, odd

from corpuscle.llm import pii, queries

#: The base patterns as the contract states them, applied plainly.
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def fits(kind: str, found: str) -> bool:
    digits = [int(c) for c in found if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        doubled = [sum(divmod(2 * d, 10)) if k % 2 else d for k, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text: str | None) -> list[tuple[str, int, int]]:
    return [(kind, *m.span()) for kind, p in PLAIN.items() for m in re.finditer(p, text or "") if fits(kind, m[0])]


def test_base_spans_of_random_texts():
    rng = random.Random(4)
    bits = ["@", ".", "-", "+", " ", "(", ")", "a.b", "x@y.com", "@@", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "٣", "é", "0" * 30, "12", "7", "%", "mail", "\n", "1.2.3.4.5.6.7.8.9", "300.1.2.3.4"]
    for _ in range(6000):
        text = "".join(rng.choices(bits, k=rng.randrange(1, 14)))
        assert [(x.kind, x.start, x.end) for x in pii.find(text) if x.base] == brute(text), repr(text)


def test_whole_table(spark, tiny):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    for r in queries.op8_pii(spark, tiny).collect():
        base = brute(texts[r["doc_id"]])
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(b[0] == k for b in base) for k in PLAIN]
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert {*joined.split(",")} - {""} <= {*r["spans"].split(",")}


def test_added_kinds_need_a_checksum_or_words_nearby():
    kinds = lambda text: [x.kind for x in pii.find(text)]
    assert kinds("IBAN DE89 3704 0044 0532 0130 00 please") == ["iban"]
    assert kinds("IBAN DE89 3704 0044 0532 0130 01 please") == []
    assert kinds("social security 123-45-6789") == ["ssn"]
    assert kinds("part 123-45-6789") == []
    assert kinds("call me: phone (555) 010-1234") == ["local_phone"]
    assert kinds("555 010 1234") == []


def test_scores_follow_the_words_nearby():
    plain, better, worse = (pii.find(t)[0].score for t in ("at 10.0.0.1 then", "server 10.0.0.1", "version 10.0.0.1"))
    assert worse < plain < better


def test_linear_on_hostile_texts():
    for text in ("a" * 300_000, "a." * 150_000 + "@", "@" * 300_000, "1 " * 300_000, "+1" + "(" * 300_000, "1." * 300_000, "7" * 1_000_000, "123-45-6789 a@b.c " * 20_000):
        began = time.perf_counter()
        pii.find(text)
        assert time.perf_counter() - began < 10, text[:20]


def test_odd_rows_and_redaction(spark):
    docs = odd(spark)
    assert pii.spans(docs).count() == docs.count()
    assert pii.spans(none(spark)).count() == 0
    assert sorted(map(str, pii.redact(docs).collect())) == sorted(map(str, docs.collect()))
    two = spark.createDataFrame([(1, "write to a.b@c.org or +44 20 7946 0958", "k"), (2, None, "k")], "doc_id long, text string, kind string")
    assert [tuple(r) for r in pii.redact(two).orderBy("doc_id").collect()] == [(1, "write to <EMAIL> or <PHONE>", "k"), (2, None, "k")]
