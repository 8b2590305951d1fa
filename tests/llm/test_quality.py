from __future__ import annotations

import math
import re
import sys
import zlib
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import regex
from rows import none, odd

from corpuscle.llm import quality, queries

SMALL = "/root/testdata/sf0.01"


def auc(pairs):
    ranked = sorted(pairs)
    good = bad = 0
    wins = 0.0
    at = 0
    while at < len(ranked):
        end = at
        while end < len(ranked) and ranked[end][0] == ranked[at][0]:
            end += 1
        g = sum(label for _, label in ranked[at:end])
        b = end - at - g
        wins += g * (bad + b / 2)
        good, bad, at = good + g, bad + b, end
    return wins / (good * bad)


def test_held_out_ranking_and_whole_table(spark):
    rows = queries.op10_quality(spark, SMALL).collect()
    assert len(rows) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    held = [(r["score"], label[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in label]
    free = [(r["score"], label[r["doc_id"]]) for r in rows if not r["held_out"] and r["doc_id"] in label]
    good = sum((s >= 0.3) == bool(y) for s, y in held) / len(held)
    print(f"held out: AUC {auc(held):.3f}, accuracy {good:.3f} of {len(held)}; fitted: AUC {auc(free):.3f}")
    assert auc(held) >= 0.8


def test_rules_are_columns_that_agree_with_the_formula(spark):
    rules = (quality.Rule((("digits", False, 0.1), ("log_chars", True, 5.0)), 1.5), quality.Rule((("upper", False, 0.5),), -2.0))
    docs = spark.createDataFrame([(1, "1234 abc"), (2, "ABC"), (3, ""), (4, None), (5, "x" * 1000)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in quality.scored(docs, quality.Ensemble(0.25, rules)).collect()}
    logistic = lambda x: 1 / (1 + math.exp(-x))
    for i, total in {1: 1.75, 2: -1.75, 3: 0.25, 4: 0.25, 5: 0.25}.items():
        assert abs(got[i] - logistic(total)) < 1e-12


def test_several_bounds_become_the_tightest():
    assert quality.simplified((("a", True, 3.0), ("a", True, 1.0), ("a", False, 0.5), ("a", False, 0.7))) == (("a", False, 0.7), ("a", True, 1.0))


def test_odd_rows(spark):
    rules = quality.Ensemble(0.0, (quality.Rule((("words", False, 1.0),), 1.0),))
    docs = odd(spark)
    out = quality.scored(docs, rules)
    assert sorted(out.columns) == sorted(docs.columns)  # a column named score is replaced
    assert out.count() == docs.count()
    assert quality.scored(none(spark), rules).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.learn(docs, labels) == quality.Ensemble(0.0, ())
    one = spark.createDataFrame([(i, 1, 0) for i in range(8)], "doc_id long, quality int, toxic int")
    assert quality.learn(docs, one).rules == ()


def brute_statistics(text: str | None) -> dict[str, float]:
    text = text or ""
    size, words = max(len(text), 1), max(len(re.findall(r"[^ \t\n\x0b\f\r]+", text)), 1)
    count = lambda p: len(regex.findall(p, text))
    s = r"[ \t\n\x0b\f\r]"
    n = r"[^ \t\n\x0b\f\r]"
    return {
        "log_chars": math.log1p(len(text)), "word_chars": len(text) / words, "upper": count(r"\p{Lu}") / size, "digits": count("[0-9]") / size,
        "symbols": count(r"[^\p{L}\p{N} \t\n\x0b\f\r.,;:!?'\"()-]") / size, "stops": count("[.,;:]") / words, "bangs": count("!") / words,
        "bars": count(rf"(?<!{n})[|](?!{n})") / words, "long_words": count(n + "{20,}+") / words, "repeats": len(regex.findall(rf"(?<!{n})({n}++)(?={s}\1(?!{n}))", text)) / words,
        "lines": count(r"\n") / words, "capitals": count(rf"(?<!{n})\p{{Lu}}{{2}}") / words, "words": math.log1p(words),
    }


def test_whole_query_against_the_rules_by_hand(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    ensemble = quality.learn(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    assert ensemble.rules and all(r.terms for r in ensemble.rules)
    got = {r["doc_id"]: r for r in queries.op10_quality(spark, SMALL).collect()}
    for i, text in docs.collect():
        stats = brute_statistics(text)
        total = ensemble.intercept + sum(r.weight for r in ensemble.rules if all(stats[n] <= c if below else stats[n] > c for n, below, c in r.terms))
        assert abs(got[i]["score"] - 1 / (1 + math.exp(-total))) < 1e-9, i
        assert got[i]["predicted"] == (got[i]["score"] >= 0.3)


def test_names_that_differ_in_case_alone(spark):
    rules = quality.Ensemble(0.0, (quality.Rule((("words", False, 1.0),), 1.0),))
    docs = spark.createDataFrame([(1, "one two three four", "w", "s", 3)], "doc_id long, text string, Words string, `__Score` string, `__STAT_words` long")
    assert quality.scored(docs, rules).columns == [*docs.columns, "score"]
    assert [tuple(r) for r in quality.keep(docs, rules, 0.3).collect()] == [tuple(r) for r in docs.collect()]


def test_paths_of_printed_trees():
    text = "  Tree 0 (weight 1.0):\n    If (feature 3 <= 0.5)\n     If (feature 0 <= 1.0E-4)\n      Predict: 1.0\n     Else (feature 0 > 1.0E-4)\n      Predict: 0.0\n    Else (feature 3 > 0.5)\n     Predict: 2.0\n  Tree 1 (weight 0.3):\n    Predict: 1.0\n"
    digits, chars = ("digits", True, 0.5), ("log_chars", True, 1e-4)
    assert quality.paths(text) == [(digits,), (digits, chars), (digits, ("log_chars", False, 1e-4)), (("digits", False, 0.5),)]
