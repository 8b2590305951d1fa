"""Rows that every operator on texts must stand: nulls, empty and long texts, repeated rows, clashing column names."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, Fp string, ID long, Words string, score double, Data string, gram long, Item long, H long, T1 string, __One_R1 string, `a.b` string"


def rows() -> list[tuple]:
    texts = ["alpha beta gamma delta epsilon zeta", "", None, "   \n\t ", "one", "Two words", "a b c " * 40_000, "naïve 日本語 text   sep 😀 é", "alpha beta gamma delta epsilon zeta"]
    out = [(i, t) for i, t in enumerate(texts)]
    out += [(0, texts[0]), (None, "no id here at all"), (None, None), (7, texts[7])]
    return [(i, t, "x", "fp", 5, "w", 0.5, "d", 1, 2, 3, "t1", "r1", "ab") for i, t in out]


def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)
