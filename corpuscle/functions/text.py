"""Column functions over texts and questions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .words import FIGURE_LABEL, STOP_WORDS, TABLE_LABEL


def all_of(*parts: Column | None) -> Column:
    """The conjunction of the parts that are there; true if none is."""
    return reduce(and_, [p for p in parts if p is not None], F.lit(True))


def cut(value: Column, most: int) -> Column:
    """The value, or its first characters and an ellipsis if it is longer than ``most``."""
    return F.when(F.length(value) > most, F.concat(F.substring(value, 1, most - 1), F.lit("…"))).otherwise(value)


def tokens(value: Column) -> Column:
    """Lower-case ASCII words of two letters or digits and more, then all CJK characters one by one."""
    low = F.lower(F.coalesce(value, F.lit("")))
    return F.concat(F.regexp_extract_all(low, F.lit("[a-z][a-z0-9]+"), F.lit(0)), F.regexp_extract_all(low, F.lit("[一-鿿]"), F.lit(0)))


TOKENS_SQL = "list_concat(regexp_extract_all(lower(coalesce({0}, '')), '[a-z][a-z0-9]+'), regexp_extract_all(lower(coalesce({0}, '')), '[一-鿿]'))"


def keywords(question: Column) -> Column:
    """English words of three letters and more in lower case, then CJK runs of two and more; no stop words, each once."""
    english = F.transform(F.regexp_extract_all(question, F.lit(r"[A-Za-z][A-Za-z\-]{2,}"), F.lit(0)), F.lower)
    found = F.concat(english, F.regexp_extract_all(question, F.lit("[一-鿿]{2,}"), F.lit(0)))
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(*STOP_WORDS)))


def labels(question: Column, pattern: str) -> Column:
    """Labels of figures or tables that a question names: upper case, each once, in order."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(question, F.lit(pattern), F.lit(1)), F.upper)))


def figure_labels(question: Column) -> Column:
    return labels(question, FIGURE_LABEL)


def table_labels(question: Column) -> Column:
    return labels(question, TABLE_LABEL)


def contains_any(value: Column, parts: Sequence[str]) -> Column:
    """Whether the value has one of the parts, taken literally."""
    return reduce(lambda a, b: a | b, [F.contains(value, F.lit(p)) for p in parts], F.lit(False))


def estimated_tokens(value: Column) -> Column:
    """CJK characters count one each, of the others four make one."""
    cjk = F.length(F.regexp_replace(value, "[^一-鿿]", ""))
    return (cjk + F.ceil((F.length(value) - cjk) / 4)).cast("long")


def snippet(value: Column, most: int) -> Column:
    """The value, or three quarters of ``most`` from its head and a quarter from its tail."""
    head = most * 3 // 4
    return F.when(F.length(value) > most, F.concat(F.substring(value, 1, head), F.lit(" … "), F.right(value, F.lit(most - head)))).otherwise(value)


def squeezed(value: Column) -> Column:
    """Without white space."""
    return F.regexp_replace(value, r"[ \t\r\n]+", "")


def plain_name(name: Column) -> Column:
    """A document's name for comparison: lower case, without blanks and separators."""
    return F.regexp_replace(F.lower(name), r"[ \t\r\n,，;；/\\.\-_:：()（）\[\]【】]+", "")


def signature(value: Column) -> Column:
    """Keywords in one form and order: lower case, without punctuation and plural s."""
    words = F.split(F.trim(F.regexp_replace(F.lower(value), "[^a-z0-9一-鿿]+", " ")), " ")
    single = F.transform(F.filter(words, lambda w: w != ""), lambda w: F.when((F.length(w) > 3) & w.endswith("s"), F.substring(w, 1, F.length(w) - 1)).otherwise(w))
    return F.array_join(F.array_sort(F.array_distinct(single)), " ")
