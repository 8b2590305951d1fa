"""A sparse rule ensemble for quality: paths of boosted trees as conjunctive rules, lasso logistic weights on them.

The statistics are Spark columns, and so is the fitted score: each rule that keeps a weight is a CASE over statistics.
Trees and weights are fitted by Spark ML on a bounded sample of labelled rows.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import free_prefix, materialize

#: Labelled rows to fit on at most; the rows with the smallest hashes of their ids are taken.
SAMPLE_ROWS = 20_000
TREES, DEPTH, LASSO = 12, 3, 0.002


def statistics(text: Column, words: Column) -> dict[str, Column]:
    """Statistics of a text by name; all are 0 for null and empty texts. words: see :func:`word_count`."""
    text = F.coalesce(text, F.lit(""))
    size = F.greatest(F.length(text), F.lit(1)).cast("double")
    count = lambda pattern: F.coalesce(F.regexp_count(text, F.lit(pattern)).cast("double"), F.lit(0.0))
    # single characters by what is left without the others, or by how much shorter the text is without them
    left = lambda others: F.length(F.regexp_replace(text, others, "")).cast("double")
    gone = lambda chars: (F.length(text) - F.length(F.translate(text, chars, ""))).cast("double")
    return {
        "log_chars": F.log1p(F.length(text).cast("double")),
        "word_chars": F.length(text).cast("double") / words,
        "upper": left(r"[^\p{Lu}]++") / size,
        "digits": gone("0123456789") / size,
        "symbols": left(r"[\p{L}\p{N}\s.,;:!?'\"()-]++") / size,
        "stops": gone(".,;:") / words,
        "bangs": gone("!") / words,
        "bars": count(r"(?<!\S)[|](?!\S)") / words,
        "long_words": count(r"\S{20,}+") / words,
        "repeats": count(r"(?<!\S)(\S++)(?=\s\1(?!\S))") / words,
        "lines": gone("\n") / words,
        "capitals": count(r"(?<!\S)\p{Lu}{2}") / words,
        "words": F.log1p(words),
    }


def word_count(text: Column) -> Column:
    """Number of words, 1 at least."""
    return F.greatest(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S++")), F.lit(1)).cast("double")


NAMES = tuple(["log_chars", "word_chars", "upper", "digits", "symbols", "stops", "bangs", "bars", "long_words", "repeats", "lines", "capitals", "words"])


class Rule(NamedTuple):
    """A conjunction of (statistic, upper bound or None, lower bound or None) and its weight."""

    terms: tuple[tuple[str, bool, float], ...]
    weight: float

    def holds(self, prefix: str = "") -> Column:
        """Whether the rule holds for statistics that are columns with this before their names."""
        out = F.lit(True)
        for name, below, cut in self.terms:
            value = F.col(prefix + name)
            out = out & ((value <= cut) if below else (value > cut))
        return out


class Ensemble(NamedTuple):
    """The fitted score: logistic of intercept plus the weights of the rules that hold."""

    intercept: float
    rules: tuple[Rule, ...]

    def score(self, prefix: str = "") -> Column:
        total = F.lit(self.intercept)
        for rule in self.rules:
            total = total + F.when(rule.holds(prefix), rule.weight).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


_EDGE = re.compile(r"^( +)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)$", re.MULTILINE)


def paths(trees: str) -> list[tuple[tuple[str, bool, float], ...]]:
    """The conjunction that leads to each node below a root, of trees in Spark's printed form (``toDebugString``)."""
    out, above = [], []
    for indent, feature, sign, cut in _EDGE.findall(trees):
        while above and above[-1][0] >= len(indent):
            above.pop()
        above.append((len(indent), (NAMES[int(feature)], sign == "<=", float(cut))))
        out.append(tuple(term for _, term in above))
    return out


def simplified(terms: tuple) -> tuple[tuple[str, bool, float], ...]:
    """Terms in order, of several bounds on one side the tightest."""
    tight: dict[tuple[str, bool], float] = {}
    for name, below, cut in terms:
        held = tight.get((name, below))
        tight[name, below] = cut if held is None else min(held, cut) if below else max(held, cut)
    return tuple(sorted((name, below, cut) for (name, below), cut in tight.items()))


def fit(labelled: DataFrame, text_col: str, label_col: str, id_col: str, sample_rows: int = SAMPLE_ROWS) -> Ensemble:
    """Fit on at most ``sample_rows`` of the rows with label 0 or 1; no usable row gives a score of 0.5 for any text.

    One class alone gives a constant score near it. Ids only choose the sample; they and other columns are no inputs.
    """
    usable = labelled.where(F.col(label_col).isin(0, 1))
    # the statistics first, where the texts are: the rows that are put in order are narrow
    wide, prefix = _with_statistics(usable, text_col)
    order = [F.xxhash64(F.col(id_col)).alias("by"), F.xxhash64(F.col(text_col)).alias("then")]
    own = wide.select(*order, F.col(label_col).cast("double").alias("label"), *(F.col(prefix + n).alias(n) for n in NAMES))
    own = materialize(own, "quality-statistics").orderBy("by", "then", "label").limit(sample_rows).drop("by", "then")
    own = materialize(own, "quality-sample")
    sizes = {r["label"]: r["count"] for r in own.groupBy("label").count().collect()}
    if len(sizes) < 2:
        n = sum(sizes.values())
        return Ensemble(0.0 if not n else 4.0 if 1.0 in sizes else -4.0, ())
    own = own.coalesce(4).cache()
    named = own.select("label", array_to_vector(F.array(*NAMES)).alias("features"))
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, maxBins=64).fit(named)
    rules = [Rule(c, 1.0) for c in sorted({simplified(p) for p in paths(trees.toDebugString)})]
    if not rules:
        own.unpersist()
        share = sizes[1.0] / (sizes[0.0] + sizes[1.0])
        return Ensemble(math.log(share / (1 - share)), ())
    on = own.select("label", array_to_vector(F.array(*(r.holds().cast("double") for r in rules))).alias("features"))
    model = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, maxIter=60, standardization=False).fit(on)
    own.unpersist()
    weights = model.coefficients.toArray()
    return Ensemble(float(model.intercept), tuple(Rule(r.terms, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-6))


def _with_statistics(docs: DataFrame, text_col: str) -> tuple[DataFrame, str]:
    """``docs`` with the statistics of their texts, and what stands before their names: no column starts so, in any case."""
    prefix = free_prefix(docs, "__stat_")
    # columns of one-element arrays: words are counted once for a text, and so is what rules read more than once
    counted = docs.select("*", F.explode(F.array(word_count(F.col(text_col)))).alias(prefix))
    own = F.struct(*(c.alias(n) for n, c in statistics(F.col(text_col), F.col(prefix)).items()))
    return counted.select("*", F.inline(F.array(own)).alias(*(prefix + n for n in NAMES))).drop(prefix), prefix


def scored(docs: DataFrame, ensemble: Ensemble, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 for each row, null and empty texts too; the other columns as they were.

    A column that has the score's name already, in any case, gives way to it.
    """
    wide, prefix = _with_statistics(docs, text_col)
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != score_col.lower()]
    return wide.select(*kept, ensemble.score(prefix).alias(score_col))


def keep(docs: DataFrame, ensemble: Ensemble, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, all columns as they were."""
    wide, prefix = _with_statistics(docs, text_col)
    return wide.where(ensemble.score(prefix) >= least).select(*(F.col(f"`{c}`") for c in docs.columns))


def learn(docs: DataFrame, labels: DataFrame, held_out_of: int = 5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Ensemble:
    """Fit on the labelled rows whose crc32 of the id as text isn't divisible by ``held_out_of``.

    The sample is chosen among the labels first, so texts of other rows aren't moved.
    """
    free = labels.where(F.crc32(F.col(id_col).cast("string").cast("binary")) % held_out_of != 0).where(F.col(label_col).isin(0, 1))
    free = free.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__label")).distinct().orderBy(F.xxhash64("__id"), "__label").limit(SAMPLE_ROWS)
    joined = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text")).join(F.broadcast(free), F.col("__doc") == F.col("__id"))
    return fit(joined, "__text", "__label", "__id")
