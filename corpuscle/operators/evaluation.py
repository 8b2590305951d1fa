"""How good retrieval is: recall of gold passages, exact answers, recall at k and their means."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import lexical_index, retrieval
from .lexical_index import LexicalIndex

#: Longest gold text and answer looked for as a whole; of longer ones windows of WINDOW characters, each half a window on.
WINDOW, WHOLE_ANSWER = 20, 30


def nfkc(value: Column) -> Column:
    """Unicode's compatibility form; Spark has no function for it."""

    @F.pandas_udf("string")
    def form(values: pd.Series) -> pd.Series:
        return values.str.normalize("NFKC")

    return form(value)


def comparable(value: Column) -> Column:
    """A text for comparison: compatibility form, lower case, one kind of times, tilde and minus, no white space."""
    return F.regexp_replace(F.translate(F.lower(nfkc(F.coalesce(value, F.lit("")))), "×∼－", "x~-"), r"\s+", "")


def _found(found: DataFrame) -> DataFrame:
    """All that was retrieved for a question as one comparable text, in the order of ranks."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"])
    return found.groupBy("question_id").agg(F.array_join(texts, " ").alias("__all")).select("question_id", comparable(F.col("__all")).alias("__all"))


def gold_recall(gold: DataFrame, found: DataFrame) -> DataFrame:
    """Share of a question's gold texts of which the retrieved texts hold a part; questions without gold give no row."""
    own = gold.select("question_id", comparable(F.col("text")).alias("g")).where("g != ''").join(_found(found), "question_id", "left")
    n, text = F.length("g"), F.coalesce("__all", F.lit(""))
    windows = F.exists(F.sequence(F.lit(1), F.greatest(n - WINDOW + 1, F.lit(1)), F.lit(WINDOW // 2)), lambda i: F.contains(text, F.substring("g", i, F.lit(WINDOW))))
    return own.withColumn("ok", F.when(n <= WINDOW, F.contains(text, F.col("g"))).otherwise(windows)).groupBy("question_id").agg(F.avg(F.col("ok").cast("double")).alias("recall"))


def exact_hits(answers: DataFrame, found: DataFrame) -> DataFrame:
    """Whether the retrieved texts hold the answer, or the head of a long one; null without an answer."""
    own = answers.select("question_id", comparable(F.col("text")).alias("a")).join(_found(found), "question_id", "left")
    part = F.when(F.length("a") <= WHOLE_ANSWER, F.col("a")).otherwise(F.substring("a", 1, WINDOW))
    return own.select("question_id", F.when(F.col("a") != "", F.contains(F.coalesce("__all", F.lit("")), part).cast("double")).alias("hit"))


def recall_at(ranked: DataFrame, ks: Sequence[int], by: str = "kind") -> DataFrame:
    """Share of questions with a relevant hit among the first k, for each k, by kind of question."""
    best = ranked.groupBy(by, "question_id").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"))
    return best.groupBy(by).agg(*(F.avg(F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0))).alias(f"recall_{k}") for k in ks), F.count("*").alias("n"))


def report(results: DataFrame, by: str = "eval_kind") -> DataFrame:
    """Counts and means of each kind and of all results together; means skip nulls, latency also failed ones."""
    ok = F.col("error").isNull()
    out = results.rollup(by).agg(
        F.count("*").alias("n"), F.count_if(ok).alias("success"), F.round(F.avg("recall"), 4).alias("recall"),
        F.round(F.avg("exact"), 4).alias("exact"), F.round(F.avg(F.when(ok, F.col("latency"))), 3).alias("latency"), F.grouping(by).alias("__all"),
    )
    return out.withColumn(by, F.when(F.col("__all") == 1, "ALL").otherwise(F.col(by))).drop("__all")


#: What a question's type stands for, where its kind isn't given (fixed values).
KINDS = ("fact_retrieval", "doc_scoped_retrieval", "generation", "skip_auto")
KIND_OF_TYPE = {"progressive": "fact_retrieval", "local": "doc_scoped_retrieval", "metadata_fig": "doc_scoped_retrieval", "metadata_page": "doc_scoped_retrieval", "metadata_entity": "doc_scoped_retrieval", "references": "doc_scoped_retrieval", "summary": "generation", "multi": "skip_auto"}


def eval_kind(kind: Column, query_type: Column) -> Column:
    """The kind of a question: the given one if it is known, else that of its type."""
    given = F.lower(F.trim(F.coalesce(kind, F.lit(""))))
    by_type = F.element_at(F.create_map(*(F.lit(x) for pair in KIND_OF_TYPE.items() for x in pair)), F.when(query_type.isin(*KIND_OF_TYPE), query_type).otherwise("progressive"))
    return F.when(given.isin(*KINDS), given).otherwise(by_type)


def contexts(hits: DataFrame) -> DataFrame:
    """``(query_id, at, text)``: texts of hits (query_id, route_pos, rank, type, content, context), each once, in order.

    The context of figures and tables counts as a text of its own.
    """
    both = F.array(F.col("content"), F.when(F.col("type").isin("image", "table"), F.col("context")))
    each = hits.select("query_id", "route_pos", "rank", F.posexplode(both).alias("part", "text")).select("query_id", F.struct("route_pos", "rank", "part").alias("place"), F.trim("text").alias("text")).where("text != ''")
    first = each.groupBy("query_id", "text").agg(F.min("place").alias("place"))
    return first.withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy("place"))).select("query_id", "at", "text")


def retrieve_only(queries: DataFrame, chunks: DataFrame, index: LexicalIndex, scope: DataFrame, k: int) -> DataFrame:
    """``(query_id, pk, score, rank)``: the k best hits of each question (query_id, q, q_vec, kind), as an evaluation asks for them.

    Both paths are fused with the weights that the question's words call for; each brings three times as many hits, 40 at
    least. Questions about one document search in it alone: scope is (query_id, doc_id). ``index`` holds the chunks' words.
    """
    wide, inside = max(40, 3 * k), F.col("kind") == "doc_scoped_retrieval"
    dense, lexical = retrieval.weights(retrieval.bias(F.col("q")), F.lit("simple"))
    weighed = queries.select("query_id", dense.alias("w_dense"), lexical.alias("w_bm25"))
    narrow, free = queries.where(inside), queries.where(~inside)
    paths = []
    for name, found in (
        ("w_dense", retrieval.dense(free, chunks, wide).unionByName(retrieval.scoped_dense(narrow, chunks, scope, wide))),
        ("w_bm25", lexical_index.search(free, index, wide).unionByName(lexical_index.scoped_search(narrow, index, scope, wide))),
    ):
        paths.append((found.join(weighed, "query_id"), name))
    return retrieval.fused(paths, k).select("query_id", "pk", "score", "rank")
