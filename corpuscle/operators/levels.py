"""Two-level retrieval: documents by titles and summaries first, then passages, by vectors and the stored lexical index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.sources.shared import stored

from . import lexical_index as lexical
from . import retrieval as r
from .lexical_index import LexicalIndex


def first_level(queries: DataFrame, chunks: DataFrame, index: LexicalIndex, overview: Sequence[str], k: int = 5, docs: int = 10) -> DataFrame:
    """``(query_id, doc_id, score, rank)``: documents by their best title or summary on either path."""
    own = chunks.where(F.col("type").isin(*overview))
    names = own.select("pk", "doc_id", "doc_name")
    paths = [r.documents_by_score(hits.join(names, "pk"), None) for hits in (r.dense(queries, own, k), lexical.search(queries, index, k, overview))]
    return r.merged_rankings(*paths, 1.0, docs)


def progressive(queries: DataFrame, chunks: DataFrame, index: LexicalIndex, overview: Sequence[str], pools: Sequence[tuple[Sequence[str], int]], k: int = 5, least: float = 0.35) -> DataFrame:
    """``(query_id, pk, score, sources, stage)``: documents first, then passages.

    The first level finds documents by titles and summaries. Where the best passages in these are sure enough, the second
    level stays in them (stage l2), else it searches everywhere (l2_global). Each pool of types is searched by both paths,
    and cut to a number of its own. ``index`` holds the chunks that have vectors.
    """
    scope = stored(first_level(queries, chunks, index, overview).select("query_id", "doc_id"), "first-level")
    prose = chunks.where(F.col("type").isin(*pools[0][0]))
    sure = r.confidence(lexical.scoped_search(queries, index, scope, 1, pools[0][0]), r.scoped_dense(queries, prose, scope, 1), least)
    sure = stored(queries.select("query_id").join(sure, "query_id", "left").select("query_id", F.coalesce("sure", F.lit(False)).alias("sure")), "confidence")
    inside, outside = (queries.join(sure.where(c).select("query_id"), "query_id", "left_semi") for c in (F.col("sure"), ~F.col("sure")))
    out = None
    for types, most in pools:
        part = chunks.where(F.col("type").isin(*types))
        paths = {
            "l2": [("vector", r.scoped_dense(inside, part, scope, k)), ("bm25", lexical.scoped_search(inside, index, scope, k, types))],
            "l2_global": [("vector", r.dense(outside, part, k)), ("bm25", lexical.search(outside, index, k, types))],
        }
        for stage, found in paths.items():
            hits = r.top_k(r.union_max(found), most).select("query_id", "pk", "score", "sources", F.lit(stage).alias("stage"))
            out = hits if out is None else out.unionByName(hits)
    return out


def direct(queries: DataFrame, chunks: DataFrame, index: LexicalIndex, scope: DataFrame, types: Sequence[str], k: int = 8) -> DataFrame:
    """``(query_id, pk, score, sources)``: the k best passages of each query within the documents it names."""
    own = chunks.where(F.col("type").isin(*types))
    return r.top_k(r.union_max([("vector", r.scoped_dense(queries, own, scope, k)), ("bm25", lexical.scoped_search(queries, index, scope, k, types))]), k).drop("rank")
