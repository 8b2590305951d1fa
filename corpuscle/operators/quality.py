"""Judging hits: score statistics, thresholds, exemptions, gates and the likely cause of poor ones."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import first_by

#: Types that are found by structure and not by wording.
STRUCTURAL = ("image", "table", "references")
#: Standard deviation that stands in for zero.
LEAST_DEVIATION = 1e-3
#: Weights of the best and of the mean route quality where there are several routes.
BEST_SHARE, MEAN_SHARE = 0.7, 0.3


def clamped(rows: DataFrame, k: int) -> DataFrame:
    """The k best reranked rows of each query: scores held to 0..1, ties in the order they came; null scores go."""
    held = rows.where("score IS NOT NULL").withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "pos")
    return held.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def dominant(rows: DataFrame, by: Sequence[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each group; of equally frequent ones that which came first."""
    counted = rows.groupBy(*by, value).agg(F.count("*").alias("n"), F.min(order).alias("__first"))
    return first_by(counted, by, F.desc("n"), F.col("__first")).select(*by, value, "n")


def score_stats(rows: DataFrame) -> DataFrame:
    """Mean, greatest score and number of hits by route, by type and in all, in one pass; means skip nulls, counts don't."""
    sets = rows.groupingSets([["query_id", "route"], ["query_id", "type"], ["query_id"]], "query_id", "route", "type")
    level = F.when(F.grouping("route") == 0, "route").when(F.grouping("type") == 0, "type").otherwise("all")
    return sets.agg(level.alias("level"), F.round(F.avg("score"), 6).alias("mean"), F.max("score").alias("best"), F.count("*").alias("n"))


def group_zscore(rows: DataFrame, group: str = "grp") -> DataFrame:
    """Scores as distances from their group's mean in its deviations, where a query has several groups and a group several scores."""
    query, own = Window.partitionBy("query_id"), Window.partitionBy("query_id", group)
    several = F.min(group).over(query) != F.max(group).over(query)
    deviation = F.stddev_pop("score").over(own)
    z = (F.col("score") - F.avg("score").over(own)) / F.when(deviation > 0, deviation).otherwise(LEAST_DEVIATION)
    return rows.withColumn("z", F.when(several & (F.count("score").over(own) >= 2), z).otherwise(F.col("score")))


def route_quality(rows: DataFrame, k: int) -> DataFrame:
    """Mean of the k best scores of each route."""
    order = Window.partitionBy("query_id", "route").orderBy(F.desc("score"))
    best = rows.where("score IS NOT NULL").withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= k)
    return best.groupBy("query_id", "route").agg(F.avg("score").alias("quality"))


def gate(routes: DataFrame, threshold: Column) -> DataFrame:
    """Blended quality of each query, and whether any of its routes reaches its threshold."""
    blended = F.when(F.count("*") == 1, F.max("quality")).otherwise(BEST_SHARE * F.max("quality") + MEAN_SHARE * F.avg("quality"))
    return routes.groupBy("query_id").agg(blended.alias("quality"), F.bool_or(F.col("quality") >= threshold).alias("passes"))


def threshold(matrix: Mapping[tuple[str, str, str], float], default: float, route: str = "route", stage: str = "stage", kind: str = "type") -> Column:
    """The threshold for a hit: the most specific entry of (route, stage, type) that there is, empty strings fitting any.

    In order: route, stage and type; route and stage; route and type; route; type; the default. The matrix is
    configuration and goes into the plan as a literal.
    """
    r, s, t = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (route, stage, kind))
    if not matrix:
        return F.lit(default)
    table = F.create_map(*chain.from_iterable((F.lit("|".join(k)), F.lit(float(v))) for k, v in matrix.items()))
    none = F.lit("")
    ladder = [(r, s, t), (r, s, none), (r, none, t), (r, none, none), (none, none, t)]
    return F.coalesce(*(F.try_element_at(table, F.concat_ws("|", *step)) for step in ladder), F.lit(default))


def gated(hits: DataFrame, matrix: Mapping[tuple[str, str, str], float], default: float, quality_k: int, k: int) -> DataFrame:
    """The k best hits of each route (query_id, route, pk, type, score) with the verdict on their query.

    A route's quality is the mean of its best scores and its threshold that of its most frequent type; a query passes with
    any of its routes.
    """
    kinds = dominant(hits, ["query_id", "route"], "type", "pk").select("query_id", "route", "type")
    routes = route_quality(hits, quality_k).join(kinds, ["query_id", "route"])
    judged = gate(routes, threshold(matrix, default, stage=F.lit("")))
    order = Window.partitionBy("query_id", "route").orderBy(F.desc("score"), "pk")
    best = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(judged, "query_id").select("query_id", "route", "pk", "rank", "quality", "passes")


def exemption(route: str = "route", kind: str = "type", asked: str = "asked_type", structural_refs: str = "structural_refs") -> Column:
    """Whether a hit is spared the rerank gate: full, topk_only or none.

    Metadata hits are, fully if the question named a figure, table, page or paragraph; else structural types that the
    question asked for.
    """
    kind_, asked_ = F.lower(F.trim(kind)), F.lower(F.trim(F.coalesce(asked, F.lit(""))))
    by_route = F.when(F.col(structural_refs), "full").otherwise("topk_only")
    return F.when(F.col(route) == "metadata", by_route).when(kind_.isin(*STRUCTURAL) & (kind_ == asked_), "full").otherwise("none")


def _confidence(base: str, signal: str) -> str:
    """The base, moved by up to 0.06 either way by a signal from 0 to 1, held to 0.5..0.99."""
    return f"greatest(0.5e0, least(0.99e0, ({base}) + 0.12e0 * (greatest(0e0, least(1e0, {signal})) - 0.5e0)))"


_IMAGE_LOW = "(n_image = 0 OR avg_image < global_avg * 0.5e0)"
_TABLE_LOW = "(n_table = 0 OR avg_table < global_avg * 0.5e0)"
_STRONG = f"((n_fig > 0 AND {_IMAGE_LOW}) OR (n_tab > 0 AND {_TABLE_LOW}))"
_MISSING = "((n_fig > 0 AND n_image = 0) OR (n_tab > 0 AND n_table = 0))"
_GAP = f"(CASE WHEN global_avg > 0.001e0 AND greatest(avg_image, avg_table) > 0 THEN greatest(0e0, 1e0 - greatest(avg_image, avg_table) / global_avg) WHEN {_MISSING} THEN 0.8e0 ELSE 0.4e0 END)"
_STRONG_SIGNAL = f"((least(1e0, (n_fig + n_tab) / 3e0) + (CASE WHEN {_MISSING} THEN 1e0 ELSE 0.4e0 END) + {_GAP}) / 3e0)"

#: (cause, when it holds, confidence) in the order in which equal confidences are settled: plain SQL over a row of figures.
CAUSES = (
    ("wrong_type", f"NOT has_metadata AND ({_STRONG} OR n_ref > 0)", f"CASE WHEN {_STRONG} THEN {_confidence('0.92e0', _STRONG_SIGNAL)} ELSE {_confidence('0.80e0', 'n_ref / 2e0')} END"),
    ("wrong_type", "refs_intent AND (n_references = 0 OR avg_references < refs_threshold)", _confidence("0.86e0", "CASE WHEN n_references = 0 THEN 0.85e0 ELSE 0.3e0 + 0.6e0 * greatest(0e0, 1e0 - avg_references / greatest(refs_threshold, 0.001e0)) END")),
    ("wrong_route", "n_dead > 0 AND n_alive > 0 AND ((is_summary AND NOT has_summary) OR (has_docs AND NOT has_local) OR (progressive_dead AND NOT has_progressive))", _confidence("0.86e0", "(n_dead * 1e0 / n_routes + least(1e0, alive_max / greatest(threshold, 0.001e0))) / 2e0")),
    ("too_narrow", "hits < 3 AND top3_avg >= type_threshold * 0.75e0", _confidence("CASE WHEN (is_summary AND has_summary) OR (NOT is_summary AND has_progressive) THEN 0.70e0 ELSE 0.72e0 END", "(1e0 - hits / 3e0 + least(1e0, top3_avg / greatest(type_threshold, 0.001e0))) / 2e0")),
    ("too_broad", "hits >= 15 AND quality < type_threshold", _confidence("0.75e0", "(least(1e0, hits / 30e0) + greatest(0e0, 1e0 - quality / greatest(type_threshold, 0.001e0))) / 2e0")),
)
#: Without any cause: nothing scored, or off topic.
ZERO_CONFIDENCE, OFF_TOPIC_CONFIDENCE = 0.35, 0.3
#: A second cause counts from this confidence on, and at most so far below the first.
SECOND_LEAST, SECOND_GAP = 0.65, 0.25
#: From this confidence on these causes need no reflection.
SURE, SURE_CAUSES = 0.90, ("wrong_type", "wrong_route")


def diagnosed(figures: DataFrame) -> DataFrame:
    """Likely cause of each query's poor hits, its confidence, other causes to act on, and whether reflection can be skipped."""
    rules = [F.when(F.expr(when), F.struct(F.expr(sure).cast("double").alias("confidence"), F.lit(-k).alias("place"), F.lit(cause).alias("cause"))) for k, (cause, when, sure) in enumerate(CAUSES)]
    nothing = (F.col("quality") <= 0.05) & (F.col("hits") > 0)
    fallback = F.struct(F.when(nothing, ZERO_CONFIDENCE).otherwise(OFF_TOPIC_CONFIDENCE).alias("confidence"), F.lit(0).alias("place"), F.when(nothing, "zero").otherwise("off_topic").alias("cause"))
    found = figures.withColumn("__all", F.array_compact(F.array(*rules))).withColumn("__main", F.coalesce(F.array_max("__all"), fallback))
    main, least = F.col("__main"), F.greatest(F.lit(SECOND_LEAST), F.col("__main.confidence") - SECOND_GAP)
    others = F.filter("__all", lambda c: (c["confidence"] >= least) & (c["cause"] != main["cause"]))
    return found.select("query_id", main["cause"].alias("cause"), main["confidence"].alias("confidence"), F.array_join(F.transform(others, lambda c: c["cause"]), ",").alias("others"), ((main["confidence"] >= SURE) & main["cause"].isin(*SURE_CAUSES)).alias("skip_reflect"))
