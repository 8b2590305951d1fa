"""Windows, budgets, quotas and merges over ranked rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(rows: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """The first row of each key."""
    own = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(own)).where("__n = 1").drop("__n")


def rescued(reranked: DataFrame, lexical: DataFrame, dense: DataFrame, top: int, each: int) -> DataFrame:
    """The best reranked hits and the best two of each path; a key once, reranked first."""
    parts = [(reranked, top, 0), (lexical, each, 1), (dense, each, 2)]
    both = None
    for rows, k, place in parts:
        own = rows.where(F.col("rank") <= k).select("query_id", "pk", "rank", F.lit(place).alias("place"))
        both = own if both is None else both.unionByName(own)
    return first_by(both, ["query_id", "pk"], "place", "rank").select("query_id", "pk", "place")


def tiered_quota(hits: DataFrame, quotas: tuple[int, int, int] = (8, 5, 3)) -> DataFrame:
    """Hits by document: documents in thirds by the sum of their three best scores, each third with its own quota."""
    best = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("score"), "pk")
    ranked = hits.withColumn("k", F.row_number().over(best))
    weight = ranked.where("k <= 3").groupBy("query_id", "doc_id").agg(F.round(F.sum("score"), 6).alias("w"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("w"), "doc_id"))
    n = F.count("*").over(Window.partitionBy("query_id"))
    first, second = F.greatest(F.lit(1), F.floor(n / 3)), F.floor(2 * n / 3)
    quota = F.when(place <= first, quotas[0]).when(place <= second, quotas[1]).otherwise(quotas[2])
    return ranked.join(weight.select("query_id", "doc_id", quota.alias("quota")), ["query_id", "doc_id"]).where("k <= quota").select("query_id", "doc_id", "pk", "quota")


def prefix_dedup(hits: DataFrame, chars: int = 80) -> DataFrame:
    """Of hits of a document that start alike without white space the best."""
    prefix = F.substring(F.regexp_replace("content", r"[ \t\r\n]+", ""), 1, chars)
    return first_by(hits.withColumn("__p", prefix), ["doc_id", "__p"], F.desc("score"), "pk").drop("__p")


def paragraph_numbers(blocks: DataFrame) -> DataFrame:
    """Numbers from 1 for paragraphs of a document that are neither equations nor before its first heading."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    counts = (F.col("type") == "text") & (F.max(F.when(F.col("type") == "title", 1).otherwise(0)).over(order) == 1)
    return blocks.withColumn("c", counts.cast("int")).select("pk", F.when(F.col("c") == 1, F.sum("c").over(order)).otherwise(-1).cast("int").alias("paragraph_index"))


def section_fill(blocks: DataFrame) -> DataFrame:
    """The last heading before each block."""
    order = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.select("pk", F.last(F.when(F.col("type") == "title", F.col("text")), ignorenulls=True).over(order).alias("section"))


def batched(rows: DataFrame, key: str, order: str, value: str, size: int) -> DataFrame:
    """Rows of a key in batches: first and last ordinal, number, and the values joined by line ends."""
    own = rows.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(order))).withColumn("batch", F.floor((F.col("n") - 1) / size))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", value))), lambda x: x[value]), "\n")
    return own.groupBy(key, "batch").agg(F.min("n").alias("first"), F.max("n").alias("last"), F.count("*").alias("size"), joined.alias("content")).drop("batch")


def budget_cut(hits: DataFrame, chars: int, by: Sequence[str]) -> DataFrame:
    """Hits in order until the first that overflows the budget; each costs its length and two."""
    order = Window.partitionBy(*by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return hits.withColumn("used", F.sum(F.length("content") + 2).over(order)).where(F.col("used") <= chars)


def registry_window(rows: DataFrame, most: int = 40) -> DataFrame:
    """Registry rows of a session that stay: pinned ones, and of the others the newest that still fit."""
    pinned = F.sum(F.col("pinned").cast("int")).over(Window.partitionBy("session_id"))
    place = F.row_number().over(Window.partitionBy("session_id", "pinned").orderBy(F.desc("pos")))
    return rows.withColumn("p", pinned).withColumn("k", place).where(F.col("pinned") | (F.col("k") <= most - F.col("p"))).drop("p", "k")


def registry_merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two registries in one: the first place and name of a document, pinned if either is."""
    both = old.withColumn("g", F.lit(0)).unionByName(new.withColumn("g", F.lit(1)))
    return both.groupBy("session_id", "doc_id").agg(F.min_by("doc_name", F.struct("g", "pos")).alias("doc_name"), F.bool_or("pinned").alias("pinned"), F.min(F.struct("g", "pos")).alias("at")).select("session_id", "doc_id", "doc_name", "pinned", F.row_number().over(Window.partitionBy("session_id").orderBy("at")).alias("pos"))


def recent_turns(turns: DataFrame, n: int) -> DataFrame:
    """The last n rows of each conversation."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("k", F.row_number().over(order)).where(F.col("k") <= n).drop("k")


def history_from_user(turns: DataFrame, n: int) -> DataFrame:
    """The last n rows of each conversation from the first of them that a user said."""
    own = recent_turns(turns, n)
    first = F.min(F.when(F.col("role") == "user", F.col("turn"))).over(Window.partitionBy("conv_id"))
    return own.withColumn("first", first).where("turn >= first").drop("first")


def merged_hits(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old hits in their order, then new keys in theirs."""
    both = old.withColumn("g", F.lit(0)).unionByName(new.withColumn("g", F.lit(1)))
    own = first_by(both, ["query_id", "pk"], "g", "pos")
    return own.select("query_id", "pk", "score", F.row_number().over(Window.partitionBy("query_id").orderBy("g", "pos")).alias("pos"))


def merged_decisions(rows: DataFrame) -> DataFrame:
    """Decisions of one question in one: ordered unions of lists, first scalars that are set, rewrites joined."""
    held = F.array_sort(F.collect_list(F.struct("pos", "routes", "docs", "chunk_type", "rewrite")))
    own = rows.groupBy("query_id").agg(held.alias("h"))
    union = lambda c: F.array_join(F.array_distinct(F.flatten(F.transform("h", lambda x: F.coalesce(x[c], F.array().cast("array<string>"))))), ",")
    kinds = F.array_compact(F.transform("h", lambda x: x["chunk_type"]))
    return own.select("query_id", union("routes").alias("routes"), union("docs").alias("docs"), F.get(kinds, F.lit(0)).alias("chunk_type"), F.array_join(F.transform("h", lambda x: x["rewrite"]), " | ").alias("rewrite"))
