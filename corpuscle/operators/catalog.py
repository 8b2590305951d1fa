"""What is in the store: counts by document, type and collection, and years by vote."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stats(chunks: DataFrame) -> DataFrame:
    """Number of chunks and year for each document and type."""
    return chunks.groupBy("doc_id", "type").agg(F.count("*").alias("n"), F.max("publication_year").alias("publication_year"))


def documents(chunks: DataFrame) -> DataFrame:
    """For each document its number of chunks, first name that isn't empty and first year that isn't 0."""
    named, dated = F.col("doc_name") != "", F.col("publication_year") != 0
    first = lambda c, ok: F.min_by(F.when(ok, F.col(c)), F.when(ok, F.col("paragraph_index")))
    return chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), first("doc_name", named).alias("doc_name"), first("publication_year", dated).alias("publication_year"))


def collections(chunks: DataFrame, column: str, prefix: str) -> DataFrame:
    """Chunks and documents of each collection whose name has the prefix."""
    own = chunks.where(F.col(column).startswith(prefix)).groupBy(F.col(column).alias("collection"))
    return own.agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("documents"))


def year_by_vote(chunks: DataFrame, first: int = 5, chars: int = 2000) -> DataFrame:
    """The year that a document's first chunks name most often, of equals the latest."""
    found = F.explode(F.regexp_extract_all(F.substring("content", 1, chars), F.lit("(?:19|20)[0-9][0-9]"), F.lit(0)))
    votes = chunks.where(F.col("pos") <= first).select("doc_id", found.alias("year")).groupBy("doc_id", F.col("year").cast("int").alias("year")).count()
    order = Window.partitionBy("doc_id").orderBy(F.desc("count"), F.desc("year"))
    return votes.withColumn("r", F.row_number().over(order)).where("r = 1").select("doc_id", "year")
