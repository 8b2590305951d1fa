"""Files that come in and results that go out: the newest layout, sinks that go on where they stopped, reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def newest(spark: SparkSession, path: str, pattern: str = "*content_list_v2.json") -> str | None:
    """The file below a folder whose name fits and that was changed last; None without one. Only names and times are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    row = files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path")).first()
    return row["path"]


def layouts(spark: SparkSession, path: str, pattern: str = "*content_list_v2.json") -> DataFrame:
    """``(doc_id, layout)`` of all layout files below a folder: each document's newest, the folder's name its id."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    own = files.select(F.element_at(F.split("path", "/"), -2).alias("doc_id"), "path", "modificationTime", F.col("content").cast("string").alias("layout"))
    return own.groupBy("doc_id").agg(F.max_by("layout", F.struct("modificationTime", "path")).alias("layout"))


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key a sink doesn't hold yet: what an ingestion that was cut off still has to do."""
    return rows.join(done.select(key).distinct(), key, "left_anti").select(rows.columns)


def append_pending(rows: DataFrame, path: str, key: str) -> int:
    """Write the rows that a JSON sink doesn't hold yet, and say how many; the sink's own rows are its progress."""
    spark = rows.sparkSession
    try:
        done = spark.read.schema(rows.schema).json(path)
        rows = pending(rows, done, key)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    before = _count(spark, path, rows)
    rows.write.mode("append").json(path)
    return _count(spark, path, rows) - before


def _count(spark: SparkSession, path: str, like: DataFrame) -> int:
    try:
        return spark.read.schema(like.schema).json(path).count()
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return 0


def write_report(report: DataFrame, path: str, kind: str = "csv") -> None:
    """A report of a few rows as one file, csv with a header or json."""
    writer = report.coalesce(1).write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)


def uncached(texts: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts (pk, text) that a cache (digest, embedding) has vectors of, and the distinct digests and texts it lacks."""
    own = texts.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    return own.join(cache, "digest").select("pk", "embedding"), own.join(cache, "digest", "left_anti").groupBy("digest").agg(F.first("text").alias("text"))


def location(settings: Mapping[str, str], legacy: str = "uri") -> tuple[str, str]:
    """(mode, path) of the chunk table: a folder of its own, else the warehouse, else what an older setting names."""
    if path := settings.get("path"):
        return "folder", path
    if name := settings.get("table"):
        return "table", name
    if old := settings.get(legacy):
        return ("folder", old) if "://" not in old or old.startswith("file:") else ("table", old.rsplit("/", 1)[-1])
    return "table", "chunks"
