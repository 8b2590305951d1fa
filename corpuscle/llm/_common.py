"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
#: Keys with more than this share of a table's rows are hot; there are fewer than 2,048 of them in any table.
HOT_SHARE = 1 / 2048


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a new one where it is unset.

    The fallback is a local folder and so only taken with a local master (tests); a cluster must name a shared folder.
    """
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
        base = _OWN[app]
    return f"{base.rstrip('/')}/{app}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts lineage, and lost executors cost no rework."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_uneven(left: DataFrame, right: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """An inner join with a right side that has one row for each key, of n rows of ``left`` (its column ``n``) out of ``rows``.

    The hot keys are broadcast, fewer than 1 / HOT_SHARE rows however large the tables, so none of them fills a task;
    the others are joined by shuffle. Both sides are read more than once and should be tables.
    """
    hot = F.col("n") > rows * HOT_SHARE
    few = F.broadcast(right.where(hot))
    rest = left.join(F.broadcast(right.where(hot).select(*keys)), keys, "left_anti").join(right.where(~hot), keys)
    return left.join(few, keys).unionByName(rest)


def without_uneven(left: DataFrame, right: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """The rows of ``left`` whose key is not in ``right``, by the same means as :func:`join_uneven`."""
    hot = F.col("n") > rows * HOT_SHARE
    return left.join(F.broadcast(right.where(hot).select(*keys)), keys, "left_anti").join(right.where(~hot), keys, "left_anti")


def text_bytes(text: str | Column) -> Column:
    """A text as UTF-8 bytes; null counts as empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(text.cast("binary"), F.lit(b"").cast("binary"))


def text_id(data: Column) -> list[Column]:
    """128 bits, t1 and t2, that name a text by its content: rows with the same text share them."""
    return [F.xxhash64(data).alias("t1"), F.xxhash64(F.lit(1), data).alias("t2")]


def free_prefix(df: DataFrame, prefix: str) -> str:
    """The prefix, with as many underscores that no column of ``df`` starts so, in any case."""
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix = "_" + prefix
    return prefix


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
