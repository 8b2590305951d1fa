"""The chunk table: made from documents, loaded, merged, replaced and checked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscle.functions import text

#: The types that a chunk may have; any other counts as text.
TYPES = ("summary", "text", "title", "table", "image", "equation", "references")
#: Longest content and context; longer ones are cut to one less and an ellipsis.
CONTENT_CHARS, CONTEXT_CHARS = 32000, 8000
SCHEMA = T.StructType([T.StructField("pk", T.StringType()), T.StructField("doc_id", T.StringType()), T.StructField("doc_name", T.StringType()), T.StructField("chunk_id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("section", T.StringType()), T.StructField("page_start", T.IntegerType()), T.StructField("paragraph_index", T.IntegerType()), T.StructField("publication_year", T.IntegerType()), T.StructField("content", T.StringType())])


def from_documents(docs: DataFrame) -> DataFrame:
    """Chunks of plain documents: a row for each line that isn't empty.

    Type, page, section and year follow from ordinals by rule and are no data: the first line is a title, the second a
    summary, then every 11th an image, 13th a table, 17th an equation, 19th references, the rest text.
    """
    line = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("at", "content")).toDF("doc_id", "n", "lang", "source", "at", "content")
    at = F.col("at") + 1
    kind = F.when(at == 1, "title").when(at == 2, "summary").when(at % 11 == 0, "image").when(at % 13 == 0, "table").when(at % 17 == 0, "equation").when(at % 19 == 0, "references").otherwise("text")
    return line.where("content != ''").select(F.concat_ws("::", "doc_id", at.cast("string")).alias("pk"), "doc_id", F.concat(F.lit("paper "), "doc_id").alias("doc_name"), F.concat(F.lit("c"), at.cast("string")).alias("chunk_id"), kind.alias("type"), F.concat(F.lit("s"), F.floor(at / 10).cast("string")).alias("section"), F.floor((at - 1) / 5).cast("int").alias("page_start"), at.cast("int").alias("paragraph_index"), (F.lit(2000) + F.col("n") % 25).cast("int").alias("publication_year"), "content", "source", "lang")


#: The same view for DuckDB, to put after WITH.
CHUNKS_SQL = """chunk_lines AS (SELECT doc_id, lang, source, unnest(parts) AS content, unnest(range(1, len(parts) + 1)) AS ord FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) parts FROM documents) p),
chunks AS (SELECT doc_id || '::' || ord AS pk, CAST(doc_id AS VARCHAR) AS doc_id, 'paper ' || doc_id AS doc_name, 'c' || ord AS chunk_id,
 CASE WHEN ord = 1 THEN 'title' WHEN ord = 2 THEN 'summary' WHEN ord % 11 = 0 THEN 'image' WHEN ord % 13 = 0 THEN 'table' WHEN ord % 17 = 0 THEN 'equation' WHEN ord % 19 = 0 THEN 'references' ELSE 'text' END AS type,
 's' || (ord // 10) AS section, CAST((ord - 1) // 5 AS INTEGER) AS page_start, CAST(ord AS INTEGER) AS paragraph_index, CAST(2000 + doc_id % 25 AS INTEGER) AS publication_year, content, source, lang
 FROM chunk_lines WHERE content <> '')"""


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Chunk rows with vectors from JSON files below a path, with the file of each."""
    wide = T.StructType([*SCHEMA.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])
    rows = spark.read.schema(wide).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*_vec.json").json(path)
    return rows.withColumn("file", F.col("_metadata.file_path"))


def sidecar_path(path: str) -> F.Column:
    """Where the metadata of a vector file is: its name without _vec, _vectors or _embedded, then _meta.json."""
    return F.regexp_replace(path, r"(?:_vec|_vectors|_embedded)?\.json$", "_meta.json")


def with_sidecars(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Files with the name and year of their sidecar where there is one."""
    return files.withColumn("meta", sidecar_path("path")).join(sidecars.withColumnRenamed("path", "meta"), "meta", "left")


def merge_sidecar(old: DataFrame, new: DataFrame, key: str, replaced: Sequence[str]) -> DataFrame:
    """Sidecars after a write: only the named columns take the new value, and only where it isn't null."""
    fresh = new.select(key, *(F.col(c).alias(f"new_{c}") for c in replaced))
    both = old.join(fresh, key, "full")
    return both.select(*(F.coalesce(f"new_{c}", c).alias(c) if c in replaced else F.col(c) for c in old.columns))


def infer_meta(files: DataFrame, explicit: str = "explicit_name", sidecar: str = "sidecar_name", path: str = "path", year: str = "explicit_year", content: str = "content") -> DataFrame:
    """Document name and year: explicit, then sidecar, then file stem (its folder for generic stems); year also from the path, then the text."""
    stem = F.regexp_extract(path, r"([^/]+?)(?:_vec|_vectors)?\.json$", 1)
    folder = F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)
    name = F.when(stem.isin("content", "knowledge_blocks", "output", "result"), folder).otherwise(stem)
    blank = lambda c: F.when(F.trim(c) != "", F.col(c))
    found = lambda c: F.when(F.regexp_extract(c, "(?:19|20)[0-9][0-9]", 0) != "", F.regexp_extract(c, "(?:19|20)[0-9][0-9]", 0).try_cast("int"))
    return files.select(path, F.coalesce(blank(explicit), blank(sidecar), name).alias("doc_name"), F.coalesce(F.when(F.col(year) > 0, F.col(year)), found(path), found(content), F.lit(0)).alias("publication_year"))


def upsert_latest(old: DataFrame, new: DataFrame, key: str = "pk", version: str = "version") -> DataFrame:
    """One row for each key: of several the one with the greatest version, new rows before old ones."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    order = Window.partitionBy(key).orderBy(F.desc("__new"), F.desc(version))
    return both.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n", "__new")


def purge_replace(old: DataFrame, new: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Old rows of documents that the new rows don't have, and the new rows."""
    return old.join(new.select(doc).distinct(), doc, "left_anti").select(new.columns).unionByName(new)


def append_new(old: DataFrame, new: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Old rows, and the new rows of documents that are not there yet."""
    return old.unionByName(new.join(old.select(doc).distinct(), doc, "left_anti").select(old.columns))


def checked(chunks: DataFrame, dim: int | None = None) -> DataFrame:
    """The same rows if the required columns have their types; else an error that names what is wrong."""
    wrong = [f.name for f in SCHEMA if f.name not in chunks.columns or chunks.schema[f.name].dataType != f.dataType]
    if wrong:
        raise ValueError(f"rebuild needed: columns {wrong} are missing or of another type")
    if dim is not None:
        return chunks.withColumn("embedding", F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(F.raise_error(F.lit(f"vector size is not {dim}"))))
    return chunks


def normalised(chunks: DataFrame) -> DataFrame:
    """Rows as the table holds them: key from document and chunk, known types only, long texts cut, sentinels for nulls."""
    kind = F.lower(F.trim("type"))
    return chunks.select(F.concat_ws("::", "doc_id", "chunk_id").alias("pk"), F.substring("doc_id", 1, 128).alias("doc_id"), F.when(kind.isin(*TYPES), kind).otherwise("text").alias("type"), F.coalesce("page_start", F.lit(-1)).alias("page_start"), F.coalesce("paragraph_index", F.lit(-1)).alias("paragraph_index"), text.cut(F.coalesce("content", F.lit("")), CONTENT_CHARS).alias("content"))
