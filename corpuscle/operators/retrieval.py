"""Retrieval of chunks for many questions at once: lexical, dense, fused and two-level."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions import text
from corpuscle.sources.shared import stored
from corpuscle.functions.words import DENSE_WEIGHT, LEAST_WEIGHT, MOST_WEIGHT

from . import bm25_scores
from .bm25_scores import DIGITS, K1, B

#: The constant of rank fusion.
RRF_K = 60
#: Query vectors that are sent to every task at most; more of them meet the vectors in blocks dealt out by shuffle.
QUERY_BLOCK = 4096
#: Vectors in such a block, and query vectors whose scores are held at a time.
VECTOR_BLOCK, QUERY_COLUMNS = 16_384, 256
#: Asked terms that are broadcast at most, once they are counted.
BROADCAST_TERMS = 200_000


def top_k(hits: DataFrame, k: int | None, by: Sequence[str] = ("query_id",), score: str = "score", tie: str = "pk") -> DataFrame:
    """The k best of each group (all, if None) with their rank; ties go to the smaller key. Spark limits each group before the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(tie))
    ranked = hits.withColumn("rank", F.row_number().over(order))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def postings(chunks: DataFrame, key: str = "pk", value: str = "content") -> DataFrame:
    """``(key, term, tf, dl)``: how often each token is in each chunk, and the chunk's number of tokens."""
    own = chunks.select(key, text.tokens(F.col(value)).alias("t")).select(key, F.size("t").alias("dl"), F.explode("t").alias("term"))
    return own.groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def corpus_stats(chunks: DataFrame, value: str = "content") -> DataFrame:
    """One row: number of chunks and mean number of tokens."""
    size = F.size(text.tokens(F.col(value)))
    return chunks.agg(F.count("*").alias("n_docs"), F.avg(size).alias("avgdl"))


def bm25(queries: DataFrame, chunks: DataFrame, k: int | None, key: str = "pk", value: str = "content") -> DataFrame:
    """``(query_id, key, score, rank)`` of the k chunks (all, if None) that fit each query (query_id, q) best.

    The chunks are tokenized once, and of their tokens only those go on that some query has. A token that a query repeats
    counts as often. For the k best of up to BROADCAST_TERMS asked terms chunks are scored where they are.
    """
    asked = stored(queries.select("query_id", F.explode(text.tokens(F.col("q"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf")), "asked-terms")
    few = asked.count() <= BROADCAST_TERMS
    if k is None or not few:
        return _bm25_by_shuffle(asked, few, chunks, k, key, value)
    words = [r["term"] for r in asked.select("term").distinct().collect()]
    every = stored(bm25_scores.counted(chunks.select(key, text.tokens(F.col(value)).alias("t")), "t", words), "counted")
    own = bm25_scores.once_each(every, [key])
    stats = every.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    df = own.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weighed = asked.join(F.broadcast(df), "term").select("query_id", "term", F.col("qtf") * F.ln((stats["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0))
    found = bm25_scores.best(own, [tuple(r) for r in weighed.collect()], stats["avgdl"], k, asked.schema["query_id"].dataType, key)
    return top_k(found, k, tie=key)


def _bm25_by_shuffle(asked: DataFrame, few: bool, chunks: DataFrame, k: int | None, key: str, value: str) -> DataFrame:
    """The same with a row for each pair; an empty token for each chunk carries its length to the statistics."""
    small = (lambda t: F.broadcast(t)) if few else (lambda t: t)
    terms = small(asked.select("term").distinct().union(chunks.sparkSession.createDataFrame([("",)], "term string")))
    own = chunks.select(key, text.tokens(F.col(value)).alias("t")).select(key, F.size("t").alias("dl"), F.explode(F.concat(F.array(F.lit("")), "t")).alias("term"))
    own = stored(own.join(terms, "term", "left_semi").groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl")), "postings")
    stats = own.where("term = ''").agg(F.sum("tf").alias("n_docs"), (F.sum(F.col("tf") * F.col("dl")) / F.sum("tf")).alias("avgdl"))  # one row
    found = own.where("term != ''")
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    weighed = df.join(F.broadcast(stats)).withColumn("idf", F.ln((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0))
    part = F.col("qtf") * F.col("idf") * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = found.join(small(weighed), "term").join(small(asked), "term").groupBy("query_id", key).agg(F.round(F.sum(part), DIGITS).alias("score"))
    return top_k(scored, k, tie=key)


def with_chunks(hits: DataFrame, chunks: DataFrame, key: str = "pk") -> DataFrame:
    """Hits with the columns of their chunks. Hits are made once, and up to BROADCAST_TERMS of them go to the chunks, which stay where they are."""
    own = stored(hits, "hits")
    return (F.broadcast(own) if own.count() <= BROADCAST_TERMS else own).join(chunks, key)


def bm25_sql(k: int | None, queries: str, source: str = "chunks", key: str = "pk") -> str:
    """CTEs of the same for DuckDB, ending in ``bm25``; ``queries`` names a relation (query_id, q)."""
    tok = text.TOKENS_SQL.format
    return f"""bt AS (SELECT {key}, {tok('content')} t FROM {source}), be AS (SELECT {key}, len(t) dl, unnest(t) term FROM bt),
bp AS (SELECT {key}, term, count(*) tf, any_value(dl) dl FROM be GROUP BY {key}, term), bd AS (SELECT term, count(*) df FROM bp GROUP BY term),
bs AS (SELECT count(*) n_docs, avg(len(t)) avgdl FROM bt), bq AS (SELECT query_id, term, count(*) qtf FROM (SELECT query_id, unnest({tok('q')}) term FROM {queries}) x GROUP BY ALL),
bsc AS (SELECT query_id, {key}, round(sum(qtf * ln((n_docs - df + 0.5) / (df + 0.5) + 1.0) * (tf * {K1 + 1}) / (tf + {K1} * ({1 - B} + {B} * dl / avgdl))), {DIGITS}) score FROM bq JOIN bp USING (term) JOIN bd USING (term) CROSS JOIN bs GROUP BY query_id, {key}),
bm25 AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {key}) AS INTEGER) AS rank FROM bsc) r WHERE rank <= {k if k is not None else 'rank'})"""


def dense(queries: DataFrame, vectors: DataFrame, k: int, key: str = "pk", vector: str = "embedding") -> DataFrame:
    """``(query_id, key, score, rank)`` of the k largest inner products of each query ``(query_id, q_vec)``.

    Exact, ties of rounded scores included: each task keeps the best of its own rows by matrix product, and a window
    merges them. Up to QUERY_BLOCK query vectors are sent to every task; more of them stay a table, and each block of
    queries meets each block of vectors in a task of its own.
    """
    types = [queries.schema["query_id"].dataType.simpleString(), vectors.schema[key].dataType.simpleString()]
    schema = f"query_id {types[0]}, {key} {types[1]}, score double"
    asked, own = queries.select("query_id", "q_vec").where("q_vec IS NOT NULL"), vectors.select(key, vector).where(F.col(vector).isNotNull())
    rows = asked.limit(QUERY_BLOCK + 1).collect()
    if not rows:
        return vectors.sparkSession.createDataFrame([], f"{schema}, rank int")
    if len(rows) <= QUERY_BLOCK:
        ids, matrix = [r["query_id"] for r in rows], np.array([r["q_vec"] for r in rows], np.float64)
        return top_k(own.mapInPandas(lambda f: _best(f, ids, matrix, k, key), schema), k, tie=key)

    def block(table: DataFrame, column: str, of: str, size: int) -> tuple[DataFrame, int]:
        parts = max(1, -(-table.count() // size))
        return table.withColumn(column, F.pmod(F.xxhash64(of), F.lit(parts)).cast("int")), parts

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": left["query_id"][:0], key: right[key][:0], "score": np.array([], np.float64)})
        found = _best(iter([right[[key, vector]]]), left["query_id"].tolist(), np.stack(left["q_vec"].to_numpy()).astype(np.float64), k, key)
        return pd.concat(found, ignore_index=True)

    (asked, n_asked), (own, n_own) = block(asked, "qb", "query_id", QUERY_BLOCK), block(own, "vb", key, VECTOR_BLOCK)
    asked = asked.withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(n_own - 1))))
    own = own.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1))))
    return top_k(asked.groupBy("qb", "vb").cogroup(own.groupBy("qb", "vb")).applyInPandas(run, schema), k, tie=key)


def _best(frames: Iterator[pd.DataFrame], ids: list, matrix: np.ndarray, k: int, key: str) -> Iterator[pd.DataFrame]:
    """The k best rows of each frame for each query: by rounded score, and of equal scores the smaller keys."""
    for frame in frames:
        if not len(frame):
            continue
        frame = frame.sort_values(key, na_position="first")
        own, vectors = frame[key].to_numpy(), np.stack(frame.iloc[:, 1].to_numpy()).astype(np.float64)
        n = min(k, len(own))
        for at in range(0, len(ids), QUERY_COLUMNS):
            scores = vectors @ matrix[at : at + QUERY_COLUMNS].T
            scores = np.copysign(np.floor(np.abs(scores) * 10**DIGITS + 0.5) / 10**DIGITS, scores)  # halves away from zero, as DuckDB
            order = np.where(np.isnan(scores), np.inf, scores)
            last = np.partition(order, len(own) - n, axis=0)[len(own) - n]
            above, ties = order > last, order == last
            pick = above | ties & (np.cumsum(ties, axis=0) <= n - above.sum(axis=0))
            q, row = np.nonzero(pick.T)
            yield pd.DataFrame({"query_id": np.asarray(ids)[at + q], key: own[row], "score": scores[row, q]})


def dense_sql(k: int, queries: str, source: str, key: str, vector: str = "embedding") -> str:
    """CTEs of the same for DuckDB, ending in ``dense``; ``queries`` names a relation (query_id, q_vec)."""
    return f"""dsc AS (SELECT query_id, {key}, round(list_inner_product(CAST(q_vec AS DOUBLE[]), CAST({vector} AS DOUBLE[])), {DIGITS}) score FROM {queries} CROSS JOIN {source}),
dense AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {key}) AS INTEGER) AS rank FROM dsc) r WHERE rank <= {k})"""


def fused(paths: Sequence[tuple[DataFrame, float | str]], k: int, key: str = "pk") -> DataFrame:
    """Weighted reciprocal rank fusion: each path gives weight / (60 + rank); a path without rows gives nothing."""
    parts = [hits.select("query_id", key, (F.expr(str(w)) / (F.lit(float(RRF_K)) + F.col("rank"))).alias("part")) for hits, w in paths]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return top_k(both.groupBy("query_id", key).agg(F.round(F.sum("part"), 6).alias("score")), k, tie=key)


def bias(question: Column, chunk_type: Column | None = None) -> Column:
    """What a question leans to: entity_heavy, keyword, semantic or balanced."""
    from corpuscle.functions import words as w

    kind = F.lower(F.trim(F.coalesce(chunk_type if chunk_type is not None else F.lit(""), F.lit(""))))
    q = F.trim(F.coalesce(question, F.lit("")))
    short = F.length(F.replace(q, F.lit(" "), F.lit(""))) <= 4
    return (
        F.when(kind == "references", "entity_heavy").when(kind == "equation", "keyword").when(q == "", "balanced")
        .when(q.rlike(w.QUOTED) | q.rlike(w.CHEMICAL) | q.rlike(w.DOI), "entity_heavy").when(q.rlike(w.LOCATED) | short, "keyword")
        .when(q.rlike(w.VALUE), "keyword").when(q.rlike(w.MEANING), "semantic").otherwise("balanced")
    )


def weights(leaning: Column, stage: Column) -> tuple[Column, Column]:
    """Dense and lexical weight by bias and stage: unknown ones as balanced and simple, clamped, scaled to 1, four digits."""
    table = F.create_map(*(F.lit(x) for (b, s), v in DENSE_WEIGHT.items() for x in (f"{b}/{s}", v)))
    known = F.when(leaning.isin(*{b for b, _ in DENSE_WEIGHT}), leaning).otherwise("balanced")
    at = F.when(stage.isin(*{s for _, s in DENSE_WEIGHT}), stage).otherwise("simple")
    raw = F.element_at(table, F.concat_ws("/", known, at))
    clamp = lambda c: F.least(F.greatest(c, F.lit(LEAST_WEIGHT)), F.lit(MOST_WEIGHT))
    own, other = clamp(raw), clamp(1.0 - raw)
    return F.round(own / (own + other), 4), F.round(other / (own + other), 4)


def union_max(paths: Sequence[tuple[str, DataFrame]], key: str = "pk") -> DataFrame:
    """Hits of several paths in one row for each key: the greatest raw score, and the paths that found it."""
    both = None
    for name, hits in paths:
        part = hits.select("query_id", key, "score", F.lit(name).alias("path"))
        both = part if both is None else both.unionByName(part)
    return both.groupBy("query_id", key).agg(F.max("score").alias("score"), F.array_join(F.array_sort(F.collect_set("path")), ",").alias("sources"))


def documents_by_score(hits: DataFrame, k: int, scale: float = 1.0) -> DataFrame:
    """Documents of the hits by their best scaled score, with the name of the best hit."""
    own = hits.groupBy("query_id", "doc_id").agg(F.round(F.max(F.col("score") * scale), DIGITS + 2).alias("score"), F.max_by("doc_name", F.struct("score", "doc_name")).alias("doc_name"))
    return top_k(own, k, tie="doc_id")


def merged_rankings(first: DataFrame, second: DataFrame, weight: float, k: int) -> DataFrame:
    """Two rankings of documents in one: the greater of the first's score and the second's times the weight."""
    both = first.select("query_id", "doc_id", "score").unionByName(second.select("query_id", "doc_id", (F.col("score") * weight).alias("score")))
    return top_k(both.groupBy("query_id", "doc_id").agg(F.round(F.max("score"), DIGITS).alias("score")), k, tie="doc_id")


def anchored(hits: DataFrame, grades: Column, content: str = "content") -> DataFrame:
    """Hits of each question in a new order: first those whose text names one of its ``grades``, by rank within both parts."""
    named = F.coalesce(F.exists(grades, lambda g: F.contains(F.lower(content), F.lower(g))), F.lit(False))
    order = Window.partitionBy("query_id").orderBy((~named).cast("int"), "rank", "pk")
    return hits.withColumn("place", F.row_number().over(order))


def signal(documents: DataFrame) -> DataFrame:
    """How strong the first level's documents (query_id, n_docs, best, n_paths) are: strong, moderate, weak or empty."""
    strong = (F.col("best") >= 0.7) & (F.col("n_paths") == 2)
    value = F.when(F.col("n_docs") == 0, "empty").when(strong, "strong").when((F.col("best") >= 0.5) | (F.col("n_docs") >= 3), "moderate").otherwise("weak")
    return documents.select("query_id", value.alias("signal"))


def structural(chunks: DataFrame, kinds: Sequence[str], most: int) -> DataFrame:
    """All chunks of the kinds in reading order, the first ``most`` of each document, all with a score of 1."""
    order = Window.partitionBy("doc_id").orderBy("page_start", "paragraph_index", "pk")
    own = chunks.where(F.col("type").isin(*kinds)).withColumn("place", F.row_number().over(order))
    return own.where(F.col("place") <= most).select("doc_id", "pk", F.lit(1.0).alias("score"))


def label_scores(rows: DataFrame, figures: Sequence[str], tables: Sequence[str]) -> DataFrame:
    """``(pk, score)`` of chunks that name a figure or table: 5 for each in a chunk of that kind, else 2."""
    label = lambda n: rf"(?:^|[^A-Za-z0-9_])fig(?:ure|\.)?[ ]*{n}(?:[^0-9A-Za-z]|$)|图[ ]*{n}(?:[^0-9A-Za-z]|$)|(?:^|[^A-Za-z0-9_])fig\.?[ ]*s{n}(?:[^0-9A-Za-z]|$)"
    named = [("image", f"(?i){label(n)}") for n in figures] + [("table", rf"(?i)(?:^|[^A-Za-z0-9_])table[ ]*{n}(?:[^0-9A-Za-z]|$)|表[ ]*{n}(?:[^0-9A-Za-z]|$)") for n in tables]
    points = [F.when(F.col("content").rlike(p), F.when(F.col("type") == kind, 5).otherwise(2)).otherwise(0) for kind, p in named]
    score = sum(points[1:], points[0]) if points else F.lit(0)
    return rows.select("pk", score.cast("double").alias("score")).where("score > 0")


def relaxed(questions: DataFrame, filtered: DataFrame, free: DataFrame) -> DataFrame:
    """Hits under a time filter; questions that have none there get those without the filter, and say so."""
    empty = questions.select("query_id").distinct().join(filtered.select("query_id").distinct(), "query_id", "left_anti")
    return filtered.withColumn("relaxed", F.lit(False)).unionByName(free.join(empty, "query_id", "left_semi").withColumn("relaxed", F.lit(True)))


def scoped_dense(queries: DataFrame, vectors: DataFrame, scope: DataFrame, k: int, vector: str = "embedding") -> DataFrame:
    """The k largest inner products of each query among the chunks of its own documents; scope is (query_id, doc_id)."""
    dot = F.aggregate(F.zip_with("q_vec", vector, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    pairs = vectors.select("pk", "doc_id", vector).where(F.col(vector).isNotNull()).join(scope.distinct(), "doc_id").join(queries.select("query_id", "q_vec").where("q_vec IS NOT NULL"), "query_id")
    return top_k(pairs.select("query_id", "pk", F.round(dot, DIGITS).alias("score")), k)


def confidence(lexical: DataFrame, vector: DataFrame, least: float) -> DataFrame:
    """Whether the best hits of a question are sure: both paths have some, and the dense best alone (where the lexical is over 1), else their mean, reaches ``least``."""
    best = lambda hits, name: hits.groupBy("query_id").agg(F.max("score").alias(name))
    both = best(lexical, "l").join(best(vector, "v"), "query_id", "full")
    value = F.when(F.col("l") > 1, F.col("v")).otherwise((F.col("l") + F.col("v")) / 2)
    return both.select("query_id", F.coalesce(F.col("l").isNotNull() & F.col("v").isNotNull() & (value >= least), F.lit(False)).alias("sure"))
