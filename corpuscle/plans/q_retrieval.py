"""Queries over lexical, dense, fused, two-level and metadata retrieval."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions import text
from corpuscle.functions.words import DENSE_WEIGHT
from corpuscle.operators import filters, levels, lexical_index, retrieval as r, routing, vector_index
from corpuscle.sources.chunks import CHUNKS_SQL as C

from .q_store import FIGURES, chunks
from .registry import SQL, Fixture, query, table

DOC_NAMES = Fixture("query_id int, q string", (1, "nt onor the of it"), (2, "The and attion to thanedble"), (3, ""), (4, "ciónrami esargaos 钢 é"))


def benchmark_queries(spark, d) -> DataFrame:
    """The benchmark items as questions, whole."""
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))


BQ = "bench AS (SELECT item_id AS query_id, text AS q FROM benchmark)"
#: Documents as chunks of one text each: the coarse corpus of the flagship query.
DOCS = "docs AS (SELECT doc_id AS pk, text AS content FROM documents)"


def document_rows(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("pk"), F.col("text").alias("content"))


@query("bm25_topk", f"WITH {BQ}, {DOCS}, {r.bm25_sql(5, 'bench', 'docs')} SELECT query_id, pk, score, rank FROM bm25")
def bm25_topk(spark, d):
    return r.bm25(benchmark_queries(spark, d), document_rows(spark, d), 5).select("query_id", "pk", "score", "rank")


_INDEXES: dict[tuple[str, str, str], object] = {}


def once(spark, d, name: str, build):
    """What ``build`` makes of the tables in ``d``, made once for a Spark application."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _INDEXES:
        _INDEXES[key] = build()
    return _INDEXES[key]


def lexical(spark, d) -> lexical_index.LexicalIndex:
    """The stored index of all chunks, which all queries of an application read."""
    return once(spark, d, "lexical", lambda: lexical_index.build(chunks(spark, d)))


@query("bm25_chunks", f"WITH {C}, {BQ}, {r.bm25_sql(10, 'bench')} SELECT query_id, pk, score, rank FROM bm25")
def bm25_chunks(spark, d):
    return lexical_index.search(benchmark_queries(spark, d), lexical(spark, d), 10).select("query_id", "pk", "score", "rank")


@query("bm25_corpus_stats", f"WITH {C}, t AS (SELECT type, {text.TOKENS_SQL.format('content')} t FROM chunks) SELECT count(*)::BIGINT AS n_docs, round(avg(len(t)), 6) AS avgdl FROM t")
def bm25_corpus_stats(spark, d):
    return r.corpus_stats(chunks(spark, d)).select("n_docs", F.round("avgdl", 6).alias("avgdl"))


@query("bm25_document_frequency", f"WITH {C}, t AS (SELECT pk, unnest({text.TOKENS_SQL.format('content')}) term FROM chunks) SELECT term, count(DISTINCT pk)::BIGINT AS df, count(*)::BIGINT AS cf FROM t GROUP BY term")
def bm25_document_frequency(spark, d):
    return r.postings(chunks(spark, d)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query("bm25_max_queries", f"WITH {DOCS}, sub AS (SELECT * FROM {DOC_NAMES.sql}), {r.bm25_sql(None, 'sub', 'docs')} SELECT pk, max(score) AS score FROM bm25 GROUP BY pk")
def bm25_max_queries(spark, d):
    return r.bm25(DOC_NAMES.df(spark), document_rows(spark, d), None).groupBy("pk").agg(F.max("score").alias("score"))


def query_vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q_vec"))


QV = "qv AS (SELECT vec_id AS query_id, embedding AS q_vec FROM embeddings WHERE vec_id % 100 = 0)"


@query("vector_topk", f"WITH {QV}, {r.dense_sql(10, 'qv', 'embeddings', 'vec_id')} SELECT query_id, vec_id, score, rank FROM dense")
def vector_topk(spark, d):
    return r.dense(query_vectors(spark, d), table(spark, d, "embeddings"), 10, "vec_id").select("query_id", "vec_id", "score", "rank")


@query("vector_topk_filtered", f"WITH {QV}, sub AS (SELECT * FROM embeddings WHERE label < 5), {r.dense_sql(3, 'qv', 'sub', 'vec_id')} SELECT query_id, vec_id, score, rank FROM dense")
def vector_topk_filtered(spark, d):
    return r.dense(query_vectors(spark, d), table(spark, d, "embeddings").where("label < 5"), 3, "vec_id").select("query_id", "vec_id", "score", "rank")


#: The columns that filters of a dense search may ask for go into the index with the vectors.
def vectors_index(spark, d) -> vector_index.VectorIndex:
    return once(spark, d, "vectors", lambda: vector_index.build(table(spark, d, "embeddings"), "vec_id"))


@query("dense_indexed")
def dense_indexed(spark, d):
    return vector_index.search(query_vectors(spark, d), vectors_index(spark, d), 10).select("query_id", "vec_id", "score", "rank")


@query("dense_indexed_filtered")
def dense_indexed_filtered(spark, d):
    return vector_index.search(query_vectors(spark, d), vectors_index(spark, d), 3, F.col("label") < 5).select("query_id", "vec_id", "score", "rank")


@query("dense_indexed_exact", SQL["vector_topk"])
def dense_indexed_exact(spark, d):
    return vector_index.search(query_vectors(spark, d), vectors_index(spark, d), 10, exact=True).select("query_id", "vec_id", "score", "rank")


@query("dense_indexed_filtered_exact", SQL["vector_topk_filtered"])
def dense_indexed_filtered_exact(spark, d):
    return vector_index.search(query_vectors(spark, d), vectors_index(spark, d), 3, F.col("label") < 5, exact=True).select("query_id", "vec_id", "score", "rank")


#: All chunks with vectors, and all questions: the vectors there are in turn, by ordinals.
VC = f"{C}, vchunks AS (SELECT c.*, e.embedding FROM chunks c JOIN embeddings e ON (CAST(c.doc_id AS BIGINT) * 31 + paragraph_index) % (SELECT count(*) FROM embeddings) = e.vec_id)"
VQ = "vq AS (SELECT query_id, q, embedding AS q_vec FROM bench JOIN embeddings ON query_id * 7 % (SELECT count(*) FROM embeddings) = vec_id)"


def vector_chunks(spark, d) -> DataFrame:
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    return chunks(spark, d).withColumn("vec_id", (F.col("doc_id").cast("long") * 31 + F.col("paragraph_index")) % vectors.count()).join(vectors, "vec_id").drop("vec_id")


#: Ids of vectors that go to the chunks at most, once they are counted.
BROADCAST_IDS = 1 << 20


def worded_chunks(spark, d) -> DataFrame:
    """The chunks that have vectors, without these: what is searched by words. The ids go to the chunks, so that no text is shuffled to meet them."""
    ids = table(spark, d, "embeddings").select("vec_id")
    n = ids.count()
    own = chunks(spark, d).withColumn("vec_id", (F.col("doc_id").cast("long") * 31 + F.col("paragraph_index")) % n)
    return own.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, "vec_id").drop("vec_id")


def both_queries(spark, d) -> DataFrame:
    vectors = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("q_vec"))
    return benchmark_queries(spark, d).withColumn("vec_id", F.col("query_id") * 7 % vectors.count()).join(vectors, "vec_id").drop("vec_id")


def rrf_sql(k: int) -> str:
    return f"rrf AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pk) AS INTEGER) AS rank FROM (SELECT query_id, pk, round(sum(w / (60.0::DOUBLE + rank)), 6) score FROM (SELECT query_id, pk, rank, 0.6::DOUBLE w FROM dense UNION ALL SELECT query_id, pk, rank, 0.4::DOUBLE FROM bm25) u GROUP BY query_id, pk) s) t WHERE rank <= {k})"


@query("hybrid_rrf", f"WITH {VC}, {BQ}, {VQ}, {r.dense_sql(10, 'vq', 'vchunks', 'pk')}, {r.bm25_sql(10, 'vq', 'vchunks')}, {rrf_sql(5)} SELECT query_id, pk, score, rank FROM rrf")
def hybrid_rrf(spark, d):
    q, own = both_queries(spark, d), vector_chunks(spark, d)
    return r.fused([(r.dense(q, own, 10), 0.6), (r.bm25(q, own, 10), 0.4)], 5).select("query_id", "pk", "score", "rank")


BIASES = Fixture(
    "id int, q string, chunk_type string", (1, "what is the mechanism of rust", None), (2, "图 3 是什么", None), (3, "硬度是多少", None), (4, 'find "weathering steel" data', ""), (5, "anything", "references"), (6, "anything", "equation"),
    (7, "Fe3O4Cr2 layer", None), (8, "abc", None), (9, "plain words of no kind", None), (10, "10.1016/j.corsci.2020 details", None), (11, "如何影响 腐蚀 速度", None), (12, None, None), (13, "page table 5", None),
)


def _bias_sql() -> str:
    from corpuscle.functions import words as w

    m = lambda p: f"regexp_matches(q2, '{p.replace(chr(39), chr(39) * 2)}')"
    return f"""CASE WHEN kind = 'references' THEN 'entity_heavy' WHEN kind = 'equation' THEN 'keyword' WHEN q2 = '' THEN 'balanced' WHEN {m(w.QUOTED.replace(chr(92) + chr(34), chr(34)))} OR {m(w.CHEMICAL)} OR {m(w.DOI)} THEN 'entity_heavy'
 WHEN {m(w.LOCATED)} OR length(replace(q2, ' ', '')) <= 4 THEN 'keyword' WHEN {m(w.VALUE)} THEN 'keyword' WHEN {m(w.MEANING)} THEN 'semantic' ELSE 'balanced' END"""


@query("retrieve_bias", f"SELECT id, {_bias_sql()} AS bias FROM (SELECT id, trim(coalesce(q, '')) q2, lower(trim(coalesce(chunk_type, ''))) kind FROM {BIASES.sql}) b")
def retrieve_bias(spark, d):
    return BIASES.df(spark).select("id", r.bias(F.col("q"), F.col("chunk_type")).alias("bias"))


STAGES = Fixture("bias string, stage string", *[(b, s) for b in ("balanced", "semantic", "entity_heavy", "keyword", "odd") for s in ("progressive_l1", "progressive_l1_global", "progressive_l2", "local_l2", "simple", "unknown")])
WEIGHTS = Fixture("b string, s string, w double", *[(b, s, w) for (b, s), w in DENSE_WEIGHT.items()])


@query("hybrid_weights", f"SELECT bias, stage, round(least(greatest(w, 0.25), 0.85) / (least(greatest(w, 0.25), 0.85) + least(greatest(1 - w, 0.25), 0.85)), 4) AS dense, round(least(greatest(1 - w, 0.25), 0.85) / (least(greatest(w, 0.25), 0.85) + least(greatest(1 - w, 0.25), 0.85)), 4) AS bm25 FROM {STAGES.sql} x JOIN {WEIGHTS.sql} y ON y.b = CASE WHEN bias = 'odd' THEN 'balanced' ELSE bias END AND y.s = CASE WHEN stage = 'unknown' THEN 'simple' ELSE stage END")
def hybrid_weights(spark, d):
    dense, lexical = r.weights(F.col("bias"), F.col("stage"))
    return STAGES.df(spark).select("bias", "stage", dense.alias("dense"), lexical.alias("bm25"))


@query("dual_path_union", f"WITH {VC}, {BQ}, {VQ}, {r.dense_sql(5, 'vq', 'vchunks', 'pk')}, {r.bm25_sql(5, 'vq', 'vchunks')} SELECT query_id, pk, max(score) AS score, string_agg(path, ',' ORDER BY path) AS sources FROM (SELECT query_id, pk, score, 'vector' path FROM dense UNION ALL SELECT query_id, pk, score, 'bm25' FROM bm25) u GROUP BY query_id, pk")
def dual_path_union(spark, d):
    q = both_queries(spark, d)
    return r.union_max([("vector", r.dense(q, vector_chunks(spark, d), 5)), ("bm25", r.bm25(q, worded_chunks(spark, d), 5))])


def pooled(spark, d, name: str, k: int) -> DataFrame:
    q, own = both_queries(spark, d), vector_chunks(spark, d).where(filters.pool(name))
    return r.union_max([("vector", r.dense(q, own, k)), ("bm25", r.bm25(q, own, k))])


def _tagged(tag: str, body: str) -> str:
    """The CTEs with names of their own, so that a statement can have them more than once."""
    for n in ("dsc", "dense", "bt", "be", "bp", "bd", "bsc", "bs", "bq", "bm25"):
        body = re.sub(rf"(?<![A-Za-z_0-9.]){n}(?![A-Za-z_0-9])", f"{tag}_{n}", body)
    return body


def _bm25_of(tag: str, queries: str, source: str, k: int) -> str:
    return _tagged(tag, r.bm25_sql(k, queries, source))


def _pool_sql(tag: str, where: str, k: int) -> str:
    body = f"{tag}_c AS (SELECT * FROM vchunks WHERE {where}), {r.dense_sql(k, 'vq', tag + '_c', 'pk')}, {r.bm25_sql(k, 'vq', tag + '_c')}"
    return f"{_tagged(tag, body)}, {tag} AS (SELECT query_id, pk, max(score) AS score, string_agg(path, ',' ORDER BY path) AS sources FROM (SELECT query_id, pk, score, 'vector' path FROM {tag}_dense UNION ALL SELECT query_id, pk, score, 'bm25' FROM {tag}_bm25) u GROUP BY query_id, pk)"


@query("summary_retrieve", f"WITH {VC}, {BQ}, {VQ}, {_pool_sql('sm', 'type = ' + chr(39) + 'summary' + chr(39), 5)}, {_pool_sql('ti', 'type = ' + chr(39) + 'title' + chr(39), 5)} SELECT query_id, pk, score, CAST(rank AS INTEGER) rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pk) AS rank FROM (SELECT query_id, pk, max(score) score FROM (SELECT * FROM sm UNION ALL SELECT * FROM ti) u GROUP BY ALL) v) w WHERE rank <= 5")
def summary_retrieve(spark, d):
    q, own = both_queries(spark, d), vector_chunks(spark, d)
    paths = []
    for kind in ("summary", "title"):
        part = own.where(F.col("type") == kind)
        paths += [(f"{kind}-vector", r.dense(q, part, 5)), (f"{kind}-bm25", r.bm25(q, part, 5))]
    return r.top_k(r.union_max(paths), 5).select("query_id", "pk", "score", "rank")


@query("merge_pools", f"WITH {VC}, {BQ}, {VQ}, {_pool_sql('pa', 'type IN (' + chr(39) + 'text' + chr(39) + ', ' + chr(39) + 'equation' + chr(39) + ')', 4)}, {_pool_sql('pb', 'type IN (' + chr(39) + 'summary' + chr(39) + ', ' + chr(39) + 'title' + chr(39) + ')', 4)} SELECT query_id, pk, max(score) score FROM (SELECT * FROM pa UNION ALL SELECT * FROM pb) u GROUP BY ALL")
def merge_pools(spark, d):
    both = pooled(spark, d, "prose", 4).unionByName(pooled(spark, d, "overview", 4))
    return both.groupBy("query_id", "pk").agg(F.max("score").alias("score"))


@query("progressive_l1", f"""WITH {VC}, {BQ}, {VQ}, ov AS (SELECT * FROM vchunks WHERE type IN ('summary', 'title')), {r.dense_sql(5, 'vq', 'ov', 'pk')}, {r.bm25_sql(5, 'vq', 'ov')},
 dd AS (SELECT query_id, split_part(pk, '::', 1) doc_id, max(score) score FROM dense GROUP BY ALL), bd2 AS (SELECT query_id, split_part(pk, '::', 1) doc_id, max(score) score FROM bm25 GROUP BY ALL)
 SELECT query_id, doc_id, score, CAST(rank AS INTEGER) rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) rank FROM (SELECT query_id, doc_id, round(max(score), 5) score FROM (SELECT * FROM dd UNION ALL SELECT * FROM bd2) u GROUP BY ALL) v) w WHERE rank <= 10""")
def progressive_l1(spark, d):
    q, own = both_queries(spark, d), vector_chunks(spark, d).where(filters.pool("overview"))
    docs = own.select("pk", "doc_id", "doc_name")
    ranked = [r.documents_by_score(hits.join(docs, "pk"), None) for hits in (r.dense(q, own, 5), r.bm25(q, own, 5))]
    return r.merged_rankings(*ranked, 1.0, 10).select("query_id", "doc_id", "score", "rank")


_DMS = "SELECT query_id, doc_id, round(max(score * 0.75), 7) score, arg_max(doc_name, score) doc_name FROM bm25 JOIN chunks USING (pk) GROUP BY query_id, doc_id"


@query("doc_max_score", f"WITH {C}, {BQ}, {r.bm25_sql(20, 'bench')} SELECT query_id, doc_id, score, doc_name, CAST(rank AS INTEGER) rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) rank FROM ({_DMS}) x) y WHERE rank <= 5")
def doc_max_score(spark, d):
    hits = lexical_index.search(benchmark_queries(spark, d), lexical(spark, d), 20).drop("rank")
    return r.documents_by_score(r.with_chunks(hits, chunks(spark, d).select("pk", "doc_id", "doc_name")), 5, 0.75)


@query("merge_doc_rankings", f"WITH {C}, {BQ}, su AS (SELECT * FROM chunks WHERE type = 'summary'), ti AS (SELECT * FROM chunks WHERE type = 'title'), {_bm25_of('s', 'bench', 'su', 10)}, {_bm25_of('t', 'bench', 'ti', 10)} SELECT query_id, doc_id, score, CAST(rank AS INTEGER) rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) rank FROM (SELECT query_id, split_part(pk, '::', 1) doc_id, round(max(score), 5) score FROM (SELECT query_id, pk, score FROM s_bm25 UNION ALL SELECT query_id, pk, score * 0.8 FROM t_bm25) u GROUP BY ALL) v) w WHERE rank <= 8")
def merge_doc_rankings(spark, d):
    names = chunks(spark, d).select("pk", "doc_id", "doc_name")
    ranked = [r.documents_by_score(r.with_chunks(lexical_index.search(benchmark_queries(spark, d), lexical(spark, d), 10, [kind]).drop("rank"), names), None) for kind in ("summary", "title")]
    return r.merged_rankings(*ranked, 0.8, 8)


@query("grade_anchor", f"WITH {C}, {BQ}, su AS (SELECT * FROM chunks WHERE type = 'summary'), {r.bm25_sql(20, 'bench', 'su')} SELECT query_id, pk, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CAST(NOT contains(lower(content), 'heed') AS INTEGER), rank, pk) AS INTEGER) AS place FROM bm25 JOIN su USING (pk)")
def grade_anchor(spark, d):
    own = chunks(spark, d).where("type = 'summary'")
    hits = r.bm25(benchmark_queries(spark, d), own, 20).join(own.select("pk", "content"), "pk")
    return r.anchored(hits, F.array(F.lit("heed"))).select("query_id", "pk", "place")


@query("l2_confidence", f"WITH {VC}, {BQ}, {VQ}, pr AS (SELECT * FROM vchunks WHERE type IN ('text', 'equation')), {r.dense_sql(1, 'vq', 'pr', 'pk')}, {r.bm25_sql(1, 'vq', 'pr')} SELECT query_id, coalesce(b.score IS NOT NULL AND v.score IS NOT NULL AND CASE WHEN b.score > 1 THEN v.score ELSE (b.score + v.score) / 2 END >= 0.35, false) AS sure FROM dense v FULL JOIN bm25 b USING (query_id)")
def l2_confidence(spark, d):
    q, own = both_queries(spark, d), vector_chunks(spark, d).where(filters.pool("prose"))
    return r.confidence(r.bm25(q, own, 1), r.dense(q, own, 1), 0.35)


@query("split_pool", f"WITH {VC}, {BQ}, {VQ}, {_pool_sql('pa', 'type IN (' + chr(39) + 'text' + chr(39) + ', ' + chr(39) + 'equation' + chr(39) + ')', 8)}, {_pool_sql('pb', 'type IN (' + chr(39) + 'image' + chr(39) + ', ' + chr(39) + 'table' + chr(39) + ', ' + chr(39) + 'title' + chr(39) + ')', 8)} SELECT query_id, pool, pk, score FROM (SELECT 'prose' pool, *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pk) rank FROM pa UNION ALL SELECT 'structural', *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pk) FROM pb) u WHERE rank <= CASE WHEN pool = 'prose' THEN 8 ELSE 2 END")
def split_pool(spark, d):
    q, own = both_queries(spark, d), vector_chunks(spark, d)
    out = None
    for name, kinds, k in (("prose", ("text", "equation"), 8), ("structural", ("image", "table", "title"), 2)):
        part = own.where(F.col("type").isin(*kinds))
        hits = r.top_k(r.union_max([("vector", r.dense(q, part, 8)), ("bm25", r.bm25(q, part, 8))]), k).select("query_id", F.lit(name).alias("pool"), "pk", "score")
        out = hits if out is None else out.unionByName(hits)
    return out


@query("dense_chunks_indexed", f"WITH {VC}, {BQ}, {VQ}, pr AS (SELECT * FROM vchunks WHERE type IN ('text', 'equation')), {r.dense_sql(10, 'vq', 'pr', 'pk')} SELECT query_id, pk, score, rank FROM dense")
def dense_chunks_indexed(spark, d):
    """Every chunk in an index, asked under a filter of types; exact."""
    index = once(spark, d, "chunk-vectors", lambda: vector_index.build(vector_chunks(spark, d).select("pk", "doc_id", "type", "publication_year", "embedding")))
    return vector_index.search(both_queries(spark, d), index, 10, filters.pool("prose"), exact=True).select("query_id", "pk", "score", "rank")


@query("structural_recall", f"WITH {C} SELECT doc_id, pk, CAST(1 AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_start, paragraph_index, pk) r FROM chunks WHERE type IN ('references', 'image', 'table')) WHERE r <= 500")
def structural_recall(spark, d):
    return r.structural(chunks(spark, d), filters.STRUCTURAL, 500)


@query("structural_first", f"WITH {VC}, {BQ}, {VQ}, ty AS (SELECT * FROM vchunks WHERE type = 'summary'), {r.dense_sql(20, 'vq', 'ty', 'pk')} SELECT query_id, split_part(pk, '::', 1) doc_id, round(max(score * 0.75), 7) score FROM dense GROUP BY ALL")
def structural_first(spark, d):
    own = vector_chunks(spark, d).where("type = 'summary'")
    hits = r.dense(both_queries(spark, d), own, 20).join(own.select("pk", "doc_id", "doc_name"), "pk")
    return r.documents_by_score(hits, None, 0.75).select("query_id", "doc_id", "score")


@query("l1_signal", f"WITH {VC}, {BQ}, {VQ}, ov AS (SELECT * FROM vchunks WHERE type IN ('summary', 'title')), {r.dense_sql(5, 'vq', 'ov', 'pk')}, {r.bm25_sql(5, 'vq', 'ov')}, g AS (SELECT query_id, count(DISTINCT doc_id) n_docs, max(score) FILTER (WHERE path = 'v') best, count(DISTINCT path) n_paths FROM (SELECT query_id, split_part(pk, '::', 1) doc_id, score, 'v' path FROM dense UNION ALL SELECT query_id, split_part(pk, '::', 1), score, 'b' FROM bm25) GROUP BY query_id) SELECT query_id, CASE WHEN n_docs = 0 THEN 'empty' WHEN best >= 0.7 AND n_paths = 2 THEN 'strong' WHEN best >= 0.5 OR n_docs >= 3 THEN 'moderate' ELSE 'weak' END AS signal FROM (SELECT query_id, coalesce(n_docs, 0) n_docs, best, coalesce(n_paths, 0) n_paths FROM bench LEFT JOIN g USING (query_id))")
def l1_signal(spark, d):
    """The best score is that of the vectors; questions without a hit are empty."""
    q, own = both_queries(spark, d), vector_chunks(spark, d).where(filters.pool("overview"))
    paths = [("v", r.dense(q, own, 5)), ("b", lexical_index.search(q, lexical(spark, d), 5, ("summary", "title")))]
    hits = [h.select("query_id", F.split_part("pk", F.lit("::"), F.lit(1)).alias("doc_id"), "score", F.lit(p).alias("path")) for p, h in paths]
    found = hits[0].unionByName(hits[1]).groupBy("query_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.max(F.when(F.col("path") == "v", F.col("score"))).alias("best"), F.countDistinct("path").alias("n_paths"))
    every = benchmark_queries(spark, d).select("query_id").join(found, "query_id", "left")
    return r.signal(every.select("query_id", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "best", F.coalesce("n_paths", F.lit(0)).alias("n_paths")))


_FIG3 = "regexp_matches(content, '(?i)(?:^|[^A-Za-z0-9_])fig(?:ure|\\.)?[ ]*3(?:[^0-9A-Za-z]|$)|图[ ]*3(?:[^0-9A-Za-z]|$)|(?:^|[^A-Za-z0-9_])fig\\.?[ ]*s3(?:[^0-9A-Za-z]|$)')"
_TAB2 = "regexp_matches(content, '(?i)(?:^|[^A-Za-z0-9_])table[ ]*2(?:[^0-9A-Za-z]|$)|表[ ]*2(?:[^0-9A-Za-z]|$)')"


@query("metadata_refs", f"SELECT pk, score FROM (SELECT pk, CAST(CASE WHEN {_FIG3} THEN CASE WHEN type = 'image' THEN 5 ELSE 2 END ELSE 0 END + CASE WHEN {_TAB2} THEN CASE WHEN type = 'table' THEN 5 ELSE 2 END ELSE 0 END AS DOUBLE) AS score FROM {FIGURES.sql}) s WHERE score > 0")
def metadata_refs(spark, d):
    return r.label_scores(FIGURES.df(spark), ["3"], ["2"])


@query("metadata_keywords", f"WITH {C}, kq AS (SELECT 1 AS query_id, 'heed the nt' AS q), {r.bm25_sql(10, 'kq')} SELECT query_id, pk, score, rank FROM bm25")
def metadata_keywords(spark, d):
    q = spark.createDataFrame([(1, "heed the nt")], "query_id int, q string")
    return r.bm25(q, chunks(spark, d), 10).select("query_id", "pk", "score", "rank")


@query("nth_asset", f"WITH {C} SELECT doc_id, pk FROM (SELECT doc_id, pk, row_number() OVER (PARTITION BY doc_id, type ORDER BY page_start, pk) n FROM chunks WHERE type = 'image') WHERE n = 2")
def nth_asset(spark, d):
    order = Window.partitionBy("doc_id", "type").orderBy("page_start", "pk")
    return chunks(spark, d).where("type = 'image'").withColumn("n", F.row_number().over(order)).where("n = 2").select("doc_id", "pk")


@query("time_relax", f"WITH {C}, {BQ}, f AS (SELECT * FROM chunks WHERE publication_year = 2003 AND type = 'image'), a AS (SELECT * FROM chunks WHERE type = 'image'), {_bm25_of('fi', 'bench', 'f', 5)}, {_bm25_of('al', 'bench', 'a', 5)} SELECT query_id, pk, score, rank, false AS relaxed FROM fi_bm25 UNION ALL SELECT query_id, pk, score, rank, true FROM al_bm25 WHERE query_id NOT IN (SELECT query_id FROM fi_bm25)")
def time_relax(spark, d):
    q, own = benchmark_queries(spark, d), chunks(spark, d).where("type = 'image'")
    return r.relaxed(q, r.bm25(q, own.where("publication_year = 2003"), 5), r.bm25(q, own, 5)).select("query_id", "pk", "score", "rank", "relaxed")


_RRF5 = rrf_sql(5)


@query("simple_modes", f"WITH {VC}, {BQ}, {VQ}, {r.dense_sql(5, 'vq', 'vchunks', 'pk')}, {r.bm25_sql(5, 'vq', 'vchunks')}, {_RRF5} SELECT 'vector' AS mode, query_id, pk, score, rank FROM dense UNION ALL SELECT 'bm25', query_id, pk, score, rank FROM bm25 UNION ALL SELECT 'hybrid', query_id, pk, score, rank FROM rrf")
def simple_modes(spark, d):
    q, own = both_queries(spark, d), vector_chunks(spark, d)
    paths = {"vector": r.dense(q, own, 5), "bm25": r.bm25(q, own, 5)}
    paths["hybrid"] = r.fused([(paths["vector"], 0.6), (paths["bm25"], 0.4)], 5)
    out = None
    for mode, hits in paths.items():
        part = hits.select(F.lit(mode).alias("mode"), "query_id", "pk", "score", "rank")
        out = part if out is None else out.unionByName(part)
    return out


_SCOPE = f"""ov AS (SELECT * FROM vchunks WHERE type IN ('summary', 'title')), {_tagged('o', r.dense_sql(5, 'vq', 'ov', 'pk'))}, {_tagged('o', r.bm25_sql(5, 'vq', 'ov'))},
 od AS (SELECT query_id, split_part(pk, '::', 1) doc_id, max(score) score FROM (SELECT query_id, pk, score FROM o_dense UNION ALL SELECT query_id, pk, score FROM o_bm25) u GROUP BY ALL),
 scope AS (SELECT query_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 5) DESC, doc_id) r FROM od) WHERE r <= 10)"""


def _second_level_sql(tag: str, types: str, k: int, most: int) -> str:
    """A pool's hits by both paths, in the documents of the scope where that is sure, else everywhere."""
    scored = f"{tag}_c AS (SELECT * FROM vchunks WHERE type IN ({types})), {_tagged(tag, r.dense_sql(1, 'vq', tag + '_c', 'pk'))}, {_tagged(tag, r.bm25_sql(1, 'vq', tag + '_c'))}"
    part = lambda path, kind: f"SELECT query_id, pk, score, '{path}' path, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pk) r FROM {tag}_{kind} JOIN sure USING (query_id) WHERE NOT sure OR (query_id, split_part(pk, '::', 1)) IN (SELECT (query_id, doc_id) FROM scope)"
    return f"""{scored}, {tag}_h AS (SELECT query_id, pk, max(score) score, string_agg(path, ',' ORDER BY path) sources FROM ({part('vector', 'dsc')} UNION ALL {part('bm25', 'bsc')}) u WHERE r <= {k} GROUP BY ALL),
 {tag}_top AS (SELECT query_id, pk, score, sources, if(sure, 'l2', 'l2_global') AS stage FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pk) r FROM {tag}_h) JOIN sure USING (query_id) WHERE r <= {most})"""


_BEST = "SELECT query_id, max(score) s FROM {0} WHERE (query_id, split_part(pk, '::', 1)) IN (SELECT (query_id, doc_id) FROM scope) GROUP BY ALL"
_PROSE_SCORES = f"pp AS (SELECT * FROM vchunks WHERE type IN ('text', 'equation')), {_tagged('q', r.dense_sql(1, 'vq', 'pp', 'pk'))}, {_tagged('q', r.bm25_sql(1, 'vq', 'pp'))}"
_SURE = f"sure AS (SELECT query_id, coalesce(CASE WHEN l.s > 1 THEN v.s ELSE (l.s + v.s) / 2 END >= 0.35, false) AS sure FROM vq LEFT JOIN ({_BEST.format('q_bsc')}) l USING (query_id) LEFT JOIN ({_BEST.format('q_dsc')}) v USING (query_id))"


@query("progressive_full", f"WITH {VC}, {BQ}, {VQ}, {_SCOPE}, {_PROSE_SCORES}, {_SURE}, {_second_level_sql('a', chr(39) + 'text' + chr(39) + ', ' + chr(39) + 'equation' + chr(39), 5, 8)}, {_second_level_sql('z', chr(39) + 'image' + chr(39) + ', ' + chr(39) + 'table' + chr(39), 5, 2)} SELECT * FROM a_top UNION ALL SELECT * FROM z_top")
def progressive_full(spark, d):
    q, own = both_queries(spark, d), vector_chunks(spark, d)
    return levels.progressive(q, own, lexical(spark, d), ("summary", "title"), [(("text", "equation"), 8), (("image", "table"), 2)])


#: Each question names documents by id: those whose number it divides by 40 with the rest that its own number is.
def _named(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "doc_id").toDF("doc_id", "n")
    return benchmark_queries(spark, d).select("query_id").withColumn("m", F.col("query_id") % 40).join(docs.withColumn("m", F.col("n") % 40), "m").select("query_id", "doc_id")


_NAMED = "scope AS (SELECT query_id, CAST(doc_id AS VARCHAR) doc_id FROM bench JOIN documents ON doc_id % 40 = query_id % 40)"


#: The scope first: only chunks of the named documents are scored, by the statistics of all of their types.
_DIRECT_SQL = f"""WITH {VC}, {BQ}, {VQ}, {_NAMED}, pc AS (SELECT * FROM vchunks WHERE type IN ('text', 'equation')), bt AS (SELECT pk, doc_id, {text.TOKENS_SQL.format('content')} t FROM pc),
 be AS (SELECT pk, doc_id, len(t) dl, unnest(t) term FROM bt), bp AS (SELECT pk, doc_id, term, count(*) tf, any_value(dl) dl FROM be GROUP BY ALL), bd AS (SELECT term, count(*) df FROM bp GROUP BY term), bs AS (SELECT count(*) n_docs, avg(len(t)) avgdl FROM bt),
 bq AS (SELECT query_id, term, count(*) qtf FROM (SELECT query_id, unnest({text.TOKENS_SQL.format('q')}) term FROM vq) x GROUP BY ALL), sp AS MATERIALIZED (SELECT query_id, pk, term, tf, dl FROM scope JOIN bp USING (doc_id)),
 l AS (SELECT query_id, pk, round(sum(qtf * ln((n_docs - df + 0.5) / (df + 0.5) + 1.0) * (tf * {r.K1 + 1}) / (tf + {r.K1} * ({1 - r.B} + {r.B} * dl / avgdl))), {r.DIGITS}) score FROM sp JOIN bq USING (query_id, term) JOIN bd USING (term) CROSS JOIN bs GROUP BY query_id, pk),
 v AS (SELECT query_id, pk, round(list_inner_product(CAST(q_vec AS DOUBLE[]), CAST(embedding AS DOUBLE[])), {r.DIGITS}) score FROM scope JOIN pc USING (doc_id) JOIN vq USING (query_id)),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY score DESC, pk) r FROM (SELECT *, 'vector' path FROM v UNION ALL SELECT *, 'bm25' FROM l)), h AS (SELECT query_id, pk, max(score) score, string_agg(path, ',' ORDER BY path) sources FROM ranked WHERE r <= 8 GROUP BY query_id, pk)
 SELECT query_id, pk, score, sources FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pk) r FROM h) WHERE r <= 8"""


@query("local_direct", _DIRECT_SQL)
def local_direct(spark, d):
    return levels.direct(both_queries(spark, d), vector_chunks(spark, d), lexical(spark, d), _named(spark, d), ("text", "equation"), 8)


@query("l1_fallback", f"WITH {C}, {BQ}, su AS (SELECT * FROM chunks WHERE type = 'summary'), {r.bm25_sql(20, 'bench', 'su')} SELECT query_id, doc_id, score, CAST(rank AS INTEGER) rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) rank FROM (SELECT query_id, split_part(pk, '::', 1) doc_id, round(max(score * 0.9), 7) score FROM bm25 GROUP BY ALL)) WHERE rank <= 6")
def l1_fallback(spark, d):
    own = chunks(spark, d).where("type = 'summary'")
    hits = r.bm25(benchmark_queries(spark, d), own, 20).join(own.select("pk", "doc_id", "doc_name"), "pk")
    return r.documents_by_score(hits, 6, 0.9).drop("doc_name")


def _plans(spark, d) -> DataFrame:
    """Every question as two sub-questions on routes of their own, and on the metadata route."""
    q = both_queries(spark, d)
    first = q.withColumn("sub", F.lit("sub1")).withColumn("route", F.lit("progressive"))
    second = q.withColumn("sub", F.lit("sub2")).withColumn("route", F.lit("summary"))
    return first.unionByName(second).unionByName(second.withColumn("route", F.lit("metadata")))


_ROUTES_SQL = f"WITH {VC}, {BQ}, {VQ}, su AS (SELECT * FROM vchunks WHERE type = 'summary'), im AS (SELECT * FROM vchunks WHERE type = 'image'), {_tagged('a', r.dense_sql(4, 'vq', 'vchunks', 'pk'))}, {_bm25_of('b', 'vq', 'su', 3)}, {_bm25_of('c', 'vq', 'im', 2)} SELECT query_id, 'sub1' AS sub, 'progressive' AS route, pk, score, rank FROM a_dense UNION ALL SELECT query_id, 'sub2', 'summary', pk, score, rank FROM b_bm25 UNION ALL SELECT query_id, 'sub2', 'metadata', pk, score, rank FROM c_bm25"


def _dispatch(spark, d) -> tuple[DataFrame, DataFrame]:
    own = vector_chunks(spark, d)
    handlers = {"progressive": lambda q: r.dense(q, own, 4), "summary": lambda q: r.bm25(q, own.where("type = 'summary'"), 3), "metadata": lambda q: r.bm25(q, own.where("type = 'image'"), 2)}
    return routing.dispatched(_plans(spark, d), handlers)


@query("multi_route", _ROUTES_SQL)
def multi_route(spark, d):
    return _dispatch(spark, d)[0]


@query("compound", f"SELECT query_id, sub || ':' || route AS key, count(*)::BIGINT AS hits, max(score) AS best FROM ({_ROUTES_SQL}) GROUP BY ALL")
def compound(spark, d):
    return _dispatch(spark, d)[0].groupBy("query_id", F.concat_ws(":", "sub", "route").alias("key")).agg(F.count("*").alias("hits"), F.max("score").alias("best"))


@query("route_outcomes", f"SELECT route, asked, hits, CAST(NULL AS VARCHAR) AS error FROM (SELECT route, count(*)::BIGINT AS hits FROM ({_ROUTES_SQL}) GROUP BY route) CROSS JOIN (SELECT count(*)::BIGINT AS asked FROM benchmark)")
def route_outcomes(spark, d):
    return _dispatch(spark, d)[1]
