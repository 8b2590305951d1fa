"""Queries over scans, sinks, filters and catalogues of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions import text
from corpuscle.operators import catalog, filters
from corpuscle.sources import chunks as store
from corpuscle.sources.chunks import CHUNKS_SQL as C

from .registry import Fixture, query, table


def chunks(spark, d) -> DataFrame:
    return store.from_documents(table(spark, d, "documents"))


@query("scan_filter_limit", f"WITH {C} SELECT pk, doc_id, type, content FROM chunks WHERE type = 'text' AND page_start = 0 ORDER BY pk LIMIT 100")
def scan_filter_limit(spark, d):
    return chunks(spark, d).where("type = 'text' AND page_start = 0").select("pk", "doc_id", "type", "content").orderBy("pk").limit(100)


@query("distinct_doc_ids", f"WITH {C} SELECT DISTINCT doc_id FROM chunks")
def distinct_doc_ids(spark, d):
    return chunks(spark, d).select("doc_id").distinct()


#: Documents as vector files and their sidecars, in SQL that both engines read alike.
_AT = "'/kb/' || coalesce(source, '') || '/' || doc_id"
_YEARS = "CAST(CASE WHEN doc_id % 5 > 0 THEN 2000 + doc_id % 25 END AS INT) AS publication_year"
FILES_SQL = f"SELECT {_AT} || CASE doc_id % 4 WHEN 0 THEN '_vec' WHEN 1 THEN '_vectors' WHEN 2 THEN '_embedded' ELSE '' END || '.json' AS path, length(text) AS size FROM documents"
SIDECARS_SQL = f"SELECT {_AT} || '_meta.json' AS path, 'paper ' || doc_id AS doc_name, {_YEARS} FROM documents WHERE lang = 'en'"
NEW_SIDECARS_SQL = f"SELECT {_AT} || '_meta.json' AS path, CASE WHEN length(text) > 800 THEN 'new ' || doc_id END AS doc_name, CAST(1990 + doc_id % 9 AS INT) AS publication_year FROM documents WHERE length(text) > 400"
META_SQL = """SELECT '/kb/' || doc_id || CASE doc_id % 3 WHEN 0 THEN '/content_vec.json' WHEN 1 THEN '/' || coalesce(source, '') || '_vectors.json' ELSE '/p' || (1990 + doc_id % 30) || '.json' END AS path,
 CASE doc_id % 5 WHEN 0 THEN 'given ' || doc_id WHEN 1 THEN ' ' END AS explicit_name, CASE doc_id % 2 WHEN 0 THEN 'side ' || doc_id ELSE '' END AS sidecar_name, CAST(CASE WHEN doc_id % 7 = 0 THEN 2015 ELSE 0 END AS INT) AS explicit_year, text AS content FROM documents"""


def _rows(spark, d, sql: str) -> DataFrame:
    """Rows that a SELECT makes of the documents."""
    return spark.sql(sql.replace("FROM documents", "FROM {documents}"), documents=table(spark, d, "documents"))


@query("sidecar_join", rf"SELECT f.path, f.size, s.doc_name, s.publication_year FROM ({FILES_SQL}) f LEFT JOIN ({SIDECARS_SQL}) s ON regexp_replace(f.path, '(?:_vec|_vectors|_embedded)?\.json$', '_meta.json') = s.path")
def sidecar_join(spark, d):
    return store.with_sidecars(_rows(spark, d, FILES_SQL), _rows(spark, d, SIDECARS_SQL)).select("path", F.col("size").cast("long").alias("size"), "doc_name", "publication_year")


@query("sidecar_merge", f"SELECT coalesce(o.path, n.path) path, coalesce(n.doc_name, o.doc_name) doc_name, coalesce(n.publication_year, o.publication_year) publication_year FROM ({SIDECARS_SQL}) o FULL JOIN ({NEW_SIDECARS_SQL}) n ON o.path = n.path")
def sidecar_merge(spark, d):
    return store.merge_sidecar(_rows(spark, d, SIDECARS_SQL), _rows(spark, d, NEW_SIDECARS_SQL), "path", ["doc_name", "publication_year"])


_YEAR = "CAST(nullif(regexp_extract({}, '(?:19|20)[0-9][0-9]', 0), '') AS INTEGER)"


@query("infer_doc_meta", rf"""SELECT path, coalesce(nullif(trim(explicit_name), ''), nullif(trim(sidecar_name), ''), CASE WHEN regexp_extract(path, '([^/]+?)(?:_vec|_vectors)?\.json$', 1) IN ('content', 'knowledge_blocks', 'output', 'result') THEN regexp_extract(path, '([^/]+)/[^/]+$', 1) ELSE regexp_extract(path, '([^/]+?)(?:_vec|_vectors)?\.json$', 1) END) doc_name,
 coalesce(CASE WHEN explicit_year > 0 THEN explicit_year END, {_YEAR.format('path')}, {_YEAR.format('content')}, 0) publication_year FROM ({META_SQL})""")
def infer_doc_meta(spark, d):
    return store.infer_meta(_rows(spark, d, META_SQL))


@query("upsert_latest", f"""WITH {C}, n AS (SELECT pk, reverse(content) AS content, 2 AS version FROM chunks WHERE paragraph_index % 3 = 0 UNION ALL SELECT 'new::' || pk, content, 1 FROM chunks WHERE paragraph_index = 1),
 o AS (SELECT pk, content, 1 AS version FROM chunks) SELECT pk, content, version FROM (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY version DESC) r FROM (SELECT * FROM o UNION ALL SELECT * FROM n)) WHERE r = 1""")
def upsert_latest(spark, d):
    own = chunks(spark, d)
    old = own.select("pk", "content", F.lit(1).alias("version"))
    new = own.where("paragraph_index % 3 = 0").select("pk", F.reverse("content").alias("content"), F.lit(2).alias("version")).union(own.where("paragraph_index = 1").select(F.concat(F.lit("new::"), "pk"), "content", F.lit(1)))
    return store.upsert_latest(old, new)


@query("purge_replace", f"WITH {C}, n AS (SELECT doc_id, pk FROM chunks WHERE CAST(doc_id AS BIGINT) % 4 = 0 AND paragraph_index < 4) SELECT doc_id, pk FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM n) UNION ALL SELECT * FROM n")
def purge_replace(spark, d):
    own = chunks(spark, d)
    return store.purge_replace(own.select("doc_id", "pk"), own.where("cast(doc_id AS bigint) % 4 = 0 AND paragraph_index < 4").select("doc_id", "pk"))


@query("append_skip_existing", f"WITH {C}, o AS (SELECT doc_id, pk FROM chunks WHERE CAST(doc_id AS BIGINT) % 2 = 0), n AS (SELECT doc_id, pk || '+' pk FROM chunks WHERE CAST(doc_id AS BIGINT) % 3 = 0) SELECT * FROM o UNION ALL SELECT * FROM n WHERE doc_id NOT IN (SELECT doc_id FROM o)")
def append_skip_existing(spark, d):
    own = chunks(spark, d)
    old = own.where("cast(doc_id AS bigint) % 2 = 0").select("doc_id", "pk")
    return store.append_new(old, own.where("cast(doc_id AS bigint) % 3 = 0").select("doc_id", F.concat("pk", F.lit("+")).alias("pk")))


BLOBS = Fixture("blob string", ("x paper-1::text_0a1b2c3d y other::table_99887766_p001",), ("none here",), ("doc 9::summary_deadbeef",))


@query("pk_extract", f"SELECT DISTINCT unnest(regexp_extract_all(blob, '[A-Za-z0-9-]+::[a-z]+_[0-9a-f]{{8}}(?:_p[0-9]+)?')) AS pk FROM {BLOBS.sql}")
def pk_extract(spark, d):
    return BLOBS.df(spark).select(F.explode(F.regexp_extract_all("blob", F.lit("[A-Za-z0-9-]+::[a-z]+_[0-9a-f]{8}(?:_p[0-9]+)?"), F.lit(0))).alias("pk")).distinct()


@query("in_corpus_semi", "SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)")
def in_corpus_semi(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id"), "doc_id", "left_semi").select("doc_id", "quality")


@query("filter_eq", f"WITH {C} SELECT pk FROM chunks WHERE doc_id = '7' AND type = 'text'")
def filter_eq(spark, d):
    return chunks(spark, d).where(text.all_of(F.col("doc_id") == "7", None, F.col("type") == "text")).select("pk")


@query("filter_year_range", f"WITH {C} SELECT pk, publication_year FROM chunks WHERE publication_year BETWEEN 2003 AND 2006 AND paragraph_index = 1")
def filter_year_range(spark, d):
    return chunks(spark, d).where(text.all_of(filters.years("2003到2006"), F.col("paragraph_index") == 1)).select("pk", "publication_year")


@query("filter_docset", f"WITH {C} SELECT pk FROM chunks WHERE doc_id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE quality = 0) AND type NOT IN ('summary', 'title', 'references')")
def filter_docset(spark, d):
    wanted = table(spark, d, "labels").where("quality = 0").select(F.col("doc_id").cast("string").alias("doc_id"))
    return filters.in_documents(chunks(spark, d), wanted).where(filters.pool("content")).select("pk")


@query("content_pools", f"""WITH {C} SELECT pool, count(*)::BIGINT AS n FROM (SELECT unnest(list_filter(['overview', 'content', 'prose', 'structural'], lambda p: (p = 'overview' AND type IN ('summary', 'title')) OR (p = 'content' AND type NOT IN ('summary', 'title', 'references')) OR (p = 'prose' AND type IN ('text', 'equation')) OR (p = 'structural' AND type IN ('image', 'table')))) AS pool FROM chunks) GROUP BY pool""")
def content_pools(spark, d):
    names = F.array(*(F.when(filters.pool(p), p) for p in filters.POOLS))
    return chunks(spark, d).select(F.explode(F.array_compact(names)).alias("pool")).groupBy("pool").agg(F.count("*").alias("n"))


@query("like_substring", f"WITH {C} SELECT pk FROM chunks WHERE contains(content, 'tion the') OR contains(content, '100%_') OR contains(content, '###')")
def like_substring(spark, d):
    return chunks(spark, d).where(text.contains_any(F.col("content"), ["tion the", "100%_", "###"])).select("pk")


FIGURES = Fixture("pk string, type string, content string", ("a", "image", "Fig. 3(a) shows steel"), ("b", "text", "see Figure 3a and 图3(a)"), ("c", "text", "Fig.S3 extra"), ("d", "image", "图 12 microstructure"), ("e", "table", "Table 2 lists; 表2"), ("f", "text", "table 21 and TABLE 2"), ("g", "text", "Figure 31"), ("h", "text", "图S3"))


def _variants_sql(parts: list[str]) -> str:
    return " OR ".join(f"contains(content, '{p}')" for p in parts)


@query("fig_variants", f"SELECT label, pk FROM (SELECT '3a' AS label, * FROM {FIGURES.sql} WHERE {_variants_sql(filters.figure_variants('3a'))} UNION ALL SELECT '3', * FROM {FIGURES.sql} WHERE {_variants_sql(filters.figure_variants('3'))} UNION ALL SELECT 'S3', * FROM {FIGURES.sql} WHERE {_variants_sql(filters.figure_variants('S3'))})")
def fig_variants(spark, d):
    return filters.matching_labels(FIGURES.df(spark), {label: filters.figure_variants(label) for label in ("3a", "3", "S3")})


@query("table_variants", f"SELECT '2' AS label, pk FROM {FIGURES.sql} WHERE {_variants_sql(filters.table_variants('2'))}")
def table_variants(spark, d):
    return filters.matching_labels(FIGURES.df(spark), {"2": filters.table_variants("2")})


@query("entity_filter", f"WITH {C} SELECT pk FROM chunks WHERE contains(content, 'Ofanthedin') OR contains(content, 'ofanthedin') OR contains(content, 'OFANTHEDIN') OR contains(content, 'The')")
def entity_filter(spark, d):
    return chunks(spark, d).where(filters.entity("Ofanthedin") | F.contains("content", F.lit("The"))).select("pk")


@query("metadata_filters", f"""WITH {C}, s AS (SELECT doc_id, pk, CAST(CAST(page_start IN (0, 1) AS INTEGER) + CAST(paragraph_index IN (2, 6, 7) AS INTEGER) + 2 * (CAST(contains(lower(content), 'tion') AS INTEGER) + CAST(contains(lower(content), 'heed') AS INTEGER)) AS DOUBLE) AS score FROM chunks
 WHERE page_start IN (0, 1) AND paragraph_index IN (2, 6, 7) AND (contains(content, 'tion') OR contains(content, 'TION') OR contains(content, 'heed') OR contains(content, 'HEED')))
 SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pk) AS INTEGER) AS rank FROM s) WHERE rank <= 8""")
def metadata_filters(spark, d):
    return filters.structured(chunks(spark, d), pages=[1, 2], paragraphs=[2, 6, 7], entities=["tion", "heed"], k=8, by=["doc_id"]).select("doc_id", "pk", "score", "rank")


NAV = Fixture("pk string, type string, section string, content string", ("a", "summary", "", "x"), ("b", "text", "", "[S1] Abstract: steel"), ("c", "text", "Keywords", "steel"), ("d", "text", "Intro", "An abstract idea"), ("e", "text", "", "摘 要：钢"), ("f", "text", "", "Key words: a"), ("g", "text", "关键词", "钢"))
_NAV = r"(?i)^[ ]*(?:\[[^\]]*\][ ]*)*(?:abstract|key[ ]*words?)(?:[^a-z0-9_]|$)|^[ ]*(?:\[[^\]]*\][ ]*)*(?:摘[ ]*要|关[ ]*键[ ]*词)"


@query("drop_nav", f"SELECT pk FROM {NAV.sql} WHERE NOT (lower(type) = 'summary' OR regexp_matches(substr(content, 1, 80), '{_NAV}') OR lower(trim(section)) IN ('abstract', '摘要', 'keywords', 'key words', '关键词'))")
def drop_nav(spark, d):
    return NAV.df(spark).where(~filters.navigation()).select("pk")


BLOCKS = Fixture("pk string, type string, hidden boolean, conf double, text string", ("a", "paragraph", False, 0.9, "good text"), ("b", "noise", False, 0.9, "x"), ("c", "paragraph", True, 0.9, "y"), ("d", "paragraph", False, 0.1, "z"), ("e", "paragraph", None, None, "�#@!~^*&"), ("f", "paragraph", False, 0.8, "Journal of Steel, Vol. 3"), ("g", "paragraph", False, 0.8, "Received 3 May 2020"), ("h", "paragraph", False, 0.8, "DOI: 10.1016/j.x"), ("i", "paragraph", False, 0.8, " 收 稿 日 期：2020-01-02"), ("j", "paragraph", False, 0.8, "CLC number: TG172"))


@query("block_filter", f"SELECT pk FROM {BLOCKS.sql} WHERE type NOT IN ('noise', 'header', 'footer', 'page_number') AND NOT coalesce(hidden, false) AND coalesce(conf, 1.0) >= 0.3")
def block_filter(spark, d):
    return BLOCKS.df(spark).where(filters.readable_block(0.3)).select("pk")


@query("garbled_filter", f"SELECT pk FROM {BLOCKS.sql} WHERE length(text) > 2 AND length(regexp_replace(text, '[^A-Za-z0-9一-鿿]', '', 'g')) / length(text) < 0.3")
def garbled_filter(spark, d):
    return BLOCKS.df(spark).where(filters.garbled("text")).select("pk")


@query("metadata_line", f"SELECT pk FROM {BLOCKS.sql} WHERE length(text) <= 120 AND regexp_matches(trim(text), '{filters.METADATA_LINE}')")
def metadata_line(spark, d):
    return BLOCKS.df(spark).where(filters.metadata_line("text")).select("pk")


HITS = Fixture("query_id int, route string, type string, pk string", (1, "metadata", "image", "a"), (1, "local", "table", "b"), (2, "local", "text", "c"), (2, "sub1:metadata", "text", "d"), (3, "local", "image", "e"), (4, "summary", "summary", "f"))


@query("reflect_eligible", f"SELECT query_id, pk FROM {HITS.sql} WHERE regexp_replace(route, '^.*:', '') <> 'metadata' AND type NOT IN ('image', 'table', 'references')")
def reflect_eligible(spark, d):
    return HITS.df(spark).where(filters.reflect_eligible()).select("query_id", "pk")


@query("structural_only", f"SELECT query_id FROM {HITS.sql} GROUP BY query_id HAVING count(*) FILTER (WHERE regexp_replace(route, '^.*:', '') <> 'metadata' AND type NOT IN ('image', 'table', 'references')) = 0")
def structural_only(spark, d):
    return HITS.df(spark).groupBy("query_id").agg(F.count_if(filters.reflect_eligible()).alias("n")).where("n = 0").select("query_id")


ROUTES = Fixture("route string, chunk_type string, handled boolean", ("summary", "image", False), ("metadata", None, True), ("progressive", "image", True), ("progressive", "table", False), ("local", "references", True), ("local", "", False))


@query("route_chunk_type", f"SELECT route, chunk_type, handled, CASE WHEN route = 'summary' THEN NULL WHEN route IN ('progressive', 'local') AND handled AND chunk_type IN ('image', 'table') THEN NULL ELSE nullif(chunk_type, '') END AS effective FROM {ROUTES.sql}")
def route_chunk_type(spark, d):
    return ROUTES.df(spark).withColumn("effective", filters.route_type(F.col("route"), F.col("chunk_type"), F.col("handled")))


@query("sample_chunks", f"WITH {C} SELECT pk, doc_id FROM chunks WHERE length(content) >= 100 ORDER BY md5(pk), pk LIMIT 50")
def sample_chunks(spark, d):
    return chunks(spark, d).where(F.length("content") >= 100).orderBy(F.md5("pk"), "pk").limit(50).select("pk", "doc_id")


EVAL = Fixture("question string, query_type string, eval_kind string, in_corpus boolean", ("q1", "fact", "fact_retrieval", True), ("q2", "summary", "generation", True), ("q3", "fact", "fact_retrieval", False), ("q4", "table", "doc_scoped_retrieval", None))


@query("eval_filter", f"SELECT question FROM {EVAL.sql} WHERE in_corpus AND eval_kind IN ('fact_retrieval', 'generation') AND query_type = 'fact'")
def eval_filter(spark, d):
    return EVAL.df(spark).where(text.all_of(F.col("in_corpus"), F.col("eval_kind").isin("fact_retrieval", "generation"), F.col("query_type") == "fact")).select("question")


@query("collection_stats", f"WITH {C} SELECT doc_id, type, count(*)::BIGINT AS n, max(publication_year) AS publication_year FROM chunks GROUP BY doc_id, type")
def collection_stats(spark, d):
    return catalog.stats(chunks(spark, d))


@query("collection_matrix", f"WITH {C} SELECT source, count(*) FILTER (WHERE type = 'summary')::BIGINT AS summary, count(*) FILTER (WHERE type = 'text')::BIGINT AS text, count(*) FILTER (WHERE type = 'image')::BIGINT AS image, count(*) FILTER (WHERE type = 'table')::BIGINT AS \"table\" FROM chunks GROUP BY source")
def collection_matrix(spark, d):
    return chunks(spark, d).groupBy("source").agg(*(F.count_if(F.col("type") == t).alias(t) for t in ("summary", "text", "image", "table")))


@query("list_documents", f"WITH {C} SELECT doc_id, count(*)::BIGINT AS chunks, arg_min(doc_name, paragraph_index) AS doc_name, arg_min(publication_year, paragraph_index) FILTER (WHERE publication_year <> 0) AS publication_year FROM chunks GROUP BY doc_id")
def list_documents(spark, d):
    return catalog.documents(chunks(spark, d))


@query("list_collections", f"WITH {C} SELECT source AS collection, count(*)::BIGINT AS chunks, count(DISTINCT doc_id)::BIGINT AS documents FROM chunks WHERE starts_with(source, 'src1') GROUP BY source")
def list_collections(spark, d):
    return catalog.collections(chunks(spark, d), "source", "src1")


@query("type_counts", f"WITH {C} SELECT type, count(*)::BIGINT AS n FROM chunks GROUP BY type")
def type_counts(spark, d):
    return chunks(spark, d).groupBy("type").agg(F.count("*").alias("n"))


DOC_TEXT = Fixture("doc_id string, pos int, content string", ("a", 1, "Received 2014; Published: 12 May 2015. Copyright 2015"), ("a", 2, "in 1999 and 2015"), ("b", 1, "© 2008 Elsevier (2009)"), ("c", 9, "Published 2001"), ("d", 1, "no year"))


@query("year_vote", f"SELECT doc_id, year FROM (SELECT doc_id, year, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, year DESC) r FROM (SELECT doc_id, CAST(unnest(regexp_extract_all(substr(content, 1, 2000), '(?:19|20)[0-9][0-9]')) AS INTEGER) AS year FROM {DOC_TEXT.sql} WHERE pos <= 5) y GROUP BY doc_id, year) WHERE r = 1")
def year_vote(spark, d):
    return catalog.year_by_vote(DOC_TEXT.df(spark))


@query("rebuild", f"WITH {C} SELECT pk, doc_id, doc_name, chunk_id, type, section, page_start, paragraph_index, publication_year, content FROM chunks")
def rebuild(spark, d):
    return store.checked(chunks(spark, d)).select(store.SCHEMA.fieldNames())


@query("fallback_page", f"WITH {C} SELECT pk, CAST(row_number() OVER (ORDER BY pk) AS BIGINT) AS n FROM chunks WHERE doc_id = '3'")
def fallback_page(spark, d):
    return chunks(spark, d).where("doc_id = '3'").select("pk", F.row_number().over(Window.orderBy("pk")).cast("long").alias("n"))
