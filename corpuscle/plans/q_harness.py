"""Queries that evaluate retrieval, render contexts, and read what models answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import answers
from corpuscle.operators import context, evaluation, retrieval as r
from corpuscle.sources import sinks
from corpuscle.sources.chunks import CHUNKS_SQL as C

from .q_retrieval import BQ, VC, VQ, WEIGHTS, _bias_sql, both_queries, lexical, vector_chunks
from .q_store import chunks
from .registry import Fixture, query, table

KINDS = Fixture("id int, eval_kind string, query_type string", (1, " Generation ", "local"), (2, "odd", "local"), (3, None, "multi"), (4, "", "never heard of"), (5, "skip_auto", None), (6, None, None), (7, None, "summary"))


@query("eval_kinds", f"SELECT id, CASE WHEN lower(trim(coalesce(eval_kind, ''))) IN ('fact_retrieval', 'doc_scoped_retrieval', 'generation', 'skip_auto') THEN lower(trim(eval_kind)) WHEN query_type IN ('local', 'metadata_fig', 'metadata_page', 'metadata_entity', 'references') THEN 'doc_scoped_retrieval' WHEN query_type = 'summary' THEN 'generation' WHEN query_type = 'multi' THEN 'skip_auto' ELSE 'fact_retrieval' END AS kind FROM {KINDS.sql}")
def eval_kinds(spark, d):
    return KINDS.df(spark).select("id", evaluation.eval_kind(F.col("eval_kind"), F.col("query_type")).alias("kind"))


#: Lines of the corpus as hits of a question for each language, by two routes.
_ROWS = f"{C}, rows AS (SELECT lang AS query_id, CAST(paragraph_index % 2 AS INTEGER) AS route_pos, row_number() OVER (PARTITION BY lang, paragraph_index % 2 ORDER BY md5(pk)) AS rank, type, content, source AS context FROM chunks)"


@query("result_contexts", f"WITH {_ROWS}, e AS (SELECT query_id, route_pos, rank, 0 AS part, trim(content) AS text FROM rows UNION ALL SELECT query_id, route_pos, rank, 1, trim(context) FROM rows WHERE type IN ('image', 'table')), f AS (SELECT query_id, text, min((route_pos, rank, part)) AS place FROM e WHERE text <> '' GROUP BY ALL) SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY place) AS INTEGER) AS at, text FROM f")
def result_contexts(spark, d):
    from pyspark.sql import Window

    side = (F.col("paragraph_index") % 2).cast("int")
    rank = F.row_number().over(Window.partitionBy("lang", side).orderBy(F.md5("pk")))
    return evaluation.contexts(chunks(spark, d).select(F.col("lang").alias("query_id"), side.alias("route_pos"), rank.alias("rank"), "type", "content", F.col("source").alias("context")))


def _scope(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), (F.col("doc_id") % 40).alias("m"))
    return both_queries(spark, d).select("query_id", (F.col("query_id") % 40).alias("m")).join(docs, "m").select("query_id", "doc_id")


_IN = "(query_id % 2 = 0 OR (query_id, split_part(pk, '::', 1)) IN (SELECT (query_id, doc_id) FROM scope))"
_RANKED = "SELECT query_id, pk, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pk) r FROM {} WHERE " + _IN


@query("retrieve_only", f"""WITH {VC}, {BQ}, {VQ}, scope AS (SELECT query_id, CAST(doc_id AS VARCHAR) doc_id FROM bench JOIN documents ON doc_id % 40 = query_id % 40), {r.dense_sql(1, 'vq', 'vchunks', 'pk')}, {r.bm25_sql(1, 'vq', 'vchunks')},
 w AS (SELECT query_id, round(least(greatest(w, 0.25), 0.85) / (least(greatest(w, 0.25), 0.85) + least(greatest(1 - w, 0.25), 0.85)), 4) AS wd, round(least(greatest(1 - w, 0.25), 0.85) / (least(greatest(w, 0.25), 0.85) + least(greatest(1 - w, 0.25), 0.85)), 4) AS wb FROM (SELECT query_id, {_bias_sql()} AS bias FROM (SELECT query_id, trim(coalesce(q, '')) q2, '' AS kind FROM vq)) JOIN {WEIGHTS.sql} y ON y.b = bias AND y.s = 'simple'),
 u AS (SELECT query_id, pk, wd / (60.0::DOUBLE + r) part FROM ({_RANKED.format('dsc')}) JOIN w USING (query_id) WHERE r <= 40 UNION ALL SELECT query_id, pk, wb / (60.0::DOUBLE + r) FROM ({_RANKED.format('bsc')}) JOIN w USING (query_id) WHERE r <= 40)
 SELECT query_id, pk, score, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pk) k FROM (SELECT query_id, pk, round(sum(part), 6) score FROM u GROUP BY ALL)) WHERE k <= 10""")
def retrieve_only(spark, d):
    q = both_queries(spark, d).withColumn("kind", F.when(F.col("query_id") % 2 == 0, "fact_retrieval").otherwise("doc_scoped_retrieval"))
    return evaluation.retrieve_only(q, vector_chunks(spark, d), lexical(spark, d), _scope(spark, d), 10)


@query("paper_discovery", f"WITH {C} SELECT doc_id, count(*)::BIGINT AS n_chunks FROM chunks JOIN labels l ON CAST(l.doc_id AS VARCHAR) = chunks.doc_id WHERE source <> 'src1' GROUP BY doc_id".replace("SELECT doc_id, count", "SELECT chunks.doc_id, count").replace("GROUP BY doc_id", "GROUP BY chunks.doc_id"))
def paper_discovery(spark, d):
    known = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("doc_id")).distinct()
    return chunks(spark, d).where("source != 'src1'").join(known, "doc_id", "left_semi").groupBy("doc_id").agg(F.count("*").alias("n_chunks"))


@query("full_texts", f"WITH {C} SELECT doc_id, string_agg('[' || pk || ']' || chr(10) || trim(content), chr(10) || chr(10) ORDER BY paragraph_index, pk) AS text FROM chunks WHERE trim(content) <> '' GROUP BY doc_id")
def full_texts(spark, d):
    return context.full_text(chunks(spark, d))


@query("pending_documents", f"WITH {C} SELECT DISTINCT doc_id FROM chunks WHERE doc_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)")
def pending_documents(spark, d):
    done = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("doc_id"))
    return sinks.pending(chunks(spark, d).select("doc_id").distinct(), done, "doc_id")


ROUTES = ("progressive", "local", "metadata")


def route_hits(spark, d) -> DataFrame:
    """Lines of the corpus as hits of a question for each language; every seventh is on two routes."""
    from pyspark.sql import Window

    own = chunks(spark, d).withColumn("query_id", F.col("lang")).withColumn("context", F.col("source"))
    n = F.col("paragraph_index")
    every = own.withColumn("route", F.explode(F.when(n % 7 == 0, F.array(F.lit("progressive"), F.lit("local"))).otherwise(F.array(F.element_at(F.array(*map(F.lit, ROUTES)), (n % 2 + 1).cast("int"))))))
    return every.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "route").orderBy(F.md5("pk"), "pk")))


@query("route_context")
def route_context(spark, d):
    own = route_hits(spark, d)
    asked = own.select("query_id").distinct().withColumn("question", F.concat(F.lit("What is in "), "query_id"))
    return context.routed(asked, own, ROUTES)


ANSWERS = Fixture(
    "id int, answer string",
    (1, '<tool_call>{"name": "plan", "arguments": {"a": 1}}</tool_call> and <TOOL_CALL> {"name":"ask"} </TOOL_CALL>'), (2, '{"name": "reuse", "arguments": "{\\"m\\": 2}"} </tool_call>'), (3, '<tool_call> {"name": "plan", "arguments": {}}'), (4, '```json\n{"name": "multi", "arguments": {"x": [1]}}\n```'),
    (5, 'so {"name": "ok"} it is'), (6, "no call"), (7, None), (8, '<tool_call>{broken}</tool_call> {"name": ""}'), (9, 'ids: ["text_1", "image_2"] done'),
)


@query("tool_calls")
def tool_calls(spark, d):
    own = ANSWERS.df(spark).select("id", answers.tool_calls(F.col("answer")).alias("t"))
    return own.select("id", "t.source", F.array_join(F.transform("t.calls", lambda c: F.concat_ws(":", c["name"], c["arguments"])), ";").alias("calls"))


@query("json_lists")
def json_lists(spark, d):
    return ANSWERS.df(spark).select("id", F.array_join(answers.json_list(F.col("answer")), ",").alias("ids")).where("ids IS NOT NULL")
