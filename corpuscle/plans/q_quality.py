"""Queries over judged hits, evaluation, context and questions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpuscle.functions import questions, text, words
from corpuscle.operators import context, evaluation, lexical_index, quality, retrieval as r
from corpuscle.sources.chunks import CHUNKS_SQL as C
from corpuscle.sources.shared import stored

from .q_retrieval import BQ, benchmark_queries, lexical
from .q_store import chunks
from .registry import Fixture, query, table

#: The twelve best chunks for each benchmark item, with a route by their type, a stage by their document, and scores scaled to about 0 to 1.
HITS = f"""{C}, {BQ}, {r.bm25_sql(12, 'bench')}, hits AS (SELECT query_id, CAST(CAST(doc_id AS BIGINT) % 2 AS VARCHAR) AS grp, CASE WHEN type IN ('text', 'equation') THEN 'progressive' WHEN type = 'summary' THEN 'summary' WHEN type = 'title' THEN 'local' ELSE 'metadata' END AS route,
 CASE WHEN type IN ('text', 'equation') THEN CASE WHEN CAST(doc_id AS BIGINT) % 3 = 0 THEN 'l1' ELSE 'l2' END END AS stage, type, rank AS pos, score / 37.0::DOUBLE AS score, pk, doc_id, doc_name, content FROM bm25 JOIN chunks USING (pk))"""


def hits(spark, d):
    found = r.with_chunks(lexical_index.search(benchmark_queries(spark, d), lexical(spark, d), 12), chunks(spark, d).select("pk", "doc_id", "doc_name", "type", "content"))
    n, prose = F.col("doc_id").cast("long"), F.col("type").isin("text", "equation")
    route = F.when(prose, "progressive").when(F.col("type") == "summary", "summary").when(F.col("type") == "title", "local").otherwise("metadata")
    stage = F.when(prose, F.when(n % 3 == 0, "l1").otherwise("l2"))
    return found.select("query_id", (n % 2).cast("string").alias("grp"), route.alias("route"), stage.alias("stage"), "type", F.col("rank").alias("pos"), (F.col("score") / 37.0).alias("score"), "pk", "doc_id", "doc_name", "content")


@query("rerank_top", f"WITH {HITS} SELECT query_id, pos, held AS score, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY held DESC, pos) k FROM (SELECT *, greatest(0, least(1, score)) held FROM hits WHERE score IS NOT NULL)) WHERE k <= 2")
def rerank_top(spark, d):
    return quality.clamped(hits(spark, d), 2).select("query_id", "pos", "score", "rank")


@query("dominant_type", f"WITH {HITS} SELECT query_id, type, n FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, o) k FROM (SELECT query_id, type, count(*) n, min(pos) o FROM hits GROUP BY ALL)) WHERE k = 1")
def dominant_type(spark, d):
    return quality.dominant(hits(spark, d), ["query_id"], "type", "pos")


@query("score_stats", f"WITH {HITS} SELECT query_id, route, type, CASE WHEN grouping(route) = 0 THEN 'route' WHEN grouping(type) = 0 THEN 'type' ELSE 'all' END AS level, round(avg(score), 6) AS mean, max(score) AS best, count(*) AS n FROM hits GROUP BY GROUPING SETS ((query_id, route), (query_id, type), (query_id))")
def score_stats(spark, d):
    return quality.score_stats(hits(spark, d))


@query("group_zscore", f"WITH {HITS} SELECT query_id, pos, round(CASE WHEN g > 1 AND n >= 2 THEN (score - m) / (CASE WHEN s > 0 THEN s ELSE 0.001 END) ELSE score END, 6) AS z FROM (SELECT *, avg(score) OVER w m, stddev_pop(score) OVER w s, count(score) OVER w n, count(DISTINCT grp) OVER (PARTITION BY query_id) g FROM hits WINDOW w AS (PARTITION BY query_id, grp))")
def group_zscore(spark, d):
    return quality.group_zscore(hits(spark, d)).select("query_id", "pos", F.round("z", 6).alias("z"))


_ROUTES = f"(SELECT query_id, route, avg(score) AS quality FROM (SELECT *, row_number() OVER (PARTITION BY query_id, route ORDER BY score DESC) k FROM hits WHERE score IS NOT NULL) WHERE k <= 2 GROUP BY ALL)"


@query("route_quality", f"WITH {HITS} SELECT query_id, route, round(quality, 6) AS quality FROM {_ROUTES}")
def route_quality(spark, d):
    return quality.route_quality(hits(spark, d), 2).select("query_id", "route", F.round("quality", 6).alias("quality"))


@query("blended_quality", f"WITH {HITS} SELECT query_id, round(CASE WHEN count(*) = 1 THEN max(quality) ELSE 0.7 * max(quality) + 0.3 * avg(quality) END, 6) AS quality FROM {_ROUTES} GROUP BY query_id")
def blended_quality(spark, d):
    return quality.gate(quality.route_quality(hits(spark, d), 2), F.lit(0.5)).select("query_id", F.round("quality", 6).alias("quality"))


@query("quality_gate", f"WITH {HITS} SELECT query_id, bool_or(quality >= CASE route WHEN 'local' THEN 0.8 WHEN 'summary' THEN 0.35 ELSE 0.25 END) AS passes FROM {_ROUTES} GROUP BY query_id")
def quality_gate(spark, d):
    limit = quality.threshold({("local", "", ""): 0.8, ("summary", "", ""): 0.35}, 0.25, stage=F.lit(""), kind=F.lit(""))
    return quality.gate(quality.route_quality(hits(spark, d), 2), limit).select("query_id", "passes")


@query("hit_counts", f"WITH {HITS} SELECT query_id, coalesce(route, 'ALL') AS route, count(*) AS n FROM hits GROUP BY GROUPING SETS ((query_id, route), (query_id))")
def hit_counts(spark, d):
    own = hits(spark, d).groupingSets([["query_id", "route"], ["query_id"]], "query_id", "route").agg(F.count("*").alias("n"))
    return own.withColumn("route", F.coalesce("route", F.lit("ALL")))


MATRIX = {("progressive", "l1", "text"): 0.18, ("progressive", "l1", ""): 0.12, ("progressive", "l2", "image"): 0.15, ("progressive", "", ""): 0.22, ("local", "", "text"): 0.3, ("metadata", "", ""): 0.1, ("", "", "image"): 0.05, ("", "", "table"): 0.08}
ENTRIES = Fixture("route string, stage string, type string, value double", *((*k, v) for k, v in MATRIX.items()))
_STEP = f"(SELECT value FROM {ENTRIES.sql} m WHERE m.route = {{}} AND m.stage = {{}} AND m.type = {{}})"


@query("threshold_ladder", f"WITH {HITS} SELECT query_id, pos, coalesce({_STEP.format('h.route', 'h.st', 'h.type')}, {_STEP.format('h.route', 'h.st', chr(39) * 2)}, {_STEP.format('h.route', chr(39) * 2, 'h.type')}, {_STEP.format('h.route', chr(39) * 2, chr(39) * 2)}, {_STEP.format(chr(39) * 2, chr(39) * 2, 'h.type')}, 0.25) AS threshold FROM (SELECT *, coalesce(stage, '') st FROM hits) h")
def threshold_ladder(spark, d):
    return hits(spark, d).select("query_id", "pos", quality.threshold(MATRIX, 0.25).alias("threshold"))


#: What a question asked for: every third one for images, every third for what its hit is, the others for nothing; every second names a label.
_ASKED = "(SELECT query_id, pos, route, type, CASE query_id % 3 WHEN 0 THEN 'Image ' WHEN 1 THEN type END AS asked_type, query_id % 2 = 0 AS structural_refs FROM hits)"


@query("exempt_levels", f"WITH {HITS} SELECT query_id, pos, CASE WHEN route = 'metadata' AND structural_refs THEN 'full' WHEN route = 'metadata' THEN 'topk_only' WHEN type IN ('image', 'table', 'references') AND type = lower(trim(asked_type)) THEN 'full' ELSE 'none' END AS level FROM {_ASKED}")
def exempt_levels(spark, d):
    asked = F.when(F.col("query_id") % 3 == 0, "Image ").when(F.col("query_id") % 3 == 1, F.col("type"))
    own = hits(spark, d).withColumn("asked_type", asked).withColumn("structural_refs", F.col("query_id") % 2 == 0)
    return own.select("query_id", "pos", quality.exemption().alias("level"))


FIGURES = Fixture(
    "query_id int, n_fig int, n_tab int, n_ref int, refs_intent boolean, has_metadata boolean, has_docs boolean, has_local boolean, has_progressive boolean, has_summary boolean, is_summary boolean, n_image int, avg_image double, n_table int, avg_table double, n_references int, avg_references double, refs_threshold double, global_avg double, n_routes int, n_dead int, n_alive int, alive_max double, progressive_dead boolean, hits int, top3_avg double, type_threshold double, threshold double, quality double",
    (1, 2, 0, 0, False, False, True, False, True, False, False, 0, 0.0, 1, 0.4, 0, 0.0, 0.15, 0.5, 2, 1, 1, 0.6, False, 8, 0.6, 0.3, 0.25, 0.5),
    (2, 0, 0, 1, False, False, False, False, True, False, False, 1, 0.1, 0, 0.0, 0, 0.0, 0.15, 0.4, 1, 0, 1, 0.4, False, 2, 0.4, 0.3, 0.25, 0.4),
    (3, 0, 0, 0, True, True, False, False, True, False, False, 0, 0.0, 0, 0.0, 2, 0.05, 0.15, 0.4, 1, 0, 1, 0.4, False, 20, 0.4, 0.3, 0.25, 0.1),
    (4, 0, 0, 0, False, False, False, False, True, False, False, 0, 0.0, 0, 0.0, 0, 0.0, 0.15, 0.4, 1, 0, 1, 0.4, False, 9, 0.4, 0.3, 0.25, 0.4),
    (5, 0, 0, 0, False, False, False, False, True, False, False, 0, 0.0, 0, 0.0, 0, 0.0, 0.15, 0.01, 1, 1, 0, 0.0, True, 9, 0.01, 0.3, 0.25, 0.01),
    (6, 0, 1, 0, False, False, False, True, False, False, True, 0, 0.0, 3, 0.1, 0, 0.0, 0.15, 0.5, 3, 2, 1, 0.2, True, 1, 0.5, 0.3, 0.25, 0.2),
)
_CANDIDATES = " UNION ALL ".join(f"SELECT query_id, {k} AS place, '{cause}' AS cause, CAST({sure} AS DOUBLE) AS confidence FROM fg WHERE {when}" for k, (cause, when, sure) in enumerate(quality.CAUSES))


@query("diagnosis", f"""WITH fg AS (SELECT * FROM {FIGURES.sql}), c AS ({_CANDIDATES}), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, place) k FROM c) WHERE k = 1),
 m AS (SELECT fg.query_id, coalesce(b.cause, CASE WHEN quality <= 0.05 AND hits > 0 THEN 'zero' ELSE 'off_topic' END) AS cause, coalesce(b.confidence, CASE WHEN quality <= 0.05 AND hits > 0 THEN 0.35 ELSE 0.3 END) AS confidence FROM fg LEFT JOIN b USING (query_id))
 SELECT query_id, cause, round(confidence, 6) AS confidence, coalesce((SELECT string_agg(c.cause, ',' ORDER BY place) FROM c WHERE c.query_id = m.query_id AND c.confidence >= greatest(0.65, m.confidence - 0.25) AND c.cause <> m.cause), '') AS others, confidence >= 0.9 AND cause IN ('wrong_type', 'wrong_route') AS skip_reflect FROM m""")
def diagnosis(spark, d):
    return quality.diagnosed(FIGURES.df(spark)).withColumn("confidence", F.round("confidence", 6))


_NORM = "regexp_replace(translate(lower(coalesce({}, '')), '×∼－', 'x~-'), '\\s+', '', 'g')"
#: Benchmark items as gold texts, their heads as answers (every fourth has none), and what was retrieved for them.
_EVAL = f"{HITS}, gold AS (SELECT item_id AS question_id, text FROM benchmark), answers AS (SELECT item_id AS question_id, CASE WHEN item_id % 4 > 0 THEN left(text, CAST(12 + item_id % 30 AS INTEGER)) ELSE '' END AS text FROM benchmark), found AS (SELECT query_id AS question_id, pos AS rank, content AS text FROM hits), hay AS (SELECT question_id, {_NORM.format(chr(34) + 'all' + chr(34))} h FROM (SELECT question_id, string_agg(text, ' ' ORDER BY rank) AS \"all\" FROM found GROUP BY question_id))"


def _evaluated(spark, d, judged=None):
    """(gold, answers, found), of hits that are at hand or searched for now"""
    items = benchmark_queries(spark, d).withColumnRenamed("query_id", "question_id")
    head = F.when(F.col("question_id") % 4 > 0, F.substring("q", F.lit(1), (F.col("question_id") % 30 + 12).cast("int"))).otherwise("")
    judged = hits(spark, d) if judged is None else judged
    found = judged.select(F.col("query_id").alias("question_id"), F.col("pos").alias("rank"), F.col("content").alias("text"))
    return items.select("question_id", F.col("q").alias("text")), items.select("question_id", head.alias("text")), found


_GOLD_SQL = f"SELECT question_id, avg(CASE WHEN length(g) <= 20 THEN contains(h, g) ELSE len(list_filter(range(1, length(g) - 18, 10), lambda i: contains(h, substr(g, i, 20)))) > 0 END::INTEGER)::DOUBLE AS recall FROM (SELECT question_id, g, coalesce(h, '') h FROM (SELECT question_id, {_NORM.format('text')} g FROM gold) LEFT JOIN hay USING (question_id) WHERE g <> '') GROUP BY question_id"


@query("gold_recall", f"WITH {_EVAL} {_GOLD_SQL}")
def gold_recall(spark, d):
    gold, _, found = _evaluated(spark, d)
    return evaluation.gold_recall(gold, found)


_EXACT_SQL = f"SELECT question_id, CASE WHEN a <> '' THEN contains(coalesce(h, ''), CASE WHEN length(a) <= 30 THEN a ELSE substr(a, 1, 20) END)::INTEGER::DOUBLE END AS hit FROM (SELECT question_id, {_NORM.format('text')} a FROM answers) LEFT JOIN hay USING (question_id)"


@query("exact_hit", f"WITH {_EVAL} {_EXACT_SQL}")
def exact_hit(spark, d):
    _, answers, found = _evaluated(spark, d)
    return evaluation.exact_hits(answers, found)


#: A hit is relevant if it has the item's first twenty characters; kinds are those of the best hit.
_RANKED = "(SELECT query_id AS question_id, first_value(type) OVER (PARTITION BY query_id ORDER BY pos) AS kind, pos AS rank, contains(content, left(q, 20)) AS relevant FROM hits JOIN bench USING (query_id))"


@query("recall_at_k", f"WITH {HITS} SELECT kind, avg(coalesce(f <= 1, false)::INTEGER)::DOUBLE AS recall_1, avg(coalesce(f <= 3, false)::INTEGER)::DOUBLE AS recall_3, avg(coalesce(f <= 5, false)::INTEGER)::DOUBLE AS recall_5, count(*) AS n FROM (SELECT kind, question_id, min(CASE WHEN relevant THEN rank END) f FROM {_RANKED} GROUP BY ALL) GROUP BY kind")
def recall_at_k(spark, d):
    own = hits(spark, d).join(benchmark_queries(spark, d), "query_id")
    kind = F.first("type").over(Window.partitionBy("query_id").orderBy("pos"))
    return evaluation.recall_at(own.select(F.col("query_id").alias("question_id"), kind.alias("kind"), F.col("pos").alias("rank"), F.contains("content", F.left("q", F.lit(20))).alias("relevant")), [1, 3, 5])


#: Runs by the route of their best hit: those that found no answer failed, and a run takes a quarter of a second for each hit.
_RESULTS = f"(SELECT question_id AS id, eval_kind, CASE WHEN hit = 0 THEN 'not found' END AS error, recall, hit AS exact, n / 4.0::DOUBLE AS latency FROM (SELECT query_id AS question_id, arg_min(route, pos) AS eval_kind, count(*) AS n FROM hits GROUP BY query_id) JOIN ({{recall}}) USING (question_id) JOIN ({{exact}}) USING (question_id))"


@query("eval_rollup", f"WITH {_EVAL} SELECT CASE WHEN grouping(eval_kind) = 1 THEN 'ALL' ELSE eval_kind END AS eval_kind, count(*) AS n, count(*) FILTER (WHERE error IS NULL) AS success, round(avg(recall), 4) AS recall, round(avg(exact), 4) AS exact, round(avg(latency) FILTER (WHERE error IS NULL), 3) AS latency FROM {_RESULTS.format(recall=_GOLD_SQL, exact=_EXACT_SQL)} GROUP BY ROLLUP (eval_kind)")
def eval_rollup(spark, d):
    judged = stored(hits(spark, d), "judged-hits")
    gold, answers, found = _evaluated(spark, d, judged)
    runs = judged.groupBy(F.col("query_id").alias("question_id")).agg(F.min_by("route", "pos").alias("eval_kind"), (F.count("*") / 4.0).alias("latency"))
    own = runs.join(evaluation.gold_recall(gold, found), "question_id").join(evaluation.exact_hits(answers, found), "question_id")
    return evaluation.report(own.select("eval_kind", F.when(F.col("hit") == 0, "not found").alias("error"), "recall", F.col("hit").alias("exact"), "latency"))


ASKS = Fixture("query_id int, question string", (1, "What rusts?"), (2, "Nothing?"))
SHOWN = Fixture("query_id int, rank int, type string, sources array<string>, rrf double, score double, doc_id string, page int, chunk_id string, year int, section string, content string", (1, 2, "text", ["vec", "bm25"], 0.0327, 0.5, "d1", 3, "text_0001", 2011, "Intro", "Iron rusts."), (1, 1, "image", [], 0.0, 0.0, "d2", 0, "image_0002", 0, "", "Fig. 1"))
_HEAD = "concat_ws(' | ', '## [' || rank || '] ' || upper(type), 'source=' || coalesce(nullif(array_to_string(sources, '+'), ''), '?'), coalesce(nullif(concat_ws(', ', CASE WHEN rrf <> 0 THEN printf('rrf=%.4f', rrf) END, CASE WHEN score <> 0 THEN printf('raw=%.3f', score) END), ''), 'n/a'), 'doc=' || doc_id, 'page=' || page, 'chunk_id=' || chunk_id, CASE WHEN year <> 0 THEN 'year=' || year END)"


@query("simple_context", f"SELECT query_id, CASE WHEN n IS NULL THEN '[No relevant context retrieved]' ELSE concat_ws(chr(10) || chr(10) || '---' || chr(10) || chr(10), '# Query' || chr(10) || question, '# Retrieved Context (' || n || ' chunks)', t) END AS context FROM {ASKS.sql} LEFT JOIN (SELECT query_id, count(*) n, string_agg(concat_ws(chr(10), {_HEAD}, CASE WHEN section <> '' THEN '**Section:** ' || section END, chr(10) || content), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) t FROM {SHOWN.sql} GROUP BY query_id) USING (query_id)")
def simple_context(spark, d):
    return context.rendered(ASKS.df(spark), SHOWN.df(spark))


@query("doc_summary", f"WITH {C} SELECT doc_id, trim(arg_min(content, (CASE WHEN type = 'summary' THEN 0 ELSE 1000000 END) + paragraph_index) FILTER (WHERE type IN ('summary', 'text'))) AS summary, trim(arg_min(content, paragraph_index) FILTER (WHERE type = 'title')) AS title FROM chunks WHERE type IN ('summary', 'text', 'title') GROUP BY doc_id")
def doc_summary(spark, d):
    return context.summaries(chunks(spark, d))


EARLIER = Fixture("session_id int, pos int, doc_id string", (1, 1, "d1"), (1, 2, "d2"), (1, 3, "d1"), (2, 1, "d5"), (2, 2, "d6"), (3, 1, "d1"))
WANTED = Fixture("session_id int, doc_id string", (1, "d1"), (1, "d1"), (2, "d9"))


@query("context_reuse", f"SELECT session_id, pos, doc_id FROM (SELECT *, max(hit) OVER (PARTITION BY session_id) best FROM (SELECT *, ((session_id, doc_id) IN (SELECT (session_id, doc_id) FROM {WANTED.sql}))::INTEGER hit FROM {EARLIER.sql})) WHERE hit = 1 OR best = 0")
def context_reuse(spark, d):
    return context.kept_context(EARLIER.df(spark), WANTED.df(spark)).select("session_id", "pos", "doc_id")


CITED = Fixture("answer_id int, answer string", (1, "Rust [text_00ab, image_1234] and [text_00ab]; see [table_ffff]."), (2, "Nothing [1] cited"), (3, "Twice [text_0001][text_0002][text_0001]"))


@query("citation_numbers", f"SELECT answer_id, unnest(u) AS chunk_id, CAST(unnest(range(1, len(u) + 1)) AS INTEGER) AS number FROM (SELECT answer_id, list_filter(a, lambda x, i: list_position(a, x) = i) u FROM (SELECT answer_id, flatten(list_transform(regexp_extract_all(answer, '\\[[^\\[\\]]*\\]'), lambda m: regexp_extract_all(m, '[a-z]+_[0-9a-f]{{4,}}'))) a FROM {CITED.sql}))")
def citation_numbers(spark, d):
    return context.citations(CITED.df(spark))


QUESTIONS = Fixture(
    "id int, q string",
    (1, "Show page 12 and 第十二页, p. 3, page 12"), (2, "第 二十 页 第3段 paragraph 7, since 2015"), (3, "work from 2010-2014 on 'weathering steel' and \"Q450\""), (4, "the past 5 years"), (5, "最近三年 的 进展"),
    (6, "before 1999"), (7, "in 2003 only"), (8, "Compare Figure 3 with Table II and fig. iv"), (9, "nothing"),
)
#: All turns of conversations as questions, and some that have what is rare there.
_TURNS = f"(SELECT conv_id * 1000 + turn AS id, text AS q FROM conversations UNION ALL SELECT id, q FROM {QUESTIONS.sql})"


def turns(spark, d):
    own = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("q"))
    return own.unionByName(QUESTIONS.df(spark).select("id", "q"))


_CN = "(CASE WHEN regexp_matches({0}, '^[0-9]+$') THEN TRY_CAST({0} AS BIGINT) WHEN contains({0}, '十') THEN (CASE WHEN {0} LIKE '十%' THEN 1 ELSE strpos('一二三四五六七八九', split_part({0}, '十', 1)) END) * 10 + (CASE WHEN {0} LIKE '%十' THEN 0 ELSE strpos('一二三四五六七八九', split_part({0}, '十', 2)) END) WHEN {0} = '' THEN 0 ELSE strpos('一二三四五六七八九', {0}) END)"


def _refs_sql(pattern: str) -> str:
    tokens = f"list_transform(regexp_extract_all(q, '{pattern}'), lambda m: regexp_extract(m, '{questions.NUMBER}', 0))"
    return f"array_to_string(list_filter(n, lambda x, i: x >= 1 AND list_position(n, x) = i), ',') FROM (SELECT id, list_transform({tokens}, lambda t: {_CN.format('t')}) n FROM {_TURNS})"


@query("page_refs", f"SELECT id, {_refs_sql(questions.PAGE).replace(' FROM (', ' AS pages FROM (', 1)}")
def page_refs(spark, d):
    return turns(spark, d).select("id", F.array_join(questions.references(F.col("q"), questions.PAGE), ",").alias("pages"))


@query("paragraph_refs", f"SELECT id, {_refs_sql(questions.PARAGRAPH).replace(' FROM (', ' AS paragraphs FROM (', 1)}")
def paragraph_refs(spark, d):
    return turns(spark, d).select("id", F.array_join(questions.references(F.col("q"), questions.PARAGRAPH), ",").alias("paragraphs"))


@query("quoted_names", f"SELECT id, array_to_string(list_transform(regexp_extract_all(q, '{questions.QUOTED_NAME.replace(chr(39), chr(39) * 2)}', 1), lambda x: trim(x)), ',') AS names FROM {_TURNS}")
def quoted_names(spark, d):
    return turns(spark, d).select("id", F.array_join(questions.quoted_names(F.col("q")), ",").alias("names"))


_N = _CN.format(f"regexp_extract(regexp_extract(q, '{questions.RECENT_YEARS}', 0), '{questions.NUMBER}', 0)")


@query("time_hint", f"SELECT id, coalesce(nullif(regexp_extract(q, '{questions.YEAR_RANGE}', 1), '') || '-' || regexp_extract(q, '{questions.YEAR_RANGE}', 2), nullif(regexp_extract(q, '{questions.SINCE_YEAR}', 1), '') || '-2024', '1900-' || nullif(regexp_extract(q, '{questions.BEFORE_YEAR}', 1), ''), CASE WHEN {_N} > 0 THEN (2024 - {_N}) || '-2024' END, nullif(regexp_extract(q, '{questions.ONE_YEAR}', 1), ''), '') AS years FROM {_TURNS}")
def time_hint(spark, d):
    return turns(spark, d).select("id", questions.years(F.col("q"), 2024).alias("years"))


def _once(x: str) -> str:
    return f"list_filter({x}, lambda w, i: list_position({x}, w) = i)"


_WORDS = "list_concat(list_transform(regexp_extract_all(q, '[A-Za-z][A-Za-z\\-]{2,}'), lambda w: lower(w)), regexp_extract_all(q, '[一-鿿]{2,}'))"
_STOP = ", ".join(f"'{w}'" for w in words.STOP_WORDS)
_LABEL = "list_sort(list_distinct(list_transform(regexp_extract_all(q, '{}', 1), lambda w: upper(w))))"


@query("parse_query", f"SELECT id, {_once('k')} AS keywords, {_LABEL.format(words.FIGURE_LABEL)} AS figures, {_LABEL.format(words.TABLE_LABEL)} AS tables FROM (SELECT id, q, list_filter({_WORDS}, lambda w: w NOT IN ({_STOP})) k FROM {_TURNS})")
def parse_query(spark, d):
    q = F.col("q")
    return turns(spark, d).select("id", text.keywords(q).alias("keywords"), text.figure_labels(q).alias("figures"), text.table_labels(q).alias("tables"))


@query("sentence_count", f"WITH {C} SELECT pk, CAST(len(list_filter(regexp_split_to_array(content, '[。！？!?；;\\n]+'), lambda s: trim(s) <> '')) AS BIGINT) AS sentences FROM chunks")
def sentence_count(spark, d):
    return chunks(spark, d).select("pk", questions.sentence_count(F.col("content")).alias("sentences"))


OUTPUT = Fixture("id int, out string", (1, "<think>a</think> answer"), (2, "cut off</think>rest"), (3, "kept <think>never closed"), (4, "<redacted_thinking x=1>b</think>one<THINK>c</think >two"), (5, "plain"))


@query("strip_thinking", f"SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(out, '(?is)<(?:redacted_thinking|think)\\b[^>]*>.*?</think\\s*>', '', 'g'), '(?is)^.*?</think\\s*>', ''), '(?is)<(?:redacted_thinking|think)\\b[^>]*>.*$', '')) AS answer FROM (SELECT conv_id * 1000 + turn AS id, text AS out FROM conversations UNION ALL SELECT id, out FROM {OUTPUT.sql})")
def strip_thinking(spark, d):
    own = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("out"))
    return own.unionByName(OUTPUT.df(spark)).select("id", questions.without_thinking(F.col("out")).alias("answer"))


@query("fixed_windows", f"WITH {C} SELECT pk, i AS start, substr(content, i, 120) AS piece FROM (SELECT pk, content, unnest(range(1, length(content) + 1, 80)) i FROM chunks WHERE type = 'text')")
def fixed_windows(spark, d):
    own = chunks(spark, d).where("type = 'text'").select("pk", F.posexplode(questions.windows(F.col("content"), 100, 120, 20)).alias("at", "piece"))
    return own.select("pk", (F.col("at").cast("long") * 80 + 1).alias("start"), "piece")


@query("split_long", f"WITH {C} SELECT pk || '_p' || lpad(CAST((i - 1) // 400 + 1 AS VARCHAR), 3, '0') AS pk, CAST((i - 1) // 400 + 1 AS INTEGER) AS chunk_index, CAST((length(content) + 399) // 400 AS INTEGER) AS chunk_total FROM (SELECT pk, content, unnest(range(1, length(content) + 1, 400)) i FROM chunks WHERE type = 'text' AND length(content) > 500)")
def split_long(spark, d):
    own = chunks(spark, d).where("type = 'text' AND length(content) > 500").withColumn("pieces", questions.windows(F.col("content"), 400, 500, 0))
    rows = own.select("pk", F.size("pieces").alias("chunk_total"), F.posexplode("pieces").alias("at", "piece"))
    return rows.select(F.format_string("%s_p%03d", "pk", F.col("at") + 1).alias("pk"), (F.col("at") + 1).alias("chunk_index"), "chunk_total")


@query("embedding_cosine", "WITH a AS (SELECT embedding::DOUBLE[] e FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], e), 5) AS cosine FROM embeddings, a")
def embedding_cosine(spark, d):
    own = spark.read.parquet(f"{d}/embeddings.parquet")
    anchor = own.agg(F.min_by("embedding", "vec_id").alias("e"))  # one row
    return own.crossJoin(F.broadcast(anchor)).select("vec_id", F.round(questions.cosine(F.col("embedding"), F.col("e")), 5).alias("cosine"))
