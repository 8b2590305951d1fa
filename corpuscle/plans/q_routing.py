"""Queries that turn questions into searches, check them, and follow a run from state to state."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import questions as qs
from corpuscle.functions.words import FIGURE_LABEL, TABLE_LABEL
from corpuscle.operators import quality, research, routing as o
from corpuscle.sources.chunks import CHUNKS_SQL as C

from .q_layout import _q
from .q_retrieval import benchmark_queries, lexical
from .q_store import chunks
from .registry import Fixture, query, table

ODD_QUESTIONS = Fixture(
    "id long, q string",
    (-1, "Compare Figure 3 with Table II on page 12"), (-2, "总结 Q450NQR1 与 09CuPCrNi 的腐蚀；以及 SPA-H 的强度"), (-3, "这篇的参考文献有哪些"), (-4, "该论文 第 3 段 说了什么"), (-5, "fig. 2 and fig 2, 16Mn"), (-6, "第2篇和第十篇分别讲什么"), (-7, "它们的结论"),
    (-8, "refs of that paper, since 2015"), (-9, ""), (-10, "how many papers; list all; overview"), (-11, "page 3 of 'the rust paper'"), (-12, "上面那篇 的 内容"), (-13, "rust、salt、rain"), (-14, "Table 2 以及 Table 3 summarize"),
)
ASKS = f"asks AS (SELECT conv_id * 1000 + turn AS id, text AS q FROM conversations UNION ALL SELECT id, q FROM {ODD_QUESTIONS.sql})"


def asks(spark, d) -> DataFrame:
    """All turns of the conversations, and a few that ask for figures, pages and documents."""
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("q"))
    return turns.unionByName(ODD_QUESTIONS.df(spark))


@query("grade_names", f"WITH {ASKS} SELECT id, array_to_string(list_sort(list_distinct(regexp_extract_all(q, {_q(qs.GRADE)}, 0))), ',') AS grades FROM asks")
def grade_names(spark, d):
    return asks(spark, d).select("id", F.array_join(qs.grades(F.col("q")), ",").alias("grades"))


@query("document_scopes", f"WITH {ASKS} SELECT id, regexp_matches(q, {_q(qs.BATCH_SCOPE)}) AS batch, regexp_matches(q, {_q(qs.EXPLICIT_SCOPE)}) AS explicit, len(regexp_extract_all(q, {_q(qs.ORDINAL)}, 0)) AS ordinals FROM asks")
def document_scopes(spark, d):
    q = F.col("q")
    return asks(spark, d).select("id", q.rlike(qs.BATCH_SCOPE).alias("batch"), q.rlike(qs.EXPLICIT_SCOPE).alias("explicit"), F.size(qs.references(q, qs.ORDINAL)).cast("long").alias("ordinals"))


_KINDS = " + ".join(f"CAST(regexp_matches(q, {_q(p)}) AS INTEGER)" for p in qs.INTENTS)


@query("compound_intents", f"WITH {ASKS} SELECT id, CAST(CASE WHEN trim(coalesce(q, '')) = '' THEN 0 WHEN k >= 2 THEN k WHEN k >= 1 AND c >= 1 THEN k + c WHEN c >= 2 THEN c ELSE 0 END AS INTEGER) AS n FROM (SELECT id, q, {_KINDS} AS k, greatest(len(list_filter(regexp_split_to_array(q, {_q(qs.CLAUSE)}), lambda p: trim(p) <> '')) - 1, 0) AS c FROM asks)")
def compound_intents(spark, d):
    return asks(spark, d).select("id", qs.intents(F.col("q")).cast("int").alias("n"))


_FRAMING = ", ".join(_q(w) for w in qs.FRAMING)


@query("content_keywords", f"WITH {ASKS} SELECT id, array_to_string(list_filter(w, lambda x, i: list_position(list_transform(w, lambda y: lower(y)), lower(x)) = i), ' ') AS keywords FROM (SELECT id, list_filter(string_split(q, ' '), lambda x: x <> '' AND x NOT IN ({_FRAMING})) w FROM asks)")
def content_keywords(spark, d):
    return asks(spark, d).select("id", F.array_join(qs.content_keywords(F.split("q", " ")), " ").alias("keywords"))


@query("instructed_questions", f"WITH {ASKS} SELECT id, CASE WHEN trim(q) = '' OR id % 3 = 0 THEN trim(q) ELSE 'Instruct: ' || CASE WHEN id % 3 = 1 THEN {_q(qs.INSTRUCTIONS['summary'])} ELSE {_q(qs.INSTRUCTIONS['passage'])} END || chr(10) || 'Query:' || trim(q) END AS asked FROM asks")
def instructed_questions(spark, d):
    stage = F.when(F.col("id") % 3 == 1, "summary").when(F.col("id") % 3 != 0, "unknown").otherwise("")
    return asks(spark, d).select("id", qs.instructed(F.col("q"), stage).alias("asked"))


_HAS = {"fig": FIGURE_LABEL, "tab": TABLE_LABEL, "listed": qs.REFERENCES_HINT, "doc": qs.DOCUMENT_REF, "loose": qs.LOOSE_DOCUMENT_REF, "page": qs.PAGE, "para": qs.PARAGRAPH, "name": qs.QUOTED_NAME, "sum": qs.SUMMARY_HINT}


@query("heuristic_routes", f"""WITH {ASKS}, h AS (SELECT id, {', '.join(f'regexp_matches(q, {_q(p)}) AS h_{n}' for n, p in _HAS.items())} FROM asks), f AS (SELECT *, h_fig AND NOT h_listed AS fig, h_tab AND NOT h_listed AS tab FROM h)
 SELECT id, CASE WHEN h_sum THEN 'summary' WHEN h_doc OR (h_listed AND h_loose) THEN 'local' ELSE 'progressive' END || CASE WHEN fig OR tab OR h_page OR h_para OR h_name THEN ',metadata' ELSE '' END AS routes, CASE WHEN h_listed THEN 'references' WHEN fig AND NOT tab THEN 'image' WHEN tab AND NOT fig THEN 'table' END AS chunk_type FROM f""")
def heuristic_routes(spark, d):
    return o.decided(asks(spark, d), 2024).select("id", F.array_join("routes", ",").alias("routes"), "chunk_type")


@query("decision_checks", f"""WITH {ASKS}, h AS (SELECT id, {', '.join(f'regexp_matches(q, {_q(p)}) AS h_{n}' for n, p in _HAS.items())} FROM asks), f AS (SELECT *, h_fig AND NOT h_listed AS fig, h_tab AND NOT h_listed AS tab FROM h)
 SELECT id, CASE WHEN id % 2 = 0 THEN CASE WHEN h_page OR h_para OR h_name OR fig OR tab THEN 'metadata' ELSE 'progressive' END ELSE CASE WHEN h_page OR h_para OR h_name OR fig OR tab THEN 'summary,metadata' ELSE 'summary' END END AS routes, CASE WHEN h_listed THEN 'references' WHEN fig AND NOT tab THEN 'image' WHEN tab AND NOT fig THEN 'table' END AS chunk_type FROM f""")
def decision_checks(spark, d):
    raw = o.decided(asks(spark, d), 2024).withColumn("routes", F.when(F.col("id") % 2 == 0, F.array(F.lit("metadata"))).otherwise(F.array(F.lit("summary")))).withColumn("chunk_type", F.lit("unheard of"))
    return o.checked(raw).select("id", F.array_join("routes", ",").alias("routes"), "chunk_type")


ARGS = [
    {"paths": [{"t": "progressive", "kw": ["文献", "rust", "Rust", "salt"]}, {"t": "metadata", "figs": ["3"]}], "time": " 2010-2014 "}, {"paths": [{"t": "metadata", "figs": ["1"]}, {"t": "metadata", "tabs": ["2"]}]}, {"paths": [{"t": "local", "kw": ["x"], "docs": ["A"], "refs": [2], "ctype": "References"}, {"t": "metadata", "pages": [3], "ents": ["Q450"]}]},
    {"paths": [{"t": "summary", "kw": ["all"]}]}, {"paths": []}, {"paths": [{"t": "progressive", "ctype": "table"}, {"t": "metadata", "figs": ["4"]}, {"t": "local"}]},
]
PLANS = Fixture("id int, args string", *[(i, json.dumps(a, ensure_ascii=False)) for i, a in enumerate(ARGS)])


@query("plan_decisions")
def plan_decisions(spark, d):
    own = o.from_plans(PLANS.df(spark))
    return own.select("id", F.array_join("routes", ",").alias("routes"), F.array_join("rewrites", ";").alias("rewrites"), F.array_join("docs", ",").alias("docs"), "chunk_type", "time", o.to_split(F.col("paths")).alias("split"))


REGISTRY = Fixture("session_id int, pos int, doc_id string, doc_name string, pinned boolean", (1, 1, "a", "Alpha", False), (1, 2, "b", "Beta", True), (1, 3, "c", "", False), (2, 1, "d", "Delta", False), (3, 1, "e", "Eps", True), (3, 2, "f", "Phi", True), (3, 3, "g", None, False))


@query("focus_document", f"SELECT session_id, CASE WHEN p = 1 THEN one ELSE single END AS doc_id, CASE WHEN p = 1 THEN 'single-pinned' ELSE 'single-entry' END AS reason FROM (SELECT session_id, count(*) n, count(*) FILTER (WHERE pinned) p, max(doc_id) FILTER (WHERE pinned) one, max(doc_id) AS single FROM {REGISTRY.sql} GROUP BY session_id) WHERE p = 1 OR n = 1")
def focus_document(spark, d):
    return o.focus(REGISTRY.df(spark))


SCOPED = Fixture("id int, session_id int, q string", (1, 1, "第2篇 和 第 三 篇 说了什么"), (2, 1, "这几篇 的 结论"), (3, 1, "前面 说 的 内容"), (4, 3, "前面 的"), (5, 2, "第9篇"), (6, 1, "rust"), (7, 2, "上一轮 的 结果"))


@query("scope_documents", f"WITH g AS (SELECT * FROM {REGISTRY.sql}), s AS (SELECT * FROM {SCOPED.sql}) SELECT id, doc_id, CAST(pos AS BIGINT) AS pos FROM s JOIN g USING (session_id) WHERE (id = 1 AND pos IN (2, 3)) OR (id = 2) OR (id = 3 AND doc_id = 'b') OR (id = 7 AND doc_id = 'd')")
def scope_documents(spark, d):
    return o.scope(SCOPED.df(spark), REGISTRY.df(spark))


@query("registry_block", f"SELECT session_id, string_agg(pos || '. ' || coalesce(nullif(doc_name, ''), doc_id) || CASE WHEN pinned THEN ' [pinned]' ELSE '' END, chr(10) ORDER BY pos) FILTER (WHERE pos <= 2) || CASE WHEN count(*) > 2 THEN chr(10) || '... (' || count(*) || ' in all)' ELSE '' END AS block FROM {REGISTRY.sql} GROUP BY session_id")
def registry_block(spark, d):
    return o.registry_block(REGISTRY.df(spark), 2)


GUARDED = Fixture("id int, q string, routes array<string>, refs array<int>, n_docs int", (1, "how many papers are there", ["summary"], [], 3), (2, "page 3", ["metadata"], [], 3), (3, "page 3", ["metadata"], [1], 3), (4, "page 3", ["metadata"], None, 1), (5, "list all", ["progressive"], [], 0), (6, "rust", ["summary", "metadata"], [], 2))


@query("route_guards", f"SELECT id, CASE WHEN len(routes) = 1 AND routes[1] = 'metadata' AND coalesce(len(refs), 0) = 0 AND n_docs > 1 THEN 'ask-document' WHEN regexp_matches(q, {_q(o.INVENTORY)}) AND list_contains(routes, 'summary') THEN 'ask-inventory' ELSE 'search' END AS action FROM {GUARDED.sql}")
def route_guards(spark, d):
    return o.guarded(GUARDED.df(spark)).select("id", "action")


REUSES = Fixture("id int, mode string, op string, q string", (1, "drilldown", " more on rust ", "q1"), (2, "continue", "", "q2"), (3, "reformat", "as a table", "q3"), (4, "chitchat", None, "q4"), (5, "continue", None, "q5"))


@query("reuse_conversion", f"SELECT id, CASE WHEN m THEN 'local' END AS route, CASE WHEN m THEN coalesce(nullif(trim(op), ''), q) END AS rewrite, CASE WHEN m THEN 'assets,adjacent' END AS expand, NOT m AS skips_search FROM (SELECT *, mode IN ('drilldown', 'continue') m FROM {REUSES.sql})")
def reuse_conversion(spark, d):
    return o.reused(REUSES.df(spark))


RUNS = Fixture("id int, hits int, structural_hits int, failed boolean, patched boolean, retries int, most_retries int, bias string", (1, 0, 0, False, False, 0, 2, None), (2, 0, 0, False, False, 2, 2, "keyword"), (3, 0, 3, False, False, 0, 2, None), (4, 5, 0, False, False, 0, 2, None), (5, 5, 0, True, False, 0, 2, None), (6, 5, 0, True, True, 0, 2, None), (7, 0, 0, False, False, 0, 0, None), (8, 0, 0, False, False, 1, 2, "semantic"))


@query("reflect_shortcuts", f"SELECT id, v AS verdict, CASE WHEN v = 'retry' THEN 'progressive' END AS route, CASE WHEN v = 'retry' THEN coalesce(bias, 'balanced') END AS bias FROM (SELECT *, CASE WHEN most_retries <= 0 OR retries >= most_retries THEN 'no_retry' WHEN failed AND NOT patched THEN 'no_retry' WHEN hits = 0 AND structural_hits > 0 THEN 'accept' WHEN hits = 0 THEN 'retry' ELSE 'ask_model' END v FROM {RUNS.sql})")
def reflect_shortcuts(spark, d):
    return o.reflected(RUNS.df(spark))


_FLAGS = ("needs_clarify", "needs_reuse", "needs_retry", "sufficient", "has_results", "has_errors", "has_decision", "skip_reflect")
_STATES, _n = [], 0
for _phase in ("start", "router", "retrieve", "reranker", "reflect", "rewrite", "context_build", "", "odd"):
    for _bits in ((), ("needs_clarify",), ("needs_reuse",), ("needs_retry",), ("needs_retry", "skip_reflect"), ("sufficient",), ("has_results",), ("has_errors",), ("has_decision",), ("has_results", "needs_retry"), ("needs_retry", "has_errors")):
        for _retries in (0, 2):
            _STATES.append((_n, _phase, *(f in _bits for f in _FLAGS), _retries, 2))
            _n += 1
STATES = Fixture("id int, phase string, " + ", ".join(f"{f} boolean" for f in _FLAGS) + ", retries int, most_retries int", *_STATES)


@query("policy_actions", f"""SELECT id, CASE WHEN NOT has_results AND has_errors AND NOT needs_clarify AND NOT needs_reuse AND phase IN ('retrieve', 'reranker', 'reflect') AND retries < most_retries THEN 'rewrite'
 WHEN phase IN ('clarify', 'reuse', 'context_build') THEN 'stop' WHEN needs_clarify THEN 'clarify' WHEN needs_reuse THEN 'reuse' WHEN phase IN ('start', 'policy') THEN 'router' WHEN phase = 'router' THEN 'retrieve' WHEN phase = 'retrieve' THEN if(has_results, 'reranker', 'reflect')
 WHEN phase = 'reranker' THEN CASE WHEN NOT needs_retry THEN 'context_build' WHEN skip_reflect AND retries < most_retries THEN 'rewrite' WHEN retries >= most_retries THEN 'answer' ELSE 'reflect' END
 WHEN phase = 'reflect' THEN CASE WHEN sufficient THEN 'context_build' WHEN needs_retry AND retries < most_retries THEN 'rewrite' ELSE 'answer' END WHEN phase = 'rewrite' THEN 'retrieve' WHEN phase = '' AND has_decision AND NOT has_results AND NOT has_errors THEN 'retrieve' ELSE 'router' END AS action FROM {STATES.sql}""")
def policy_actions(spark, d):
    return o.next_action(STATES.df(spark))


SUB_HITS = Fixture("query_id int, sub string, pk string, q string", (1, "sub1", "a", " rust "), (1, "sub2", "b", " rust "), (1, "sub2", "a", " rust "), (1, "", "c", " rust "), (2, "", "d", "salt"))
SUBS = Fixture("query_id int, sub string, rewrite string", (1, "sub1", "rust layer"), (1, "sub2", " "))


@query("rerank_groups", f"SELECT query_id, coalesce(nullif(trim(rewrite), ''), trim(q)) AS asked, count(*)::BIGINT AS n, list_sort(list(DISTINCT pk)) AS pks FROM {SUB_HITS.sql} LEFT JOIN {SUBS.sql} USING (query_id, sub) GROUP BY ALL")
def rerank_groups(spark, d):
    return o.rerank_groups(SUB_HITS.df(spark), SUBS.df(spark))


HINTED = Fixture(
    "id int, q string, routes array<string>, figures array<string>, tables array<string>, pages array<int>, paragraphs array<int>, names array<string>, rewrite string, rerank_mode boolean",
    (1, " what is it ", ["metadata"], ["3", "4"], [], [2], [], ["Q450"], "", None), (2, "q", ["progressive", "metadata"], ["3"], [], [], [], [], "kw", True), (3, "q", ["progressive"], [], [], [], [], [], "kw", False), (4, "", ["progressive"], [], [], [], [], [], "kw", None), (5, "q", ["metadata"], [], [], [], [], [], "", None),
)


@query("rerank_questions", f"SELECT id, CASE WHEN trim(q) = '' THEN trim(rewrite) WHEN len(routes) = 1 AND routes[1] = 'metadata' AND h <> '' THEN trim(q) || ' (' || h || ')' WHEN coalesce(rerank_mode, false) AND trim(rewrite) <> '' THEN trim(rewrite) ELSE trim(q) END AS asked FROM (SELECT *, concat_ws('; ', 'figure ' || nullif(array_to_string(figures, ' '), ''), 'table ' || nullif(array_to_string(tables, ' '), ''), 'page ' || nullif(array_to_string(pages, ' '), ''), 'paragraph ' || nullif(array_to_string(paragraphs, ' '), ''), 'entity ' || nullif(array_to_string(names, ' '), '')) h FROM {HINTED.sql})")
def rerank_questions(spark, d):
    return o.rerank_question(HINTED.df(spark))


#: Lines of the corpus as the hits of searches, a search for each language, with scores by rule.
HITS = f"{C}, hits AS (SELECT lang AS query_id, CASE WHEN paragraph_index % 2 = 0 THEN 'local' ELSE 'progressive' END AS route, pk, type, doc_name, doc_id, page_start, (length(content) % 97) / 100.0::DOUBLE AS score, CASE WHEN paragraph_index % 3 = 0 THEN (length(content) % 89) / 100.0::DOUBLE END AS rerank_score, content, paragraph_index FROM chunks)"


def hits(spark, d) -> DataFrame:
    n, p = F.length("content"), F.col("paragraph_index")
    return chunks(spark, d).select(F.col("lang").alias("query_id"), F.when(p % 2 == 0, "local").otherwise("progressive").alias("route"), "pk", "type", "doc_name", "doc_id", "page_start", (n % 97 / 100).alias("score"), F.when(p % 3 == 0, n % 89 / 100).alias("rerank_score"), "content", "paragraph_index")


@query("emb_safety_net", f"WITH {HITS} SELECT query_id, CAST(round(avg(CAST(score AS DECIMAL(20, 6))), 6) AS DOUBLE) AS quality, avg(CAST(score AS DECIMAL(20, 6))) < 0.9 AS retry FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pk) k FROM hits WHERE score > 0) WHERE k <= 40 GROUP BY query_id")
def emb_safety_net(spark, d):
    return o.safety_net(hits(spark, d), 40, 0.9)


_SNIP = "CASE WHEN length(content) > 200 THEN substr(content, 1, 150) || ' … ' || right(content, 50) ELSE content END"


@query("reflect_summaries", f"""WITH {HITS}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id, route ORDER BY coalesce(rerank_score, score) DESC, pk) k FROM hits),
 t AS (SELECT query_id, route, sum(n) n, string_agg(type || '=' || n, ', ' ORDER BY type || '=' || n) types FROM (SELECT query_id, route, type, count(*) n FROM k GROUP BY ALL) GROUP BY ALL),
 l AS (SELECT query_id, route, string_agg('  [' || type || '] doc=' || doc_name || ' page=' || (page_start + 1) || CASE WHEN score = 0 AND rerank_score IS NULL THEN '' ELSE ' ' || concat_ws(' ', CASE WHEN score <> 0 THEN printf('emb=%.3f', score) END, CASE WHEN rerank_score IS NOT NULL THEN printf('rerank=%.3f', rerank_score) END) END || ': ' || {_SNIP}, chr(10) ORDER BY k) lines FROM k WHERE k <= 6 GROUP BY ALL),
 b AS (SELECT query_id, route, n, '[' || route || ']' || chr(10) || '  ' || n || ' hits (' || types || ')' || chr(10) || lines AS b FROM t JOIN l USING (query_id, route))
 SELECT query_id, string_agg(CASE WHEN length(b) > 2400 THEN substr(b, 1, 2399) || '…' ELSE b END, chr(10) || chr(10) ORDER BY route) AS summary, sum(n)::BIGINT AS n FROM b GROUP BY query_id""")
def reflect_summaries(spark, d):
    return o.reflect_summary(hits(spark, d))


ROUNDS = f"{HITS}, rounds AS (SELECT query_id AS run_id, 1 + paragraph_index % 4 AS round, pk, doc_id, score FROM hits UNION ALL SELECT query_id, 1 + (paragraph_index + 1) % 4, pk, doc_id, score FROM hits WHERE length(content) % 2 = 0)"


def rounds(spark, d) -> DataFrame:
    own = hits(spark, d).withColumnRenamed("query_id", "run_id")
    first = own.withColumn("round", F.col("paragraph_index") % 4 + 1)
    again = own.where(F.length("content") % 2 == 0).withColumn("round", (F.col("paragraph_index") + 1) % 4 + 1)
    return first.unionByName(again).select("run_id", "round", "pk", "doc_id", "score")


@query("evidence_rounds", f"""WITH {ROUNDS}, f AS (SELECT run_id, pk, min(round) r FROM rounds GROUP BY ALL), g AS (SELECT run_id, f.r AS round, count(*) added, count(*) FILTER (WHERE s >= 0.5) q FROM (SELECT run_id, pk, round, max(score) s FROM rounds GROUP BY ALL) x JOIN f USING (run_id, pk) WHERE x.round = f.r GROUP BY ALL),
 dd AS (SELECT run_id, r AS round, count(*) n FROM (SELECT run_id, doc_id, min(round) r FROM rounds GROUP BY ALL) GROUP BY ALL) SELECT run_id, round, coalesce(added, 0)::BIGINT AS added, coalesce(q, 0)::BIGINT AS quality_added, CAST(sum(coalesce(n, 0)) OVER (PARTITION BY run_id ORDER BY round) AS BIGINT) AS docs FROM (SELECT DISTINCT run_id, round FROM rounds) LEFT JOIN g USING (run_id, round) LEFT JOIN dd USING (run_id, round)""")
def evidence_rounds(spark, d):
    return o.new_evidence(rounds(spark, d), 0.5)


RESEARCH = Fixture(
    "run_id int, round int, quality_added int, docs int, gaps string, repeated boolean",
    (1, 1, 2, 2, "a", False), (1, 2, 0, 2, "b", False), (1, 3, 0, 2, "c", False), (2, 1, 4, 4, "a", False), (2, 2, 0, 4, "a", False), (2, 3, 0, 4, "a", False), (3, 1, 0, 0, "", False), (3, 2, 0, 0, "", False), (4, 1, 1, 1, "x", False), (4, 2, 1, 2, "y", False), (4, 3, 1, 3, "z", False), (4, 4, 1, 4, "w", False),
    (5, 1, 3, 5, "g", False), (5, 2, 1, 6, "g", False), (5, 3, 1, 7, "g", False), (6, 1, 3, 3, "g", True),
)


@query("research_stops", f"""WITH r AS (SELECT *, max(CASE WHEN quality_added > 0 THEN round END) OVER w good, coalesce(gaps <> '' AND lag(gaps) OVER w = gaps, false) same FROM {RESEARCH.sql} WINDOW w AS (PARTITION BY run_id ORDER BY round)),
 s AS (SELECT *, round - coalesce(good, 0) stall, round - max(CASE WHEN NOT same THEN round END) OVER (PARTITION BY run_id ORDER BY round) gap FROM r)
 SELECT run_id, round, CAST(stall AS BIGINT) AS stall, CASE WHEN docs = 0 AND round >= 2 THEN 'clarify' WHEN stall >= 2 THEN if(docs >= 3, 'finish', 'clarify') WHEN round >= 4 THEN if(docs = 0, 'clarify', 'finish') WHEN repeated THEN 'finish' WHEN gap >= 2 AND docs >= 3 THEN 'finish' ELSE 'continue' END AS verdict FROM s""")
def research_stops(spark, d):
    return o.stops(RESEARCH.df(spark), 4)


@query("research_loop")
def research_loop(spark, d):
    """All benchmark items as runs over all chunks, until each has ended."""
    return research.research(benchmark_queries(spark, d), lexical(spark, d), 5, 8.0).runs


_SIGN = "array_to_string(list_sort(list_distinct(list_transform(list_filter(string_split(trim(regexp_replace(lower({0}), '[^a-z0-9一-鿿]+', ' ', 'g')), ' '), lambda w: w <> ''), lambda w: CASE WHEN length(w) > 3 AND w LIKE '%s' THEN left(w, length(w) - 1) ELSE w END))), ' ')"


@query("tried_searches", f"WITH {ASKS} SELECT DISTINCT run_id, 'progressive:' || s AS signature FROM (SELECT CAST(floor(id / 1000.0) AS BIGINT) AS run_id, {_SIGN.format('q')} s FROM asks) WHERE s <> ''")
def tried_searches(spark, d):
    own = asks(spark, d).select(F.floor(F.col("id") / 1000).alias("run_id"), F.lit("progressive").alias("route"), F.col("q").alias("rewrite"))
    return o.tried(own)


GAPS = Fixture("run_id int, gaps array<string>", (1, ["Composition_system: rare earths missing", "salts and Rains"]), (2, []), (3, ["B: x", "a: y", "b: z"]))


@query("gap_signatures", f"SELECT run_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(gaps, lambda g: {_SIGN.format('split_part(g, chr(58), 1)')}), lambda s: s <> ''))), '|') AS signature FROM {GAPS.sql}")
def gap_signatures(spark, d):
    return GAPS.df(spark).select("run_id", o.gap_signature(F.col("gaps")).alias("signature"))


@query("research_observation", f"""WITH {HITS}, k AS (SELECT query_id AS run_id, doc_id, pk, score, content, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, pk) k FROM hits),
 w AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY w DESC, doc_id) n FROM (SELECT run_id, doc_id, sum(CAST(score AS DECIMAL(20, 6))) w FROM k WHERE k <= 3 GROUP BY ALL)),
 t AS (SELECT run_id, doc_id, '## ' || doc_id || chr(10) || string_agg('- [' || pk || '] ' || CASE WHEN length(content) > 240 THEN substr(content, 1, 180) || ' … ' || right(content, 60) ELSE content END, chr(10) ORDER BY k) t FROM k WHERE k <= 3 GROUP BY run_id, doc_id)
 SELECT run_id, string_agg(t, chr(10) || chr(10) ORDER BY n) AS text FROM w JOIN t USING (run_id, doc_id) WHERE n <= 6 GROUP BY run_id""")
def research_observation(spark, d):
    return o.observation(hits(spark, d).withColumnRenamed("query_id", "run_id"))


SKILLS = Fixture("skill_id string, priority int, triggers array<string>", ("survey", 1, ["overview", "compare|对比", "the"]), ("trend", 2, ["since [0-9]{4}", "and"]), ("none", 9, ["zzzz"]))


@query("skill_triggers", f"WITH {ASKS} SELECT id, skill_id, hits, hits >= 2 AS strong FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hits DESC, priority DESC, skill_id) k FROM (SELECT id, skill_id, priority, count(*) hits FROM asks JOIN (SELECT skill_id, priority, unnest(triggers) t FROM {SKILLS.sql}) ON regexp_matches(q, '(?i)' || t) GROUP BY ALL)) WHERE k = 1")
def skill_triggers(spark, d):
    return o.skills_for(asks(spark, d), SKILLS.df(spark))


SKILL_FILES = Fixture("dir_pos int, skill_id string, body string", (1, "survey", "old"), (2, "survey", "new"), (1, "trend", "t"), (2, "", "x"), (2, "blank", " "))


@query("skill_precedence", f"SELECT dir_pos, skill_id, body FROM (SELECT *, row_number() OVER (PARTITION BY skill_id ORDER BY dir_pos DESC) k FROM {SKILL_FILES.sql} WHERE trim(coalesce(skill_id, '')) <> '' AND trim(coalesce(body, '')) <> '') WHERE k = 1")
def skill_precedence(spark, d):
    return o.loaded_skills(SKILL_FILES.df(spark))


GUARDS = Fixture("run_id string, guards array<string>, least_docs int", ("en", ["min_docs", "need_quantitative"], 100000), ("de", ["need_quantitative"], 1), ("none", ["min_docs", "need_quantitative"], 2), ("es", [], 100000))


@query("unmet_guards", f"WITH {HITS} SELECT run_id, concat_ws(',', CASE WHEN list_contains(guards, 'min_docs') AND least_docs > coalesce(docs, 0) THEN 'min_docs' END, CASE WHEN list_contains(guards, 'need_quantitative') AND NOT coalesce(m, false) THEN 'need_quantitative' END) AS missing FROM {GUARDS.sql} LEFT JOIN (SELECT query_id AS run_id, count(DISTINCT doc_id) docs, bool_or(regexp_matches(content, {_q(o.QUANTITY)})) m FROM hits GROUP BY ALL) USING (run_id)")
def unmet_guards(spark, d):
    return o.unmet(GUARDS.df(spark), hits(spark, d).withColumnRenamed("query_id", "run_id"))


GATE = {("progressive", "", "text"): 0.97, ("local", "", ""): 0.9, ("local", "", "image"): 0.2}


@query("gate_node", f"""WITH {HITS}, t AS (SELECT query_id, route, type FROM (SELECT query_id, route, type, row_number() OVER (PARTITION BY query_id, route ORDER BY count(*) DESC, min(pk)) k FROM hits GROUP BY query_id, route, type) WHERE k = 1),
 r AS (SELECT query_id, route, avg(score) q FROM (SELECT *, row_number() OVER (PARTITION BY query_id, route ORDER BY score DESC) k FROM hits) WHERE k <= 30 GROUP BY ALL),
 g AS (SELECT query_id, CASE WHEN count(*) = 1 THEN max(q) ELSE 0.7 * max(q) + 0.3 * avg(q) END AS quality, bool_or(q >= CASE WHEN route = 'progressive' AND type = 'text' THEN 0.97 WHEN route = 'local' AND type = 'image' THEN 0.2 WHEN route = 'local' THEN 0.9 ELSE 0.5 END) AS passes FROM r JOIN t USING (query_id, route) GROUP BY query_id)
 SELECT query_id, route, pk, CAST(k AS INTEGER) AS rank, round(quality, 6) AS quality, passes FROM (SELECT *, row_number() OVER (PARTITION BY query_id, route ORDER BY score DESC, pk) k FROM hits) JOIN g USING (query_id) WHERE k <= 8""")
def gate_node(spark, d):
    return quality.gated(hits(spark, d), GATE, 0.5, 30, 8).withColumn("quality", F.round("quality", 6))
