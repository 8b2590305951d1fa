"""Queries over joins, windows, budgets and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscle.operators import links, ranking
from corpuscle.operators.retrieval import bm25, bm25_sql
from corpuscle.sources.chunks import CHUNKS_SQL as C

from .q_retrieval import BQ, benchmark_queries
from .q_store import chunks
from .registry import Fixture, query, table

SEEDS_SQL = "seeds AS (SELECT CAST(doc_id AS BIGINT) % 50 AS query_id, pk, doc_id, paragraph_index, page_start, ['c' || (paragraph_index + 3), 'c' || (paragraph_index + 5)] AS related FROM chunks WHERE paragraph_index = 4)"


def seeds(spark, d):
    p = F.col("paragraph_index")
    related = F.array(*(F.concat(F.lit("c"), (p + n).cast("string")) for n in (3, 5)))
    return chunks(spark, d).where("paragraph_index = 4").select((F.col("doc_id").cast("long") % 50).alias("query_id"), "pk", "doc_id", "paragraph_index", "page_start", related.alias("related"))


_ASSETS = "SELECT DISTINCT s.query_id, c.pk FROM (SELECT *, unnest(related) cid FROM seeds) s JOIN chunks c ON c.chunk_id = s.cid AND c.doc_id = s.doc_id"
_ADJACENT = "SELECT DISTINCT s.query_id, c.pk FROM seeds s JOIN chunks c ON c.doc_id = s.doc_id AND abs(c.paragraph_index - s.paragraph_index) <= 2 AND c.paragraph_index >= 1 AND c.pk <> s.pk"
_PAGE = "SELECT DISTINCT s.query_id, c.pk FROM seeds s JOIN chunks c ON c.doc_id = s.doc_id AND c.page_start = s.page_start AND c.pk <> s.pk"


@query("expand_assets", f"WITH {C}, {SEEDS_SQL} {_ASSETS}")
def expand_assets(spark, d):
    return links.by_assets(seeds(spark, d), chunks(spark, d))


@query("expand_adjacent", f"WITH {C}, {SEEDS_SQL} {_ADJACENT}")
def expand_adjacent(spark, d):
    return links.within(seeds(spark, d), chunks(spark, d), "paragraph_index", 2, 1)


@query("expand_page", f"WITH {C}, {SEEDS_SQL} {_PAGE}")
def expand_page(spark, d):
    return links.within(seeds(spark, d), chunks(spark, d), "page_start", 0)


@query("expand_similar", f"WITH {C}, {SEEDS_SQL}, fq AS (SELECT query_id, arg_min(substr(content, 1, 500), pk) q FROM seeds JOIN chunks USING (pk) GROUP BY query_id), sc AS (SELECT * FROM chunks WHERE type = 'summary'), {bm25_sql(5, 'fq', 'sc')} SELECT query_id, pk, score FROM bm25")
def expand_similar(spark, d):
    own = chunks(spark, d)
    first = seeds(spark, d).join(own.select("pk", "content"), "pk").groupBy("query_id").agg(F.min_by(F.substring("content", 1, 500), "pk").alias("q"))
    return bm25(first, own.where("type = 'summary'"), 5).select("query_id", "pk", "score")


@query("neighbor_expand", f"""WITH {C}, {SEEDS_SQL}, u AS (SELECT 0 place, 'assets' mode, * FROM ({_ASSETS}) UNION ALL SELECT 1, 'adjacent', * FROM ({_ADJACENT}) UNION ALL SELECT 2, 'page', * FROM ({_PAGE})),
 o AS (SELECT query_id, pk, min(place) place, arg_min(mode, place) mode FROM u WHERE (query_id, pk) NOT IN (SELECT query_id, pk FROM seeds) GROUP BY query_id, pk)
 SELECT query_id, pk, mode, CAST(n AS INTEGER) n FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place, pk) n FROM o) WHERE n <= 12""")
def neighbor_expand(spark, d):
    s, own = seeds(spark, d), chunks(spark, d)
    parts = [("assets", links.by_assets(s, own)), ("adjacent", links.within(s, own, "paragraph_index", 2, 1)), ("page", links.within(s, own, "page_start", 0))]
    return links.expanded(parts, s, 12)


@query("asset_hydration", f"WITH {C}, {SEEDS_SQL} SELECT query_id, pk, CAST(n AS INTEGER) n FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pk) n FROM ({_ASSETS})) WHERE n <= 8")
def asset_hydration(spark, d):
    s = seeds(spark, d)
    return links.expanded([("assets", links.by_assets(s, chunks(spark, d)))], s, 8).select("query_id", "pk", "n")


@query("supplement_anti", f"WITH {C}, {BQ}, {bm25_sql(20, 'bench')}, k AS (SELECT query_id, pk FROM bm25 WHERE rank <= 5) SELECT query_id, pk, score, CAST(r AS INTEGER) AS rank FROM (SELECT query_id, pk, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pk) r FROM bm25 WHERE (query_id, pk) NOT IN (SELECT query_id, pk FROM k)) WHERE r <= 12")
def supplement_anti(spark, d):
    hits = bm25(benchmark_queries(spark, d), chunks(spark, d), 20)
    return links.without_known(hits, hits.where("rank <= 5").select("query_id", "pk"), 12).select("query_id", "pk", "score", "rank")


REGISTRY = Fixture("session_id int, pos int, doc_id string, doc_name string, pinned boolean", (1, 1, "d1", "Weathering Steel: A Review (2015)", False), (1, 2, "d2", "Corrosion of Q450", True), (1, 3, "d3", "Q45", False), (1, 4, "d4", "耐候钢 综述", False), (2, 1, "d2", "Corrosion of Q450", False), (2, 2, "d5", "Other", False))
NAMES = Fixture("name string", ("d3",), ("weathering steel a review 2015",), ("Corrosion of Q450 in sea air",), ("Q45",), ("综述",), ("耐候钢综述",), ("nothing at all",))
_PLAIN = r"regexp_replace(lower({}), '[ \t\r\n,，;；/\\.\-_:：()（）\[\]【】]+', '', 'g')"


#: What conversations and benchmark items say, as names, and all documents under their first two words as the registry; some of both that are rare there.
_ASKED_NAMES = f"(SELECT text AS name FROM conversations UNION SELECT text FROM benchmark UNION SELECT name FROM {NAMES.sql})"
_ALL_ENTRIES = f"(SELECT doc_id AS pos, CAST(doc_id AS VARCHAR) AS doc_id, regexp_extract(text, '[a-z]+ [a-z]+', 0) AS doc_name FROM documents UNION ALL SELECT pos - 100, doc_id, doc_name FROM {REGISTRY.sql} WHERE session_id = 1)"


@query("registry_match", f"""WITH a AS (SELECT name, {_PLAIN.format('name')} n FROM {_ASKED_NAMES}), b AS (SELECT *, {_PLAIN.format('doc_name')} r FROM {_ALL_ENTRIES}), p AS (SELECT DISTINCT n, r FROM (SELECT DISTINCT n FROM a WHERE length(n) >= 4) JOIN (SELECT DISTINCT r FROM b WHERE length(r) >= 4) ON contains(n, r) OR contains(r, n))
 SELECT name, doc_id, CAST(tier AS INTEGER) tier FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY tier, pos) k FROM (SELECT name, pos, doc_id, 1 AS tier FROM a JOIN b ON (name = doc_id OR n = r) AND n <> '' UNION ALL SELECT name, pos, doc_id, 2 FROM a JOIN p USING (n) JOIN b USING (r))) WHERE k = 1""")
def registry_match(spark, d):
    asked = table(spark, d, "conversations").select(F.col("text").alias("name")).union(table(spark, d, "benchmark").select("text")).union(NAMES.df(spark))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("doc_id"), F.regexp_extract("text", "[a-z]+ [a-z]+", 0).alias("doc_name"))
    few = REGISTRY.df(spark).where("session_id = 1").select((F.col("pos") - 100).cast("long").alias("pos"), "doc_id", "doc_name")
    return links.registry_match(asked, docs.unionByName(few))


DOCS = Fixture("doc_id string, doc_name string", ("d1", "Weathering steel review"), ("d2", "Steel in sea air"), ("d3", "Sea air"), ("d4", "Rust"))
ASKED = Fixture("query_id int, name string", (1, "sea air"), (2, "steel"), (3, "none"), (4, "air steel"))


@query("locate_by_name", f"""WITH w AS (SELECT query_id, name, unnest(list_distinct(regexp_extract_all(lower(name), '[a-z][a-z0-9]+'))) word FROM {ASKED.sql}), h AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(doc_name), '[a-z][a-z0-9]+'))) word FROM {DOCS.sql}),
 b AS (SELECT query_id, doc_id, 2 tier FROM w JOIN h USING (word) GROUP BY query_id, doc_id HAVING count(*) = (SELECT count(*) FROM w x WHERE x.query_id = w.query_id) UNION ALL SELECT query_id, doc_id, 1 FROM {ASKED.sql} a JOIN {DOCS.sql} e ON lower(name) = lower(doc_name)),
 m AS (SELECT query_id, doc_id, min(tier) tier FROM b GROUP BY ALL) SELECT query_id, doc_id, tier FROM (SELECT *, min(tier) OVER (PARTITION BY query_id) best FROM m) WHERE tier = best""")
def locate_by_name(spark, d):
    return links.located(ASKED.df(spark), DOCS.df(spark))


IDS = Fixture("pos int, doc_id string", (1, "d3"), (2, "dx"), (3, "d1"))


@query("locate_by_id", f"SELECT pos, a.doc_id, coalesce(doc_name, a.doc_id) AS doc_name FROM {IDS.sql} a LEFT JOIN {DOCS.sql} b ON a.doc_id = b.doc_id")
def locate_by_id(spark, d):
    return links.named_by_id(IDS.df(spark), DOCS.df(spark))


REFS = Fixture("session_id int, ref int", (1, 2), (1, 9), (2, 1), (1, 4))


@query("resolve_refs", f"SELECT session_id, ref, doc_id FROM {REFS.sql} r JOIN (SELECT session_id, doc_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY pos) AS INTEGER) ref FROM {REGISTRY.sql}) n USING (session_id, ref)")
def resolve_refs(spark, d):
    return links.by_ordinal(REFS.df(spark), REGISTRY.df(spark))


LABELLED = Fixture("doc_id string, pos int, pk string, kind string, label string, refs array<string>", ("a", 1, "a1", "text", None, ["fig 3", "tab 1"]), ("a", 2, "a2", "fig", "3", ["fig 3"]), ("a", 3, "a3", "fig", "3", []), ("a", 4, "a4", "tab", "1", ["fig 3"]), ("b", 1, "b1", "text", None, ["fig 3"]))


@query("crossref_link", f"WITH l AS (SELECT * FROM {LABELLED.sql}), a AS (SELECT doc_id, kind, label, arg_min(pk, pos) dst FROM l WHERE label IS NOT NULL GROUP BY ALL), n AS (SELECT doc_id, pk src, unnest(refs) r FROM l) SELECT DISTINCT src, dst FROM n JOIN a ON a.doc_id = n.doc_id AND a.kind = split_part(r, ' ', 1) AND a.label = split_part(r, ' ', 2) WHERE src <> dst")
def crossref_link(spark, d):
    return links.cross_references(LABELLED.df(spark))


@query("equation_asof_link", f"WITH {C}, e AS (SELECT pk, type, last_value(CASE WHEN type = 'text' THEN pk END IGNORE NULLS) OVER (PARTITION BY doc_id, section ORDER BY paragraph_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, first_value(CASE WHEN type = 'text' THEN pk END IGNORE NULLS) OVER (PARTITION BY doc_id, section ORDER BY paragraph_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM chunks) SELECT pk, before, after FROM e WHERE type = 'equation'")
def equation_asof_link(spark, d):
    return links.equation_context(chunks(spark, d).withColumn("pos", F.col("paragraph_index")))


@query("section_anchor_link", f"""WITH {C}, o AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY paragraph_index) run FROM (SELECT *, CASE WHEN lag(section) OVER (PARTITION BY doc_id ORDER BY paragraph_index) = section THEN 0 ELSE 1 END new FROM chunks)),
 t AS (SELECT * FROM o WHERE type = 'text'), a AS (SELECT * FROM o WHERE type IN ('image', 'table', 'equation')) SELECT t.pk AS src, a.pk AS dst FROM t JOIN a USING (doc_id, run) UNION ALL SELECT a.pk, f.dst FROM a JOIN (SELECT doc_id, run, arg_min(pk, paragraph_index) dst FROM t GROUP BY ALL) f USING (doc_id, run)""")
def section_anchor_link(spark, d):
    return links.section_links(chunks(spark, d).withColumn("pos", F.col("paragraph_index")))


CAPTIONS = Fixture("page int, ord int, pk string, type string", (0, 1, "c1", "caption"), (0, 3, "t1", "table"), (0, 5, "c2", "caption"), (1, 1, "t2", "table"), (1, 2, "c3", "caption"), (2, 1, "t3", "table"), (2, 9, "c4", "caption"))


@query("nearest_caption", f"WITH b AS (SELECT * FROM {CAPTIONS.sql}) SELECT table_pk, caption_pk FROM (SELECT t.pk table_pk, c.pk caption_pk, row_number() OVER (PARTITION BY t.pk ORDER BY abs(c.ord - t.ord), c.ord) k FROM b t JOIN b c ON t.page = c.page AND abs(c.ord - t.ord) <= 3 WHERE t.type = 'table' AND c.type = 'caption') WHERE k = 1")
def nearest_caption(spark, d):
    return links.nearest_caption(CAPTIONS.df(spark))


_SQ = r"regexp_replace({}, '[ \t\r\n]+', '', 'g')"


@query("gold_source_vote", f"WITH {C}, g AS (SELECT item_id AS question, substr({_SQ.format('unnest(string_split(text, chr(10)))')}, 1, 100) k FROM benchmark), c AS (SELECT DISTINCT doc_id, substr({_SQ.format('content')}, 1, 100) k FROM chunks), v AS (SELECT question, doc_id, count(*) n FROM g JOIN c USING (k) GROUP BY ALL) SELECT question, doc_id, n AS votes FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY n DESC, doc_id) r FROM v) WHERE r = 1")
def gold_source_vote(spark, d):
    golds = table(spark, d, "benchmark").select(F.col("item_id").alias("question"), F.explode(F.split("text", "\n")).alias("passage"))
    return links.source_by_vote(golds, chunks(spark, d))


BLOCKS = Fixture("id string, parent string, chunk_index int, text string", ("x", None, 0, "whole"), ("y_1", "y", 2, "second"), ("y_0", "y", 1, "first"), ("z", None, 0, "zed"))
WANTED = Fixture("id string", ("y",), ("x",), ("none",))


@query("block_resolve", f"WITH b AS (SELECT * FROM {BLOCKS.sql}) SELECT w.id, coalesce(o.text, p.text) AS text FROM {WANTED.sql} w LEFT JOIN b o ON o.id = w.id LEFT JOIN (SELECT parent id, string_agg(text, chr(10) ORDER BY chunk_index) text FROM b WHERE parent IS NOT NULL GROUP BY parent) p ON p.id = w.id")
def block_resolve(spark, d):
    return links.resolved_blocks(WANTED.df(spark), BLOCKS.df(spark))


@query("topk_per_route", f"WITH {C} SELECT doc_id, type, pk, CAST(n AS INTEGER) n FROM (SELECT doc_id, type, pk, row_number() OVER (PARTITION BY doc_id, type ORDER BY length(content) DESC, pk) n FROM chunks) WHERE n <= 2")
def topk_per_route(spark, d):
    from corpuscle.operators.retrieval import top_k

    own = chunks(spark, d).withColumn("score", F.length("content"))
    return top_k(own, 2, ["doc_id", "type"]).select("doc_id", "type", "pk", F.col("rank").alias("n"))


RERANKED = Fixture("query_id int, pk string, rank int", (1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "z", 1))
LEXICAL = Fixture("query_id int, pk string, rank int", (1, "b", 1), (1, "d", 2), (1, "e", 3), (2, "y", 1))
DENSE = Fixture("query_id int, pk string, rank int", (1, "f", 1), (1, "a", 2), (2, "y", 1))


@query("rescue_merge", f"SELECT query_id, pk, min(place)::INTEGER AS place FROM (SELECT query_id, pk, 0 place FROM {RERANKED.sql} WHERE rank <= 2 UNION ALL SELECT query_id, pk, 1 FROM {LEXICAL.sql} WHERE rank <= 2 UNION ALL SELECT query_id, pk, 2 FROM {DENSE.sql} WHERE rank <= 2) GROUP BY query_id, pk")
def rescue_merge(spark, d):
    return ranking.rescued(RERANKED.df(spark), LEXICAL.df(spark), DENSE.df(spark), 2, 2)


@query("tiered_quota", f"""WITH {C}, {BQ}, {bm25_sql(60, 'bench')}, h AS (SELECT query_id, split_part(pk, '::', 1) doc_id, pk, score, row_number() OVER (PARTITION BY query_id, split_part(pk, '::', 1) ORDER BY score DESC, pk) k FROM bm25),
 w AS (SELECT query_id, doc_id, round(sum(score), 6) w FROM h WHERE k <= 3 GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY w DESC, doc_id) p, count(*) OVER (PARTITION BY query_id) n FROM w),
 q AS (SELECT *, CASE WHEN p <= greatest(1, n // 3) THEN 8 WHEN p <= 2 * n // 3 THEN 5 ELSE 3 END quota FROM p) SELECT query_id, doc_id, pk, quota FROM h JOIN q USING (query_id, doc_id) WHERE k <= quota""")
def tiered_quota(spark, d):
    hits = bm25(benchmark_queries(spark, d), chunks(spark, d), 60).withColumn("doc_id", F.split_part("pk", F.lit("::"), F.lit(1)))
    return ranking.tiered_quota(hits)


@query("doc_top3_sum", f"WITH {C}, {BQ}, {bm25_sql(60, 'bench')} SELECT query_id, doc_id, CAST(round(sum(CAST(score AS DECIMAL(20, 6))), 4) AS DOUBLE) AS importance FROM (SELECT query_id, split_part(pk, '::', 1) doc_id, score, row_number() OVER (PARTITION BY query_id, split_part(pk, '::', 1) ORDER BY score DESC, pk) k FROM bm25) WHERE k <= 3 GROUP BY ALL")
def doc_top3_sum(spark, d):
    from corpuscle.operators.retrieval import top_k

    hits = bm25(benchmark_queries(spark, d), chunks(spark, d), 60).drop("rank").withColumn("doc_id", F.split_part("pk", F.lit("::"), F.lit(1)))
    return top_k(hits, 3, ["query_id", "doc_id"]).groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("score").cast("decimal(20,6)")), 4).cast("double").alias("importance"))


@query("prefix_dedup", f"WITH {C} SELECT pk FROM (SELECT pk, row_number() OVER (PARTITION BY doc_id, substr({_SQ.format('content')}, 1, 80) ORDER BY length(content) DESC, pk) k FROM chunks) WHERE k = 1")
def prefix_dedup(spark, d):
    return ranking.prefix_dedup(chunks(spark, d).withColumn("score", F.length("content"))).select("pk")


PARTS = Fixture("doc_id string, pos int, pk string, type string, text string", ("a", 1, "a1", "text", "before"), ("a", 2, "a2", "title", "One"), ("a", 3, "a3", "text", "x"), ("a", 4, "a4", "equation", "e"), ("a", 5, "a5", "text", "y"), ("a", 6, "a6", "title", "Two"), ("a", 7, "a7", "text", "z"), ("b", 1, "b1", "text", "only"))


@query("paragraph_number", f"WITH p AS (SELECT *, CAST(type = 'text' AND max(CAST(type = 'title' AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos) = 1 AS INTEGER) c FROM {PARTS.sql}) SELECT pk, CAST(CASE WHEN c = 1 THEN sum(c) OVER (PARTITION BY doc_id ORDER BY pos) ELSE -1 END AS INTEGER) AS paragraph_index FROM p")
def paragraph_number(spark, d):
    return ranking.paragraph_numbers(PARTS.df(spark))


@query("section_fill", f"SELECT pk, last_value(CASE WHEN type = 'title' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM {PARTS.sql}")
def section_fill(spark, d):
    return ranking.section_fill(PARTS.df(spark))


LAYOUT = Fixture("doc_id string, page int, ord int, block string, text string", ("a", 1, 2, "b3", "t3"), ("a", 0, 2, "b2", "t2"), ("a", 0, 1, "b1", "t1"), ("a", 0, 4, "b1", "again"), ("b", 0, 1, "b1", "u1"))


@query("block_order", f"SELECT doc_id, page, ord, text, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, ord) AS INTEGER) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page, block ORDER BY ord) k FROM {LAYOUT.sql}) WHERE k = 1")
def block_order(spark, d):
    from pyspark.sql import Window

    own = ranking.first_by(LAYOUT.df(spark), ["doc_id", "page", "block"], "ord")
    return own.select("doc_id", "page", "ord", "text", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "ord")).alias("pos"))


@query("batch_refs", f"""WITH {C}, r AS (SELECT doc_id, content, row_number() OVER (PARTITION BY doc_id ORDER BY paragraph_index) n FROM chunks WHERE type = 'text') SELECT doc_id, min(n)::INTEGER AS "first", max(n)::INTEGER AS "last", count(*)::BIGINT AS size, string_agg(content, chr(10) ORDER BY n) AS content FROM r GROUP BY doc_id, (n - 1) // 5""")
def batch_refs(spark, d):
    return ranking.batched(chunks(spark, d).where("type = 'text'"), "doc_id", "paragraph_index", "content", 5)


@query("budget_cut", f"WITH {C} SELECT doc_id, pk, used FROM (SELECT doc_id, pk, CAST(sum(length(content) + 2) OVER (PARTITION BY doc_id ORDER BY paragraph_index ROWS UNBOUNDED PRECEDING) AS BIGINT) used FROM chunks) WHERE used <= 1000")
def budget_cut(spark, d):
    return ranking.budget_cut(chunks(spark, d).withColumn("rank", F.col("paragraph_index")), 1000, ["doc_id"]).select("doc_id", "pk", "used")


ROUTED = Fixture("query_id int, route_pos int, rank int, pk string", (1, 0, 1, "a"), (1, 0, 2, "b"), (1, 1, 1, "b"), (1, 1, 2, "c"), (2, 1, 1, "a"))


@query("first_seen", f"SELECT query_id, pk, route_pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id, pk ORDER BY route_pos, rank) k FROM {ROUTED.sql}) WHERE k = 1")
def first_seen(spark, d):
    return ranking.first_by(ROUTED.df(spark), ["query_id", "pk"], "route_pos", "rank").select("query_id", "pk", "route_pos")


@query("best_summary", f"WITH {C} SELECT doc_id, pk FROM (SELECT doc_id, pk, row_number() OVER (PARTITION BY doc_id ORDER BY CAST(contains(lower(content), 'the') AS INTEGER) DESC, abs(length(content) - 250), paragraph_index) k FROM chunks WHERE type IN ('summary', 'text')) WHERE k = 1")
def best_summary(spark, d):
    own = chunks(spark, d).where("type IN ('summary', 'text')")
    has = F.contains(F.lower("content"), F.lit("the")).cast("int")
    return ranking.first_by(own, ["doc_id"], has.desc(), F.abs(F.length("content") - 250), F.col("paragraph_index")).select("doc_id", "pk")


@query("registry_lru", f"SELECT session_id, pos, doc_id, pinned FROM (SELECT *, sum(CAST(pinned AS INTEGER)) OVER (PARTITION BY session_id) p, row_number() OVER (PARTITION BY session_id, pinned ORDER BY pos DESC) k FROM {REGISTRY.sql}) WHERE pinned OR k <= 3 - p")
def registry_lru(spark, d):
    return ranking.registry_window(REGISTRY.df(spark), 3).select("session_id", "pos", "doc_id", "pinned")


MORE = Fixture("session_id int, pos int, doc_id string, doc_name string, pinned boolean", (1, 1, "d3", "Q45 again", True), (1, 2, "d9", "New", False), (3, 1, "d1", "First", False))


@query("registry_merge", f"SELECT session_id, doc_id, doc_name, pinned, CAST(row_number() OVER (PARTITION BY session_id ORDER BY o) AS INTEGER) AS pos FROM (SELECT session_id, doc_id, arg_min(doc_name, o) doc_name, bool_or(pinned) pinned, min(o) o FROM (SELECT *, pos o FROM {REGISTRY.sql} UNION ALL SELECT *, pos + 1000 FROM {MORE.sql}) GROUP BY session_id, doc_id)")
def registry_merge(spark, d):
    return ranking.registry_merged(REGISTRY.df(spark), MORE.df(spark))


@query("recent_turns", "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) k FROM (SELECT DISTINCT * FROM conversations)) WHERE k <= 4")
def recent_turns(spark, d):
    return ranking.recent_turns(table(spark, d, "conversations").distinct(), 4)


@query("history_window", "WITH r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) k FROM (SELECT DISTINCT * FROM conversations)) WHERE k <= 3) SELECT conv_id, turn, role FROM (SELECT *, min(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) f FROM r) WHERE turn >= f")
def history_window(spark, d):
    return ranking.history_from_user(table(spark, d, "conversations").distinct(), 3).select("conv_id", "turn", "role")


@query("cap_per_doc", f"WITH {C} SELECT doc_id, pk FROM (SELECT doc_id, pk, row_number() OVER (PARTITION BY doc_id ORDER BY md5(pk), pk) k FROM chunks) WHERE k <= 5")
def cap_per_doc(spark, d):
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id").orderBy(F.md5("pk"), "pk")
    return chunks(spark, d).withColumn("k", F.row_number().over(order)).where("k <= 5").select("doc_id", "pk")


OLD_HITS = Fixture("query_id int, pos int, pk string, score double", (1, 1, "a", 0.9), (1, 2, "b", 0.5), (2, 1, "z", 0.1))
NEW_HITS = Fixture("query_id int, pos int, pk string, score double", (1, 1, "c", 0.99), (1, 2, "a", 1.5), (3, 1, "q", 0.2))


@query("merge_hits", f"SELECT query_id, pk, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY o) AS INTEGER) AS pos FROM (SELECT query_id, pk, arg_min(score, o) score, min(o) o FROM (SELECT *, pos o FROM {OLD_HITS.sql} UNION ALL SELECT *, 1000 + pos FROM {NEW_HITS.sql}) GROUP BY ALL)")
def merge_hits(spark, d):
    return ranking.merged_hits(OLD_HITS.df(spark), NEW_HITS.df(spark))


DECISIONS = Fixture("query_id int, pos int, routes array<string>, docs array<string>, chunk_type string, rewrite string", (1, 1, ["local"], ["d1"], None, "first"), (1, 2, ["local", "metadata"], ["d2", "d1"], "image", "second"), (1, 3, ["summary"], None, "table", "third"), (2, 1, ["progressive"], [], None, "alone"))


@query("merge_decisions", f"""WITH x AS (SELECT * FROM {DECISIONS.sql}), r AS (SELECT query_id, v, min(pos * 100 + i) o FROM (SELECT query_id, pos, unnest(routes) v, unnest(range(1, len(routes) + 1)) i FROM x) GROUP BY ALL), s AS (SELECT query_id, v, min(pos * 100 + i) o FROM (SELECT query_id, pos, unnest(docs) v, unnest(range(1, len(docs) + 1)) i FROM x) GROUP BY ALL),
 rr AS (SELECT query_id, string_agg(v, ',' ORDER BY o) routes FROM r GROUP BY ALL), ss AS (SELECT query_id, string_agg(v, ',' ORDER BY o) docs FROM s GROUP BY ALL)
 SELECT query_id, routes, coalesce(docs, '') AS docs, chunk_type, rewrite FROM (SELECT query_id, arg_min(chunk_type, pos) FILTER (WHERE chunk_type IS NOT NULL) AS chunk_type, string_agg(rewrite, ' | ' ORDER BY pos) AS rewrite FROM x GROUP BY query_id) b JOIN rr USING (query_id) LEFT JOIN ss USING (query_id)""")
def merge_decisions(spark, d):
    return ranking.merged_decisions(DECISIONS.df(spark))


PATCHES = Fixture("query_id int, routes array<string>, extra array<string>", (1, ["local", "metadata"], ["metadata", "summary", "progressive"]), (2, [], ["local"]), (3, ["summary"], []))


@query("merge_patch", f"SELECT query_id, array_to_string(list_slice(list_concat(routes, list_filter(extra, lambda e: NOT list_contains(routes, e))), 1, 3), ',') AS routes FROM {PATCHES.sql}")
def merge_patch(spark, d):
    return PATCHES.df(spark).select("query_id", F.array_join(F.slice(F.array_union("routes", "extra"), 1, 3), ",").alias("routes"))


MATCHES = Fixture("query_id int, source int, pk string, score double", (1, 1, "a", 3.0), (1, 2, "a", 5.0), (1, 2, "b", 5.0), (1, 3, "c", 9.5), (2, 3, "d", 1.0))


@query("metadata_merge", f"SELECT query_id, pk, score, source, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source, pk) AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, pk ORDER BY source) k FROM {MATCHES.sql}) WHERE k = 1")
def metadata_merge(spark, d):
    from pyspark.sql import Window

    own = ranking.first_by(MATCHES.df(spark), ["query_id", "pk"], "source")
    return own.select("query_id", "pk", "score", "source", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "source", "pk")).alias("rank"))


@query("metadata_basic", f"WITH m AS (SELECT *, count(*) FILTER (WHERE source = 1) OVER (PARTITION BY query_id) refs FROM {MATCHES.sql}), o AS (SELECT *, row_number() OVER (PARTITION BY query_id, pk ORDER BY source) k FROM m) SELECT query_id, pk, CAST(pos AS INTEGER) pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY source, pk) pos FROM o WHERE k = 1) WHERE refs > 0 OR pos <= 2")
def metadata_basic(spark, d):
    from pyspark.sql import Window

    refs = F.count_if(F.col("source") == 1).over(Window.partitionBy("query_id"))
    own = ranking.first_by(MATCHES.df(spark).withColumn("refs", refs), ["query_id", "pk"], "source")
    placed = own.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("source", "pk")))
    return placed.where("refs > 0 OR pos <= 2").select("query_id", "pk", "pos")


LISTS = Fixture("id int, items array<string>", (1, ["b", "a", "b", "c", "a"]), (2, []), (3, ["x"]))


@query("array_dedup", f"SELECT id, array_to_string(list_filter(items, lambda x, i: list_position(items, x) = i), ',') AS items FROM {LISTS.sql}")
def array_dedup(spark, d):
    return LISTS.df(spark).select("id", F.array_join(F.array_distinct("items"), ",").alias("items"))


@query("subquery_prefix", f"SELECT 'sub' || query_id || ':r' || route_pos AS key, pk FROM {ROUTED.sql}")
def subquery_prefix(spark, d):
    return ROUTED.df(spark).select(F.concat(F.lit("sub"), F.col("query_id").cast("string"), F.lit(":r"), F.col("route_pos").cast("string")).alias("key"), "pk")
