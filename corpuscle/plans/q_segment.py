"""Queries that make chunks from page layout and cut long texts."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import layout as y, questions
from corpuscle.operators import retrieval as r, segment
from corpuscle.sources.chunks import CHUNKS_SQL as C

from .q_retrieval import VC, vector_chunks
from .q_store import chunks
from .registry import Fixture, query, table


def _text(kind: str, text: str) -> dict:
    return {"type": kind, "content": {f"{kind}_content": [{"type": "text", "content": text}]}}


#: Two small papers as layout files.
PAPERS = {
    "p1": [
        [
            _text("title", "R U S T on steel"), _text("paragraph", "Abstract: we look at rust. Keywords: steel"), _text("title", "1 Introduction"), _text("paragraph", "文章编号：2000-0007"), _text("paragraph", "The layer grows with"), _text("paragraph", "time and with rain, as Fig. 1 shows."),
            _text("paragraph", "It is thin."), {"type": "equation_interline", "content": {"math_content": "m = k t^n"}}, _text("paragraph", "where k is a rate! More follows."),
            {"type": "image", "content": {"image_caption": [{"type": "text", "content": "Fig. 1 The"}, {"type": "equation_inline", "content": "x"}, {"type": "text", "content": "layer"}], "image_footnote": [{"type": "text", "content": "after Lee"}], "image_source": {"path": "images/a.jpg"}}},
        ],
        [
            {"type": "table", "content": {"table_caption": [{"type": "text", "content": "Table II Rates"}], "html": "<table><tr><td>a</td></tr></table>", "image_source": {"path": "images/b.jpg"}}},
            _text("title", "参 考 文 献"),
            {"type": "list", "content": {"list_type": "reference_list", "list_items": [{"item_content": [{"type": "text", "content": t}]} for t in ("[1] Lee, J. Rust of steel [2] Kim, A. Salt and", "rain on bridges", "收稿日期", "[3] Ono. Wea-", "thering", "[4] Four of them", "[5] Five of them", "[6] Six of them")]}},
        ],
    ],
    "p2": [[_text("title", "Summary"), _text("paragraph", "All is said here."), _text("paragraph", "Nothing more"), _text("title", "!\"#$ &'()*"), _text("paragraph", "Body of the second paper, which is long enough to stand alone.")], [_text("paragraph", "Short end")]],
}
LAYOUTS = Fixture("doc_id string, layout string", *[(k, json.dumps(v, ensure_ascii=False)) for k, v in PAPERS.items()])


#: Lines on a page, blocks in a group, and the least confidence, where documents are read as layout.
PAGE_LINES, GROUP_BLOCKS, LEAST = 40, 5, 0.5


def _pages(blocks: Column) -> Column:
    """An array cut to pages."""
    last = F.floor((F.size(blocks) - 1) / PAGE_LINES).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda p: F.slice(blocks, p * PAGE_LINES + 1, PAGE_LINES))


def document_layouts(spark, d) -> DataFrame:
    """Documents as layout files: the first line a title, the others paragraphs, pages of equal length."""

    def block(line: Column, i: Column) -> Column:
        runs = F.array(F.struct(F.lit("text").alias("type"), line.alias("content")))
        content = F.struct(F.when(i == 0, runs).alias("title_content"), F.when(i > 0, runs).alias("paragraph_content"))
        return F.struct(F.when(i == 0, "title").otherwise("paragraph").alias("type"), content.alias("content"))

    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.to_json(_pages(F.transform(lines, block))).alias("layout"))


#: Lines of documents with their place.
LINES_SQL = "SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents"


@query("layout_items", f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, i // {PAGE_LINES} AS page, (i // {PAGE_LINES}) * 100000 + i % {PAGE_LINES} AS pos, CASE WHEN i = 0 THEN 'title' ELSE 'paragraph' END AS type FROM ({LINES_SQL})")
def layout_items(spark, d):
    return segment.items(document_layouts(spark, d)).select("doc_id", F.col("page").cast("long").alias("page"), F.col("pos").cast("long").alias("pos"), "type")


@query("layout_chunks")
def layout_chunks(spark, d):
    return segment.chunks(segment.items(document_layouts(spark, d)))


def document_items(spark, d) -> DataFrame:
    """Documents as items: the first line a title, each line that isn't empty a paragraph."""
    lines = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("pos", "text")).where("text != ''")
    blank = F.lit("")
    return lines.select("doc_id", F.floor(F.col("pos") / 40).cast("int").alias("page"), "pos", F.when(F.col("pos") == 0, "title").otherwise("paragraph").alias("type"), "text", F.array().cast("array<string>").alias("entries"), blank.alias("caption"), blank.alias("note"), blank.alias("path"), blank.alias("html"))


@query("paragraph_groups")
def paragraph_groups(spark, d):
    return segment.paragraphs(segment.with_sections(document_items(spark, d))).select("doc_id", "pos", "text")


@query("document_chunks")
def document_chunks(spark, d):
    return segment.chunks(document_items(spark, d))


TREES = Fixture(
    "doc_id string, tree string",
    ("t1", json.dumps([[{"type": "text", "page": 0, "block": 2, "order": 2, "text": "b"}, {"type": "figuregroup", "page": 0, "block": 5, "order": 3, "items": [{"type": "figure", "page": 0, "block": 6, "order": 4, "text": "f", "items": [{"type": "image", "page": 0, "block": 9, "order": 6, "text": "in"}]}, {"type": "group", "page": 0, "block": 7, "items": [{"type": "imagecaption", "page": 0, "block": 8, "order": 5, "text": "Fig. 1"}]}]}], [{"type": "text", "page": 1, "block": 1, "order": 1, "text": "c", "hidden": True}, {"type": "text", "page": 1, "block": 2, "order": 2, "text": "d", "conf": 0.1}, {"type": "noise", "page": 1, "block": 3, "order": 3, "text": "n"}]])),
    ("t2", json.dumps([[{"type": "text", "page": 0, "block": 1, "order": 1, "text": "a"}, {"type": "text", "page": 0, "block": 1, "order": 2, "text": "again"}]])),
)


def document_trees(spark, d) -> DataFrame:
    """Documents as nested blocks: pages hold groups, groups hold lines; some lines are unsure, some hidden."""

    def leaf(line: Column, i: Column) -> Column:
        page, at = F.floor(i / PAGE_LINES).cast("int"), i % PAGE_LINES
        return F.struct(F.lit("text").alias("type"), page.alias("page"), at.alias("block"), i.alias("order"), line.alias("text"), ((i % 7 + 3) / 10).alias("conf"), (i % 11 == 5).alias("hidden"))

    def groups(blocks: Column) -> Column:
        last = F.floor((F.size(blocks) - 1) / GROUP_BLOCKS).cast("int")
        own = lambda g: F.slice(blocks, g * GROUP_BLOCKS + 1, GROUP_BLOCKS)
        return F.transform(F.sequence(F.lit(0), last), lambda g: F.struct(F.lit("group").alias("type"), (g + 1_000).alias("block"), own(g).alias("items")))

    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), leaf)
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.to_json(F.transform(_pages(lines), groups)).alias("tree"))


@query("tree_leaves", f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, i // {PAGE_LINES} AS page, i % {PAGE_LINES} AS block, i AS ord, 'text' AS type, text, 1000 + i % {PAGE_LINES} // {GROUP_BLOCKS} AS \"group\" FROM ({LINES_SQL}) WHERE (i % 7 + 3) / 10 >= {LEAST} AND i % 11 <> 5")
def tree_leaves(spark, d):
    return segment.leaves(document_trees(spark, d), LEAST).withColumns({c: F.col(c).cast("long") for c in ("page", "block", "ord", "group")})


@query("recursive_pieces")
def recursive_pieces(spark, d):
    own = table(spark, d, "documents").select("doc_id", segment.pieces(F.col("text"), 300).alias("p"))
    return own.select("doc_id", F.posexplode("p").alias("at", "piece"))


@query("merged_sentences")
def merged_sentences(spark, d):
    own = table(spark, d, "documents").select("doc_id", segment.merged(y.sentences(F.col("text")), 400, 600, 80).alias("p"))
    return own.select("doc_id", F.posexplode("p").alias("at", "piece"))


@query("semantic_pieces")
def semantic_pieces(spark, d):
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    own = chunks(spark, d).select("doc_id", F.col("paragraph_index").alias("pos"), F.col("content").alias("text"))
    own = own.withColumn("vec_id", (F.col("doc_id").cast("long") * 31 + F.col("pos")) % vectors.count()).join(vectors, "vec_id")
    return segment.semantic_pieces(own, 600, 1500, 200, overlap=100)


SECTIONS = Fixture("doc_id string, pos int, section string", ("a", 1, "Abstract"), ("a", 2, "1 Introduction"), ("b", 1, "Preface"), ("b", 2, "An executive view of abstracted work"), ("c", 1, "概 要"), ("c", 2, "Overview"), ("c", 3, "Summary"), ("d", 1, "Abstracts in summaryform abstract1"), ("e", 1, "Results"))
ASKED = Fixture("query_id int, q string", (1, "executive abstract"), (2, "view of work"))


@query("summary_tiers", f"""WITH s AS (SELECT *, regexp_matches(section, '{segment.SUMMARY_TITLE}') hit FROM {SECTIONS.sql}), src AS (SELECT doc_id || '/' || pos AS pk, section AS content FROM {SECTIONS.sql}), aq AS (SELECT * FROM {ASKED.sql}), {r.bm25_sql(None, 'aq', 'src')},
 b AS (SELECT s.doc_id, s.pos, s.section, 2 AS tier FROM s JOIN (SELECT DISTINCT pk FROM bm25 WHERE score >= 0.5) x ON x.pk = s.doc_id || '/' || s.pos WHERE s.doc_id NOT IN (SELECT doc_id FROM s WHERE hit)), u AS (SELECT doc_id, pos, section, 1 AS tier FROM s WHERE hit UNION ALL SELECT * FROM b)
 SELECT doc_id, section, tier FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) k FROM u) WHERE k <= 2""")
def summary_tiers(spark, d):
    own = SECTIONS.df(spark)
    source = own.select(F.concat_ws("/", "doc_id", "pos").alias("pk"), F.col("section").alias("content"))
    scores = r.bm25(ASKED.df(spark), source, None).join(own.withColumn("pk", F.concat_ws("/", "doc_id", "pos")), "pk")
    return segment.summary_sections(own, ASKED.df(spark), scores)


#: The least cosine to the mean of summaries of the language at which a section counts as one.
LIKE_SUMMARY = 0.2
_MEANS = "SELECT {keys}, list(x ORDER BY i) AS e FROM (SELECT {keys}, i, avg(x) AS x FROM (SELECT *, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM vchunks WHERE {where}) GROUP BY ALL) GROUP BY {keys}"


@query("summary_by_vectors", f"""WITH {VC}, m AS ({_MEANS.format(keys='doc_id, section', where='true')}), p AS ({_MEANS.format(keys='lang', where="type = 'summary'")}),
 h AS (SELECT doc_id, section, min(paragraph_index) AS pos, arg_min(content, paragraph_index) AS title, min(lang) AS lang FROM vchunks GROUP BY ALL), s AS (SELECT *, regexp_matches(title, '{segment.SUMMARY_TITLE}') AS hit FROM h JOIN m USING (doc_id, section)),
 u AS (SELECT doc_id, pos, section, 1 AS tier, NULL::DOUBLE AS score FROM s WHERE hit UNION ALL SELECT doc_id, pos, section, 3, round(list_cosine_similarity(s.e, p.e), 6) AS score FROM s JOIN p USING (lang) WHERE doc_id NOT IN (SELECT doc_id FROM s WHERE hit) AND round(list_cosine_similarity(s.e, p.e), 6) >= {LIKE_SUMMARY})
 SELECT doc_id, section, tier, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) k FROM u) WHERE k <= 2""")
def summary_by_vectors(spark, d):
    """Of every document, the sections that are a summary: by their first line, else by the mean of their vectors."""
    own = vector_chunks(spark, d)
    dim = own.agg(F.max(F.size("embedding"))).first()[0] or 0
    head = (F.min("paragraph_index").alias("pos"), F.min_by("content", "paragraph_index").alias("title"), F.min("lang").alias("lang"))
    sections = segment.mean_vectors(own, ["doc_id", "section"], dim, *head)
    prototypes = segment.mean_vectors(own.where("type = 'summary'"), ["lang"], dim)
    return segment.summary_sections_by_vectors(sections, prototypes, "lang", LIKE_SUMMARY)


@query("semantic_distances", f"WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] v, lead(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) n FROM embeddings) SELECT vec_id, round(1 - list_cosine_similarity(v, n), 5) AS distance FROM e WHERE n IS NOT NULL")
def semantic_distances(spark, d):
    from pyspark.sql import Window

    after = F.lead("embedding").over(Window.partitionBy("label").orderBy("vec_id"))
    own = table(spark, d, "embeddings").select("vec_id", "embedding", after.alias("n")).where("n IS NOT NULL")
    return own.select("vec_id", F.round(1 - questions.cosine(F.col("embedding"), F.col("n")), 5).alias("distance"))


@query("vectorized", f"WITH {C} SELECT pk, len(embedding) AS dim FROM chunks JOIN embeddings ON (CAST(doc_id AS BIGINT) * 31 + paragraph_index) % (SELECT count(*) FROM embeddings) = vec_id")
def vectorized(spark, d):
    own = chunks(spark, d)
    return segment.with_vectors(own, vector_chunks(spark, d).select("pk", "embedding")).select("pk", F.size("embedding").cast("long").alias("dim"))
