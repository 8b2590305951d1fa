"""Queries over what texts from page layout go through: cleaning, predicates, texts for vectors and rerankers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from corpuscle.functions import layout as y, text
from corpuscle.sources.chunks import CHUNKS_SQL as C

from .q_store import chunks
from .registry import Fixture, query


def _q(pattern: str) -> str:
    """A pattern as a DuckDB literal."""
    return "'" + pattern.replace("'", "''") + "'"


def _trim(x: str) -> str:
    return f"trim(coalesce({x}, ''), ' ' || chr(9) || chr(10) || chr(12) || chr(13))"


ODD_TEXTS = Fixture(
    "pk string, content string",
    ("x1", "$\\mathrm{ C } 0 . 1 6$ and $\\leqslant 0.1 \\%$"), ("x2", "see Figure 3, fig. iv and Table II; Fig 3 again"), ("x3", "Abstract: we study rust. Keywords: steel"), ("x4", "12. Smith, J. [J] Journal of Rust [1] First entry [2] Second entry"),
    ("x5", "of the layer, which grows"), ("x6", "Ends here [12]."), ("x7", 'quoted "end!"'), ("x8", "Key words: rust"), ("x9", "References"), ("x10", "1. Introduction"), ("x11", "2.3.1 Deep heading"), ("x12", "第一句。第二句！ third? rest"),
    ("x13", "executive summary - short 1 introduction follows"), ("x14", ""), ("x15", "and so it goes on"), ("x16", "Label:"), ("x17", "Ab"), ("x18", "  text_00ab_p002 is cited "), ("x19", "`IMAGE_77FF`"), ("x20", "（下转第5页）"),
)
#: Lines of documents, and a few that have what those lack.
TEXTS = f"{C}, texts AS (SELECT pk, content FROM chunks UNION ALL SELECT pk, content FROM {ODD_TEXTS.sql})"


def texts(spark, d) -> DataFrame:
    return chunks(spark, d).select("pk", "content").unionByName(ODD_TEXTS.df(spark))


def _numbers_sql(x: str) -> str:
    x = f"regexp_replace({x}, {_q(chr(92) * 2 + 'mathrm' + chr(92) + '{([^}]*)' + chr(92) + '}')}, '\\1', 'g')"
    for old, new in y.LATEX:
        x = f"replace({x}, {_q(old)}, {_q(new)})"
    x = f"replace({x}, '$', '')"
    for _ in range(2):  # neighbours overlap: every second gap goes each time
        x = f"regexp_replace({x}, '([0-9.])[ \\t]+([0-9.])', '\\1\\2', 'g')"
    return x


@query("plain_numbers", f"WITH {TEXTS} SELECT pk, {_numbers_sql('content')} AS content FROM texts")
def plain_numbers(spark, d):
    return texts(spark, d).select("pk", y.plain_numbers(F.col("content")).alias("content"))


TABLES = Fixture(
    "id int, content string, context string",
    (1, "[Caption] Table 1 Composition\n[Table HTML]\n<table><tr><th>Steel</th><th>C</th><th>Si</th><td>Mn</td></tr><tr><td>A &amp; B</td><td> 0 . 1</td><td><b>0.2</b></td><td>1</td></tr></table>\n[Image Path] x.png", "note"),
    (2, "[Caption] [Table without caption]\n[Table HTML]\n<TABLE><TR class=a><TD>P &lt; 1</TD><TD>x\n y</TD></TR><tr></tr></TABLE>", ""), (3, "no table", None), (4, None, None), (5, "[Table HTML]\n<tr><td>C</td><td>Si</td></tr>", "two only"),
)


@query("table_lines")
def table_lines(spark, d):
    c = F.col("content")
    return TABLES.df(spark).select("id", y.caption(c).alias("caption"), y.table_lines(y.table_html(c)).alias("lines"))


@query("embedding_text", f"WITH {C} SELECT pk, substr({_trim('t')}, 1, 8000) AS embedding_text FROM (SELECT pk, CASE WHEN type = 'table' OR type = 'image' THEN concat_ws(chr(10) || chr(10), nullif('[Section] ' || section, '[Section] '), nullif(source, '')) WHEN type = 'equation' THEN concat_ws(chr(10) || chr(10), nullif('[Section] ' || section, '[Section] '), nullif({_trim('content')}, ''), nullif(source, '')) WHEN type = 'references' THEN {_trim('content')} ELSE concat_ws(chr(10) || chr(10), nullif('[Section] ' || section, '[Section] '), nullif({_numbers_sql(_trim('content'))}, '')) END AS t FROM chunks)")
def embedding_text(spark, d):
    own = chunks(spark, d)
    return own.select("pk", y.embedding_text(F.col("section"), F.col("type"), F.col("content"), F.col("source")).alias("embedding_text"))


@query("table_embedding_text")
def table_embedding_text(spark, d):
    return TABLES.df(spark).select("id", y.embedding_text(F.lit("2 Results"), F.lit("table"), F.col("content"), F.col("context")).alias("embedding_text"))


@query("rerank_text", f"WITH {C} SELECT pk, substr({_trim('t')}, 1, 8000) AS rerank_text FROM (SELECT pk, concat_ws(chr(10) || chr(10), CASE WHEN section <> '' AND type <> 'references' THEN '[Section] ' || section END, nullif({_trim('content')}, ''), CASE WHEN type IN ('table', 'image', 'equation') THEN nullif(source, '') END) t FROM chunks)")
def rerank_text(spark, d):
    own = chunks(spark, d)
    return own.select("pk", y.rerank_text(F.col("section"), F.col("type"), F.col("content"), F.col("source")).alias("rerank_text"))


_LABELS = "list_sort(list_distinct(list_transform(regexp_extract_all(content, {}, 1), lambda x: upper(x))))"


@query("cross_references", f"WITH {TEXTS} SELECT pk, {_LABELS.format(_q(y.FIGURE_REF))} AS figures, {_LABELS.format(_q(y.TABLE_REF))} AS tables, nullif(upper(regexp_extract(content, {_q(y.FIGURE_REF)}, 1)), '') AS label FROM texts")
def cross_references(spark, d):
    c = F.col("content")
    return texts(spark, d).select("pk", y.cross_references(c, y.FIGURE_REF).alias("figures"), y.cross_references(c, y.TABLE_REF).alias("tables"), y.caption_label(c, F.lit("image")).alias("label"))


def _summary_sql(x: str) -> str:
    x = _trim(x)
    for head in y.SUMMARY_HEADS:
        x = _trim(f"regexp_replace({x}, {_q(head)}, '')")
    return x


_STOPS = ", ".join(f"nullif(strpos(t, nullif(regexp_extract(t, {_q(p)}, 0), '')), 0)" for p in y.SUMMARY_STOPS)


@query("summary_body", f"WITH {TEXTS} SELECT pk, {_trim('CASE WHEN cut IS NULL THEN t ELSE substr(t, 1, cut - 1) END')} AS body FROM (SELECT *, least({_STOPS}) AS cut FROM (SELECT pk, {_summary_sql('content')} AS t FROM texts))")
def summary_body(spark, d):
    return texts(spark, d).select("pk", y.summary_body(F.col("content")).alias("body"))


def _tail_sql(x: str) -> str:
    x = f"rtrim({x})"
    for _ in range(3):
        x = f"regexp_replace(regexp_replace({x}, {_q(y.TRAILING_CITATION)}, ''), {_q(y.TRAILING_NOISE)}, '')"
    return x


_ENDED = "(r <> '' AND contains({0}, r))".format(_q(y.TERMINATORS))
_LEADING = y.LEADING_WORD.replace("(?![一-鿿A-Za-z0-9_])", "(?:[^一-鿿A-Za-z0-9_]|$)")


@query("paragraph_pairs", f"""WITH {C}, pairs AS (SELECT doc_id, pk, lag(content) OVER (PARTITION BY doc_id ORDER BY paragraph_index) AS b, content AS a FROM chunks),
 t AS (SELECT *, {_trim('b')} was, {_trim('a')} now, right({_tail_sql('b')}, 1) r, right({_tail_sql('a')}, 1) ra FROM pairs)
 SELECT pk, ra <> '' AND contains({_q(y.TERMINATORS)}, ra) AS ends, coalesce(CASE WHEN was = '' OR now = '' THEN false WHEN regexp_matches(was, {_q(y.KEYWORD_LINE)}) THEN false WHEN regexp_matches(now, {_q(y.NEW_BLOCK)}) THEN false WHEN was LIKE '%：' OR was LIKE '%:' THEN true
 WHEN length(now) < 40 AND NOT {_ENDED} AND NOT regexp_matches(now, {_q(y.NUMBERED)}) THEN true WHEN {_ENDED} OR regexp_matches(now, {_q(y.NUMBERED)}) THEN false ELSE regexp_matches(now, '^[a-z]') OR regexp_matches(now, {_q(_LEADING)}) OR NOT regexp_matches(now, '^\\p{{Lu}}') END, false) AS together FROM t""")
def paragraph_pairs(spark, d):
    before = F.lag("content").over(Window.partitionBy("doc_id").orderBy("paragraph_index"))
    own = chunks(spark, d).select("pk", "content", before.alias("before"))
    return own.select("pk", y.ends_sentence(F.col("content")).alias("ends"), y.belong_together(F.col("before"), F.col("content")).alias("together"))


@query("reference_rules", f"WITH {TEXTS} SELECT pk, regexp_matches(t, {_q(y.REFERENCES_TITLE)}) OR regexp_matches(t, {_q(y.REFERENCES_TITLE_START)}) AS title, regexp_matches(t, {_q(y.ENTRY_START + '|' + y.AUTHOR_START)}) AS starts, length(t) <= 3 OR regexp_matches(t, {_q(y.REFERENCE_NOISE)}) OR regexp_matches(t, {_q(y.REFERENCE_BODY)}) OR (length(t) > 350 AND regexp_matches(t, '(?i)\\bAbstract\\b|摘\\s*要')) AS noise, CAST(len(list_filter(string_split(regexp_replace(t, '([\\[［]\\s*[0-9]+\\s*[\\]］])', chr(1) || '\\1', 'g'), chr(1)), lambda p: trim(p) <> '')) AS INTEGER) AS entries FROM (SELECT pk, {_trim('content')} t FROM texts)")
def reference_rules(spark, d):
    c = F.col("content")
    return texts(spark, d).select("pk", y.is_references_title(c).alias("title"), y.is_entry_start(c).alias("starts"), y.is_reference_noise(c).alias("noise"), F.size(y.inline_entries(c)).alias("entries"))


@query("heading_levels", f"WITH {TEXTS} SELECT pk, CAST(CASE WHEN h = '' THEN 1 ELSE len(string_split(h, '.')) END AS INTEGER) AS level FROM (SELECT pk, regexp_extract(content, '^([0-9]+(?:\\.[0-9]+)*)[\\s.]', 1) h FROM texts)")
def heading_levels(spark, d):
    return texts(spark, d).select("pk", y.heading_level(F.col("content")).alias("level"))


_PARTS = "list_filter(list_transform(string_split(regexp_replace(t, '([。！？!?])\\s*', '\\1' || chr(1), 'g'), chr(1)), lambda p: trim(p, ' ' || chr(9) || chr(10) || chr(12) || chr(13))), lambda p: p <> '')"


@query("edge_sentences", f"WITH {TEXTS} SELECT pk, coalesce(s[1], '') AS first, coalesce(s[-1], '') AS last FROM (SELECT pk, {_PARTS} s FROM (SELECT pk, {_trim('content')} t FROM texts))")
def edge_sentences(spark, d):
    c = F.col("content")
    return texts(spark, d).select("pk", y.first_sentences(c).alias("first"), y.last_sentences(c).alias("last"))


@query("block_ids", f"WITH {TEXTS} SELECT pk, CASE WHEN b <> '' THEN lower(b) ELSE t END AS block FROM (SELECT pk, t, regexp_extract(t, '(?i)\\b((?:title|text|table|image|summary)_[a-z0-9]+(?:_p[0-9]+)?)\\b', 1) b FROM (SELECT pk, trim({_trim('content')}, '`\"''') t FROM texts))")
def block_ids(spark, d):
    return texts(spark, d).select("pk", y.block_id(F.col("content")).alias("block"))


NAMES = Fixture("id int, name string", (1, "demo"), (2, "My  Base-2"), (3, "耐候钢 库"), (4, "kb_old"), (5, "é"), (6, "___"), (7, "kb_é"))


@query("collection_slugs", f"SELECT id, left(CASE WHEN NOT regexp_matches(n, '[^\\x00-\\x7F]') AND b <> '' THEN CASE WHEN b LIKE 'kb\\_%' ESCAPE '\\' THEN b ELSE 'kb_' || b END WHEN regexp_replace(b, '^kb_', '') = '' THEN 'kb_' || left(sha1(n), 8) ELSE 'kb_' || regexp_replace(b, '^kb_', '') || '_' || left(sha1(n), 8) END, 64) AS slug FROM (SELECT id, trim(name) n, trim(regexp_replace(regexp_replace(lower(trim(name)), '[^a-z0-9_]', '_', 'g'), '_+', '_', 'g'), '_') b FROM {NAMES.sql})")
def collection_slugs(spark, d):
    return NAMES.df(spark).select("id", y.collection_slug(F.col("name")).alias("slug"))


STEMS = Fixture("id int, name string", (1, "up/load/a:b?.pdf"), (2, "耐候钢_JSCX202308015.pdf"), (3, "plain"), (4, "x_HSJJ601.000.pdf"), (5, "dots...pdf"))


@query("document_stems", f"SELECT id, s AS stem, CASE WHEN t = '' THEN s ELSE t END AS title FROM (SELECT id, s, trim(rtrim(regexp_replace(s, '_[A-Z]{{2,8}}[0-9.]+$', ''), '_')) t FROM (SELECT id, left(trim(trim(regexp_replace(regexp_replace(regexp_replace(name, '^.*/', ''), '(.)\\.[^.]*$', '\\1'), '[\\\\/:*?\"<>|\\x00-\\x1f]', '_', 'g')), '.'), 100) s FROM {STEMS.sql}))")
def document_stems(spark, d):
    own = STEMS.df(spark).select("id", y.document_stem(F.col("name")).alias("stem"))
    return own.select("id", "stem", y.document_title(F.col("stem")).alias("title"))


_PLAIN = "regexp_replace(lower(content), '[ \\t\\r\\n,，;；/\\\\.\\-_:：()（）\\[\\]【】]+', '', 'g')"
_CJK = "length(regexp_replace(content, '[^一-鿿]', '', 'g'))"


@query("text_forms", f"WITH {TEXTS} SELECT pk, {_PLAIN} AS plain, CAST({_CJK} + ceil((length(content) - {_CJK}) / 4.0) AS BIGINT) AS tokens, CASE WHEN length(content) > 80 THEN substr(content, 1, 60) || ' … ' || right(content, 20) ELSE content END AS snippet, CASE WHEN length(content) > 100 THEN substr(content, 1, 99) || '…' ELSE content END AS cut FROM texts")
def text_forms(spark, d):
    c = F.col("content")
    return texts(spark, d).select("pk", text.plain_name(c).alias("plain"), text.estimated_tokens(c).alias("tokens"), text.snippet(c, 80).alias("snippet"), text.cut(c, 100).alias("cut"))
