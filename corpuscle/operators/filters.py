"""Predicates over chunks, blocks and hits."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import text

from .retrieval import top_k

#: Pools of chunk types that searches are confined to.
POOLS = ("overview", "content", "prose", "structural")
#: Types whose hits are found by structure and not by meaning.
STRUCTURAL = ("image", "table", "references")
#: Types of layout blocks that carry no text of the document.
NOISE = ("noise", "header", "footer", "page_number")
#: Starts of lines that name a journal, dates of handling or a licence and are no content.
METADATA_LINE = (  # fixed values: what lines of a journal's data start with
    r"(?i)^[ \t]*(?:中\s*图\s*分\s*类\s*号|文\s*献\s*标\s*[识志]\s*码|文\s*章\s*编\s*号|DOI(?:\s*号)?|收\s*稿\s*日\s*期|修\s*回\s*日\s*期|基\s*金\s*项\s*目|作\s*者\s*简\s*介|通\s*[讯信]\s*作\s*者|作\s*者\s*单\s*位"
    r"|CLC\s*number|document\s*code|article\s*id)\s*[:：]"
)
#: Fixed parts of figure and table references in texts.
FIGURE_WORDS, TABLE_WORDS = ("Fig.", "Fig", "Figure", "figure", "图"), ("Table", "table", "TABLE", "表")
MOST_VARIANTS = 12


def years(value: str, column: str = "publication_year") -> Column | None:
    """The filter of ``2003``, ``2003-2006``, also with ~, 到 or 至 between; None for anything else."""
    m = re.fullmatch(r"\s*(\d{4})(?:\s*[-~到至]\s*(\d{4}))?\s*", value or "")
    if not m:
        return None
    first, last = int(m[1]), int(m[2] or m[1])
    return F.col(column).between(min(first, last), max(first, last))


def pool(name: str, column: str = "type") -> Column:
    """Whether a chunk is in the pool."""
    kind = F.col(column)
    return {"overview": kind.isin("summary", "title"), "content": ~kind.isin("summary", "title", "references"), "prose": kind.isin("text", "equation"), "structural": kind.isin("image", "table")}[name]


def in_documents(chunks: DataFrame, docs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Chunks of the given documents; a semi join, so the set may be of any size."""
    return chunks.join(docs.select(doc).distinct(), doc, "left_semi").select(chunks.columns)


def figure_variants(label: str) -> list[str]:
    """How texts write a figure label: with or without blank, panels in brackets first, supplements with S; 12 at most."""
    label = label.strip()
    panel = re.fullmatch(r"(\d+)([A-Za-z])", label)
    out = []
    if panel:
        number, letter = panel[1], panel[2]
        out += [f"{w}{number}({c})" for w in ("Fig. ", "Fig ", "Figure ") for c in (letter.lower(), letter.upper())]
        out += [f"图{number}({letter.lower()})", f"图 {number}({letter.lower()})"]
        out += [f"Fig. {label}", f"Fig.{label}", f"Figure {label}", f"图 {label}"]
    out += [f"{w}{gap}{label}" for w in FIGURE_WORDS for gap in (" ", "")]
    extra = label if label.isdigit() else label[1:] if re.fullmatch(r"[Ss]\d+", label) else ""
    if extra:
        out += [f"{w}{gap}{extra}" for w in ("Fig.S", "Fig. S", "Fig S") for gap in ("", " ")]
    return list(dict.fromkeys(out))[:MOST_VARIANTS]


def table_variants(label: str) -> list[str]:
    """How texts write a table label; 12 at most."""
    return [f"{w}{gap}{label.strip()}" for w in TABLE_WORDS for gap in (" ", "")][:MOST_VARIANTS]


def matching_labels(chunks: DataFrame, variants: Mapping[str, Sequence[str]], value: str = "content") -> DataFrame:
    """``(label, pk)`` for each chunk and label one of whose variants it has."""
    found = F.array(*(F.when(text.contains_any(F.col(value), v), label) for label, v in variants.items()))
    return chunks.select(F.explode(F.array_compact(found)).alias("label"), "pk")


def entity(name: str, value: str = "content") -> Column:
    """Whether the value has the name as given, in lower or in upper case; mixed case of another form doesn't count."""
    return text.contains_any(F.col(value), list(dict.fromkeys([name, name.lower(), name.upper()])))


def structured(chunks: DataFrame, pages: Sequence[int] = (), paragraphs: Sequence[int] = (), entities: Sequence[str] = (), k: int = 10, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """Chunks on one of the pages (from 1), with one of the paragraph numbers and one of the entities, each where given.

    The score is 1 for the page, 1 for the paragraph and 2 for each entity in any case; the k best of each group.
    """
    page = F.col("page_start").isin(*(max(0, p - 1) for p in pages)) if pages else None
    paragraph = F.col("paragraph_index").isin(*paragraphs) if paragraphs else None
    named = reduce(or_, [entity(e) for e in entities]) if entities else None
    points = [c.cast("int") for c in (page, paragraph) if c is not None]
    points += [2 * F.contains(F.lower("content"), F.lit(e.lower())).cast("int") for e in entities]
    score = reduce(add, points, F.lit(0)).cast("double")
    return top_k(chunks.where(text.all_of(page, paragraph, named)).withColumn("score", score), k, by)


def navigation() -> Column:
    """Whether a chunk is a summary or starts like an abstract or a list of keywords."""
    head = r"(?i)^[ ]*(?:\[[^\]]*\][ ]*)*(?:abstract|key[ ]*words?)(?:[^a-z0-9_]|$)|^[ ]*(?:\[[^\]]*\][ ]*)*(?:摘[ ]*要|关[ ]*键[ ]*词)"
    return (F.lower("type") == "summary") | F.substring("content", 1, 80).rlike(head) | F.lower(F.trim("section")).isin("abstract", "摘要", "keywords", "key words", "关键词")


def readable_block(least: float) -> Column:
    """Whether a layout block is shown, sure enough and no noise."""
    return ~F.col("type").isin(*NOISE) & ~F.coalesce("hidden", F.lit(False)) & (F.coalesce("conf", F.lit(1.0)) >= least)


def garbled(value: str) -> Column:
    """Whether less than three tenths of a text of more than two characters are letters, digits or CJK."""
    return (F.length(value) > 2) & (F.length(F.regexp_replace(value, "[^A-Za-z0-9一-鿿]", "")) / F.length(value) < 0.3)


def metadata_line(value: str) -> Column:
    """Whether a short line only names the journal, dates of handling or the licence."""
    return (F.length(value) <= 120) & F.trim(value).rlike(METADATA_LINE)


def base_route(route: str = "route") -> Column:
    """A route without the prefix of its sub-question."""
    return F.regexp_replace(route, "^.*:", "")


def reflect_eligible() -> Column:
    """Whether a hit says something about the meaning of an answer: not from metadata and not structural."""
    return (base_route() != "metadata") & ~F.col("type").isin(*STRUCTURAL)


def route_type(route: Column, chunk_type: Column, handled: Column) -> Column:
    """The chunk type that a route keeps: none for summaries, nor for images and tables that metadata handles."""
    free = F.when(chunk_type != "", chunk_type)
    return F.when(route == "summary", None).when(route.isin("progressive", "local") & handled & chunk_type.isin("image", "table"), None).otherwise(free)
