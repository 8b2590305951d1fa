"""Chunks from page layout: blocks in order, paragraphs put together, sections, references, figures, summaries."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpuscle.functions import layout as y, questions
from corpuscle.functions.paragraphs import joined
from corpuscle.sources.shared import stored

from . import filters

_RUN = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("content", T.StringType())]))
_CONTENT = T.StructType(
    [T.StructField(c, _RUN) for c in ("title_content", "paragraph_content", "image_caption", "image_footnote", "table_caption", "table_footnote")]
    + [T.StructField("list_type", T.StringType()), T.StructField("list_items", T.ArrayType(T.StructType([T.StructField("item_content", _RUN)])))]
    + [T.StructField("image_source", T.StructType([T.StructField("path", T.StringType())])), T.StructField("html", T.StringType()), T.StructField("math_content", T.StringType())]
)
#: A layout file: pages of blocks, each with its type and the content of that type.
PAGES = T.ArrayType(T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("content", _CONTENT)])))
#: Titles of sections that are a summary.
SUMMARY_TITLE = r"(?i)\babstract\b|\bexecutive\s+summary\b|\bsynopsis\b|\bsummary\b|\boverview\b|\btl;?\s*dr\b|摘\s*要|概\s*要|提\s*要|梗\s*概"
#: Where a long text may be cut, in the order in which the places are tried: paragraphs, sentences, semicolons, commas.
CUTS = (r"\n{2,}", r"(?<=[。！？!?])\s*", r"(?<=[；;])\s*", r"(?<=[，,])\s*")
#: Paragraphs that are handed on together.
JOINED_ROWS = 1_000
#: References in one chunk.
BATCH = 5


def inline(runs: Column) -> Column:
    """Runs of text and formulas as one line."""
    part = lambda r: F.when(r["type"] == "equation_inline", F.concat(F.lit("$"), F.trim(r["content"]), F.lit("$"))).otherwise(F.trim(r["content"]))
    kept = F.filter(F.transform(F.coalesce(runs, F.array().cast(_RUN)), part), lambda p: F.coalesce(p, F.lit("")) != "")
    return y.despaced(F.regexp_replace(F.array_join(kept, " "), r"\s+", " "))


def items(files: DataFrame) -> DataFrame:
    """``(doc_id, page, pos, type, text, entries, caption, note, path, html)`` of files (doc_id, layout), layout being JSON."""
    pages = files.select("doc_id", F.posexplode(F.from_json("layout", PAGES)).alias("page", "blocks"))
    rows = pages.select("doc_id", "page", F.posexplode("blocks").alias("at", "b"))
    c = F.col("b.content")
    either = lambda a, b: F.when(F.col("b.type") == "image", inline(c[a])).otherwise(inline(c[b]))
    text = F.when(F.col("b.type") == "title", inline(c["title_content"])).when(F.col("b.type") == "equation_interline", F.trim(c["math_content"])).otherwise(inline(c["paragraph_content"]))
    kind = F.when(F.col("b.type") == "equation_interline", "equation").when((F.col("b.type") == "list") & (F.lower(c["list_type"]) == "reference_list"), "reference_list").otherwise(F.col("b.type"))
    entries = F.transform(F.coalesce(c["list_items"], F.array().cast(_CONTENT["list_items"].dataType)), lambda i: inline(i["item_content"]))
    return rows.select(
        "doc_id", "page", (F.col("page") * 100_000 + F.col("at")).alias("pos"), kind.alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.filter(entries, lambda e: e != "").alias("entries"),
        either("image_caption", "table_caption").alias("caption"), either("image_footnote", "table_footnote").alias("note"), F.coalesce(c["image_source"]["path"], F.lit("")).alias("path"), F.coalesce(F.trim(c["html"]), F.lit("")).alias("html"),
    )


def leaves(pages: DataFrame, least_confidence: float = 0.0) -> DataFrame:
    """``(doc_id, page, block, ord, type, text, group)`` of nested blocks (doc_id, tree: JSON pages), each block once.

    group is the block number of the nearest container. Hidden and unsure blocks go, as the flat layout has it. Levels are
    unfolded one after the other until none has children, and each is stored, so that no level is read from the first again;
    only their number comes to the driver.
    """
    node = "struct<type:string,page:int,block:int,order:int,text:string,conf:double,hidden:boolean,items:string>"
    level = pages.select("doc_id", F.explode(F.from_json("tree", "array<array<string>>")).alias("p")).select("doc_id", F.explode("p").alias("json"), F.lit(None).cast("int").alias("group"))
    out = None
    while True:
        own = level.select("doc_id", "group", F.from_json("json", node).alias("n"))
        holder = F.coalesce(F.col("n.type").isin("group", "figuregroup", "tablegroup"), F.lit(False))
        sure = ~F.coalesce(F.col("n.hidden"), F.lit(False)) & (F.coalesce(F.col("n.conf"), F.lit(1.0)) >= least_confidence) & (F.coalesce(F.col("n.type"), F.lit("")) != "noise")
        part = own.where(~holder & sure).select("doc_id", "n.page", "n.block", F.col("n.order").alias("ord"), "n.type", "n.text", "group")
        out = part if out is None else out.unionByName(part)
        inner = own.where(F.col("n.items").isNotNull() & (holder | sure)).select("doc_id", F.explode(F.from_json("n.items", "array<string>")).alias("json"), F.when(holder, F.col("n.block")).otherwise(F.col("group")).alias("group"))
        level = stored(inner, "blocks")
        if level.isEmpty():
            break
    first = Window.partitionBy("doc_id", "page", "block").orderBy(F.col("group").isNull(), "ord")
    return out.withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")


def paragraphs(rows: DataFrame) -> DataFrame:
    """``(doc_id, section_pos, section, pos, page, text)``: paragraphs of items (with section) put together.

    A paragraph takes the next one by all that it has become, and short ones go with the one before. A window marks where
    nothing may be joined and leaves the rows of a document in one partition, in order; one pass over it joins them and
    holds no more than two paragraphs.
    """
    line = Window.partitionBy("doc_id").orderBy("pos")
    near = (F.lag("type").over(line) == "paragraph") & (F.lag("section_pos").over(line) == F.col("section_pos"))
    kept = rows.where(F.col("type").isin("paragraph", "equation", "list", "reference_list", "title") & ~((F.col("type") == "paragraph") & ((y.stripped(F.col("text")) == "") | filters.metadata_line("text"))))
    marked = kept.select("doc_id", "section_pos", "section", "pos", "page", "type", "text", (~F.coalesce(near, F.lit(False))).alias("apart")).where("type = 'paragraph'").drop("type")
    shape = marked.select("doc_id", "section_pos", "section", "pos", "page", "text").schema

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("doc_id", "section_pos", "section", "pos", "page", "text", "apart")
        lines = (row for b in batches for row in zip(*(b.column(n).to_pylist() for n in names), strict=True))
        found = joined(((row[:3], row[3], row[4], row[5], row[6]) for row in lines))
        while part := list(islice(found, JOINED_ROWS)):
            values = zip(*((*key, pos, page, text) for key, pos, page, text in part), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(values, to_arrow_schema(shape), strict=True)], names=shape.names)

    return marked.sortWithinPartitions("doc_id", "pos").mapInArrow(join, shape)


def with_sections(rows: DataFrame) -> DataFrame:
    """Items with the title they stand under and its place; titles that can't be read count as none."""
    line = Window.partitionBy("doc_id").orderBy("pos")
    title = F.when(F.col("type") == "title", F.when(filters.garbled("text"), "").otherwise(F.col("text")))
    at = F.last(F.when(F.col("type") == "title", F.col("pos")), ignorenulls=True).over(line)
    return rows.withColumn("section", F.coalesce(F.last(title, ignorenulls=True).over(line), F.lit(""))).withColumn("section_pos", F.coalesce(at, F.lit(-1)))


def entries(rows: DataFrame) -> DataFrame:
    """``(doc_id, section_pos, n, pos, page, entry)``: references of pieces (doc_id, section_pos, pos, page, piece) in order.

    Noise goes; a piece that doesn't start a reference goes on with the one before, without a hyphen's blank.
    """
    line = Window.partitionBy("doc_id", "section_pos").orderBy("pos", "at")
    pieces = rows.where(~y.is_reference_noise(F.col("piece")))
    marked = pieces.withColumn("n", F.sum((y.is_entry_start(F.col("piece")) | (F.row_number().over(line) == 1)).cast("int")).over(line))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "at", "piece"))), lambda x: x["piece"])
    seam = lambda a, x: F.when(a.rlike("[-－—]$"), F.concat(a, F.ltrim(x))).otherwise(y.fused(a, x))
    own = marked.groupBy("doc_id", "section_pos", "n").agg(F.min("pos").alias("pos"), F.min("page").alias("page"), F.aggregate(parts, F.lit(""), seam).alias("entry"))
    return own.where((F.length("entry") >= 6) | y.is_entry_start(F.col("entry")))


def asset_content(kind: Column, caption: Column, html: Column, path: Column) -> Column:
    """What the chunk of a figure or table holds: caption, table, path."""
    none = F.when(kind == "image", "[Image without caption]").otherwise("[Table without caption]")
    at = F.when(kind == "image", "[Image Path] ").otherwise("[Table Image Path] ")
    head = F.when(caption != "", F.concat(F.lit("[Caption] "), caption)).otherwise(none)
    return F.concat_ws("\n", head, F.when((kind == "table") & (html != ""), F.concat(F.lit("[Table HTML]\n"), html)), F.when(path != "", F.concat(at, path)))


def chunks(rows: DataFrame) -> DataFrame:
    """``(doc_id, pk, type, section, page_start, paragraph_index, content, context, label)`` of items, see :func:`items`.

    A title chunk, summaries of sections that are one, paragraphs, equations with the sentences around them, figures and
    tables, references by fives. A document without a summary gets one from its first page's paragraph that starts as one.
    """
    own = with_sections(rows)
    line = Window.partitionBy("doc_id").orderBy("pos")
    listed = own.where((F.col("type") == "reference_list") | (F.col("type").isin("paragraph", "list") & y.is_references_title(F.col("section"))))
    split = listed.select("doc_id", "section_pos", "pos", "page", F.posexplode(F.when(F.size("entries") > 0, F.col("entries")).otherwise(F.array("text"))).alias("e", "t"))
    split = split.select("doc_id", "section_pos", "pos", "page", "e", F.posexplode(y.inline_entries(F.col("t"))).alias("i", "piece")).withColumn("at", F.col("e") * 10_000 + F.col("i"))
    found = entries(split)
    ordered = found.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy("doc_id", "section_pos").orderBy("n")) - 1) / BATCH))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("n", "entry"))), lambda x: x["entry"])
    shape = ["doc_id", "pos", "page", "type", "section", "content", "context", "label"]
    blank = F.lit("")
    references = ordered.groupBy("doc_id", "section_pos", "batch").agg(F.min("pos").alias("pos"), F.min("page").alias("page"), F.array_join(texts, "\n").alias("content")).select("doc_id", "pos", "page", F.lit("references").alias("type"), F.lit("References").alias("section"), "content", blank.alias("context"), F.lit(None).cast("string").alias("label"), F.col("batch").cast("int").alias("part"))

    prose = paragraphs(own.where(~y.is_references_title(F.col("section"))))
    is_summary = F.col("section").rlike(SUMMARY_TITLE)
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n\n")
    summaries = prose.where(is_summary).groupBy("doc_id", "section_pos", "section").agg(F.min("pos").alias("pos"), F.min("page").alias("page"), y.summary_body(parts).alias("content")).where("content != ''")
    summaries = summaries.select("doc_id", "pos", "page", F.lit("summary").alias("type"), "section", "content", blank.alias("context"), F.lit(None).cast("string").alias("label"))
    plain = prose.where(~is_summary).select("doc_id", "pos", "page", F.lit("text").alias("type"), "section", F.col("text").alias("content"), blank.alias("context"), F.lit(None).cast("string").alias("label"))
    text = promoted(plain, summaries)

    around = lambda f, side: F.coalesce(f(F.when(F.col("type") == "paragraph", F.col("text")), ignorenulls=True).over(Window.partitionBy("doc_id", "section_pos").orderBy("pos").rowsBetween(*side)), blank)
    before, after = around(F.last, (Window.unboundedPreceding, -1)), around(F.first, (1, Window.unboundedFollowing))
    formulas = own.withColumn("before", before).withColumn("after", after).where("type = 'equation' AND text != ''")
    formulas = formulas.select("doc_id", "pos", "page", "type", "section", F.col("text").alias("content"), F.array_join(F.filter(F.array(y.last_sentences(F.col("before")), y.first_sentences(F.col("after"))), lambda s: s != ""), "\n").alias("context"), F.lit(None).cast("string").alias("label"))
    assets = own.where("type IN ('image', 'table')").select("doc_id", "pos", "page", "type", "section", asset_content(F.col("type"), F.col("caption"), F.col("html"), F.col("path")).alias("content"), F.col("note").alias("context"), y.caption_label(F.col("caption"), F.col("type")).alias("label"))
    titles = own.where("type = 'title' AND section != ''").withColumn("k", F.row_number().over(line)).where("k = 1").select("doc_id", "pos", "page", "type", "section", F.col("text").alias("content"), blank.alias("context"), F.lit(None).cast("string").alias("label"))

    every = references.select(*shape, "part")
    for part in (titles, text, formulas, assets):
        every = every.unionByName(part.select(*shape, F.lit(0).alias("part")))
    counted = F.col("type").isin("text", "summary").cast("int")
    number = F.when(counted == 1, F.sum(counted).over(line)).otherwise(-1).cast("int")
    return every.select("doc_id", F.concat_ws("::", "doc_id", F.concat(F.col("type"), F.lit("_"), F.lpad(F.lower(F.hex("pos")), 8, "0"), F.when(F.col("part") > 0, F.format_string("_p%03d", "part")).otherwise(""))).alias("pk"), "type", "section", F.col("page").alias("page_start"), number.alias("paragraph_index"), "content", "context", "label")


def promoted(texts: DataFrame, summaries: DataFrame) -> DataFrame:
    """Texts and summaries; of a document without a summary the first text that starts as one, on its first page, is it."""
    lone = texts.join(summaries.select("doc_id").distinct(), "doc_id", "left_anti").where(F.col("page") == 0).where(y.is_summary_head(F.col("content"))).withColumn("body", y.summary_body(F.col("content"))).where("body != ''")
    first = lone.groupBy("doc_id").agg(F.min("pos").alias("pos"), F.min_by("body", "pos").alias("body"))
    changed = texts.join(first, ["doc_id", "pos"], "left").withColumn("type", F.when(F.col("body").isNotNull(), "summary").otherwise(F.col("type"))).withColumn("content", F.coalesce("body", "content")).drop("body")
    return changed.unionByName(summaries.select(changed.columns))


def _cut(text: str, most: int, level: int = 0) -> list[str]:
    text = text.strip()
    if len(text) <= most:
        return [text] if text else []
    for k in range(level, len(CUTS)):
        parts = [p for p in re.split(CUTS[k], text) if p.strip()]
        if len(parts) > 1:  # what is cut at a level has no such place left
            return [x for p in parts for x in _cut(p, most, k + 1)]
    return [text[i : i + most] for i in range(0, len(text), most)]


def pieces(value: Column, most: int) -> Column:
    """A text cut to pieces of at most ``most`` characters, at the strongest places first."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else _cut(t, most))

    return cut(value)


def _seam(a: str, b: str) -> str:
    return a + b if "\u4e00" <= b[:1] <= "\u9fff" or not a else f"{a} {b}"


def _grouped(parts: list[str], breaks: list[bool], target: int, most: int, least: int, overlap: int = 0) -> list[str]:
    groups: list[list[str]] = [[]]
    size = 0
    for p, ends in zip(parts, breaks, strict=True):
        groups[-1].append(p)
        size += len(p)
        if size >= most or (size >= target and ends):
            groups.append([])
            size = 0
    text = lambda g: reduce(_seam, g, "").strip()
    out: list[list[str]] = []
    fits = lambda a, b: len(text(a)) + len(text(b)) <= most
    for g in filter(None, groups):
        if out and len(text(out[-1])) < least and fits(out[-1], g):
            out[-1] = out[-1] + g
        else:
            out.append(g)
    if len(out) > 1 and len(text(out[-1])) < least and fits(out[-2], out[-1]):
        out[-2:] = [out[-2] + out[-1]]
    shown = [text(g) for g in out]
    for k in range(len(out) - 1, 0, -1) if overlap else ():
        tail: list[str] = []
        for p in reversed(out[k - 1]):
            if tail and sum(map(len, tail)) + len(p) > overlap:
                break
            tail.insert(0, p)
            if sum(map(len, tail)) >= overlap:
                break
        if len(longer := _seam(text(tail), shown[k])) <= most:
            shown[k] = longer
    return shown


def merged(parts: Column, target: int, most: int, least: int, breaks: Column | None = None, overlap: int = 0) -> Column:
    """Sentences in groups: closed at ``target`` characters where the text breaks (``breaks``, anywhere if None), at ``most`` anyway.

    Groups under ``least`` go with the next, the last with the one before, where that fits. ``overlap`` repeats whole
    sentences of that many characters before the next group, where that fits.
    """

    @F.pandas_udf("array<string>")
    def group(lists: pd.Series, marks: pd.Series) -> pd.Series:
        return pd.Series([[] if x is None else _grouped(list(x), list(m), target, most, least, overlap) for x, m in zip(lists, marks, strict=True)])

    return group(parts, F.transform(parts, lambda _: F.lit(True)) if breaks is None else breaks)


def semantic_pieces(sentences: DataFrame, target: int, most: int, least: int, share: float = 0.85, overlap: int = 0) -> DataFrame:
    """``(doc_id, at, piece)`` of sentences (doc_id, pos, text, embedding): groups that end where the subject changes.

    A sentence ends a subject where its vector's cosine distance to the next is among the greatest of its document: at
    the percentile ``share`` or over it.
    """
    line = Window.partitionBy("doc_id").orderBy("pos")
    after = F.lead("embedding").over(line)
    far = sentences.withColumn("d", F.when(after.isNotNull(), 1 - questions.cosine(F.col("embedding"), after)))
    marked = far.withColumn("least", F.percentile("d", share).over(Window.partitionBy("doc_id"))).withColumn("ends", F.coalesce(F.col("d") >= F.col("least"), F.lit(False)))
    own = marked.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text", "ends"))).alias("s"))
    parts = own.select("doc_id", merged(F.transform("s", lambda x: x["text"]), target, most, least, F.transform("s", lambda x: x["ends"]), overlap).alias("p"))
    return parts.select("doc_id", F.posexplode("p").alias("at", "piece"))


def summary_sections(sections: DataFrame, asked: DataFrame, scores: DataFrame, least: float = 0.5, most: int = 2) -> DataFrame:
    """``(doc_id, section, tier)``: sections that are a summary, by their titles, else by BM25 of the titles, ``most`` a document.

    sections: (doc_id, pos, section); scores: (doc_id, section, score) of the summary words asked for in ``asked``.
    """
    ruled = sections.where(F.col("section").rlike(SUMMARY_TITLE)).select("doc_id", "pos", "section", F.lit(1).alias("tier"))
    best = scores.join(asked.select("query_id"), "query_id", "left_semi").groupBy("doc_id", "section").agg(F.max("score").alias("score")).where(F.col("score") >= least)
    scored = sections.join(best, ["doc_id", "section"]).join(ruled.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "pos", "section", F.lit(2).alias("tier"))
    order = Window.partitionBy("doc_id").orderBy("pos")
    return ruled.unionByName(scored).withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).select("doc_id", "section", "tier")


def mean_vectors(rows: DataFrame, keys: list[str], dim: int, *others: Column) -> DataFrame:
    """``(keys, others, embedding)``: the mean of the vectors of ``dim`` components of each group, other aggregates beside it.

    Component by component, so that it is summed before the shuffle. Vectors that are null, of another size or hold what is
    not finite take no part; a group without any has a null.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    own = rows.withColumn("embedding", F.when((F.size("embedding") == dim) & finite, F.col("embedding")))
    parts = [F.avg(F.get(F.col("embedding"), F.lit(i)).cast("double")).alias(f"__{i}") for i in range(dim)]
    sums = own.groupBy(*keys).agg(*others, *parts)
    vector = F.when(F.col("__0").isNotNull(), F.array(*(f"__{i}" for i in range(dim))))
    return sums.withColumn("embedding", vector).drop(*(f"__{i}" for i in range(dim)))


def summary_sections_by_vectors(sections: DataFrame, prototypes: DataFrame, by: str, least: float = 0.5, most: int = 2) -> DataFrame:
    """``(doc_id, section, tier, score)``: sections that are a summary, by their titles, else by their vectors, ``most`` a document.

    sections: (doc_id, pos, section, title, embedding, by); prototypes: (by, embedding) of texts known as summaries. What
    counts is the sum of the cosines to the prototypes under the same ``by``, such as the language; it is rounded to six
    digits, and the greatest come first, earlier sections before later ones. A title settles its document and has no score.
    """
    ruled = sections.where(F.col("title").rlike(SUMMARY_TITLE)).select("doc_id", "pos", "section", F.lit(1).alias("tier"), F.lit(None).cast("double").alias("score"))
    known = prototypes.where("embedding IS NOT NULL").select(F.col(by).alias("__by"), F.col("embedding").alias("__to"))
    near = sections.where("embedding IS NOT NULL").join(ruled.select("doc_id").distinct(), "doc_id", "left_anti").join(known, F.col(by).eqNullSafe(F.col("__by")))
    scored = near.groupBy("doc_id", "pos", "section").agg(F.round(F.sum(questions.cosine(F.col("embedding"), F.col("__to"))), 6).alias("score")).where(F.col("score") >= least)
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), "pos", "section")
    return ruled.unionByName(scored.select("doc_id", "pos", "section", F.lit(3).alias("tier"), "score")).withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).select("doc_id", "section", "tier", "score")


def with_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks with their vectors by key; an error where a chunk has none or more than one."""
    n = vectors.groupBy("pk").agg(F.count("*").alias("n"), F.first("embedding").alias("embedding"))
    both = chunks.join(n, "pk", "left")
    wrong = F.raise_error(F.concat(F.lit("vectors of "), F.col("pk"), F.lit(": "), F.coalesce(F.col("n"), F.lit(0)).cast("string")))
    return both.withColumn("embedding", F.when(F.col("n") == 1, F.col("embedding")).otherwise(wrong)).drop("n")
