"""Hits as text for a language model, summaries of documents, citations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import first_by

#: What stands between two chunks, and instead of any.
BETWEEN, NOTHING = "\n\n---\n\n", "[No relevant context retrieved]"
#: How a chunk id looks inside brackets.
CHUNK_ID = "[a-z]+_[0-9a-f]{4,}"


def heading() -> Column:
    """The line above a chunk: rank, type, where it was found, scores, document, page, id and year."""
    scores = F.concat_ws(", ", F.when(F.col("rrf") != 0, F.format_string("rrf=%.4f", "rrf")), F.when(F.col("score") != 0, F.format_string("raw=%.3f", "score")))
    year = F.when(F.col("year") != 0, F.concat(F.lit("year="), F.col("year").cast("string")))
    return F.concat_ws(
        " | ", F.concat(F.lit("## ["), F.col("rank").cast("string"), F.lit("] "), F.upper("type")), F.concat(F.lit("source="), F.coalesce(F.nullif(F.concat_ws("+", "sources"), F.lit("")), F.lit("?"))),
        F.coalesce(F.nullif(scores, F.lit("")), F.lit("n/a")), F.concat(F.lit("doc="), "doc_id"), F.concat(F.lit("page="), F.col("page").cast("string")), F.concat(F.lit("chunk_id="), "chunk_id"), year,
    )


def rendered(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """One text for each query: the question, the number of chunks, then each chunk under its heading, in order of rank."""
    part = lambda column, before: F.when(F.coalesce(F.col(column), F.lit("")) != "", F.concat(F.lit(before), F.col(column)))
    block = F.concat_ws("\n", heading(), part("section", "**Section:** "), part("content", "\n"))
    blocks = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("t")))), lambda x: x["t"]).alias("blocks"))
    title = F.concat(F.lit("# Retrieved Context ("), F.size("blocks").cast("string"), F.lit(" chunks)"))
    text = F.concat_ws(BETWEEN, F.concat(F.lit("# Query\n"), "question"), title, "blocks")
    return queries.join(blocks, "query_id", "left").select("query_id", F.when(F.col("blocks").isNull(), NOTHING).otherwise(text).alias("context"))


def summaries(chunks: DataFrame) -> DataFrame:
    """Title and summary of each document: its first summary, else its first text."""
    place = F.when(F.col("type") == "summary", 0).otherwise(1)
    best = first_by(chunks.where("type IN ('summary', 'text')"), ["doc_id"], place, F.col("paragraph_index")).select("doc_id", F.trim("content").alias("summary"))
    title = first_by(chunks.where("type = 'title'"), ["doc_id"], F.col("paragraph_index")).select("doc_id", F.trim("content").alias("title"))
    return best.join(title, "doc_id", "full")


def kept_context(blocks: DataFrame, docs: DataFrame) -> DataFrame:
    """Blocks of an earlier context that belong to the named documents; all of a session's blocks where none does."""
    marked = blocks.join(docs.select("session_id", "doc_id").distinct().withColumn("__hit", F.lit(1)), ["session_id", "doc_id"], "left")
    some = marked.groupBy("session_id").agg(F.max("__hit").alias("__any"))
    return marked.join(some, "session_id").where("__hit = 1 OR __any IS NULL").drop("__hit", "__any")


def citations(answers: DataFrame) -> DataFrame:
    """Chunk ids in brackets of each answer, numbered by first appearance."""
    ids = F.flatten(F.transform(F.regexp_extract_all("answer", F.lit(rf"(?i)\[[^\[\]\n]*?{CHUNK_ID}[^\[\]\n]*?\]"), F.lit(0)), lambda m: F.regexp_extract_all(m, F.lit(f"(?i){CHUNK_ID}"), F.lit(0))))
    numbered = answers.select("answer_id", F.posexplode(F.array_distinct(ids)).alias("at", "chunk_id"))
    return numbered.select("answer_id", "chunk_id", (F.col("at") + 1).alias("number"))


def hit_lines(rank: Column) -> Column:
    """A chunk under its line: rank, type, id, document, section, page and paragraph from 1, year; figures with their context."""
    head = F.concat_ws(
        " | ", F.concat(F.lit("["), rank.cast("string"), F.lit("] "), F.upper("type")), F.concat(F.lit("chunk_id="), "pk"), F.concat(F.lit("doc="), "doc_id"), F.concat(F.lit("section="), F.nullif("section", F.lit(""))),
        F.when(F.col("page_start") >= 0, F.concat(F.lit("page="), (F.col("page_start") + 1).cast("string"))), F.when(F.col("paragraph_index") >= 1, F.concat(F.lit("para="), F.col("paragraph_index").cast("string"))),
        F.when(F.col("publication_year") != 0, F.concat(F.lit("year="), F.col("publication_year").cast("string"))),
    )
    more = F.when(F.col("type").isin("image", "table") & (F.coalesce("context", F.lit("")) != ""), F.concat(F.lit("[Related Section Context]\n"), F.col("context")))
    return F.concat_ws("\n", head, F.nullif("content", F.lit("")), more)


def routed(queries: DataFrame, hits: DataFrame, routes: Sequence[str], route_chars: int = 10_000, most_chars: int = 24_000) -> DataFrame:
    """``(query_id, context, cut)``: hits route by route within budgets; a chunk that is there already gets a line that points to it.

    hits: (query_id, route, rank, pk, ...). A route takes hits in order until the first that no longer fits its budget, or
    what is left of the whole. Routes are few and fixed, so they are gone through one after the other in one plan.
    """
    state = queries.select("query_id", F.concat(F.lit("# Query\n"), F.coalesce("question", F.lit(""))).alias("context"), F.lit(False).alias("cut"))
    seen = hits.select("query_id", "pk").where("false").withColumn("at", F.lit(""))
    for route in routes:
        own = hits.where(F.col("route") == route).join(seen, ["query_id", "pk"], "left").join(state.select("query_id", F.length("context").alias("used")), "query_id")
        line = F.when(F.col("at").isNotNull(), F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] (shown as "), F.col("at"), F.lit(", chunk_id="), F.col("pk"), F.lit(")"))).otherwise(hit_lines(F.col("rank")))
        head = f"# From [{route}]"
        order = Window.partitionBy("query_id").orderBy("rank", "pk")
        summed = own.withColumn("line", line).withColumn("sum", F.sum(F.length("line") + 2).over(order) + len(head))
        kept = summed.withColumn("fits", F.col("sum") <= F.least(F.lit(route_chars), F.lit(most_chars) - F.col("used")))
        shown = kept.where("fits")
        block = shown.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "pk", "line"))), lambda x: x["line"]), "\n\n").alias("lines"))
        over = kept.groupBy("query_id").agg(F.max(~F.col("fits")).alias("over"))
        text = F.concat(F.col("context"), F.lit(BETWEEN), F.lit(head), F.lit("\n\n"), F.coalesce("lines", F.lit("*(nothing found)*")))
        full = F.length("context") >= most_chars
        state = state.join(block, "query_id", "left").join(over, "query_id", "left").select("query_id", F.when(full, F.col("context")).otherwise(text).alias("context"), (F.col("cut") | full | F.coalesce("over", F.lit(False))).alias("cut"))
        fresh = shown.where("at IS NULL").select("query_id", "pk", F.concat(F.lit(f"[{route}] #"), F.col("rank").cast("string")).alias("at"))
        seen = seen.unionByName(fresh)
    return state


def full_text(chunks: DataFrame) -> DataFrame:
    """``(doc_id, text)``: a document's chunks in order, each under its id."""
    block = F.concat(F.lit("["), F.col("pk"), F.lit("]\n"), F.trim("content"))
    return chunks.where("trim(content) != ''").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paragraph_index", "pk", block.alias("t")))), lambda x: x["t"]), "\n\n").alias("text"))
