"""Chunks that belong together: neighbours, cross references, captions and names of documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions import text


def by_assets(seeds: DataFrame, chunks: DataFrame, same_document: bool = True) -> DataFrame:
    """Chunks that the seeds' related assets name; within the seed's document unless told otherwise."""
    wanted = seeds.select("query_id", F.col("doc_id").alias("seed_doc"), F.explode("related").alias("chunk_id"))
    on = (F.col("w.chunk_id") == F.col("c.chunk_id")) & ((F.col("w.seed_doc") == F.col("c.doc_id")) if same_document else F.lit(True))
    return wanted.alias("w").join(chunks.alias("c"), on).select("query_id", "c.pk").distinct()


def within(seeds: DataFrame, chunks: DataFrame, column: str, width: int, least: int = 0) -> DataFrame:
    """Chunks of the seed's document at most ``width`` away in an ordinal column; an equi-join on every ordinal in reach."""
    reach = F.explode(F.sequence(F.col(column) - width, F.col(column) + width)).alias(column)
    wanted = seeds.where(F.col(column) >= least).select("query_id", "doc_id", F.col("pk").alias("seed"), reach)
    found = wanted.join(chunks.where(F.col(column) >= least).select("pk", "doc_id", column), ["doc_id", column])
    return found.where("pk != seed").select("query_id", "pk").distinct()


def expanded(parts: Sequence[tuple[str, DataFrame]], seeds: DataFrame, cap: int) -> DataFrame:
    """Neighbours of several modes without the seeds: each once, by order of modes then key, ``cap`` for each question."""
    both = None
    for place, (mode, found) in enumerate(parts):
        part = found.select("query_id", "pk", F.lit(mode).alias("mode"), F.lit(place).alias("place"))
        both = part if both is None else both.unionByName(part)
    fresh = both.join(seeds.select("query_id", "pk").distinct(), ["query_id", "pk"], "left_anti")
    once = fresh.groupBy("query_id", "pk").agg(F.min("place").alias("place"), F.min_by("mode", "place").alias("mode"))
    order = Window.partitionBy("query_id").orderBy("place", "pk")
    return once.withColumn("n", F.row_number().over(order)).where(F.col("n") <= cap).select("query_id", "pk", "mode", "n")


def without_known(hits: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """Hits that are not known yet, the k best of each question."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "pk")
    return hits.join(known, ["query_id", "pk"], "left_anti").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Length of the pieces by which names are looked up inside each other; shorter names are only found whole.
GRAM = 4


def _grams(names: DataFrame) -> DataFrame:
    """``(s, gram)``: the pieces of each name, each once."""
    long = names.where(F.length("s") >= GRAM)
    pieces = F.transform(F.sequence(F.lit(1), F.length("s") - GRAM + 1), lambda i: F.substring("s", i, F.lit(GRAM)))
    return long.select("s", F.explode(F.array_distinct(pieces)).alias("gram"))


def contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """``(inner, outer)``: the names (s) of one table that are inside names (s) of the other, of GRAM characters and more.

    A name can only be inside one that has all its pieces: the piece of it that is rarest among the outer names finds the
    candidates by an equi-join, and they are checked. Names with a piece that no outer name has go at once.
    """
    where = _grams(outer.distinct())
    often = where.groupBy("gram").agg(F.count("*").alias("n"))
    keys = _grams(inner.distinct()).join(often, "gram", "left").groupBy("s").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.bool_and(F.col("n").isNotNull()).alias("every")).where("every")
    pairs = keys.select(F.col("s").alias("inner"), "gram").join(where.select(F.col("s").alias("outer"), "gram"), "gram")
    return pairs.where(F.contains("outer", F.col("inner"))).select("inner", "outer")


def registry_match(names: DataFrame, registry: DataFrame) -> DataFrame:
    """The registry entry that each name means: same id or name first, then one name inside the other (four characters at least).

    Within a tier the earlier entry wins. All steps are equi-joins, of names and registries of any size.
    """
    own = names.select("name", text.plain_name(F.col("name")).alias("n")).where("n != ''").distinct()
    reg = registry.select("pos", "doc_id", text.plain_name(F.col("doc_name")).alias("r"))
    by_id = own.join(reg, F.col("name") == F.col("doc_id")).select("name", "pos", "doc_id", F.lit(1).alias("tier"))
    by_name = own.join(reg, F.col("n") == F.col("r")).select("name", "pos", "doc_id", F.lit(1).alias("tier"))
    asked, known = own.select(F.col("n").alias("s")), reg.select(F.col("r").alias("s"))
    inside = contained(known, asked).select(F.col("inner").alias("r"), F.col("outer").alias("n")).unionByName(contained(asked, known).select(F.col("outer").alias("r"), F.col("inner").alias("n")))
    first = reg.groupBy("r").agg(F.min(F.struct("pos", "doc_id")).alias("e"))  # of equal names the earlier entry
    best = inside.join(first, "r").groupBy("n").agg(F.min("e").alias("e")).select("n", "e.pos", "e.doc_id")
    by_part = own.join(best, "n").select("name", "pos", "doc_id", F.lit(2).alias("tier"))
    found = by_id.unionByName(by_name).unionByName(by_part).groupBy("name").agg(F.min(F.struct("tier", "pos", "doc_id")).alias("e"))
    return found.select("name", "e.doc_id", "e.tier")


def located(names: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents by name: equal names, else names that have every word of the asked one."""
    words = names.select("query_id", "name", F.explode(F.array_distinct(text.tokens(F.col("name")))).alias("word"))
    need = words.groupBy("query_id").agg(F.count("*").alias("need"))
    has = documents.select("doc_id", F.explode(F.array_distinct(text.tokens(F.col("doc_name")))).alias("word"))
    every = words.join(has, "word").groupBy("query_id", "doc_id").agg(F.count("*").alias("n")).join(need, "query_id").where("n = need").select("query_id", "doc_id", F.lit(2).alias("tier"))
    same = names.join(documents, F.lower("name") == F.lower("doc_name")).select("query_id", "doc_id", F.lit(1).alias("tier"))
    both = same.unionByName(every).groupBy("query_id", "doc_id").agg(F.min("tier").alias("tier"))
    return both.withColumn("best", F.min("tier").over(Window.partitionBy("query_id"))).where("tier = best").select("query_id", "doc_id", "tier")


def named_by_id(asked: DataFrame, documents: DataFrame) -> DataFrame:
    """Names of documents by id, the id where there is none, in the order asked."""
    return asked.join(documents, "doc_id", "left").select("pos", "doc_id", F.coalesce("doc_name", "doc_id").alias("doc_name"))


def by_ordinal(refs: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry entries by their ordinals from 1; others are dropped."""
    numbered = registry.withColumn("ref", F.row_number().over(Window.partitionBy("session_id").orderBy("pos")))
    return refs.join(numbered, ["session_id", "ref"]).select("session_id", "ref", "doc_id")


def cross_references(chunks: DataFrame) -> DataFrame:
    """``(src, dst)`` from texts to the first asset of a document that bears a label they name; not to themselves."""
    asset = chunks.where("label IS NOT NULL").groupBy("doc_id", "kind", "label").agg(F.min_by("pk", "pos").alias("dst"))
    named = chunks.select("doc_id", F.col("pk").alias("src"), F.explode("refs").alias("ref")).select("doc_id", "src", F.split_part("ref", F.lit(" "), F.lit(1)).alias("kind"), F.split_part("ref", F.lit(" "), F.lit(2)).alias("label"))
    return named.join(asset, ["doc_id", "kind", "label"]).where("src != dst").select("src", "dst").distinct()


def equation_context(chunks: DataFrame) -> DataFrame:
    """For each equation the nearest text before and after it in its section."""
    order = Window.partitionBy("doc_id", "section").orderBy("pos")
    prose = F.when(F.col("type") == "text", F.col("pk"))
    before = F.last(prose, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(prose, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    return chunks.select("pk", "type", before.alias("before"), after.alias("after")).where("type = 'equation'").select("pk", "before", "after")


def section_runs(chunks: DataFrame) -> DataFrame:
    """``(pk, run)``: consecutive chunks of a document with one section have one run number."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    new = F.when(F.lag("section").over(order) == F.col("section"), 0).otherwise(1)
    return chunks.withColumn("new", new).select("doc_id", "pk", "type", "pos", F.sum("new").over(order).alias("run"))


def section_links(chunks: DataFrame) -> DataFrame:
    """``(src, dst)``: every text of a run to its assets, every asset to the run's first text."""
    own = section_runs(chunks)
    texts, assets = own.where("type = 'text'"), own.where("type IN ('image', 'table', 'equation')")
    down = texts.select("doc_id", "run", F.col("pk").alias("src")).join(assets.select("doc_id", "run", F.col("pk").alias("dst")), ["doc_id", "run"])
    first = texts.groupBy("doc_id", "run").agg(F.min_by("pk", "pos").alias("dst"))
    up = assets.select("doc_id", "run", F.col("pk").alias("src")).join(first, ["doc_id", "run"])
    return down.select("src", "dst").unionByName(up.select("src", "dst"))


def nearest_caption(blocks: DataFrame, reach: int = 3) -> DataFrame:
    """For each table the caption on its page at most ``reach`` places away: the nearest, of equals the one before."""
    spots = F.explode(F.sequence(F.col("ord") - reach, F.col("ord") + reach)).alias("at")
    tables = blocks.where("type = 'table'").select("page", F.col("pk").alias("table_pk"), "ord", spots)
    captions = blocks.where("type = 'caption'").select("page", F.col("ord").alias("at"), F.col("pk").alias("caption_pk"))
    order = Window.partitionBy("table_pk").orderBy(F.abs(F.col("at") - F.col("ord")), "at")
    return tables.join(captions, ["page", "at"]).withColumn("k", F.row_number().over(order)).where("k = 1").select("table_pk", "caption_pk")


def source_by_vote(golds: DataFrame, chunks: DataFrame, chars: int = 100) -> DataFrame:
    """The document that most gold passages of a question start like a chunk of; of equals the smallest id."""
    key = lambda c: F.substring(text.squeezed(F.col(c)), 1, chars).alias("key")
    votes = golds.select("question", key("passage")).join(chunks.select("doc_id", key("content")).distinct(), "key").groupBy("question", "doc_id").count()
    order = Window.partitionBy("question").orderBy(F.desc("count"), "doc_id")
    return votes.withColumn("k", F.row_number().over(order)).where("k = 1").select("question", "doc_id", F.col("count").alias("votes"))


def resolved_blocks(ids: DataFrame, blocks: DataFrame) -> DataFrame:
    """The text of each block id: its own, or its parts joined by line ends in their order."""
    parts = blocks.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]), "\n").alias("joined"))
    own = blocks.select("id", F.col("text").alias("own"))
    return ids.join(own, "id", "left").join(parts, "id", "left").select("id", F.coalesce("own", "joined").alias("text"))
