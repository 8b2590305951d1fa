"""From questions to searches: decisions by rule, their checks, retries, the states of a run, rounds of research."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions import questions as qs, text
from corpuscle.functions.words import FIGURE_LABEL, TABLE_LABEL
from corpuscle.sources.shared import stored

from . import retrieval as r

#: Types that a decision may ask for; modes of reuse that still need a search; routes and sub-questions at most.
TYPES = ("text", "summary", "title", "image", "table", "equation", "references")
SEARCHING_MODES = ("drilldown", "continue")
MOST_ROUTES, MOST_PATHS, MOST_SUBS = 4, 2, 3
STRUCTURAL = ("references", "image", "table")
#: A question about all there is, and a value with its unit (fixed values).
INVENTORY = r"(?i)(?:一共|总共|全部|所有|多少篇|几篇|统计|盘点|清单|how many (?:papers|documents)|list all)"
QUANTITY = r"(?i)[0-9]+(?:[.,][0-9]+)?\s*(?:%|‰|°c|k|μm|um|nm|mm|cm|m|mol|wt%|at%|mpa|gpa|kpa|pa|v|mv|μa|ua|ma|a|h|min|s|day|年|天|小时|分钟)"
PLAN = "struct<paths:array<struct<t:string,kw:array<string>,docs:array<string>,refs:array<int>,figs:array<string>,tabs:array<string>,pages:array<int>,paras:array<int>,ents:array<string>,ctype:string,expand:array<string>>>,time:string>"


def _distinct(*arrays: Column) -> Column:
    """Arrays in one, each value once, in order."""
    return F.array_distinct(F.flatten(F.array(*(F.coalesce(a, F.array().cast("array<string>")) for a in arrays))))


def decided(rows: DataFrame, this_year: int) -> DataFrame:
    """Questions (id, q) with the searches that their words ask for: routes, type, labels, pages, names, years, leaning."""
    q = F.col("q")
    listed, points = q.rlike(qs.REFERENCES_HINT), q.rlike(qs.DOCUMENT_REF) | (q.rlike(qs.REFERENCES_HINT) & q.rlike(qs.LOOSE_DOCUMENT_REF))
    none = F.array().cast("array<string>")
    own = rows.select(
        "*", F.when(listed, none).otherwise(text.labels(q, FIGURE_LABEL)).alias("figures"), F.when(listed, none).otherwise(text.labels(q, TABLE_LABEL)).alias("tables"), qs.references(q, qs.PAGE).alias("pages"),
        qs.references(q, qs.PARAGRAPH).alias("paragraphs"), qs.quoted_names(q).alias("names"), qs.years(q, this_year).alias("time"), listed.alias("__listed"), points.alias("__points"),
    )
    fig, tab = F.size("figures") > 0, F.size("tables") > 0
    kind = F.when(F.col("__listed"), "references").when(fig & ~tab, "image").when(tab & ~fig, "table")
    main = F.when(q.rlike(qs.SUMMARY_HINT), "summary").when(F.col("__points"), "local").otherwise("progressive")
    extra = fig | tab | (F.size("pages") > 0) | (F.size("paragraphs") > 0) | (F.size("names") > 0)
    routes = F.when(extra, F.array(main, F.lit("metadata"))).otherwise(F.array(main))
    return own.withColumn("routes", routes).withColumn("chunk_type", kind).withColumn("bias", r.bias(q, kind)).drop("__listed", "__points")


def checked(rows: DataFrame) -> DataFrame:
    """Decisions (id, q, routes, figures, tables, pages, paragraphs, names, chunk_type, docs) made sound.

    Labels in upper case, unknown types dropped or inferred, the metadata route where there is something to filter by and
    only there, the progressive route where none is left. rewritten names the routes whose question is rewritten: never
    the metadata route.
    """
    up = lambda c: F.array_distinct(F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.upper(F.trim(x))), lambda x: x != ""))
    positive = lambda c: F.array_distinct(F.filter(F.coalesce(F.col(c), F.array().cast("array<int>")), lambda x: x >= 1))
    own = rows.withColumns({"figures": up("figures"), "tables": up("tables"), "pages": positive("pages"), "paragraphs": positive("paragraphs"), "names": _distinct(F.col("names"))})
    given = F.lower(F.trim("chunk_type"))
    fig, tab = F.size("figures") > 0, F.size("tables") > 0
    kind = F.when(given.isin(*TYPES), given).when(F.col("q").rlike(qs.REFERENCES_HINT), "references").when(fig & ~tab, "image").when(tab & ~fig, "table")
    some = fig | tab | (F.size("pages") > 0) | (F.size("paragraphs") > 0) | (F.size("names") > 0)
    others = F.array_remove(F.coalesce("routes", F.array().cast("array<string>")), "metadata")
    had = F.array_contains(F.coalesce("routes", F.array().cast("array<string>")), "metadata")
    kept = F.when(some & had, F.col("routes")).when(some, F.concat(others, F.array(F.lit("metadata")))).otherwise(others)
    out = own.withColumn("chunk_type", kind).withColumn("routes", F.when(F.size(kept) == 0, F.array(F.lit("progressive"))).otherwise(F.slice(F.array_distinct(kept), 1, MOST_ROUTES)))
    return out.withColumn("rewritten", F.array_remove("routes", "metadata"))


def from_plans(plans: DataFrame) -> DataFrame:
    """``(id, routes, rewrites, ...)`` of tool calls (id, args: JSON): what all paths of a plan ask for, each once, in order."""
    own = plans.select("id", F.from_json("args", PLAN).alias("p")).select("id", "p.time", F.coalesce("p.paths", F.array().cast("array<" + PLAN.split("paths:array<")[1].rsplit(">,time", 1)[0] + ">")).alias("paths"))
    every = lambda f: F.array_distinct(F.flatten(F.transform("paths", lambda x: F.coalesce(x[f], F.array().cast("array<int>" if f in ("refs", "pages", "paras") else "array<string>")))))
    routes = F.array_distinct(F.filter(F.transform("paths", lambda x: x["t"]), lambda t: t.isNotNull()))
    spoken = F.filter("paths", lambda x: (x["t"] != "metadata") & (F.size(F.coalesce(x["kw"], F.array().cast("array<string>"))) > 0))
    rewrites = F.array_distinct(F.transform(spoken, lambda x: F.concat_ws("=", x["t"], F.array_join(qs.content_keywords(x["kw"]), " "))))
    kind = F.element_at(F.concat(F.filter(F.transform("paths", lambda x: F.lower(x["ctype"])), lambda t: t.isin(*TYPES)), F.array(F.lit(None).cast("string"))), 1)
    return own.select("id", routes.alias("routes"), rewrites.alias("rewrites"), every("docs").alias("docs"), every("refs").alias("refs"), every("figs").alias("figures"), every("tabs").alias("tables"), every("pages").alias("pages"), every("ents").alias("names"), kind.alias("chunk_type"), F.trim(F.coalesce("time", F.lit(""))).alias("time"), "paths")


def to_split(paths: Column) -> Column:
    """Whether the paths of a plan would spoil each other's filters, so that each becomes a sub-question."""
    filled = lambda x: F.exists(F.array(*(F.size(F.coalesce(x[f].cast("array<string>"), F.array().cast("array<string>"))) for f in ("figs", "tabs", "pages", "paras", "ents"))), lambda n: n > 0)
    meta, other = F.filter(paths, lambda x: x["t"] == "metadata"), F.filter(paths, lambda x: x["t"] != "metadata")
    typed = lambda x: F.lower(F.coalesce(x["ctype"], F.lit("")))
    sign = lambda x: F.concat_ws("|", *(F.array_join(F.array_sort(F.coalesce(x[f].cast("array<string>"), F.array().cast("array<string>"))), ",") for f in ("figs", "tabs", "pages", "paras", "ents")))
    signs = F.size(F.array_distinct(F.transform(F.filter(meta, filled), sign)))
    pair = (F.size(paths) == 2) & (F.size(meta) == 1) & F.exists(meta, filled) & ~F.exists(other, lambda x: typed(x) == "references")
    structural = F.exists(meta, filled) & (F.exists(paths, lambda x: typed(x) == "references") | F.exists(other, lambda x: typed(x) != ""))
    return F.when((F.size(paths) <= 1) | pair, False).otherwise((signs >= 2) | structural)


def focus(registry: DataFrame) -> DataFrame:
    """``(session_id, doc_id, reason)``: the one document that "it" means: the only pinned one, else the only one."""
    own = registry.groupBy("session_id").agg(F.count("*").alias("n"), F.count_if("pinned").alias("p"), F.max(F.when(F.col("pinned"), F.col("doc_id"))).alias("one"), F.max("doc_id").alias("only"))
    return own.where("p = 1 OR n = 1").select("session_id", F.when(F.col("p") == 1, F.col("one")).otherwise(F.col("only")).alias("doc_id"), F.when(F.col("p") == 1, "single-pinned").otherwise("single-entry").alias("reason"))


def scope(asked: DataFrame, registry: DataFrame) -> DataFrame:
    """``(id, doc_id, pos)``: documents of the session that a question is about.

    Those it counts off, else all where it means them all, else the focus where it points back. registry has pos from 1.
    """
    q = F.col("q")
    ordinals = qs.references(q, qs.ORDINAL)
    mode = F.when(F.size(ordinals) > 0, "ordinal").when(q.rlike(qs.BATCH_SCOPE), "all").when(q.rlike(qs.EXPLICIT_SCOPE), "focus")
    own = asked.select("id", "session_id", ordinals.alias("ns"), mode.alias("mode"))
    counted = own.where("mode = 'ordinal'").select("id", "session_id", F.explode("ns").alias("pos")).join(registry.select("session_id", F.col("pos").cast("long").alias("pos"), "doc_id"), ["session_id", "pos"])
    every = own.where("mode = 'all'").join(registry.select("session_id", F.col("pos").cast("long").alias("pos"), "doc_id"), "session_id")
    one = own.where("mode = 'focus'").join(focus(registry).select("session_id", "doc_id"), "session_id").join(registry.select("session_id", "doc_id", F.col("pos").cast("long").alias("pos")), ["session_id", "doc_id"])
    shape = ["id", "doc_id", "pos"]
    return counted.select(shape).union(every.select(shape)).union(one.select(shape))


def guarded(decisions: DataFrame) -> DataFrame:
    """Decisions (id, q, routes, refs, n_docs) with what is done with them: asked back, or searched.

    Questions about all there is aren't answered by the best few summaries; filters by page, figure or paragraph need to
    know the document where a session has several.
    """
    located = F.size(F.coalesce("refs", F.array().cast("array<int>"))) > 0
    alone = (F.size("routes") == 1) & F.array_contains("routes", "metadata")
    action = F.when(alone & ~located & (F.col("n_docs") > 1), "ask-document").when(F.col("q").rlike(INVENTORY) & F.array_contains("routes", "summary"), "ask-inventory").otherwise("search")
    return decisions.withColumn("action", action)


def reused(outcomes: DataFrame) -> DataFrame:
    """Reuse requests (id, mode, op, q) as what is done: those that need more evidence search in the documents."""
    again = F.col("mode").isin(*SEARCHING_MODES)
    rewrite = F.when(again, F.coalesce(F.nullif(F.trim("op"), F.lit("")), F.col("q")))
    return outcomes.select("id", F.when(again, "local").alias("route"), rewrite.alias("rewrite"), F.when(again, "assets,adjacent").alias("expand"), (~again).alias("skips_search"))


def reflected(runs: DataFrame) -> DataFrame:
    """Runs (id, hits, structural_hits, failed, patched, retries, most_retries, bias) with the verdict where none is needed from a model."""
    spent = (F.col("most_retries") <= 0) | (F.col("retries") >= F.col("most_retries"))
    verdict = F.when(spent, "no_retry").when(F.col("failed") & ~F.col("patched"), "no_retry").when((F.col("hits") == 0) & (F.col("structural_hits") > 0), "accept").when(F.col("hits") == 0, "retry").otherwise("ask_model")
    retry = verdict == "retry"
    return runs.select("id", verdict.alias("verdict"), F.when(retry, "progressive").alias("route"), F.when(retry, F.coalesce("bias", F.lit("balanced"))).alias("bias"))


def next_action(states: DataFrame) -> DataFrame:
    """``(id, action)`` of a run's state: where its flags and its phase lead."""
    f, left = F.col, F.col("retries") < F.col("most_retries")
    action = (
        F.when(f("phase").isin("clarify", "reuse", "context_build"), "stop").when(f("needs_clarify"), "clarify").when(f("needs_reuse"), "reuse").when(f("phase").isin("start", "policy", ""), F.when((f("phase") == "") & f("has_decision") & ~f("has_results") & ~f("has_errors"), "retrieve").otherwise("router"))
        .when(f("phase") == "router", "retrieve").when(f("phase") == "retrieve", F.when(f("has_results"), "reranker").otherwise("reflect"))
        .when(f("phase") == "reranker", F.when(~f("needs_retry"), "context_build").when(f("skip_reflect") & left, "rewrite").when(~left, "answer").otherwise("reflect"))
        .when(f("phase") == "reflect", F.when(f("sufficient"), "context_build").when(f("needs_retry") & left, "rewrite").otherwise("answer")).when(f("phase") == "rewrite", "retrieve").otherwise("router")
    )
    stuck = ~f("has_results") & f("has_errors") & ~f("needs_clarify") & ~f("needs_reuse") & f("phase").isin("retrieve", "reranker", "reflect") & left
    return states.select("id", F.when(stuck, "rewrite").otherwise(action).alias("action"))


def registry_block(registry: DataFrame, most: int = 20) -> DataFrame:
    """``(session_id, block)``: the documents of a session as numbered lines, pinned ones marked, the first ``most``."""
    line = F.concat(F.col("pos").cast("string"), F.lit(". "), F.coalesce(F.nullif("doc_name", F.lit("")), "doc_id"), F.when(F.col("pinned"), " [pinned]").otherwise(""))
    own = registry.groupBy("session_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("pos") <= most, F.struct("pos", line.alias("t"))))).alias("lines"))
    cut = F.when(F.col("n") > most, F.concat(F.lit("\n... ("), F.col("n").cast("string"), F.lit(" in all)"))).otherwise("")
    return own.select("session_id", F.concat(F.array_join(F.transform("lines", lambda x: x["t"]), "\n"), cut).alias("block"))


def rerank_groups(hits: DataFrame, subs: DataFrame) -> DataFrame:
    """Hits (query_id, sub, pk) by the question they are reranked with: that of their sub-question, else the whole one."""
    own = hits.join(subs.select("query_id", "sub", F.trim("rewrite").alias("rewrite")), ["query_id", "sub"], "left")
    asked = F.coalesce(F.nullif("rewrite", F.lit("")), F.trim("q"))
    return own.groupBy("query_id", asked.alias("asked")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("pk")).alias("pks"))


def rerank_question(decisions: DataFrame) -> DataFrame:
    """``(id, asked)``: the question for the reranker: with what is filtered by, where that is all; rewritten, where that is wanted."""
    part = lambda name, c: F.when(F.size(c) > 0, F.concat(F.lit(name + " "), F.array_join(F.col(c).cast("array<string>"), " ")))
    hints = F.concat_ws("; ", part("figure", "figures"), part("table", "tables"), part("page", "pages"), part("paragraph", "paragraphs"), part("entity", "names"))
    base, rewrite = F.trim(F.coalesce("q", F.lit(""))), F.trim(F.coalesce("rewrite", F.lit("")))
    alone = (F.size("routes") == 1) & F.array_contains("routes", "metadata") & (hints != "")
    asked = F.when(base == "", rewrite).when(alone, F.concat(base, F.lit(" ("), hints, F.lit(")"))).when(F.coalesce("rerank_mode", F.lit(False)) & (rewrite != ""), rewrite).otherwise(base)
    return decisions.select("id", asked.alias("asked"))


def safety_net(hits: DataFrame, k: int, least: float) -> DataFrame:
    """``(query_id, quality, retry)`` where reranking failed: the mean of the k best scores over 0, and whether it is too low."""
    top = r.top_k(hits.where("score > 0"), k)
    return top.groupBy("query_id").agg(F.round(F.avg(F.col("score").cast("decimal(20,6)")), 6).cast("double").alias("quality")).withColumn("retry", F.col("quality") < least)


def reflect_summary(hits: DataFrame, most: int = 6, chars: int = 200, route_chars: int = 2400) -> DataFrame:
    """``(query_id, summary, n)``: what a model reads to judge a search: by route the counts by type and the best hits.

    hits: (query_id, route, pk, type, doc_name, page_start, score, rerank_score, content), of the routes that are judged.
    """
    order = Window.partitionBy("query_id", "route").orderBy(F.desc(F.coalesce("rerank_score", "score", F.lit(0.0))), "pk")
    scores = F.concat_ws(" ", F.when(F.col("score") != 0, F.format_string("emb=%.3f", "score")), F.when(F.col("rerank_score").isNotNull(), F.format_string("rerank=%.3f", "rerank_score")))
    shown = F.concat_ws(" ", F.concat(F.lit("["), F.col("type"), F.lit("]")), F.concat(F.lit("doc="), F.col("doc_name")), F.concat(F.lit("page="), (F.col("page_start") + 1).cast("string")), F.nullif(scores, F.lit("")))
    own = hits.withColumn("k", F.row_number().over(order)).withColumn("line", F.concat(F.lit("  "), shown, F.lit(": "), text.snippet(F.col("content"), chars)))
    counts = own.groupBy("query_id", "route", "type").count().groupBy("query_id", "route").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "type", "count"))), ", ").alias("types"), F.sum("count").alias("n"))
    lines = own.where(F.col("k") <= most).groupBy("query_id", "route").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    block = F.concat(F.lit("["), F.col("route"), F.lit("]\n  "), F.col("n").cast("string"), F.lit(" hits ("), F.col("types"), F.lit(")\n"), F.col("lines"))
    blocks = counts.join(lines, ["query_id", "route"]).withColumn("block", text.cut(block, route_chars))
    return blocks.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("route", "block"))), lambda x: x["block"]), "\n\n").alias("summary"), F.sum("n").alias("n"))


def _routed(plans: DataFrame, route: str, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The hits of one route for all of its sub-questions; each has hits of its own."""
    asked = plans.where(F.col("route") == route).withColumn("query_id", F.concat_ws("/", F.col("query_id").cast("string"), "sub"))
    hits = search(asked.drop("sub", "route"))
    return hits.select(F.substring_index("query_id", "/", 1).cast(plans.schema["query_id"].dataType).alias("query_id"), F.substring_index("query_id", "/", -1).alias("sub"), F.lit(route).alias("route"), "pk", "score", "rank")


def dispatched(plans: DataFrame, handlers: Mapping[str, Callable[[DataFrame], DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Hits ``(query_id, sub, route, pk, score, rank)`` of every route that a plan (query_id, sub, route, q, ...) names, and how each route ended.

    Each route answers all of its questions in a job of its own, whose hits are stored; one that fails, when it is made or
    when it runs, costs its own hits only. Outcomes: (route, asked, hits, error), error null where the route ended well.
    """
    spark, done, outcomes = plans.sparkSession, [], []
    asked = {r["route"]: r["n"] for r in plans.where(F.col("route").isin(*handlers)).groupBy("route").agg(F.count("*").alias("n")).collect()}
    for route, search in handlers.items():
        try:
            part = stored(_routed(plans, route, search), f"route-{len(outcomes)}")
            outcomes.append((route, asked.get(route, 0), part.count(), None))
            done.append(part)
        except Exception as error:  # whatever a route does, the others go on
            outcomes.append((route, asked.get(route, 0), 0, f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}"[:500]))
    kind = plans.schema["query_id"].dataType.simpleString()
    hits = spark.createDataFrame([], f"query_id {kind}, sub string, route string, pk string, score double, rank int")
    if done:
        hits = done[0]
        for part in done[1:]:
            hits = hits.unionByName(part)
    return hits, spark.createDataFrame(outcomes, "route string, asked long, hits long, error string")


def new_evidence(rounds: DataFrame, least: float | None = None) -> DataFrame:
    """``(run_id, round, added, quality_added, docs)``: hits that a round is the first to bring, those good enough, documents so far.

    rounds: (run_id, round, pk, doc_id, score); hits without a score count as good.
    """
    first = rounds.groupBy("run_id", "pk").agg(F.min("round").alias("round"))
    own = rounds.groupBy("run_id", "round", "pk").agg(F.max("doc_id").alias("doc_id"), F.max("score").alias("score"))
    fresh = own.join(first, ["run_id", "round", "pk"])
    good = F.lit(True) if least is None else F.coalesce(F.col("score") >= least, F.lit(True))
    docs = own.groupBy("run_id", "doc_id").agg(F.min("round").alias("round")).groupBy("run_id", "round").agg(F.count("*").alias("d"))
    counts = fresh.groupBy("run_id", "round").agg(F.count("*").alias("added"), F.count_if(good).alias("quality_added"))
    line = Window.partitionBy("run_id").orderBy("round")
    every = own.select("run_id", "round").distinct().join(counts, ["run_id", "round"], "left").join(docs, ["run_id", "round"], "left").fillna(0, ["added", "quality_added", "d"])
    return every.withColumn("docs", F.sum("d").over(line)).drop("d")


def stops(rounds: DataFrame, most_rounds: int, stall_limit: int = 2, least_docs: int = 3, gap_limit: int = 2) -> DataFrame:
    """``(run_id, round, stall, verdict)``: when a research run ends: finish, clarify, or go on.

    rounds: (run_id, round, quality_added, docs, gaps, repeated). stall counts the rounds in a row without good evidence.
    A run also finishes where its next searches are all repeats, or its gaps stay the same with documents enough.
    """
    line = Window.partitionBy("run_id").orderBy("round")
    last_good = F.max(F.when(F.col("quality_added") > 0, F.col("round"))).over(line)
    first = F.min("round").over(Window.partitionBy("run_id"))
    same = F.coalesce((F.col("gaps") != "") & (F.lag("gaps").over(line) == F.col("gaps")), F.lit(False))
    own = rounds.withColumn("stall", F.col("round") - F.coalesce(last_good, first - 1)).withColumn("same", same).withColumn("gap_stall", F.row_number().over(line) - F.coalesce(F.max(F.when(~F.col("same"), F.col("round"))).over(line) - first + 1, F.lit(0)))
    enough = F.col("docs") >= least_docs
    verdict = (
        F.when((F.col("docs") == 0) & (F.col("round") >= 2), "clarify").when(F.col("stall") >= stall_limit, F.when(enough, "finish").otherwise("clarify"))
        .when(F.col("round") >= most_rounds, F.when(F.col("docs") == 0, "clarify").otherwise("finish")).when(F.col("repeated"), "finish").when((F.col("gap_stall") >= gap_limit) & enough, "finish").otherwise("continue")
    )
    return own.select("run_id", "round", F.col("stall").cast("long").alias("stall"), verdict.alias("verdict"))


def tried(decisions: DataFrame) -> DataFrame:
    """``(run_id, signature)``: searches that a run has done, as route and keywords in one form, each once."""
    own = decisions.select("run_id", "route", text.signature(F.col("rewrite")).alias("s")).where("s != ''")
    return own.select("run_id", F.concat_ws(":", "route", "s").alias("signature")).distinct()


def gap_signature(gaps: Column) -> Column:
    """Gaps in one form and order: what stands before the colon, as keywords."""
    keys = F.transform(gaps, lambda g: text.signature(F.trim(F.substring_index(g, ":", 1))))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(keys, lambda s: s != ""))), "|")


def observation(evidence: DataFrame, docs: int = 6, per_doc: int = 3, chars: int = 240) -> DataFrame:
    """``(run_id, text)``: evidence (run_id, doc_id, pk, score, content) as a model reads it: the best documents, their best hits."""
    line = Window.partitionBy("run_id", "doc_id").orderBy(F.desc("score"), "pk")
    ranked = evidence.withColumn("k", F.row_number().over(line))
    weight = ranked.where("k <= 3").groupBy("run_id", "doc_id").agg(F.sum(F.col("score").cast("decimal(20,6)")).alias("w"))
    best = weight.withColumn("n", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("w"), "doc_id"))).where(F.col("n") <= docs)
    shown = ranked.where(F.col("k") <= per_doc).groupBy("run_id", "doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "pk", "content"))), lambda x: F.concat(F.lit("- ["), x["pk"], F.lit("] "), text.snippet(x["content"], chars))), "\n").alias("t"))
    own = best.join(shown, ["run_id", "doc_id"]).select("run_id", "n", F.concat(F.lit("## "), "doc_id", F.lit("\n"), "t").alias("t"))
    return own.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda x: x["t"]), "\n\n").alias("text"))


def skills_for(asked: DataFrame, skills: DataFrame, strong: int = 2) -> DataFrame:
    """``(id, skill_id, hits, strong)``: skills by how many of their triggers a question has, then by priority.

    skills: (skill_id, priority, triggers), a table of a few rows that is broadcast once it has been counted.
    """
    if skills.count() > 10_000:
        raise ValueError("skills are a table of 10,000 rows at most")
    each = F.broadcast(skills.select("skill_id", "priority", F.explode("triggers").alias("trigger")))
    hits = asked.join(each, F.expr("q RLIKE concat('(?i)', trigger)")).groupBy("id", "skill_id", "priority").agg(F.count("*").alias("hits"))
    order = Window.partitionBy("id").orderBy(F.desc("hits"), F.desc("priority"), "skill_id")
    return hits.withColumn("k", F.row_number().over(order)).where("k = 1").select("id", "skill_id", "hits", (F.col("hits") >= strong).alias("strong"))


def loaded_skills(files: DataFrame) -> DataFrame:
    """Skills (dir_pos, skill_id, body, ...) of several folders: one of the same name in a later folder wins; empty ones go."""
    last = Window.partitionBy("skill_id").orderBy(F.desc("dir_pos"))
    return files.where("trim(coalesce(skill_id, '')) != '' AND trim(coalesce(body, '')) != ''").withColumn("k", F.row_number().over(last)).where("k = 1").drop("k")


def unmet(runs: DataFrame, evidence: DataFrame) -> DataFrame:
    """``(run_id, missing)``: what a run's guards (run_id, guards, least_docs) still miss: documents enough, values with units."""
    own = evidence.groupBy("run_id").agg(F.count_distinct("doc_id").alias("docs"), F.max(F.col("content").rlike(QUANTITY)).alias("measured"))
    few = F.array_contains("guards", "min_docs") & (F.col("least_docs") > F.coalesce("docs", F.lit(0)))
    bare = F.array_contains("guards", "need_quantitative") & ~F.coalesce("measured", F.lit(False))
    return runs.join(own, "run_id", "left").select("run_id", F.array_join(F.array(F.when(few, "min_docs"), F.when(bare, "need_quantitative")), ",").alias("missing"))
