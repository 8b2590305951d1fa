"""Research runs in rounds: what is still missing is searched for again until a stop rule holds.

All runs go on together. A round asks the index for the open runs only, keeps what they don't hold yet, notes what is
missing, and applies the stop rules; runs that end leave. Each round's rows are written to the shared folder, so a round
never recomputes the one before, and only the number of open runs comes to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import text
from corpuscle.sources.shared import stored

from . import lexical_index as lexical
from . import routing
from .lexical_index import LexicalIndex


@dataclass(frozen=True)
class Research:
    """``runs`` (run_id, rounds, evidence, docs, missing, verdict), ``rounds`` (run_id, round, asked, added, quality_added, docs, gaps, repeated), ``evidence`` (run_id, round, pk, doc_id, score)."""

    runs: DataFrame
    rounds: DataFrame
    evidence: DataFrame


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def research(questions: DataFrame, index: LexicalIndex, k: int, floor: float, most_rounds: int = 4) -> Research:
    """Research for each question (query_id, q), a run each, with k hits a round.

    The first round asks the whole question, each later one the words of it that no evidence has yet, in order of the
    alphabet. Evidence is what a run doesn't hold yet; of good quality it is from a score of ``floor`` on. A search that a
    run has done before, or with nothing missing, counts as repeated. The rules are those of :func:`routing.stops`. A
    question without words has one round, and nothing is found.
    """
    wanted = stored(questions.select(F.col("query_id").alias("run_id"), "q", F.array_sort(F.array_distinct(text.tokens(F.col("q")))).alias("words")), "runs")
    asks = wanted.select("run_id", F.col("q").alias("asked"))
    evidence: list[DataFrame] = []
    rounds: list[DataFrame] = []
    verdicts: list[DataFrame] = []
    for n in range(1, most_rounds + 1):
        found = lexical.search(asks.select(F.col("run_id").alias("query_id"), F.col("asked").alias("q")), index, k)
        new = found.select(F.col("query_id").alias("run_id"), F.lit(n).alias("round"), "pk", "score")
        if evidence:
            new = new.join(_all(evidence).select("run_id", "pk"), ["run_id", "pk"], "left_anti")
        held = index.texts.select("pk", "doc_id", F.transform("terms", lambda x: x["term"]).alias("terms"))
        new = new.join(held, "pk").join(wanted.select("run_id", "words"), "run_id")
        evidence.append(stored(new.select("run_id", "round", "pk", "doc_id", "score", F.array_intersect("words", "terms").alias("told")), "evidence"))
        every = _all(evidence)
        now = F.col("round") == n
        counts = every.groupBy("run_id").agg(
            F.count(F.when(now, 1)).alias("added"), F.count(F.when(now & (F.col("score") >= floor), 1)).alias("quality_added"),
            F.countDistinct("doc_id").alias("docs"), F.array_distinct(F.flatten(F.collect_list("told"))).alias("told"),
        )
        own = asks.join(wanted.select("run_id", "words"), "run_id").join(counts, "run_id", "left")
        missing = F.array_join(F.array_except("words", F.coalesce("told", F.array().cast("array<string>"))), " ")
        own = own.select("run_id", F.lit(n).alias("round"), "asked", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("added", "quality_added", "docs")), missing.alias("gaps"))
        before = own.select("run_id", F.col("asked").alias("gaps")) if not rounds else _all(rounds).select("run_id", F.col("asked").alias("gaps")).unionByName(own.select("run_id", F.col("asked").alias("gaps")))
        again = before.distinct().withColumn("done", F.lit(True))
        own = own.join(again, ["run_id", "gaps"], "left").withColumn("repeated", F.coalesce("done", F.lit(False)) | (F.col("gaps") == "")).drop("done")
        rounds.append(stored(own.select("run_id", "round", "asked", "added", "quality_added", "docs", "gaps", "repeated"), "rounds"))
        open_now = _all(rounds).join(rounds[-1].select("run_id"), "run_id", "left_semi")
        verdict = routing.stops(open_now.select("run_id", "round", "quality_added", "docs", "gaps", "repeated"), most_rounds).where(F.col("round") == n)
        verdicts.append(stored(verdict.select("run_id", "round", "verdict"), "verdicts"))
        asks = rounds[-1].join(verdicts[-1].where("verdict = 'continue'").select("run_id"), "run_id", "left_semi").select("run_id", F.col("gaps").alias("asked"))
        if asks.isEmpty():
            break
    ended = _all(verdicts).where("verdict != 'continue'")
    last = _all(rounds).join(ended, ["run_id", "round"])
    total = _all(evidence).groupBy("run_id").agg(F.count("*").alias("evidence"))
    runs = last.join(total, "run_id", "left").select("run_id", F.col("round").alias("rounds"), F.coalesce("evidence", F.lit(0)).cast("long").alias("evidence"), "docs", F.col("gaps").alias("missing"), "verdict")
    return Research(runs, _all(rounds), _all(evidence).drop("told"))
