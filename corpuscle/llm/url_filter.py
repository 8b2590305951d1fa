"""URL filters: host names split into words by unigram Viterbi, tokens scored by multinomial naive Bayes, rules on top.

Word counts come from the text of all pages. A name of n letters needs the counts of its own substrings alone, so these
are joined to the counts by shuffle, and no vocabulary is broadcast or collected. Naive Bayes learns from the urls
themselves: those that have a seed word as a whole word are labelled as to block, all others count as its allow class.
Seed words are no features, so the score of a url comes from the words beside them. Counts of tokens by class cover
every url, and a url's score is a join with them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import join_uneven, materialize


class Rule(NamedTuple):
    """A rule fits its host and all subdomains where the url's path starts with the rule's."""

    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Words that label a url as one to block, whole words of host or path; they also count as known words when names are split.
SEEDS = ("adult", "betting", "casino", "escort", "gambling", "malware", "phishing", "pills", "poker", "porn", "sex", "slots", "spam", "viagra", "warez", "xxx")
#: Words of up to so many letters are joined by themselves, longer ones by their first so many.
JOINED_LETTERS = 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased. Path: then up to ?, # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(url)), "^[^?#]*", 0)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lowered, F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: str, path: str, rules: list[Rule]) -> tuple[Column, Column]:
    """The text and the action of the longest rule that fits, or nulls."""
    text = action = None
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((F.col(host) == r.host) | F.col(host).endswith("." + r.host)) & F.col(path).startswith(r.path)
        text, action = (F.when(fits, v) if held is None else held.when(fits, v) for held, v in ((text, r.text), (action, r.action)))
    null = F.lit(None).cast("string")
    return (null, null) if text is None else (text, action)


def word_counts(pages: DataFrame, html_col: str = "html", seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """``(word, n)``: how often each run of lower-cased ASCII letters is in the pages, tags and addresses aside; seeds once more."""
    text = F.regexp_replace(F.regexp_replace(F.lower(html_col), "<[^<>]*+>", " "), r"[a-z]++://\S*+", " ")
    words = pages.select(F.explode(F.split(text, "[^a-z]+")).alias("word")).where("word != ''").groupBy("word").agg(F.count("*").alias("n"))
    known = pages.sparkSession.createDataFrame([(w, 1) for w in seeds], "word string, n long")
    return words.union(known).groupBy("word").agg(F.sum("n").alias("n"))


def segmented(label: str, counts: dict[str, int], total: float) -> list[str]:
    """The likeliest words that make the label; an unknown word costs more the longer it is. Ties go to the longer last word."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    sizes, letter, unknown = sorted({len(w) for w in counts}, reverse=True), math.log(10.0), (-math.inf, 0)
    for end in range(1, len(label) + 1):
        # of the unknown words that end here the best goes on from the best that ended before, or starts here
        new = best[end - 1][0] + math.log(10.0 / total)
        unknown = (max(unknown[0], new) - letter, unknown[1] if unknown[0] >= new else end - 1)
        options = [unknown]
        for size in sizes:
            if size <= end and (n := counts.get(label[end - size : end])):
                options.append((best[end - size][0] + math.log(n / total), end - size))
        best.append(max(options, key=lambda x: (x[0], -x[1])))
    out, end = [], len(label)
    while end:
        start = best[end][1]
        out.append(label[start:end])
        end = start
    return out[::-1]


def host_words(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """``(label, words)`` for distinct labels of lower-case letters, of any length."""
    total = float(counts.agg(F.sum("n")).first()[0] or 1)
    starts = F.explode(F.sequence(F.lit(1), F.length("label"))).alias("start")
    ends = F.explode(F.sequence(F.lit(1), F.least(F.lit(JOINED_LETTERS), F.length("label") - F.col("start") + 1))).alias("size")
    part = F.substring(F.col("label"), F.col("start"), F.col("size")).alias("part")
    parts = labels.select("label", starts).select("label", "start", ends).select("label", "start", part)
    # a word of more letters is sought by its first ones, then compared as a whole
    keyed = counts.select(F.substring("word", 1, JOINED_LETTERS).alias("part"), "word", "n")
    met = parts.join(keyed, "part").where(F.substring(F.col("label"), F.col("start"), F.length("word")) == F.col("word"))
    known = met.select("label", "word", "n").distinct().groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [segmented(label, dict(own or ()), total) for label, own in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], names=["label", "words"])

    return labels.select("label").join(known, "label", "left").select("label", "known").mapInArrow(run, "label string, words array<string>")


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", smoothing: float = 1.0, seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """``(<id_col>, host, path, rule, verdict, score, seeded)``, a row for each row of ``pages``.

    verdict is the action of the longest rule that fits, else block where the url has a seed word or its score (log odds
    of block) is over 0, else allow. Urls that are null or have no :// have empty host and path, no tokens and so the
    score of the class sizes. Repeated rows and null ids pass as they are; null pages count no words; other columns play
    no part.
    """
    host, path = host_and_path(F.col(url_col))
    own = materialize(pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")), "urls")
    urls = materialize(own.groupBy("host", "path").agg(F.count("*").alias("n")), "distinct-urls")
    pieces = materialize(urls.select("host", "path", F.explode(F.split("host", "[^a-z]+")).alias("label")).where("label != ''"), "pieces")
    labels = materialize(pieces.groupBy("label").agg(F.count("*").alias("n")), "labels")
    words = host_words(labels, materialize(word_counts(pages, html_col, seeds), "word-counts"))
    split = materialize(words.join(labels, "label"), "words")
    of_host = join_uneven(pieces, split, ["label"], pieces.count()).select("host", "path", F.explode("words").alias("word")).withColumn("token", F.col("word"))
    # path tokens have a / before them, and 0 for digits, at which host names are split
    steps = F.explode(F.split(F.regexp_replace(F.lower("path"), "[0-9]+", "0"), "[^a-z0]+"))
    of_path = urls.select("host", "path", steps.alias("word")).where("word != ''").withColumn("token", F.concat(F.lit("/"), "word"))
    seed = F.exists(F.split("word", "0"), lambda word: word.isin(*seeds))
    tokens = of_host.union(of_path).groupBy("host", "path", "token", seed.alias("seed")).agg(F.count("*").alias("n"))
    tokens = materialize(tokens, "tokens")

    marked = materialize(tokens.where("seed").select("host", "path").distinct().withColumn("bad", F.lit(1)), "seeded-urls")
    features = tokens.where("not seed").drop("seed")
    classed = features.join(marked, ["host", "path"], "left").withColumn("bad", F.coalesce("bad", F.lit(0)))
    model = classed.groupBy("token").agg(F.sum(F.col("n") * F.col("bad")).alias("b"), F.sum(F.col("n") * (1 - F.col("bad"))).alias("a"), F.count("*").alias("rows"))
    model = materialize(model, "model")
    size = model.agg(F.count("*").alias("v"), F.sum("b").alias("b"), F.sum("a").alias("a"), F.sum("rows").alias("rows")).first()
    all_urls, bad_urls = urls.count(), marked.count()
    prior = math.log((bad_urls + smoothing) / (all_urls - bad_urls + smoothing))
    of_block, of_allow = (float(x or 0) + smoothing * (size["v"] + 1) for x in (size["b"], size["a"]))
    weight = F.log((F.col("b") + smoothing) / of_block) - F.log((F.col("a") + smoothing) / of_allow)
    weights = model.select("token", weight.alias("w"), F.col("rows").alias("n"))
    weighed = join_uneven(features.withColumnRenamed("n", "times"), weights, ["token"], size["rows"] or 0)
    scores = weighed.groupBy("host", "path").agg(F.sum(F.col("w") * F.col("times")).alias("s"))
    judged = urls.join(scores, ["host", "path"], "left").join(marked, ["host", "path"], "left")
    judged = judged.select("host", "path", "n", F.round(F.lit(prior) + F.coalesce("s", F.lit(0.0)), 6).alias("score"), F.col("bad").isNotNull().alias("seeded"))
    text, action = rule_for("host", "path", rules)
    out = join_uneven(own, materialize(judged, "judged"), ["host", "path"], own.count())
    verdict = F.coalesce(action, F.when(F.col("seeded") | (F.col("score") > 0), "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", text.alias("rule"), verdict.alias("verdict"), "score", "seeded")
