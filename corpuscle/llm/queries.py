"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom_lm, bpe, decontaminate, hnsw, periodic_runs, pii, quality, simhash, suffix_dedup, url_filter, vector_codes, warc
from ._common import read

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
RULES = [url_filter.Rule("block", "net", "/"), url_filter.Rule("allow", "example.net", "/en/"), url_filter.Rule("block", "example.com", "/de/"), url_filter.Rule("allow", "org", "/fr/")]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(read(spark, sf_dir, "pages")))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"), 400)
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Number of tokens, digest of the ids, digest of the decoded text."""
    out = bpe.encode(docs, path, decoded="text")
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op5_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return hnsw.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"), RULES)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.spans(read(spark, sf_dir, "documents"))
    shown = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    number = lambda kind: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == kind)))
    counts = [number(k).cast("long").alias(f"n_{k}") for k in pii.BASE]
    return out.select("doc_id", *counts, F.sha2(shown(F.filter("spans", lambda x: x["base"])).cast("binary"), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    ensemble = quality.learn(docs, read(spark, sf_dir, "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return quality.scored(docs.select("doc_id", "text"), ensemble).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def language_scores(docs: DataFrame, bits: int = bloom_lm.BITS) -> DataFrame:
    """Scores of all rows by a model of those whose crc32(doc_id as text) mod 10 isn't 0; a null id is never held out."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
    model = bloom_lm.learn(docs.where(~held), bits=bits)
    out = bloom_lm.score(docs, model, mark=held)
    return out.select("doc_id", F.col("mark").alias("held_out"), "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op11_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(read(spark, sf_dir, "documents"))


def code_digests(vectors: DataFrame) -> DataFrame:
    """Codes and errors, with a digest of the codebooks."""
    return vector_codes.codes(vectors).withColumn("codebooks_sha256", F.sha2(F.col("codebooks").cast("binary"), 256)).drop("codebooks")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_digests(read(spark, sf_dir, "embeddings"))


def repeated(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document, of which every tenth (by the crc32 of its id) goes on with a period from some word on."""
    n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
    return [*words[:a], *(words[a + k % p] for k in range(n - a))]


def periodic_digests(docs: DataFrame) -> DataFrame:
    """Number of runs, the strongest run, digests of all runs and of the collapsed text."""
    out = periodic_runs.collapse(docs, rewrite=repeated)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    exponent = F.expr("best.length * 1000 div best.period").alias("exponent_milli")
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", exponent, F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_digests(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_warc_derivatives, op3_suffix_dedup, op4_bpe, op5_hnsw, op6_url_filter, op7_token_counts, op8_pii, op9_decontamination, op10_quality, op11_bloom_lm, op12_vector_codes, op13_periodic_runs)}
SQL = {"op2_warc_derivatives": warc.SQL, "op9_decontamination": decontaminate.SQL}
