"""Five operators in a row over ``documents``: what a training corpus goes through before it is packed."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm import decontaminate, near_copies, pii, quality, queries
from corpuscle.llm._common import materialize, read

#: Documents whose quality score is lower go.
LEAST_QUALITY = 0.3


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules don't reject; they are learnt from the labelled ones among ``docs``."""
    ensemble = quality.learn(docs, read(spark, sf_dir, "labels"))
    return quality.keep(docs, ensemble, LEAST_QUALITY)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are near copies the one with the smallest id.

    SimHash fingerprints find them, and their five-word shingles have to have a similarity of 0.8 or more.
    """
    return near_copies.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by its kind; n_chars is that of the new text."""
    out = pii.redact(docs)
    return out.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in out.columns))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens, digests of the ids and of the decoded text for each document that is left."""
    return queries.round_trip(docs, public_tokenizers.path(queries.BYTE_BPE))


STAGES = [("quality classifier", keep_good), ("simhash near-dedup", keep_one_of_each), ("benchmark decontamination", drop_contaminated), ("pii", redact), ("bpe", tokenize)]

#: SimHash and byte-pair encoding have no SQL form: the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
