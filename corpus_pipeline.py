"""The corpus pipeline: stages over documents, each written and read again before the next.

All stages but the last return the columns of documents. Nulls, empty texts, repeated rows and
empty tables are handled as each operator's docstring says. Models, frequencies and targets are
taken from the stage's own input (and from labels and benchmark).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skyfix.llm import decontam, mixing, nearcopies, secrets, toxicity
from skyfix.llm.common import keep, materialise, scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the threshold go."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: SimHash, then exact similarity of 0.8 or more of five-word shingles."""
    return nearcopies.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; every document stays."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with the number of their copies and the words these take."""
    return mixing.mix(docs).filter("copies > 0")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash-near-dedup", drop_near_duplicates),
    ("benchmark-decontamination", drop_contaminated),
    ("secret-scans", mask_secrets),
    ("mixing", mix_sources),
]

#: A trained model and fingerprints of XXH64 lie outside SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch():  # what the stage wrote on its way goes
            docs = keep(materialise(stage(spark, docs, sf_dir), f"stage-{name}"))
    return STAGES[-1][1](spark, docs, sf_dir)
