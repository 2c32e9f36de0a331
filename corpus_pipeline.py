"""A pipeline over `documents`: language, near duplicates, benchmark leaks, source weights, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. run()
writes each stage's rows in the shared folder before the next one reads them, so that no stage is computed twice.

ORACLE_SQL is None: SQL can express neither the random field nor the tokenizer; tests/llm compares the pipeline with
brute force. Every stage keeps what its operator doesn't reject; mixing repeats documents of small sources and drops none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quasilattice.llm import decontaminate, jaccard_join, lang_crf, mixing, pfor
from quasilattice.llm.common import read_table, unused, written

#: Texts without letters are rejected, and those whose best language has a smaller share of words.
LEAST_SHARE = 0.3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    language, share = unused("language", docs.columns), unused("share", docs.columns)
    named = lang_crf.identify(docs, lang_crf.fit(docs), (language, share))
    return named.where((F.col(language) != "und") & (F.col(share) >= LEAST_SHARE)).drop(language, share)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pfor.token_output(spark, docs, ordinary=False)


STAGES = [
    ("language ID", language_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("token-ID output", token_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.split()[0].lower()}")
    return STAGES[-1][1](spark, docs, sf_dir)
