"""The corpus pipeline: language, toxicity, near duplicates, benchmark leaks, pieces.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs; the next stage then deletes what the
one before had put into the shared folder.  All but the last return rows of
``documents`` with all their columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqloom.llm import decontaminate, language, neardup, pieces, sentencepieces, toxicity
from seqloom.llm.columns import SCRATCH, drop_stored, small_batches, stored

#: folders of the stage before, which its written result no longer needs
_LEFT: list[str] = []

LEAST_LANGUAGE = 0.15  # of the letters are in a language learned, not noise; lists, codes and shouting in a language have more

#: SQL can't express the trained stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def _begin(spark: SparkSession) -> None:
    small_batches(spark)  # executors outlive the stages, and what one stage has taken of their memory the next ones miss
    for path in [p for p in _LEFT if p in SCRATCH]:
        at = SCRATCH.index(path)
        drop_stored(spark, at, len(SCRATCH) - at - 1)
    _LEFT.clear()


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without text or letters go, as do those of no language learned."""
    _begin(spark)
    return language.keep_known(docs, language.train(docs), LEAST_LANGUAGE)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject; it learns from the labels of ``docs``."""
    _begin(spark)
    return toxicity.keep_clean(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    _begin(spark)
    since = len(SCRATCH)
    kept = neardup.keep_one(docs)
    _LEFT.extend(SCRATCH[since:])
    return kept


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage (a window of eight words) of the benchmark."""
    _begin(spark)
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece ids and whether they decode to the text."""
    _begin(spark)
    return sentencepieces.encode_texts(docs, pieces.model_bytes())


STAGES = [
    ("language", identify_language),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    made = small_batches(spark)
    try:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        for name, stage in STAGES:
            docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        return docs
    finally:
        for key in made:
            spark.conf.unset(key)
