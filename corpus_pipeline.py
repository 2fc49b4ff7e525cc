"""A training-data pipeline over ``documents``: five of the operators, one after the other.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir), and if wanted a stage
for its intermediate tables, and works on all that its predecessor kept. All stages but the last return the columns of ``documents``. Null and
empty texts: the classifier judges them as texts without words; what it keeps of them passes the
other stages unchanged, without tokens in the end. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voucherlens.llm import (
    decontamination,
    line_dedup,
    minhash_dedup,
    quality_classifier,
    sentencepiece_codec,
)
from voucherlens.llm.common import id_and_text, table
from voucherlens.staging import Stage

NEAR_PERCENT = 80  # of five-word shingles in common; op5_minhash_dedup alone links from 85 on


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str, stage: Stage | None = None) -> DataFrame:
    """Documents the classifier accepts; it learns from the labels of those that are there."""
    model = quality_classifier.train(id_and_text(docs), table(spark, sf_dir, "labels"))
    judged = quality_classifier.classify(docs, model, whole=True)
    return judged.where("predicted = 1").select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str, stage: Stage | None = None) -> DataFrame:
    """Documents without the boilerplate lines of their source; ``n_chars`` follows the text.

    Copies are left for the next stage, which keeps one of them.
    """
    out = line_dedup.site_line_dedup(docs, stage=stage, spare_copies=True, counts=None)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str, stage: Stage | None = None) -> DataFrame:
    """One document of each group of near duplicates, linked from ``NEAR_PERCENT`` on."""
    return minhash_dedup.drop_near_duplicates(docs, percent=NEAR_PERCENT, stage=stage)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str, stage: Stage | None = None) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    found = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), whole=True, stage=stage)
    return found.where("n_hit = 0").select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str, stage: Stage | None = None) -> DataFrame:
    """Token ids of each document."""
    return sentencepiece_codec.encode(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("SentencePiece encoding", tokens),
]

ORACLE_SQL = None  # learnt scores, connected components and a tokenizer


def run(spark: SparkSession, sf_dir: str, stage: Stage | None = None) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to shared storage and reread.

    The result is lazy and reads ``stage``, which has all intermediate tables of all stages: close
    it when the result has been written.
    """
    stage = stage or Stage(spark)
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir, stage), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir, stage)
