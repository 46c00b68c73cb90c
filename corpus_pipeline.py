"""A training corpus in five stages: each works on all that the one before it kept.

Defined results: a null text is an empty one to every stage; the classifier scores it like any other, of all empty
texts one document stays, it holds no benchmark item, has no words to mix and, if taken, is one sequence with the end
token. A null doc_id never trains and is a document like any other. An empty table of documents gives no sequences;
without labels every score is 0.5, so all stay; without benchmark items all are clean. Rows that repeat doc_id and text
are one after the near-duplicate stage. Columns beside doc_id, text and source are carried along, whatever their names,
up to the last stage.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldlight.llm import decontaminate, mixing, neardup, quality, tokens
from foldlight.llm.common import MADE, cleanup, discard, held_out, materialise, scratch_path


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Scratch tables of the last stage that ran. Its result is written by the time that the next one starts.
LEFT: set[str] = set()


def tidy(stage: Stage) -> Stage:
    """The stage, which first deletes the scratch tables of the one before that its docs don't read."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        cleanup(spark, docs, only=LEFT)
        before = set(MADE)
        out = stage(spark, docs, sf_dir)
        LEFT.clear()
        LEFT.update(MADE - before)
        return out

    return run_stage


@tidy
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier scores at the threshold or above."""
    model = quality.fit(docs.where(~held_out()), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


@tidy
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: five-word shingles, similarity of 0.8 or more."""
    return neardup.deduplicate(docs)


@tidy
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that hold no benchmark item."""
    return decontaminate.clean_documents(docs, decontaminate.questions(spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


@tidy
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix does: never, once or twice."""
    return mixing.mixed_documents(docs)


@tidy
def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token sequences in training order as shards; the index says which document a slot holds."""
    return tokens.write_order(docs, scratch_path(spark))


STAGES = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing to target weights", mixing_stage),
    ("token ids in training order", token_stage),
]

#: Learned scores and tokenizers have no SQL form; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        after = materialise(stage(spark, docs, sf_dir))
        discard(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
