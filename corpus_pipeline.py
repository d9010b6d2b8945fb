"""A corpus through quality selection, deduplication, decontamination and tokenisation.

Each stage works on all rows that the one before kept and returns the columns of
`documents`; the last returns token ids and the text decoded from them.  What a
stage returns is to be written before the next one starts: a stage begins by
deleting the tables that the stage before it worked with, and no others, and
gives back the driver memory that the stage before it no longer needs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gaussmill.llm.byte_bpe import encode_decode
from gaussmill.llm.common import scratch, written
from gaussmill.llm.decontaminate import decontaminate
from gaussmill.llm.exact_dedup import exact_dedup
from gaussmill.llm.near_copies import drop_near_copies
from gaussmill.llm.quality import select_quality
from gaussmill.runtime import Scratch, give_back, shared_folder

_tables: dict[str, Scratch] = {}


def stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage whose tables live until the next stage of the application begins."""

    @wraps(work)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own = _tables.setdefault(spark.sparkContext.applicationId, Scratch(spark))
        own.keep_last(0)
        give_back(spark)
        with scratch(own):
            return work(spark, docs, sf_dir)

    return begun


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the top grade (good and clean) is one half or more."""
    return select_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal normalised texts."""
    return exact_dedup(docs)


@stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component under links of five-word similarity 0.8 or more."""
    return drop_near_copies(docs)


@stage
def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded."""
    return encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("near dedup", near), ("decontamination", clean), ("byte BPE", tokens)]
ORACLE_SQL = None  # models, fingerprints and merges can't be written in SQL; tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name, f"{shared_folder(spark)}/stage-{uuid4().hex}")
    return STAGES[-1][1](spark, docs, sf_dir)
