"""The corpus pipeline: documents through the stages below, each written as Parquet and read again.

A stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.bpe import bpe_encode
from panelcast.llm.common import read_table
from panelcast.llm.exact_dedup import exact_dedup
from panelcast.llm.langid import keep_identified
from panelcast.llm.mixing import mix
from panelcast.llm.ngram_join import drop_near_copies
from panelcast.session import ensure_checkpoint_dir

VOCABULARY = "byte_bpe_50k.json"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised (a model trained on their labels; null labels are not learned from)."""
    return keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the smallest id."""
    return exact_dedup(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similarity 0.8 or more hold together, the smallest id."""
    return drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document; the document at a source's cut is shortened."""
    return mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with token_ids, n_tokens and round_trip (whether decoding the ids gives the text again)."""
    out = bpe_encode(docs, public_tokenizers.path(VOCABULARY), check_col="round_trip")
    return out.withColumn("n_tokens", F.size("token_ids").cast("bigint"))


STAGES = [
    ("language id", identify_language),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage returns is written to the checkpoint folder and read again."""
    base = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{k}")
            docs = spark.read.parquet(f"{base}/{k}")
    return docs
