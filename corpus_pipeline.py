"""A corpus pipeline of the training-data operators: documents in, packed sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breakfold.llm import exact, neardup, packing, quality, substring
from breakfold.llm.common import delete, table, work_folder

#: Documents that score less are rejected.
LEAST_QUALITY = 0.5
#: Near duplicates: five-word shingles, similarity 0.8; a pair at 0.8 is missed with probability 1e-7.
NEAR = neardup.Params(shingle=5, percent=80, rows=4, bands=30)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit_sample(docs, table(spark, sf_dir, "labels"), "quality", held_out=quality.quarter_held_out)
    return quality.keep_good(docs, model, LEAST_QUALITY)


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.keep_first(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_first(docs, NEAR)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less the passages of 50 words or more that a document with a smaller id has; a text that keeps all its words stays as it was."""
    left = substring.ingest(docs, substring.Index(spark), with_text=True, with_row=True)
    n = F.length(F.coalesce("text", F.lit(""))).cast("long")
    made = {"text": F.col("text"), "n_chars": n}
    return left.select(*[made.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, tokenizer=public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality classifier", good), ("exact dedup", unique), ("near dedup", distinct), ("substring dedup", without_repeats), ("best-fit packing", packed)]

#: SQL can't express the learned and hashed stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; what a stage returns is written to the shared checkpoint folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{work_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                delete(spark, f"{folder}/{k - 1}")
    return docs
