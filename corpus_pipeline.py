"""The corpus pipeline: toxicity, near copies, secrets, mixing, encoding; each stage is one operator of pagewright.llm.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of documents. A stage's rows are written and read again before the next one begins."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import remove, shared_folder, table
from pagewright.llm.mixing import mix
from pagewright.llm.pieces import encode_pieces
from pagewright.llm.secrets import redact_secrets
from pagewright.llm.simhash import group_representatives
from pagewright.llm.toxicity import THRESHOLD, fit, score_toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold. The model learns from the labels of documents that are still there."""
    weights = fit(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs.select(*COLUMNS), weights).where(F.col("score") < THRESHOLD).drop("score")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: the one with the smallest id, without an id only if no row of its group has one."""
    return group_representatives(docs.select(*COLUMNS), list(COLUMNS))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    return redact_secrets(docs.select(*COLUMNS)).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the calibrated weights draw, each as often as it is drawn."""
    drawn = mix(docs.select(*COLUMNS)).where("mix_copies > 0")
    return drawn.select(*COLUMNS, F.explode(F.sequence(F.lit(1).cast("long"), "mix_copies"))).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their piece ids."""
    return encode_pieces(docs.select(*COLUMNS), public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("toxicity", toxicity), ("near_copies", near_copies), ("secrets", secrets), ("mixing", mixing), ("encoding", encoding)]

#: SQL can express neither the training of the model nor the fingerprints, components and piece codes.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Its folder stays, as they are read from it; the others go once the next stage is written."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    last = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last:
            remove(spark, f"{folder}/{last}")
        last = name
    return docs
