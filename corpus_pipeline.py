"""A corpus from raw documents to packed sequences; each stage's rows are written and read by the next.

Defined cases, of every stage: columns that are not read are kept as they are, whatever their
names; an empty table gives an empty one; null and empty texts are rows like others (not toxic,
of fingerprint zero, without secrets, of size 0, a single id); rows with null doc_id take part
but are chosen last; repeated rows are rows of their own, of which the second stage leaves one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bucket_of, materialize
from tessera.llm.op1_packing import pack
from tessera.llm.op2_toxicity import learn, score
from tessera.llm.op3_secrets import redact
from tessera.llm.op5_simhash import first_of_each
from tessera.llm.op10_mixing import resample
from tessera.ship import ship


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents predicted to be toxic; the labels of a third of the ids stay unseen."""
    labels = ship(spark).read.parquet(f"{sf_dir}/labels.parquet")
    model = learn(docs, labels, bucket_of(F.col("doc_id"), 3) != 1)
    return score(docs, model, docs.columns).where("predicted = 0").select("_row.*")


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: that of the smallest doc_id."""
    ship(spark)
    return first_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document, with a mark in place of each secret."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: not at all, once or twice."""
    return resample(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    ship(spark)
    return pack(docs)


STAGES = [("toxicity", toxicity), ("simhash", simhash), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]

#: SQL can't express the learned and iterative stages; tests hold each stage against brute force on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to the table documents."""
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
