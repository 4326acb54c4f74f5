"""Documents to training tokens: five stages, each over all rows that the one before kept."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from envspark.llm import decontaminate, mixing, simhash, token_store, toxicity
from envspark.llm.common import fold_of, shared_folder, table
from envspark.llm.queries import TOKENIZER


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject."""
    held_out = F.coalesce(fold_of(F.col("doc_id"), 3) == 1, F.lit(False))
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.drop_near_duplicates(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without long passages of the benchmark."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their targets."""
    return mixing.mix(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and what is read back from them for each document."""
    return token_store.encode_and_digest(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", keep_clean),
    ("simhash", keep_one_of_each_group),
    ("decontamination", keep_uncontaminated),
    ("mixing", mix_sources),
    ("tokens", write_token_files),
]

#: Training, fingerprints and tokenizing have no SQL. The tests compare the operators, one by one, with brute-force versions; not these stages in a row.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
