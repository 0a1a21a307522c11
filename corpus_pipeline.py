"""The corpus pipeline: from raw documents to sharded training data."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from planeweave.llm.bbit import dedup_stage
from planeweave.llm.common import prepare
from planeweave.llm.decontam import decontaminate_stage
from planeweave.llm.langid import identify_stage
from planeweave.llm.mixing import mix_stage
from planeweave.llm.sharding import shard_stage
from planeweave.session import shared_folder

STAGES = [
    ("language_id", identify_stage),
    ("minhash_dedup", dedup_stage),
    ("decontamination", decontaminate_stage),
    ("source_mixing", mix_stage),
    ("sharding", shard_stage),
]

# Language models, signatures and index retrieval cannot be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`; each stage's rows are written and read again."""
    prepare(spark)
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
