"""From raw documents to packed sequences: five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nearfold.llm.digest_index import exact_dedup_stage
from nearfold.llm.packing import packing_stage
from nearfold.llm.quality import quality_stage
from nearfold.llm.secrets import secrets_stage
from nearfold.llm.simhash import near_dedup_stage
from nearfold.scratch import discard, new_path, written

#: (name, function of (spark, docs, sf_dir)). All but the last return the columns of documents.
STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_dedup_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("secret scans", secrets_stage),
    ("best-fit packing", packing_stage),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what the stages keep of `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name.replace(" ", "_"))
        docs = written(stage(spark, docs, sf_dir), name, path)
        if before:
            discard(spark, before)  # nothing reads it any more
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
