"""The corpus pipeline: documents in, packed sequences out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowloom.llm import stages
from rowloom.llm.common import read_table
from rowloom.session import stage_path

#: Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES = [
    ("language_id", stages.language_id),
    ("exact_dedup", stages.exact_dedup),
    ("near_dedup", stages.near_dedup),
    ("mixing", stages.mixing),
    ("packing", stages.packing),
]

#: Trained models, sketches and subword ids are beyond SQL: tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again, so a lost executor costs one stage at most. ``drop_stages`` deletes what it wrote."""
    root = stage_path(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{root}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
