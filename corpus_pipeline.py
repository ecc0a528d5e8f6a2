"""A pipeline from documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next stage's documents. All but the
last return the columns of documents. Models are fitted on the labelled documents of ``sf_dir``, within the bounds of their operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from editlore.llm.chosen_path import near_duplicates_stage
from editlore.llm.common import stored
from editlore.llm.decontamination import decontamination_stage
from editlore.llm.packing import packing_stage
from editlore.llm.quality import quality_stage
from editlore.llm.toxicity import toxicity_stage

STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("n-gram Jaccard join", near_duplicates_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]

#: SQL cannot express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
