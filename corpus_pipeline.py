"""A training corpus from raw documents, in five stages.

Each stage reads what the one before kept, from Parquet in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import language_id, line_dedup, packing, quality, simhash
from palimpsest.llm.common import Workspace, documents

STAGES = [
    ("language_id", language_id.stage),
    ("quality_rules", quality.stage),
    ("line_dedup", line_dedup.stage),
    ("simhash_dedup", simhash.stage),
    ("best_fit_packing", packing.stage),
]

#: Learned classifiers decide the first two stages, so SQL cannot express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written and reread."""
    space = Workspace(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = space.write(stage(spark, docs, sf_dir), name)
    return docs
