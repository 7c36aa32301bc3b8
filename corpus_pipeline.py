"""The corpus pipeline: STAGES in order, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fernweave.llm import decontaminate, mixing, neardup, pii, quality_rules
from fernweave.llm.common import drop_since, marked, read, written

#: (name, function of (spark, docs, sf_dir)); all but the last return the columns of documents.
STAGES = [
    ("quality rules", quality_rules.stage_quality),
    ("near dedup", neardup.stage_near_dedup),
    ("decontamination", decontaminate.stage_decontaminate),
    ("personal data", pii.stage_pii),
    ("mixing sources", mixing.stage_mix),
]

#: No single SQL statement expresses the learned stages; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is a Parquet table in the shared folder, read again by the next.

    What a stage has written on its way, and the result before, are deleted when its own result is there.
    """
    docs, mark = read(spark, sf_dir, "documents"), marked()
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        drop_since(mark, docs)
    return docs
