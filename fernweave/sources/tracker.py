"""Tracker exports: JSON arrays of issues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ISSUE

#: The fields that a record has to have.
REQUIRED = ("identifier", "title", "description", "branchName", "state", "labels", "project", "parent", "comments", "relations")


def raw_records(spark: SparkSession, path: str) -> DataFrame:
    """(value): each record of a JSON array, as it was written. Anything but an array is an error."""
    whole = spark.read.option("wholetext", "true").text(path)
    rows = whole.select(F.from_json("value", "array<string>").alias("x"), "value")
    if rows.where("x is null").limit(1).count():
        raise ValueError(f"{path} isn't a JSON array")
    return rows.select(F.explode("x").alias("value"))


def issues(records: DataFrame) -> DataFrame:
    """model.ISSUE rows of records (value); comments stay JSON, for they come in two shapes."""
    return records.select(F.from_json("value", ISSUE).alias("x")).select("x.*")


def missing_fields(records: DataFrame) -> DataFrame:
    """(field, n): records that lack the key. A key with null isn't missing."""
    keys = F.json_object_keys("value")
    counts = records.agg(*[F.count_if(~F.coalesce(F.array_contains(keys, f), F.lit(False))).alias(f) for f in REQUIRED])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("n")) for f in REQUIRED])).alias("x")).select("x.*")
