"""Landed API responses about pull requests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import PULL, REVIEW

#: Fixed values.
COMMENTS, REVIEW_COMMENTS, REVIEWS = 50, 100, 100
RETRY_DELAYS = (5, 15, 45)


def pages_of(text: str) -> list[dict]:
    """Items of JSON arrays written one after the other; what is malformed at the end is left out."""
    out, at, dec = [], 0, json.JSONDecoder()
    while at < len(text):
        while at < len(text) and text[at].isspace():
            at += 1
        try:
            items, at = dec.raw_decode(text, at)
        except ValueError:
            break
        out += items if isinstance(items, list) else [items]
    return out


def land(spark: SparkSession, text: str, path: str) -> int:
    """Writes a response's items as JSON lines for `pulls` and `reviews` to read; returns their number."""
    rows = [(i, json.dumps(x)) for i, x in enumerate(pages_of(text))]
    spark.createDataFrame(rows, "ordinal long, value string").selectExpr("to_json(struct(ordinal, value)) value").write.mode("overwrite").text(path)
    return len(rows)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    landed = spark.read.schema("ordinal long, value string").json(path)
    return landed.select("ordinal", F.from_json("value", schema).alias("x")).select("ordinal", "x.*")


def pulls(spark: SparkSession, path: str, slug: str, most: int | None = None) -> DataFrame:
    df = _read(spark, path, PULL).withColumn("slug", F.lit(slug))
    return df.where(F.col("ordinal") < most) if most is not None else df


def reviews(spark: SparkSession, path: str, slug: str, number: int) -> DataFrame:
    return _read(spark, path, REVIEW).withColumn("slug", F.lit(slug)).withColumn("number", F.lit(number).cast("long"))


def reviews_of_all(spark: SparkSession, path: str, slug: str) -> DataFrame:
    """Landed reviews of many pulls: JSON lines of model.REVIEW with number and ordinal."""
    return spark.read.schema(f"number long, ordinal long, {REVIEW}").json(path).withColumn("slug", F.lit(slug))


def thread_states(threads: DataFrame) -> DataFrame:
    """(id, thread_state) from threads (comment_id, resolved, outdated): resolved beats outdated beats open."""
    state = F.when(F.col("resolved"), "resolved").when(F.col("outdated"), "outdated").otherwise("open")
    order = F.when(state == "resolved", 0).when(state == "outdated", 1).otherwise(2)
    return threads.groupBy(F.col("comment_id").alias("id")).agg(F.min_by(state, order).alias("thread_state"))


def numbered(df: DataFrame, *keys: str, order: str = "created_at") -> DataFrame:
    """ordinal from 0 in each group, where a response's own order wasn't landed."""
    return df.withColumn("ordinal", F.row_number().over(W.partitionBy(*keys).orderBy(order, "id")) - 1)
