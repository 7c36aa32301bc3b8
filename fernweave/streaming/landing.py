"""Landed files as a stream: each run takes what is new and ends, and quads are appended once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import ISSUE


def issue_stream(spark: SparkSession, folder: str) -> DataFrame:
    """model.ISSUE rows of JSON lines that are landed in a folder."""
    return spark.readStream.schema(ISSUE).json(folder)


def append_quads(stream: DataFrame, build: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Builds the quads of each batch of new files and appends those that the table hasn't yet.

    A batch that is run again after a failure finds its own quads there: the table stays a set.
    """

    def batch(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        new = build(df).dropDuplicates()
        keys = ["g", "s", "p", "o", "o_kind"]
        try:
            old = spark.read.parquet(path)
            dt = lambda d: d.withColumn("_dt", F.coalesce("o_dt", F.lit("")))
            new = dt(new).join(dt(old).select(*keys, "_dt").distinct(), [*keys, "_dt"], "left_anti").drop("_dt").select(old.columns)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        new.write.mode("append").partitionBy("g").parquet(path)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, every: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, event_type, n) of a stream of events (ts, event_type), with late rows within the watermark."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return w.groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
