"""Reuse of what hasn't changed, and small relational helpers of a refresh."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import SECTION
from ..plans import graph as G
from ..plans.graph import Graph


def split_pages(new: DataFrame, prior: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(unchanged, changed) of new (url, content_hash, ...): unchanged where prior (url, content_hash) has the same hash.

    Pages are parsed after this, so that only the changed ones are.
    """
    same = prior.select("url", "content_hash").distinct()
    return new.join(same, ["url", "content_hash"], "left_semi"), new.join(same, ["url", "content_hash"], "left_anti")


def prior_pages(graph: Graph) -> DataFrame:
    """model.PAGE rows of the pages that a graph holds: their sections by anchor, the preamble first."""
    o, at = graph.onto, lambda p, name: graph.values(p, name)
    page = graph.instances("DocPage").select("s")
    for p, name in ((o("url"), "url"), (o("contentHash"), "content_hash"), (G.TITLE, "title")):
        page = page.join(at(p, name), "s")
    page = page.join(at(o("detail"), "detail"), "s", "left")
    part = graph.instances("DocSection").select("s").join(graph.where(o("partOf")).select("s", F.col("o").alias("page")), "s")
    for p, name in ((o("heading"), "heading"), (o("level"), "level"), (o("text"), "text"), (o("anchor"), "anchor")):
        part = part.join(at(p, name), "s", "left")
    own = part.groupBy(F.col("page").alias("s")).agg(F.transform(F.array_sort(F.collect_list(F.struct("anchor", "heading", F.col("level").cast("int").alias("level"), F.coalesce("text", F.lit("")).alias("text")))), lambda x: F.struct(x["heading"].alias("heading"), x["level"].alias("level"), x["text"].alias("text"))).alias("rest"))  # a page's sections
    none = F.array().cast(f"array<{SECTION}>")
    pre = F.when(F.col("detail").isNotNull(), F.array(F.struct(F.lit("").alias("heading"), F.lit(0).alias("level"), F.col("detail").alias("text")))).otherwise(none)
    return page.join(own, "s", "left").select("url", "title", "content_hash", F.concat(pre, F.coalesce("rest", none)).alias("sections"))


def refreshed_pages(raw: DataFrame, prior: DataFrame, extract) -> DataFrame:
    """model.PAGE rows for raw (url, html): copied from prior where the hash is the same, else extracted."""
    hashed = raw.withColumn("content_hash", F.sha2("html", 256))
    same, changed = split_pages(hashed, prior)
    return prior.join(same.select("url", "content_hash"), ["url", "content_hash"], "left_semi").select("url", "title", "content_hash", "sections").unionByName(extract(changed))


def first_by(df: DataFrame, key: str, *order: str) -> tuple[DataFrame, DataFrame]:
    """(kept, skipped): the first row of each key, and the others with a reason. order tells a key's rows apart.

    The first row is a minimum, summed map-side, so that no task orders a key's rows.
    """
    own = F.struct(*order)
    n = df.join(df.groupBy(key).agg(F.min(own).alias("_first")), key)
    return n.where(own == F.col("_first")).drop("_first"), n.where(own != F.col("_first")).drop("_first").withColumn("reason", F.lit("duplicate"))


def capped(df: DataFrame, keys: list[str], order: str, most: int) -> DataFrame:
    """The first `most` rows of each group in source order: a limit of the source's contract, an option of the caller.

    Spark limits each task's groups before the shuffle (WindowGroupLimit), so a group's task gets `most` rows a task.
    """
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where(F.col("_n") <= most).drop("_n")
