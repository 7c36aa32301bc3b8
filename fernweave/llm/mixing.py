"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key divided by its quality weight. Within a source the documents
are taken in the order of these keys until the prefix sum of their sizes meets the part of the
source's target that complete epochs (every document once) leave over.

The prefix sum needs no sort of a whole source in one task: keys are dealt into slices by a monotone
map, slice totals are summed up, and only the one slice of each source that the budget falls into
is ordered row by row. A slice holds about `slice_rows` rows, whatever the source's size.

Defined cases: a null or empty text has size 0 and is taken 0 words; a null source is a source of
its own, last in the order; sources are of any number; a document without doc_id draws its key from its text; equal keys are ordered by text
hash, and rows equal in id and text are interchangeable; an empty table gives an empty result; extra
columns of the input stay as they are, but for those named like a returned one (replaced) and those
that begin with an underscore (reserved).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_WORDS, read, small_enough, written

WEIGHTS, SHARE, MOST, SEED = (3.0, 1.0, 2.0), 1.5, 2.0, "mix-1"
SYMBOLS = "#*$%&|<>!"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORDS)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """1 for prose, down to 0.05 for texts of which a quarter or more are symbols."""
    chars = F.greatest(F.length(text), F.lit(1))
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return F.greatest(F.lit(0.05), F.lit(1.0) - F.lit(4.0) * (symbols.cast("double") / chars.cast("double")))


def name_of(doc_id: Column, text: Column) -> Column:
    """What a document's key is drawn from: its id, or without one its text."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")))))


def exponential_key(name: Column, weight: Column, seed: str = SEED) -> Column:
    """-ln(u) / weight with u in (0, 1] from 52 bits of an MD5 of the seed and the document's name."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), name)), 1, 13), 16, 10)
    u = (bits.cast("double") + F.lit(1.0)) / F.lit(float(1 << 52))
    return -F.log(u) / weight


def even(e: Column) -> Column:
    """A monotone map of keys to [0, 1] that spreads keys of any weight from 0.05 to 1: no slice gathers one weight."""
    return F.lit(1.0) - (F.exp(-e) + F.exp(e * -0.4) + F.exp(e * -0.15) + F.exp(e * -0.05)) / F.lit(4.0)


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """rows, written, with _rank from 0 in a total order: sorted by ranges, counted by range."""
    low = (1 << 33) - 1
    own = written(rows.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit(low))), "ranks")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = own.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")  # a row a range
    return own.join(F.broadcast(parts), "_part").withColumn("_rank", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def source_targets(sized: DataFrame, source: str, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(_ps, source_size, target, _rows): the targets of the sources, which take the weights in code point order with null last.

    A round shares what the capped sources leave over among the others and caps those that get too much; it ends when
    none does. A round is one aggregate over the table of sources, of any number; the driver gets two sums.
    """
    rows = sized.groupBy(F.col(source).alias("_ps")).agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("_rank") % len(weights) + 1).cast("int"))
    cap = F.lit(float(most)) * F.col("source_size")
    own = written(ranked(rows, F.col("_ps").asc_nulls_last()).withColumn("_w", w).withColumn("_cap", cap), "sources")
    total = share * float(own.agg(F.sum("source_size")).first()[0] or 0)
    full, part, last = F.lit(False), F.col("_cap"), None
    while True:
        sums = own.agg(F.sum(F.when(full, F.col("_cap"))).alias("c"), F.sum(F.when(~full, F.col("_w"))).alias("w"), F.count_if(full).alias("n")).first()
        if not sums["w"] or sums["n"] == last:
            break
        part = F.lit(total - (sums["c"] or 0.0)) * F.col("_w") / F.lit(sums["w"])
        full, last = full | (part > F.col("_cap")), sums["n"]
    return own.select("_ps", "source_size", F.when(full, F.col("_cap")).otherwise(part).alias("target"), "_rows")


def mix(docs: DataFrame, source: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED, slice_rows: int = 4096, keep_text: bool = True) -> DataFrame:
    """docs, with or without their text, with size, source_size, target and taken: whole epochs times the size, and once more if drawn."""
    sized = docs.withColumn("size", n_words(F.col("text")))
    sized = sized.withColumn("_w", F.coalesce(quality_weight(F.col("text")), F.lit(1.0))).withColumn("_tie", F.xxhash64("text")).withColumn("_name", name_of(F.col("doc_id"), F.col("text")))
    if not keep_text:
        sized = written(sized.drop("text"), "sizes")  # each text is read once
    plan = written(source_targets(sized, source, weights, share, most), "targets")
    few = small_enough(plan)  # as is `edge` below: a row a source at most
    side = F.broadcast if few else lambda df: df
    keyed = (
        sized.withColumn("_s", F.col(source))
        .withColumn("_e", exponential_key(F.col("_name"), F.col("_w"), seed))
        .join(side(plan), F.col("_s").eqNullSafe(F.col("_ps")))
        .drop("_ps")
        .withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
        .withColumn("_budget", F.col("target") - F.col("_epochs") * F.col("source_size"))
        .withColumn("_slice", F.floor(even(F.col("_e")) * F.ceil(F.col("_rows") / F.lit(slice_rows))))
    )
    # one row a slice: prefix sums over these, themselves split in groups of slices
    slices = keyed.groupBy("_s", "_slice", "_budget").agg(F.sum("size").alias("_n")).withColumn("_group", F.floor(F.col("_slice") / 4096))
    groups = slices.groupBy("_s", "_group").agg(F.sum("_n").alias("_gn"))
    over = Window.partitionBy("_s").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("_gb", F.coalesce(F.sum("_gn").over(over), F.lit(0))).drop("_gn")
    within = Window.partitionBy("_s", "_group").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    g = groups.alias("g")
    slices = slices.withColumn("_b", F.coalesce(F.sum("_n").over(within), F.lit(0))).alias("x")
    slices = slices.join(g, F.col("x._s").eqNullSafe(F.col("g._s")) & (F.col("x._group") == F.col("g._group"))).select("x._s", "x._slice", "x._n", "x._budget", (F.col("x._b") + F.col("g._gb")).alias("_before"))
    # the slice into which the budget falls: the first whose end reaches it
    edge = slices.where((F.col("_before") < F.col("_budget")) & (F.col("_before") + F.col("_n") >= F.col("_budget"))).groupBy("_s").agg(F.min(F.struct("_slice", "_before")).alias("_edge"))
    edge = edge.select(F.col("_s").alias("_es"), F.col("_edge._slice").alias("_at"), F.col("_edge._before").alias("_before"))
    keyed = keyed.join(side(edge), F.col("_s").eqNullSafe(F.col("_es")), "left").drop("_es")
    order = Window.partitionBy("_s").orderBy("_e", F.col("doc_id").asc_nulls_first(), "_tie")
    inner = keyed.where(F.col("_slice") == F.col("_at")).withColumn("_end", F.col("_before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # a document across the budget is drawn if that brings the sum nearer to it
    inner = inner.withColumn("_drawn", F.col("_end") - F.col("size") / F.lit(2.0) <= F.col("_budget")).drop("_end")
    outer = keyed.where(F.col("_at").isNull() | (F.col("_slice") != F.col("_at"))).withColumn("_drawn", F.col("_at").isNotNull() & (F.col("_slice") < F.col("_at")))
    out = inner.unionByName(outer)
    return out.withColumn("taken", (F.col("size") * (F.col("_epochs") + F.col("_drawn").cast("int"))).cast("long")).withColumn("copies", (F.col("_epochs") + F.col("_drawn").cast("int")).cast("int")).drop("_s", "_e", "_w", "_tie", "_name", "_rows", "_epochs", "_budget", "_slice", "_at", "_before", "_drawn")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep_text=False)
    return out.select("doc_id", "size", "source_size", "target", "taken")


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: every document as often as it is taken, with copy (from 1), size, source_size and target beside its columns."""
    own = ["size", "source_size", "target"]
    kept = [c for c in docs.columns if c not in (*own, "copy")]
    return mix(docs.select(*kept)).where("copies > 0").select(*kept, *own, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
