"""Benchmark decontamination by winnowing, in DataFrame and SQL functions only.

Words of items and documents are hashed in k-grams; of every window of w consecutive k-gram hashes
the smallest is kept. A span of w + k - 1 words shared by both sides has
the same w hashes on both sides and so at least one kept hash in common: with k = 5 and w = 6 no
shared span of 10 words is missed. Fingerprints of both sides are joined, and each hit is extended:
of the windows of 10 document words around it, those that are windows of an item, compared word by
word, mark their words. Items of fewer words than a window are one window each; as winnowing promises
nothing below 10 words, their lengths (nine at most) are looked up directly.

Only distinct fingerprints and windows of the benchmark are on the small side; Spark broadcasts it
where its measured size allows that and else joins by a shuffle that it may split.

Defined cases: a null or empty document has no words and is clean; a null or empty item has no
window; a window in several items names them all; rows equal in doc_id and text are one document and
get the same result each; an empty benchmark leaves all clean; a null item_id is left out of the list
of items; columns other than doc_id, item_id and text are passed by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, read, row_key, small_enough, written

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPAN, K = 10, 5


def words(text: Column) -> Column:
    """Words of a text, as an array; null: none."""
    return F.coalesce(F.regexp_extract_all(lower_ascii(text), F.lit(WORDS), F.lit(0)), F.array().cast("array<string>"))


def windows(col: str, n: int | str) -> Column:
    """All runs of n words as strings; words hold no space, so a run's string is the run."""
    return F.expr(f"transform(sequence(1, size({col}) - {n} + 1), i -> array_join(slice({col}, i, {n}), ' '))")


def winnowed(w: str, k: int, span: int) -> Column:
    """Kept k-grams of an array of words as longs: 32 bits of hash, then 32 bits of position (from 0). Fewer than `span` words: none.

    Hash and position are one number, so that the least of a window is one call without intermediate arrays.
    """
    wide = span - k + 1
    gram = "xxhash64(" + ", ".join(f"h[i + {j}]" for j in range(k)) + ")"
    grams = f"transform(sequence(0, size(h) - {k}), i -> shiftleft({gram}, 32) | cast(i as bigint))"
    least = "least(" + ", ".join(f"g[i + {j}]" for j in range(wide)) + ")"
    kept = f"array_distinct(transform(sequence(0, size(g) - {wide}), i -> {least}))"
    return F.expr(f"case when size({w}) >= {span} then transform(array(transform({w}, x -> xxhash64(x))), h -> transform(array({grams}), g -> {kept})[0])[0] else array() end")


def item_windows(items: DataFrame, span: int) -> DataFrame:
    """Distinct windows (n, window, item_ids): n words each, with the sorted ids of the items that have them."""
    w = items.select("item_id", words(F.col("text")).alias("_w")).where("size(_w) > 0").withColumn("n", F.least(F.size("_w"), F.lit(span)))
    rows = w.select("item_id", "n", F.explode(windows("_w", "n")).alias("window"))
    return rows.groupBy("n", "window").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))


def fingerprints(items: DataFrame, k: int, span: int) -> DataFrame:
    w = items.select(words(F.col("text")).alias("_w"))
    return w.select(F.explode(winnowed("_w", k, span)).alias("f")).select(F.shiftright("f", 32).alias("hash")).distinct()


def sketched(docs: DataFrame, k: int, span: int) -> DataFrame:
    """(doc_id, _k, n_words, prints) of each document, written: texts are cut in words once."""
    w = docs.select("doc_id", row_key().alias("_k"), words(F.col("text")).alias("_w"))
    return written(w.select("doc_id", "_k", F.size("_w").cast("long").alias("n_words"), winnowed("_w", k, span).alias("prints")), "prints")


def hit_windows(docs: DataFrame, sketch: DataFrame, items: DataFrame, k: int, span: int) -> DataFrame:
    """(_k, start, n, item_ids): occurrences of item windows in documents, without repeated documents."""
    known = item_windows(items, span)
    prints = sketch.select("_k", F.explode("prints").alias("f")).select("_k", F.shiftright("f", 32).alias("hash"), F.expr("cast(f & 4294967295 as int)").alias("_p"))
    hits = prints.join(fingerprints(items, k, span), "hash", "left_semi")
    at = written(hits.groupBy("_k").agg(F.collect_set("_p").alias("_at")), "hits")  # positions in one document
    at = F.broadcast(at) if (at.agg(F.sum(F.size("_at") * 4 + 64)).first()[0] or 0) <= 8 << 20 else at
    # extension: every window of `span` words that holds a kept k-gram, in the documents that have one
    around = f"""array_distinct(flatten(transform(_at, p -> sequence(greatest(p - {span - k}, 0), least(p, size(_w) - {span})))))"""
    own = docs.select(row_key().alias("_k"), "text").join(at, "_k").dropDuplicates(["_k"]).select("_k", "_at", words(F.col("text")).alias("_w"))
    near = own.withColumn("_s", F.expr(around))
    near = near.select("_k", F.explode(F.expr(f"transform(_s, s -> struct(s as start, array_join(slice(_w, s + 1, {span}), ' ') as window))")).alias("x"))
    near = near.select("_k", F.col("x.start").alias("start"), F.lit(span).alias("n"), F.col("x.window").alias("window"))
    out = near.join(known, ["n", "window"])
    short = [r["n"] for r in known.where(F.col("n") < span).select("n").distinct().collect()]  # span - 1 numbers at most
    if short:
        w = docs.select(row_key().alias("_k"), words(F.col("text")).alias("_w"))
    for n in short:
        whole = known.where(F.col("n") == n).drop("n")
        whole = F.broadcast(whole) if small_enough(whole, row_bytes=512) else whole  # then no run of a document is shuffled
        runs = w.where(F.size("_w") >= n).select("_k", F.posexplode(windows("_w", n)).alias("start", "window"))
        out = out.unionByName(runs.join(whole, "window").withColumn("n", F.lit(n)).dropDuplicates(["_k", "start", "n"]))
    return out.select("_k", "start", "n", "item_ids")


def decontaminate(docs: DataFrame, items: DataFrame, k: int = K, span: int = SPAN) -> DataFrame:
    """(doc_id, n_words, n_hit, item_ids (sorted), n_items, items_sha256, contaminated) of each document."""
    sketch = sketched(docs, k, span)
    hits = hit_windows(docs, sketch, items, k, span)
    # a document's hits are bounded by its own words: distinct (start, n)
    per = hits.groupBy("_k").agg(F.collect_set(F.struct("start", "n")).alias("_h"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"))
    covered = "cast(size(array_distinct(flatten(transform(_h, x -> sequence(x.start, x.start + x.n - 1))))) as bigint)"
    per = per.select("_k", "item_ids", F.expr(covered).alias("n_hit"))
    out = sketch.select("doc_id", "_k", "n_words").join(per, "_k", "left").drop("_k")
    out = out.withColumn("item_ids", F.coalesce("item_ids", F.array().cast("array<string>"))).withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long")))
    return out.withColumn("n_items", F.size("item_ids").cast("long")).withColumn("items_sha256", F.sha2(F.array_join("item_ids", ","), 256)).withColumn("contaminated", F.col("n_hit") > 0)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate(docs, read(spark, sf_dir, "benchmark").select("item_id", "text"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the contaminated ones."""
    own = docs.select("doc_id", "text")
    gone = written(hit_windows(own, sketched(own, K, SPAN), read(spark, sf_dir, "benchmark").select("item_id", "text"), K, SPAN).select("_k").distinct(), "hits")
    gone = F.broadcast(gone) if small_enough(gone, row_bytes=32) else gone
    keyed = docs.withColumn("__row_key", row_key())
    return keyed.join(gone, keyed["__row_key"] == gone["_k"], "left_anti").select(*docs.columns)
