"""Substring dedup over sliding sentence spans.

A text is cut in sentences: after sentence marks with white space behind them, and after a line's end;
white space goes with the sentence before it, and the pieces put together are the text. Every run of
consecutive sentences is hashed that has `run` sentences and `min_words` words: forward from each
sentence as many as it takes, and backward from each sentence likewise, so that a repeated passage of
that size is covered whole, however short its sentences. So is a single sentence of `long_words` or
more. Runs are compared by their words, whatever the white space between them.
Equal runs of the whole corpus meet in one group; its first one, by doc_id, text hash and place, stays,
and every sentence that a later one covers is removed.

Texts are cut and hashed in Arrow batches; the cost of a run doesn't depend on its length. First only
hashes are counted, summed map-side; of runs whose hash occurs once nothing else is kept. A group is a count and a minimum, so a run that a third of all rows
share is a few rows a task; runs and groups meet in a join that can be split where one group is large.

Defined cases: a null or empty text has no sentences and stays as it is; a text of white space is one
sentence; a null doc_id comes first; doc_id is of any type that has an order; rows equal in doc_id and
text are one document stored repeatedly and get the same result each; a text may become empty, its row
stays; an empty table gives an empty result; extra columns stay but for those named like a returned
one and those that begin with `_`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetext import find_words, mixed, run_hashes, word_hashes
from .common import pieces, read, row_key, text_bytes, written

RUN, MIN_WORDS, LONG_WORDS = 2, 16, 30
MARKS = np.zeros(256, bool)
MARKS[list(b".!?")] = True


def sentences(data: np.ndarray, offsets: np.ndarray, ws: np.ndarray, we: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each sentence with words, and the number of words; the text of each such sentence)."""
    if not len(ws):
        return np.zeros(1, np.int64), np.zeros(0, np.int64)
    lines = np.zeros(len(data) + 1, np.int32)
    np.cumsum(data == 10, out=lines[1:])
    new = np.ones(len(ws), bool)
    new[1:] = (at[1:] != at[:-1]) | MARKS[data[we[:-1] - 1]] | (lines[ws[1:]] > lines[we[:-1]])
    first = np.flatnonzero(new)
    return np.concatenate([first, [len(ws)]]), at[first]


def spans(words: np.ndarray, text: np.ndarray, run: int, min_words: int, long_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the runs of sentences, given where sentences' words begin (and the end of all), and their texts."""
    n = len(text)
    i = np.arange(n)
    low = np.searchsorted(text, text)  # a text's first sentence
    high = np.searchsorted(text, text, "right")
    end = np.maximum(np.searchsorted(words, words[:-1] + min_words), i + run)  # the fewest sentences with words enough
    first = np.minimum(np.searchsorted(words, words[1:] - min_words, "right") - 1, i + 1 - run)
    one = words[1:] - words[:-1] >= long_words
    ahead, back = end <= high, first >= low
    runs = np.concatenate([i[ahead] * (n + 1) + end[ahead], first[back] * (n + 1) + i[back] + 1, i[one] * (n + 1) + i[one] + 1])
    runs = np.unique(runs)
    return runs // (n + 1), runs % (n + 1)


def runs_of(docs: DataFrame, run: int, min_words: int, long_words: int, places: bool = True) -> DataFrame:
    """(doc_id, ka, kb, a, b, place) of the runs of docs (doc_id, ka, kb, text): 128 bits of hash, and first sentence << 32 | sentences; without places only a."""
    out = "a long" if not places else f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ka long, kb long, a long, b long, place long"

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in pieces(batches, "text", 1 << 20):
            data, offsets, _ = text_bytes(x.column(3))
            ws, we, at = find_words(data, offsets)
            words, text = sentences(data, offsets, ws, we, at)
            first, end = spans(words, text, run, min_words, long_words)
            h = word_hashes(data, ws, we)
            a = pa.array(run_hashes(h, words[first], words[end]).view(np.int64))
            if not places:
                yield pa.RecordBatch.from_arrays([a], names=["a"])
                continue
            b = pa.array(run_hashes(mixed(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), words[first], words[end]).view(np.int64))
            place = (first - np.searchsorted(text, text)[first]) << 32 | (end - first) if len(first) else first
            own = pa.array(text[first])
            yield pa.RecordBatch.from_arrays([*(x.column(i).take(own) for i in range(3)), a, b, pa.array(place)], names=["doc_id", "ka", "kb", "a", "b", "place"])

    return docs.select("doc_id", "ka", "kb", F.col("text").cast("string").alias("text")).mapInArrow(made, out)


def repeated(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS, long_words: int = LONG_WORDS) -> DataFrame:
    """(_k, start, n): the runs of documents that are equal to an earlier one. _k: the key of the document's row."""
    keyed = docs.select("doc_id", row_key()["a"].alias("ka"), row_key()["b"].alias("kb"), "text")
    often = written(runs_of(keyed, run, min_words, long_words, places=False).groupBy("a").agg(F.count("*").alias("_c")).where("_c > 1").select("a"), "often")
    made = runs_of(keyed, run, min_words, long_words)
    own = written(made.join(often.hint("merge"), "a", "left_semi"), "runs")  # alike at every size
    at = F.struct("doc_id", "ka", "kb", "place")
    # rows equal in id and text are one document: their runs are one run
    groups = own.groupBy("a", "b").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first != last").drop("last")
    groups = written(groups, "groups")  # so that both sides of the join are read from a shuffle, and a large group's is split
    later = own.join(groups.hint("merge"), ["a", "b"]).where(at != F.col("first"))
    key = F.struct(F.col("ka").alias("a"), F.col("kb").alias("b")).alias("_k")
    return later.select(key, F.shiftright("place", 32).cast("int").alias("start"), F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("n"))


def dedup(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS, long_words: int = LONG_WORDS) -> DataFrame:
    """docs with the text that is left, n_sentences and n_removed."""
    per = repeated(docs, run, min_words, long_words).groupBy("_k").agg(F.collect_set(F.struct("start", "n")).alias("_r"))  # bounded by a document's own sentences
    gone = per.select("_k", F.expr("array_distinct(flatten(transform(_r, x -> sequence(x.start, x.start + x.n - 1))))").alias("_gone"))
    out = docs.withColumn("text", F.col("text").cast("string")).withColumn("_k", row_key()).join(gone, "_k", "left").drop("_k")
    out = out.withColumn("n_sentences", F.lit(0).cast("long")).withColumn("n_removed", F.lit(0).cast("long"))
    names = out.columns
    text, count, removed, which = (names.index(x) for x in ("text", "n_sentences", "n_removed", "_gone"))

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in pieces(batches, "text", 1 << 20):
            data, offsets, sizes = text_bytes(x.column(text))
            ws, we, at = find_words(data, offsets)
            words, of = sentences(data, offsets, ws, we, at)
            n = np.bincount(of, minlength=x.num_rows)
            cut = np.searchsorted(of, np.arange(x.num_rows))  # a text's first sentence
            old, n_gone = x.column(text), np.zeros(x.num_rows, np.int64)
            some = np.flatnonzero(np.asarray(x.column(which).is_valid()))
            if len(some):
                texts = old.to_pylist()
                for i in some.tolist():
                    stays = np.ones(n[i], bool)
                    stays[x.column(which)[i].values.to_numpy(zero_copy_only=False)] = False
                    begins = np.concatenate([[offsets[i]], ws[words[cut[i] + 1 : cut[i] + n[i]]], [offsets[i + 1]]])
                    n_gone[i] = n[i] - stays.sum()
                    texts[i] = b"".join(data[begins[j] : begins[j + 1]].tobytes() for j in np.flatnonzero(stays).tolist()).decode()
                old = pa.array(texts, old.type)
            cols = list(x.columns)
            cols[text], cols[removed] = old, pa.array(n_gone)
            cols[count] = pa.array(np.where((n == 0) & (sizes > 0), 1, n).astype(np.int64))
            yield pa.RecordBatch.from_arrays([c for j, c in enumerate(cols) if j != which], names=[c for j, c in enumerate(names) if j != which])

    return out.mapInArrow(left, out.drop("_gone").schema)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_sentences", "n_removed", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
