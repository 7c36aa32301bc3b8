"""Quality classifier: a sparse ensemble of rules.

Boosted trees of depth three are grown over text statistics; each path from a root to a node is a
conjunctive rule. Lasso logistic regression over the rules leaves few with a weight, and these are
compiled to one Spark column expression over the columns of statistics. Trees and weights are fitted
in numpy on a bounded sample of labelled rows (`SAMPLE` at most, those of the smallest hashes of doc_id)
whose crc32(doc_id) modulo 5 isn't 0; statistics and scores cover all rows and whole texts. Labels,
lang, source and doc_id are no inputs of a score.

Defined cases: a null or empty text has statistics of zero and is scored like any other; labels other
than 0 and 1 are left out; without labelled rows of both classes the score is the share of label 1
(0.5 without any); of several labels of a doc_id the least counts, and of several texts that of the least
hash; doc_id is a whole number or null (another type is an error); equal rows get equal results; a null doc_id is never held out; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetext import per_text, statistics
from .common import pieces, read, text_bytes
from .quality_rules import labelled, sigmoid

SAMPLE, FOLDS, THRESHOLD = 8000, 5, 0.3
TREES, DEPTH, BINS, LASSO = 30, 3, 24, 2e-3
NAMES = ["n_bytes", "n_words", "word_length", "symbols", "upper", "digits", "pipes", "shouts", "stops", "commas", "lines", "dup_lines", "repeats", "bytes_a_char"]
Rule = tuple[tuple[int, bool, float], ...]  # (feature, at most, bound), all of them


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The statistics of each text, in the order of NAMES: sizes, and shares of characters or words."""
    s = statistics(data, offsets)
    n = np.diff(offsets)
    count = lambda chars: per_text(np.isin(data, np.frombuffer(chars, np.uint8)), offsets)
    chars = per_text((data & 0xC0) != 0x80, offsets)
    at_least = lambda x: np.maximum(x, 1)
    w = at_least(s["n_words"])
    lines = per_text(data == 10, offsets) + 1
    upper = per_text((data >= 65) & (data <= 90), offsets)
    cols = [n, s["n_words"], s["word_chars"] / w, s["n_symbols"] / at_least(chars), upper / w, count(b"0123456789") / at_least(chars), count(b"|") / w, count(b"!") / w, count(b".?") / w, count(b",;:") / w, lines / w, s["n_dup_lines"] / lines, s["n_repeat_words"] / w, n / at_least(chars)]
    return np.stack([np.asarray(c, float) for c in cols], 1)


def stats_of(docs: DataFrame) -> DataFrame:
    """doc_id and the columns of NAMES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", 1 << 20):
            data, offsets, _ = text_bytes(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in features(data, offsets).T)], names=["doc_id", *NAMES])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, " + ", ".join(f"{x} double" for x in NAMES))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def bounds_of(x: np.ndarray) -> list[np.ndarray]:
    """Split candidates of each feature: the middles between its quantiles."""
    out = []
    for c in x.T:
        q = np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)))
        out.append((q[1:] + q[:-1]) / 2)
    return out


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, bounds: list[np.ndarray], rows: np.ndarray, path: Rule, out: list[Rule], score: np.ndarray, rate: float = 0.3) -> None:
    """A tree by gain in the second-order loss; its nodes' paths go to out, its leaves' steps to score."""
    best = (1e-3, -1, 0.0)
    total_g, total_h = g[rows].sum(), h[rows].sum()
    if len(path) < DEPTH:
        for f, cut in enumerate(bounds):
            if not len(cut):
                continue
            k = np.searchsorted(cut, x[rows, f], "left")  # k cuts are below the value
            cg, ch = (np.cumsum(np.bincount(k, v[rows], len(cut) + 1))[:-1] for v in (g, h))
            gain = cg**2 / (ch + 1) + (total_g - cg) ** 2 / (total_h - ch + 1) - total_g**2 / (total_h + 1)
            gain[(ch < 1) | (total_h - ch < 1)] = 0
            j = int(gain.argmax())
            if gain[j] > best[0]:
                best = (gain[j], f, float(cut[j]))
    if best[1] < 0:
        score[rows] -= rate * total_g / (total_h + 1)
        return
    _, f, cut = best
    low = x[rows, f] <= cut
    for side, at_most in ((rows[low], True), (rows[~low], False)):
        own = (*path, (f, at_most, cut))
        out.append(own)
        grow(x, g, h, bounds, side, own, out, score, rate)


def tree_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    bounds, out, score = bounds_of(x), [], np.zeros(len(y))
    rng = np.random.default_rng(5)
    for _ in range(TREES):
        p = sigmoid(score)
        some = np.sort(rng.choice(len(y), max(2, len(y) * 2 // 3), replace=False))
        step = np.zeros(len(y))
        grow(x, p - y, p * (1 - p) + 1e-6, bounds, some, (), own := [], step)
        if not own:
            break
        score += applied(x, own, step, some)
        out += own
    return list(dict.fromkeys(out))


def applied(x: np.ndarray, rules: list[Rule], step: np.ndarray, some: np.ndarray) -> np.ndarray:
    """The tree's leaf steps for all rows: those of the sample's rows that meet the same rules."""
    key = np.zeros(len(x), np.int64)
    for i, r in enumerate(rules):
        key |= meets(x, r).astype(np.int64) << i
    known = dict(zip(key[some].tolist(), step[some].tolist(), strict=True))
    return np.array([known.get(k, 0.0) for k in key.tolist()])


def meets(x: np.ndarray, rule: Rule) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, at_most, cut in rule:
        out &= (x[:, f] <= cut) if at_most else (x[:, f] > cut)
    return out


def lasso(m: np.ndarray, y: np.ndarray, strength: float = LASSO, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of L1-penalised logistic regression by accelerated proximal steps; the bias isn't penalised."""
    n = len(y)
    mean = m.mean(0)
    c = m - mean
    step = 4 * n / (np.linalg.norm(c, 2) ** 2 + n)
    w, last, t = np.zeros(m.shape[1]), np.zeros(m.shape[1]), 1.0
    bias = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    look = w
    for _ in range(rounds):
        e = sigmoid(c @ look + bias) - y
        w = look - step * (c.T @ e) / n
        w = np.sign(w) * np.maximum(np.abs(w) - step * strength, 0)
        bias -= 2.0 * e.mean()
        t, was = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        look, last = w + (was - 1) / t * (w - last), w
    return w, bias - float(mean @ w)


def fit(x: np.ndarray, y: np.ndarray) -> tuple[list[tuple[Rule, float]], float]:
    """(rules with their weights, bias)."""
    if len(y) < 10 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        return [], float(np.log(share / (1 - share)))
    rules = tree_rules(x, y)
    if not rules:
        return [], float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    w, bias = lasso(np.stack([meets(x, r) for r in rules], 1).astype(float), y)
    return [(r, float(v)) for r, v in zip(rules, w, strict=True) if abs(v) > 1e-6], bias


def compiled(rules: list[tuple[Rule, float]], bias: float) -> Column:
    """The score as one Spark column expression over the columns of NAMES."""
    def met(rule: Rule) -> Column:
        return reduce(lambda a, b: a & b, ((F.col(NAMES[f]) <= F.lit(cut)) if at_most else (F.col(NAMES[f]) > F.lit(cut)) for f, at_most, cut in rule))

    z = reduce(lambda a, b: a + b, (F.when(met(r), F.lit(w)).otherwise(F.lit(0.0)) for r, w in rules), F.lit(bias))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def fitted(spark: SparkSession, sf_dir: str, sample: int = SAMPLE) -> tuple[list[tuple[Rule, float]], float]:
    labels = read(spark, sf_dir, "labels").where(~held_out())
    rows = stats_of(labelled(read(spark, sf_dir, "documents"), labels, sample)).join(F.broadcast(labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)), "doc_id")
    got = rows.toArrow().sort_by("doc_id")
    return fit(np.stack([got.column(n).to_numpy() for n in NAMES], 1), got.column("y").to_numpy().astype(float))


def scored(docs: DataFrame, rules: list[tuple[Rule, float]], bias: float) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row."""
    s = stats_of(docs).withColumn("score", compiled(rules, bias))
    return s.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op3_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(read(spark, sf_dir, "documents"), *fitted(spark, sf_dir))
