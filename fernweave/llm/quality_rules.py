"""Quality rules: exact statistics with fixed limits, then hashed n-grams in a logistic regression.

The regression has a weight for each bucket of hashed words and of hashed character 4-grams; a text's
features are the shares of its words and of its 4-grams in these buckets. It is trained on a bounded
sample of labelled rows (`SAMPLE`: the rows of the smallest hashes of doc_id, `SAMPLE` at most), made a
probability by Platt scaling on a quarter of the sample that training doesn't see, and scored in Arrow
batches over whole texts. The sample's texts become features where they are read: the one task that
trains gets at most 2^17 numbers a row, however long a text is. Statistics, scores and decisions cover all rows and all of each text.

Defined cases: a null or empty text has no words, so it fails the base limits; without labelled rows
of both classes the regression keeps all; labels other than 0 and 1 are left out, of several labels of a
doc_id the least counts, and of several texts that of the least hash; doc_id is a whole number or null
(another type is an error); equal rows get equal results; columns other than doc_id and text are passed by; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetext import find_words, gram_buckets, statistics, word_hashes
from .common import pieces, read, text_bytes, trim

SAMPLE, BITS, GRAM = 3000, 16, 4
MIN_WORDS, MAX_REPEAT_PERCENT, MIN_SCORE = 10, 20, 0.3
OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"


def labelled(docs: DataFrame, labels: DataFrame, most: int, label: str = "quality") -> DataFrame:
    """(doc_id, text, y): `most` labelled rows at most, of the smallest hashes of doc_id; one row a document."""
    own = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("y"))
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    own = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # `most` rows: a bound by parameter
    return own.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text")).select("doc_id", "text", "y")


def word_buckets(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    ws, we, at = find_words(data, offsets)
    h = (word_hashes(data, ws, we) >> np.uint64(64 - bits)).astype(np.int32)
    return h, np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(offsets) - 1))])


def families(data: np.ndarray, offsets: np.ndarray, bits: int, gram: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, bounds by text) of words and of character n-grams."""
    return [word_buckets(data, offsets, bits), gram_buckets(data, offsets, gram, bits)]


def share_sums(weights: np.ndarray, buckets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Mean weight of each text's buckets; a text without any: 0."""
    c = np.zeros(len(buckets) + 1)
    np.cumsum(weights[buckets], out=c[1:])
    return (c[bounds[1:]] - c[bounds[:-1]]) / np.maximum(np.diff(bounds), 1)


class Model:
    """Weights by family, a bias, and the two numbers of the probability's calibration."""

    def __init__(self, bits: int = BITS, gram: int = GRAM):
        self.bits, self.gram = bits, gram
        self.weights = [np.zeros(1 << bits, np.float32) for _ in range(2)]
        self.bias, self.scale, self.shift, self.ready = 0.0, 1.0, 0.0, False

    def raw(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return self.bias + sum(share_sums(w, *f) for w, f in zip(self.weights, families(data, offsets, self.bits, self.gram), strict=True))

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if not self.ready:
            return np.ones(len(offsets) - 1)
        return sigmoid(self.scale * self.raw(data, offsets) + self.shift)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def sparse(texts: pa.Array, bits: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, share) of texts, in the order of rows. A few texts at a time bound the memory."""
    data, offsets, _ = text_bytes(texts)
    rows, cols, vals = [], [], []
    for k, (b, bounds) in enumerate(families(data, offsets, bits, gram)):
        of = np.repeat(np.arange(len(texts)), np.diff(bounds))
        key, count = np.unique(of.astype(np.int64) << 32 | b, return_counts=True)
        r = (key >> 32).astype(np.int32)
        rows.append(r)
        cols.append(((key & 0xFFFFFFFF) + (k << bits)).astype(np.int32))
        vals.append((count / np.maximum(np.diff(bounds), 1)[r]).astype(np.float32))
    r, c, v = (np.concatenate(x) for x in (rows, cols, vals))
    order = np.argsort(r, kind="stable")
    return r[order], c[order], v[order]


def train(texts: list[str | None], y: np.ndarray, rounds: int = 60, l2: float = 1e-4, bits: int = BITS, gram: int = GRAM) -> Model:
    """The model of labelled texts."""
    blocks = [(at, *sparse(pa.array(texts[at : at + 64], pa.large_string()), bits, gram)) for at in range(0, len(texts), 64)]
    return train_on(blocks, y, rounds, l2, bits, gram)


def train_on(blocks: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], y: np.ndarray, rounds: int = 60, l2: float = 1e-4, bits: int = BITS, gram: int = GRAM) -> Model:
    """Accelerated gradient descent on three quarters of the rows, Platt scaling on the last quarter.

    blocks: (first row, row within, feature, share) of 64 rows each; products are made a block at a time.
    """
    m = Model(bits, gram)
    if len(y) < 8 or y.min() == y.max():
        return m
    fit = np.arange(len(y)) % 4 != 0
    if len(set(y[fit])) < 2 or len(set(y[~fit])) < 2:
        fit[:] = True
    n, size = len(y), 2 << bits
    # features have the same say whatever their usual share: divided by the root of their mean square
    rms = np.sqrt(sum(np.bincount(c, v * v, size) for _, _, c, v in blocks) / n) + 1e-3
    blocks = [(at, r, c, (v / rms[c] / np.sqrt(2 << 5)).astype(np.float32)) for at, r, c, v in blocks]
    norm = np.concatenate([np.bincount(r, v * v, min(64, n - at)) for at, r, _, v in blocks])
    values = lambda w: np.concatenate([np.bincount(r, w[c] * v, min(64, n - at)) for at, r, c, v in blocks])
    balance = np.where(y == 1, 0.5 / y[fit].mean(), 0.5 / (1 - y[fit].mean())) * fit
    w, last, bias, t = np.zeros(size), np.zeros(size), 0.0, 1.0
    step = 4.0 / max(1.0, np.percentile(norm, 99))
    look = w
    for _ in range(rounds):
        e = balance * (sigmoid(values(look) + bias) - y) / fit.sum()
        g = l2 * look
        for at, r, c, v in blocks:
            g = g + np.bincount(c, e[at + r] * v, size)
        w = look - step * fit.sum() / 8 * g
        bias -= 0.5 * e.sum()
        t, was = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        look, last = w + (was - 1) / t * (w - last), w
    flat = (w / rms / np.sqrt(2 << 5)).astype(np.float32)
    m.weights, m.bias, m.ready = [flat[: 1 << bits], flat[1 << bits :]], float(bias), True
    z, held = values(w) + bias, ~fit if (~fit).any() else fit
    m.scale, m.shift = platt(z[held], y[held])
    return m


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift that make sigmoid(scale * z + shift) a probability, by Newton steps on smoothed targets."""
    pos, neg = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    mean, sd = z.mean(), z.std() + 1e-9
    x = np.stack([(z - mean) / sd, np.ones(len(z))], 1)
    b = np.array([1.0, 0.0])
    for _ in range(50):
        p = sigmoid(x @ b)
        g = x.T @ (p - target) + 1e-3 * b
        b = b - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), g)
    return float(b[0] / sd), float(b[1] - b[0] * mean / sd)


def judged(docs: DataFrame, model: Model) -> DataFrame:
    """Statistics, base limits, score and decision for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", 1 << 20):
            data, offsets, _ = text_bytes(b.column(1))
            s = statistics(data, offsets)
            failed = (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])
            score = model.score(data, offsets)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x) for x in (s["n_words"], s["word_chars"], s["n_symbols"], s["n_dup_lines"], s["n_repeat_words"], failed, score, ~failed & (score >= MIN_SCORE)))], names=[x.split()[0] for x in OUT.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, OUT)


def fitted(spark: SparkSession, sf_dir: str, sample: int = SAMPLE) -> Model:
    """The model from the labelled rows of a corpus: trained in one task on its bounded sample, so the driver gets the weights only."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", 1 << 20):
            r, c, v = sparse(b.column(2), BITS, GRAM)
            at = pa.array(np.searchsorted(r, np.arange(b.num_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(at, pa.array(c, pa.int32())), pa.ListArray.from_arrays(at, pa.array(v, pa.float32()))], names=["doc_id", "y", "c", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches, schema) if (batches := list(batches)) else None
        if rows is None:
            return
        rows, blocks = rows.sort_by("doc_id"), []
        for at in range(0, rows.num_rows, 64):
            own = rows.slice(at, 64)
            c, v = (np.concatenate([x.values.to_numpy() for x in own.column(k)]) for k in ("c", "v"))
            blocks.append((at, np.repeat(np.arange(own.num_rows), [len(x) for x in own.column("c")]), c, v))
        m = train_on(blocks, rows.column("y").to_numpy().astype(int))
        if m.ready:
            trim()
            yield pa.RecordBatch.from_pydict({"w": pa.array([w.tobytes() for w in m.weights], pa.binary()), "k": pa.array([0, 1], pa.int32()), "bias": [m.bias] * 2, "scale": [m.scale] * 2, "shift": [m.shift] * 2})

    schema = pa.schema({"doc_id": pa.int64(), "y": pa.int32(), "c": pa.list_(pa.int32()), "v": pa.list_(pa.float32())})
    rows = labelled(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), sample)
    made = rows.select(F.col("doc_id").cast("long"), F.col("y").cast("int"), F.col("text").cast("string")).mapInArrow(features, "doc_id long, y int, c array<int>, v array<float>")
    got = made.repartition(1).mapInArrow(run, "w binary, k int, bias double, scale double, shift double").collect()
    m = Model()
    if got:
        m.weights = [np.frombuffer(bytes(r["w"]), np.float32) for r in sorted(got, key=lambda r: r["k"])]
        m.bias, m.scale, m.shift, m.ready = got[0]["bias"], got[0]["scale"], got[0]["shift"], True
    return m


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(read(spark, sf_dir, "documents"), fitted(spark, sf_dir))


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that the rules keep. The decision is made beside the row, so nothing is shuffled."""
    model = fitted(spark, sf_dir)
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", 1 << 20):
            data, offsets, _ = text_bytes(b.column(at))
            s = statistics(data, offsets)
            failed = (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])
            yield b.filter(pa.array(~failed & (model.score(data, offsets) >= MIN_SCORE)))

    return docs.mapInArrow(run, docs.schema)
