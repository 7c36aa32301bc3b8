"""Vectors of index cards, by an embedder that the caller gives.

No model is shipped. `HashingEmbedder` stands in: tokens are hashed to signed buckets and normalised, so
equal words are near and paraphrases aren't.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import VECTOR

BATCH, DIM = 64, 384


class Embedder(Protocol):
    name: str
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    def __init__(self, dim: int = DIM):
        self.name, self.dim = f"hashing-{dim}", dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % self.dim] += 1 if h >> 63 else -1
        return out


def unit(x: np.ndarray) -> np.ndarray:
    return (x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)).astype(np.float32)


def embed_cards(cards: DataFrame, embedder: Embedder) -> DataFrame:
    """(iri, embedding), L2-normalised; batches of BATCH cards are all that a task holds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), BATCH):
                own = b.iloc[at : at + BATCH]
                yield pd.DataFrame({"iri": own["iri"], "embedding": list(unit(embedder.embed(own["card_text"].fillna("").tolist())))})

    return cards.select("iri", "card_text").mapInPandas(run, VECTOR)


def embed_query(text: str, embedder: Embedder) -> list[float]:
    return unit(embedder.embed([text]))[0].tolist()


def write_index(cards: DataFrame, path: str, embedder: Embedder, stamp: str = "") -> bool:
    """Writes vectors, cards and their description; without cards nothing is written and it isn't an error."""
    if cards.isEmpty():
        return False
    embed_cards(cards, embedder).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/vectors")
    cards.orderBy("iri").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/cards")
    meta = json.dumps({"model": embedder.name, "dim": embedder.dim, "stamp": stamp})
    cards.sparkSession.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
    return True


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict] | None:
    """(vectors, cards, description), or None where there is no index."""
    try:
        meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
        return spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/cards"), meta
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def same_stamp(spark: SparkSession, path: str, stamp: str) -> bool:
    """Whether the stored vectors belong to the graph of this age."""
    got = read_index(spark, path)
    return got is not None and got[2]["stamp"] == stamp


def copy_index(spark: SparkSession, src: str, dst: str, stamp: str) -> bool:
    """Copies vectors and cards if they belong to the graph of this age; whether they did."""
    if not same_stamp(spark, src, stamp):
        return False
    for name in ("vectors", "cards"):
        spark.read.parquet(f"{src}/{name}").write.mode("overwrite").option("compression", "zstd").parquet(f"{dst}/{name}")
    spark.read.text(f"{src}/meta").coalesce(1).write.mode("overwrite").text(f"{dst}/meta")
    return True


def distinct_dims(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"))
