"""Token counts by a compiled finite-state tokenizer (see bpe_machine).

Defined cases: a null or empty text has 0 bytes and 0 tokens; texts of any length are read whole, in
chunks side by side, with blanks or without; doc_id is a whole number or null (another type is an error); equal rows get equal results; special strings in a text are one token each, as
the library's default has it; columns other than doc_id and text are passed by; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bpe_machine import Machine
from .common import pieces, read, text_bytes

LIMIT = 512
_machines: dict[int, Machine] = {}


def machine(raw: bytes) -> Machine:
    """The process's machine for a tokenizer file."""
    key = hash(raw)
    if key not in _machines:
        _machines.clear()
        _machines[key] = Machine(raw)
    return _machines[key]


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row; path: a byte-level BPE file on the driver, broadcast (a few MB)."""
    with open(path, "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(raw.value)
        for b in pieces(batches, "text", 1 << 20):
            data, offsets, sizes = text_bytes(b.column(1))
            n = m.counts(data, offsets)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.asarray(sizes, np.int64)), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
