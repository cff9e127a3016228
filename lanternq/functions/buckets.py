"""Buckets from a 64-bit BLAKE2b digest, for a table of distinct terms."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame


#: Fixed value: a digest of eight bytes, read as a big-endian number.
DIGEST_BYTES = 8


def bucket(term: str, dim: int) -> int:
    return int.from_bytes(hashlib.blake2b(term.encode(), digest_size=DIGEST_BYTES).digest(), "big") % dim


def with_buckets(terms: DataFrame, dim: int, column: str = "term") -> DataFrame:
    """(term, bucket) of the distinct terms of ``terms``; only those go through Python."""

    def made(batches):
        for batch in batches:
            words = batch.column(0)
            yield pa.RecordBatch.from_arrays([words, pa.array([bucket(w, dim) for w in words.to_pylist()], pa.int64())], ["term", "bucket"])

    return terms.select(terms[column].alias("term")).where("term IS NOT NULL").distinct().mapInArrow(made, "term string, bucket long")
