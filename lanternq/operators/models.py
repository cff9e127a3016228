"""Where models plug in: encoders of texts and rerankers of pairs, and the deterministic ones that need no model.

Encoders add a column to rows (..., search_text, posts): dense vectors are arrays of numbers, sparse ones arrays of (bucket, w)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternq.functions import text as T
from lanternq.functions import vectors as V

DENSE, SPARSE = "array<double>", "array<struct<bucket: bigint, w: double>>"


class Encoder(Protocol):
    """``documents`` and ``queries`` add ``column`` to rows (..., search_text, posts array of (term, tf)); a text without a
    vector gets null. Queries may be encoded in another way than documents."""

    def documents(self, rows: DataFrame, column: str) -> DataFrame: ...

    def queries(self, rows: DataFrame, column: str) -> DataFrame: ...


class Reranker(Protocol):
    """``pairs`` (query_id, chunk_id, question, search_text, ...) with rerank_score, from 0 to 1."""

    def scored(self, pairs: DataFrame) -> DataFrame: ...


def with_column(rows: DataFrame, column: str, kind: str, make: Callable[[pa.RecordBatch], pa.Array]) -> DataFrame:
    """``rows`` with a column that is made from each Arrow batch."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, make(batch)], [*batch.schema.names, column])

    return rows.mapInArrow(apply, f"{kinds}, `{column}` {kind}")


@dataclass(frozen=True)
class HashingDense:
    """Unit vectors to which each distinct term adds 1 + ln(tf) in its bucket; without terms all zero."""

    dim: int = 256

    def documents(self, rows: DataFrame, column: str) -> DataFrame:
        dim = self.dim

        # Only buckets and weights go to Python, no terms. What follows may explode the vectors, so no expression may be moved into them.
        @F.arrow_udf(DENSE)
        def summed(buckets: pa.Array, weights: pa.Array) -> pa.Array:
            ends, at, w = buckets.offsets.to_numpy(), buckets.flatten().to_numpy(zero_copy_only=False), weights.flatten().to_numpy(zero_copy_only=False)
            ends = ends - ends[0]
            out = np.zeros((len(buckets), dim))
            for a in range(0, len(buckets), 1024):
                part, many = ends[a : a + 1025], np.diff(ends[a : a + 1025])
                row = np.repeat(np.arange(len(many)), many)
                own = slice(part[0], part[-1])
                out[a : a + 1024] = np.bincount(row * dim + at[own], w[own], len(many) * dim).reshape(-1, dim)
            out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
            return pa.ListArray.from_arrays(np.arange(0, out.size + 1, dim, dtype=np.int32), pa.array(out.ravel()))

        summed = summed.asNondeterministic()
        posts = F.coalesce("posts", F.array().cast("array<struct<term: string, tf: bigint>>"))
        buckets = F.transform(posts, lambda p: V.portable_bucket(p["term"], dim).cast("int"))
        return rows.withColumn(column, summed(buckets, F.transform(posts, lambda p: 1 + F.log(p["tf"].cast("double")))))

    queries = documents


@dataclass(frozen=True)
class HashingSparse:
    """Occurrences of terms by bucket. Terms of one bucket stay entries of their own, as products add them up anyway."""

    dim: int = 30000

    def documents(self, rows: DataFrame, column: str) -> DataFrame:
        entry = lambda p: F.struct(V.portable_bucket(p["term"], self.dim).alias("bucket"), p["tf"].cast("double").alias("w"))
        return rows.withColumn(column, F.transform("posts", entry))

    queries = documents


class OverlapReranker:
    """Share of the question's distinct terms that the chunk has. Pairs may bring the terms of both (asked_terms, own_terms)."""

    def scored(self, pairs: DataFrame) -> DataFrame:
        terms = lambda c, known: F.col(known) if known in pairs.columns else T.simple_terms(F.col(c))
        return pairs.withColumn("rerank_score", T.overlap_share(terms("question", "asked_terms"), terms("search_text", "own_terms")))


@dataclass(frozen=True)
class ModelEncoder:
    """Vectors of a model: ``load()`` runs once in each task's batch and gives a function from a list of texts to a list of vectors:
    sequences of numbers, or with ``sparse`` dicts from number to weight. ``load_queries`` gives the one for queries if it differs."""

    load: Callable[[], Callable[[list[str]], list]]
    load_queries: Callable[[], Callable[[list[str]], list]] | None = None
    batch: int = 32
    sparse: bool = False

    def _encoded(self, rows: DataFrame, column: str, load) -> DataFrame:
        size, sparse, model = self.batch, self.sparse, []

        def made(batch: pa.RecordBatch) -> pa.Array:
            if not model:
                model.append(load())
            texts = [x or "" for x in batch.column("search_text").to_pylist()]
            got = [v for at in range(0, len(texts), size) for v in model[0](texts[at : at + size])]
            if sparse:
                kind = pa.list_(pa.struct([("bucket", pa.int64()), ("w", pa.float64())]))
                return pa.array([None if v is None else [{"bucket": int(b), "w": float(w)} for b, w in v.items() if w] for v in got], kind)
            return pa.array([None if v is None else [float(x) for x in v] for v in got], pa.list_(pa.float64()))

        return with_column(rows, column, SPARSE if sparse else DENSE, made)

    def documents(self, rows: DataFrame, column: str) -> DataFrame:
        return self._encoded(rows, column, self.load)

    def queries(self, rows: DataFrame, column: str) -> DataFrame:
        return self._encoded(rows, column, self.load_queries or self.load)


@dataclass(frozen=True)
class ModelReranker:
    """Scores of a model: ``load()`` gives a function from questions and texts to logits, which pass the sigmoid."""

    load: Callable[[], Callable[[list[str], list[str]], list[float]]]
    batch: int = 32

    def scored(self, pairs: DataFrame) -> DataFrame:
        load, size = self.load, self.batch

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = load()
            for batch in batches:
                asked, texts = (batch.column(c).to_pylist() for c in ("question", "search_text"))
                got = [float(x) for at in range(0, len(asked), size) for x in model(asked[at : at + size], texts[at : at + size])]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], [*batch.schema.names, "logit_"])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)
        return pairs.mapInArrow(apply, f"{kinds}, logit_ double").withColumn("rerank_score", V.sigmoid(F.col("logit_"))).drop("logit_")


@dataclass(frozen=True)
class Models:
    """The models of a search. Without an encoder there are no lists of its kind; without a reranker no confidence."""

    dense: Encoder | None = field(default_factory=HashingDense)
    sparse: Encoder | None = field(default_factory=HashingSparse)
    reranker: Reranker | None = field(default_factory=OverlapReranker)


@dataclass(frozen=True)
class CachedEncoder:
    """``encoder`` with its vectors kept below ``path``, by ``name`` (of the model) and a hash of the text: texts that any earlier
    run has encoded are looked up, equal texts are encoded once. ``kind`` is DENSE or SPARSE."""

    encoder: Encoder
    path: str
    name: str
    kind: str = DENSE

    def _cached(self, rows: DataFrame, column: str, how: str) -> DataFrame:
        spark, folder = rows.sparkSession, f"{self.path}/{self.name.replace('/', '__')}/{how}"
        keyed = rows.withColumn("hash_", F.sha2(F.coalesce("search_text", F.lit("")), 256))
        schema = f"hash_ string, vector_ {self.kind}"

        def known() -> DataFrame:
            try:
                return spark.read.schema(schema).parquet(folder).dropDuplicates(["hash_"])  # two runs at once may both have a text
            except AnalysisException as missing:  # nothing kept yet
                if missing.getCondition() != "PATH_NOT_FOUND":
                    raise
                return spark.createDataFrame([], schema)

        misses = keyed.select("hash_", "search_text", "posts").dropDuplicates(["hash_"]).join(known().select("hash_"), "hash_", "left_anti")
        getattr(self.encoder, how)(misses, "vector_").select("hash_", "vector_").write.mode("append").parquet(folder)
        return keyed.join(known(), "hash_", "left").withColumnRenamed("vector_", column).drop("hash_")

    def documents(self, rows: DataFrame, column: str) -> DataFrame:
        return self._cached(rows, column, "documents")

    def queries(self, rows: DataFrame, column: str) -> DataFrame:
        return self._cached(rows, column, "queries")
