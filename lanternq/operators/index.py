"""Registry and index tables: documents, chunks, postings, vectors and corpus statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lanternq.functions.stem import stem
from lanternq.functions.text import simple_terms, stemmed
from lanternq.functions.vectors import portable_bucket


def to_register(incoming: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows of ``incoming`` (hash, order) to ingest: the first of each hash, unless the registry has it with a
    status other than ``failed``."""
    first = incoming.withColumn("n_", F.row_number().over(W.partitionBy("hash").orderBy("order"))).where("n_ = 1").drop("n_")
    return first.join(registry.where("status <> 'failed'").select("hash").distinct(), "hash", "left_anti")


def upserted(documents: DataFrame, changes: DataFrame, updated: tuple[str, ...] = ("title", "pages", "chunk_count", "status", "error")) -> DataFrame:
    """``documents`` with ``changes`` by id: known rows take the updated columns, new rows are added whole."""
    both = documents.alias("d").join(changes.alias("c"), F.col("d.id") == F.col("c.id"), "full")
    changed, new = F.col("c.id").isNotNull(), F.col("d.id").isNull()
    pick = lambda c: F.when(changed if c in updated else new, F.col(f"c.{c}")).otherwise(F.col(f"d.{c}"))
    return both.select(F.coalesce("d.id", "c.id").alias("id"), *[pick(c).alias(c) for c in documents.columns if c != "id"])


def appended(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """``chunks`` and the rows of ``new`` whose id is not there yet; of repeated new ids the first by idx stays."""
    fresh = new.join(chunks.select("id"), "id", "left_anti")
    fresh = fresh.withColumn("n_", F.row_number().over(W.partitionBy("id").orderBy("idx"))).where("n_ = 1").drop("n_")
    return chunks.unionByName(fresh)


def newest_first(documents: DataFrame) -> DataFrame:
    """``documents`` by creation time, the newest first; the order is a range-partitioned sort."""
    return documents.orderBy(F.desc("created_at"), "id")


def without_documents(rows: DataFrame, gone: DataFrame, key: str = "document_id") -> DataFrame:
    """``rows`` whose document is not in ``gone`` (column document_id)."""
    return rows.join(gone.select(F.col("document_id").alias("gone_")).distinct(), F.col(key) == F.col("gone_"), "left_anti")


def term_rows(chunks: DataFrame, analyzer: str = "simple", id_: str = "chunk_id", text: str = "search_text") -> DataFrame:
    """(chunk_id, term), one row an occurrence."""
    rows = chunks.select(F.col(id_).alias("chunk_id"), F.explode(simple_terms(F.col(text))).alias("term"))
    return stemmed(rows, "term") if analyzer == "english" else rows


def posted(text: Column) -> Column:
    """(length, posts array of (term, tf)) of a text. Equal terms are runs in its sorted terms, so counting needs no shuffle. What lambdas
    read is bound by a lambda too: it is evaluated once, however the optimizer merges columns."""

    def counted(t: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i) != F.get(t, i - 1)))
        starts = F.when(F.size(t) > 0, starts).otherwise(F.array().cast("array<int>"))
        runs = lambda at: F.transform(at, lambda i, k: F.struct(F.get(t, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(t)) - i).cast("long").alias("tf")))
        return F.struct(F.size(t).cast("long").alias("length"), F.transform(F.array(starts), runs)[0].alias("posts"))

    return F.transform(F.array(F.sort_array(simple_terms(F.coalesce(text, F.lit(""))))), counted)[0]


def with_posts(chunks: DataFrame, text: str = "search_text") -> DataFrame:
    """``chunks`` with posts (term, tf) and length."""
    return chunks.withColumn("posted_", posted(F.col(text))).withColumns({"posts": F.col("posted_.posts"), "length": F.col("posted_.length")}).drop("posted_")


#: Words whose stems are counted at once.
WORDS = 500_000


def stemmed_posts(posts: Column, only: Broadcast | None = None) -> Column:
    """``posts`` (term, tf) by the stems of their terms, in order; ``only`` (a set that was sent to all tasks) leaves out all other stems. Stems
    are counted within each row, without a shuffle, in pieces of bounded size, each of whose distinct words is looked up once."""

    def counted(piece: pa.Array) -> pa.Array:
        words, tf = piece.flatten().flatten()
        row = np.repeat(np.arange(len(piece)), pc.list_value_length(piece).fill_null(0).to_numpy(zero_copy_only=False))
        coded = words.dictionary_encode()
        stems = [stem(w) for w in coded.dictionary.to_pylist()]
        names = sorted(set(stems) if only is None else only.value.intersection(stems))
        place = {w: n for n, w in enumerate(names)}
        code = np.array([place.get(w, -1) for w in stems], np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
        own, many = code >= 0, max(1, len(names))
        key, at = np.unique(row[own] * many + code[own], return_inverse=True)
        n = np.bincount(at, tf.to_numpy(zero_copy_only=False)[own], len(key)).astype(np.int64)
        starts = np.searchsorted(key, np.arange(len(piece) + 1) * many).astype(np.int32)
        return pa.ListArray.from_arrays(starts, pa.StructArray.from_arrays([pa.array(names, pa.string()).take(pa.array(key % many)), pa.array(n)], ["term", "tf"]))

    # What follows may explode the stems, so the expression may not be moved or repeated.
    @F.arrow_udf("array<struct<term: string, tf: bigint>>")
    def made(posts: pa.Array) -> pa.Array:
        ends = np.cumsum(pc.list_value_length(posts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(ends // WORDS)) + 1).tolist(), len(posts)]
        return pa.concat_arrays([counted(posts.slice(a, b - a)) for a, b in zip(cuts, cuts[1:])])

    return made.asNondeterministic()(posts)


def postings(chunks: DataFrame, analyzer: str = "simple", id_: str = "chunk_id", text: str = "search_text") -> DataFrame:
    """(chunk_id, term, tf). Both analyzers count within each row, without a shuffle, so a chunk has to be one row."""
    rows = with_posts(chunks.select(F.col(id_).alias("chunk_id"), F.col(text).alias("search_text")))
    if analyzer == "english":
        rows = rows.withColumn("posts", stemmed_posts(F.col("posts")))
    return rows.select("chunk_id", F.inline("posts"))


def chunk_lengths(chunks: DataFrame, id_: str = "chunk_id", text: str = "search_text") -> DataFrame:
    return chunks.select(F.col(id_).alias("chunk_id"), F.size(simple_terms(F.col(text))).cast("long").alias("length"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: n chunks and their average length (1.0 if there are none)."""
    return lengths.agg(F.count("*").alias("n"), F.coalesce(F.avg("length"), F.lit(1.0)).alias("avg_length"))


def hashed_dense(posts: DataFrame, dim: int = 256, buckets: DataFrame | None = None) -> DataFrame:
    """(chunk_id, bucket, w): unit vectors, each distinct term adding 1 + ln(tf) to its bucket. ``buckets``
    (term, bucket) replaces the portable bucket function."""
    rows = posts.withColumn("bucket", portable_bucket(F.col("term"), dim)) if buckets is None else posts.join(buckets, "term")
    summed = rows.groupBy("chunk_id", "bucket").agg(F.sum(1 + F.log("tf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("chunk_id")))
    return summed.withColumn("w", F.col("w") / F.greatest(norm, F.lit(1e-12)))


def hashed_sparse(posts: DataFrame, dim: int = 30000, buckets: DataFrame | None = None) -> DataFrame:
    """(chunk_id, bucket, w): occurrences of terms by bucket."""
    rows = posts.withColumn("bucket", portable_bucket(F.col("term"), dim)) if buckets is None else posts.join(buckets, "term")
    return rows.groupBy("chunk_id", "bucket").agg(F.sum("tf").cast("double").alias("w"))
