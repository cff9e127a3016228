"""One index: documents and chunks with everything that asks for them or changes them.

A store is a value: what changes it gives a new one, and ``saved`` writes it. Documents are (id, hash, title,
filename, pages, chunk_count, status, error, created_at), chunks (id, document_id, idx, section, text, search_text, page_start,
page_end) with an optional ``embedding``."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternq.config import Settings
from lanternq.operators import index, passages, search
from lanternq.operators.models import Encoder, HashingDense, HashingSparse


@dataclass(frozen=True)
class Store:
    documents: DataFrame
    chunks: DataFrame
    settings: Settings = Settings()
    dense: Encoder = HashingDense()
    sparse: Encoder = HashingSparse()

    @classmethod
    def loaded(cls, spark: SparkSession, path: str, **more) -> Store:
        return cls(spark.read.parquet(f"{path}/documents"), spark.read.parquet(f"{path}/chunks"), **more)

    def saved(self, path: str) -> Store:
        """Written below ``path``, which must not be where this store was read from; chunks lie clustered by document."""
        self.documents.write.mode("overwrite").parquet(f"{path}/documents")
        self.chunks.repartition("document_id").sortWithinPartitions("document_id", "idx").write.mode("overwrite").parquet(f"{path}/chunks")
        return replace(self, **{n: self.documents.sparkSession.read.parquet(f"{path}/{n}") for n in ("documents", "chunks")})

    def upserted(self, changes: DataFrame, whole: bool = False) -> Store:
        """With ``changes`` to documents; ``whole`` replaces known records in all columns, else name, hash and creation
        time stay."""
        columns = tuple(self.documents.columns) if whole else ("title", "pages", "chunk_count", "status", "error")
        return replace(self, documents=index.upserted(self.documents, changes, columns))

    def documents_by_id(self, ids: DataFrame) -> DataFrame:
        return self.documents.join(ids.select("id").distinct(), "id", "left_semi").select(*self.documents.columns)

    def documents_by_hash(self, hashes: DataFrame) -> DataFrame:
        return self.documents.join(hashes.select("hash").distinct(), "hash", "left_semi").select(*self.documents.columns)

    def listed(self) -> DataFrame:
        return index.newest_first(self.documents)

    def without(self, gone: DataFrame) -> Store:
        """Without the documents of ``gone`` (document_id) and their chunks."""
        return replace(self, documents=index.without_documents(self.documents, gone, "id"), chunks=index.without_documents(self.chunks, gone))

    def with_chunks(self, new: DataFrame) -> Store:
        return replace(self, chunks=index.appended(self.chunks, new))

    def _rows(self) -> DataFrame:
        return index.with_posts(self.chunks.select(F.col("id").alias("chunk_id"), "document_id", "search_text"))

    def _texts(self) -> DataFrame:
        return self.chunks.select(F.col("id").alias("chunk_id"), "search_text")

    def _allowed(self, document_ids: DataFrame | None) -> DataFrame | None:
        """Chunks of the documents (document_id) that a search is narrowed to; an empty table allows none."""
        if document_ids is None:
            return None
        return self.chunks.join(document_ids.select("document_id").distinct(), "document_id", "left_semi").select(F.col("id").alias("chunk_id"))

    def dense_search(self, queries: DataFrame, k: int, document_ids: DataFrame | None = None) -> DataFrame:
        """(query_id, chunk_id, score, rank) for vectors (query_id, embedding) of the dense encoder, whatever their scores."""
        rows = self.dense.documents(self._rows(), "embedding").drop("posts", "length", "search_text")
        allowed = self._allowed(document_ids)
        complete = not rows.where("embedding IS NULL").limit(1).count()
        return search.dense_top(queries, rows if allowed is None else rows.join(allowed.distinct(), "chunk_id", "left_semi"), k, complete=complete)

    def sparse_search(self, queries: DataFrame, k: int, document_ids: DataFrame | None = None) -> DataFrame:
        """As ``dense_search``, for vectors (query_id, sparse) and positive scores."""
        rows = self.sparse.documents(self._rows(), "sparse").select("chunk_id", F.inline("sparse"))
        return search.top(search.sparse_scores(queries.select("query_id", F.inline("sparse")), rows), k, True, self._allowed(document_ids))

    def lexical_search(self, queries: DataFrame, k: int, document_ids: DataFrame | None = None, analyzer: str = "simple") -> DataFrame:
        """BM25 for questions (query_id, text); statistics are those of all chunks whatever documents are allowed."""
        asked = index.term_rows(queries, analyzer, "query_id", "text").withColumnRenamed("chunk_id", "query_id")
        lengths = index.chunk_lengths(self._texts())
        scores = search.bm25_scores(asked, index.postings(self._texts(), analyzer), lengths, index.corpus_stats(lengths), self.settings.bm25_k1, self.settings.bm25_b)
        return search.top(scores, k, True, self._allowed(document_ids))

    def neighbors(self, wanted: DataFrame) -> DataFrame:
        return passages.neighbors(self.chunks, wanted)
