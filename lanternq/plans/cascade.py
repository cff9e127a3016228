"""Hybrid search over chunks of documents: candidates, fusion, reranking, diversification and passages."""

from __future__ import annotations

import time
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lanternq.config import Settings
from lanternq.functions import text as T
from lanternq.operators import fuse, index, passages, search
from lanternq.operators.models import Models, OverlapReranker
from lanternq.plans.registry import table
from lanternq.sources.tables import materialized
from lanternq.streaming.ingest import chunks_of_texts

#: The variant number of a hypothetical answer; it makes a dense list only.
HYDE = -1


@dataclass(frozen=True)
class Indexed:
    """Chunks as all searches over them read them, written once: (chunk_id struct of document_id and idx, document_id,
    search_text, posts, length, embedding, sparse), what is counted while they are written, and the postings of lexical search. Posts
    are those of the analyzer."""

    rows: DataFrame
    postings: DataFrame
    n: int
    avg_length: float
    terms: int
    complete: bool

    def within(self, allowed: DataFrame | None) -> Indexed:
        """With only ``allowed`` chunks (chunk_id) to be found; counts stay those of all."""
        if allowed is None:
            return self
        own = allowed.select("chunk_id").distinct()
        return Indexed(self.rows.join(own, "chunk_id", "left_semi"), self.postings, self.n, self.avg_length, self.terms, self.complete)


@contextmanager
def timed(timings: dict[str, int] | None, step: str):
    """Adds the milliseconds that a step takes to ``timings``; steps end where they write their result."""
    start = time.perf_counter()
    yield
    if timings is not None:
        timings[step] = timings.get(step, 0) + round(1000 * (time.perf_counter() - start))


def indexed(chunks: DataFrame, models: Models | None = None, analyzer: str = "simple", queries: Column | None = None, name: str = "index", text: bool = True, only: Broadcast | None = None) -> Indexed:
    """An index of ``chunks`` (chunk_id, search_text, and document_id if scopes are to be applied), with the vectors of those
    encoders that there are. With ``queries`` (a boolean column of ``chunks``) the rows where it holds are encoded as questions. ``only`` are the
    stems that will be asked for, if these are known; the English analyzer keeps no others then. Missing texts count as chunks but not in the average length."""
    models = models or Models()
    rows = index.with_posts(chunks)

    def encoded(part: DataFrame, how: str) -> DataFrame:
        for name, encoder in (("embedding", models.dense), ("sparse", models.sparse)):
            part = part if encoder is None else getattr(encoder, how)(part, name)
        return part

    if queries is None:
        rows = encoded(rows, "documents")
    else:
        rows = encoded(rows.where(queries), "queries").unionByName(encoded(rows.where(~queries), "documents"))
    if analyzer == "english":
        rows = rows.withColumn("posts", index.stemmed_posts(F.col("posts"), only))
    counted = Observation()
    seen = [F.count("*").alias("n"), F.count("search_text").alias("texts"), F.coalesce(F.sum("length"), F.lit(0)).alias("length"), F.coalesce(F.sum(F.size("posts")), F.lit(0)).alias("terms"), *([] if models.dense is None else [F.count_if(F.col("embedding").isNull()).alias("missing")])]
    rows = rows.observe(counted, *seen)
    rows = materialized(rows if text else rows.drop("search_text"), name)
    got = counted.get
    posts = rows.select("chunk_id", "length", F.inline("posts"))
    return Indexed(rows, posts, got["n"], got["length"] / got["texts"] if got["texts"] else 1.0, got["terms"], not got.get("missing"))


def candidates(ix: Indexed, variants: DataFrame, s: Settings, analyzer: str, models: Models, allowed: DataFrame | None = None, scopes: DataFrame | None = None) -> DataFrame:
    """Ranked lists (query_id, list_name, list_ord, chunk_id, score, rank): one of each retriever for each variant
    (query_id, variant, text) of a question. ``allowed`` (chunk_id) and ``scopes`` (query_id, document_ids) narrow after scoring, so
    statistics stay those of the whole index. What is sent to all tasks are the terms and vectors of the questions, counted when written."""
    k, key = s.candidates_per_retriever, F.struct("query_id", "variant")
    of = variants.select(key.alias("chunk_id"), F.col("text").alias("search_text"))
    plain = F.col("chunk_id.variant") != HYDE
    asked = indexed(of, models, analyzer, plain, "variants")
    own = ix.within(allowed)
    as_q = lambda df: df.withColumnRenamed("chunk_id", "query_id")
    if scopes is not None:  # every variant has the scope of its question
        keys = asked.rows.select("chunk_id").distinct()
        scopes = keys.join(scopes, F.col("chunk_id.query_id") == F.col("query_id")).select(F.col("chunk_id").alias("query_id"), "document_ids")

    found = []
    if models.dense is not None:
        found.append(("dense", search.dense_top(as_q(asked.rows.select("chunk_id", "embedding")), own.rows, k, complete=ix.complete, scopes=scopes)))
    words = as_q(asked.postings.where(plain)).select("query_id", "term")
    found.append(("lexical", search.bm25_top(words, own.rows, ix.postings, ix.n, ix.avg_length, k, s.bm25_k1, s.bm25_b, asked.terms, scopes)))
    if models.sparse is not None:
        found.append(("sparse", search.sparse_top(as_q(search.arrays(asked.rows.where(plain))), search.arrays(own.rows), k, scopes=scopes)))
    lists, order = None, {"dense": 0, "lexical": 1, "sparse": 2}
    for name, df in found:
        n = order[name]
        variant = F.col("query_id.variant")
        listed = F.when(variant == HYDE, F.lit(f"{name}:hyde")).otherwise(F.concat(F.lit(f"{name}:"), variant))
        place = F.when(variant == HYDE, F.lit(2**31 - 1)).otherwise(variant * 3 + n)
        rows = df.select(F.col("query_id.query_id").alias("query_id"), listed.alias("list_name"), place.alias("list_ord"), "chunk_id", "score", "rank")
        lists = rows if lists is None else lists.unionByName(rows)
    return lists


def hybrid(
    chunks: DataFrame, questions: DataFrame, documents: DataFrame, settings: Settings | None = None, analyzer: str = "simple",
    variants: DataFrame | None = None, models: Models | None = None, allowed: DataFrame | None = None, ix: Indexed | None = None,
    scopes: DataFrame | None = None, timings: dict[str, int] | None = None,
) -> DataFrame:
    """Passages for questions (query_id, text) over chunks (chunk_id, document_id, idx, section, text, search_text,
    page_start, page_end) and documents (document_id, title).

    ``variants`` (query_id, variant int, text) are what is searched for, the question itself by default; variant
    HYDE is a hypothetical answer. The question is what candidates are reranked by. ``allowed`` (chunk_id) narrows
    the search of all questions, ``scopes`` (query_id, document_ids) that of each; ``ix`` is an index of the ``keyed`` chunks
    that was made before. Pools are diversified by their vectors, or by term sets if any of them has none. Ties go by document, then
    idx. Questions that find nothing have no rows. ``timings`` is filled with the milliseconds of each step."""
    s, models = settings or Settings(), models or Models()
    own = keyed(chunks)
    with timed(timings, "index"):
        ix = ix or indexed(own.select("chunk_id", "document_id", "search_text"), models, analyzer)
    if allowed is not None:
        allowed = keyed(chunks.join(allowed.select("chunk_id").distinct(), "chunk_id", "left_semi")).select("chunk_id")
    if variants is None:
        variants = questions.select("query_id", F.lit(0).alias("variant"), "text")
    # Reranking reorders the head only, so nothing behind the head and the pool can be chosen any more.
    most = max(s.rerank_candidates if models.reranker is not None else 0, 3 * s.top_k)
    with timed(timings, "retrieve"):
        lists = candidates(ix, variants, s, analyzer, models, allowed, scopes)
        found, counted = fuse.fused(lists, s.rrf_k, {n: s.weight(n) for n in ("dense", "lexical", "sparse")}).where(F.col("position") <= most), Observation()
        hits = materialized(found.observe(counted, F.count("*").alias("n")), "fused")
        n = counted.get["n"]
    with timed(timings, "rerank"):
        vector = F.col("embedding") if models.dense is not None else F.lit(None).cast("array<double>").alias("embedding")
        # The index has the distinct terms of each chunk; those of a question are taken once, not with each of its chunks.
        known = analyzer == "simple" and isinstance(models.reranker, OverlapReranker)
        own_terms = [F.when(F.col("search_text").isNotNull(), F.col("posts.term")).alias("own_terms")] if known else []
        asked_terms = [F.array_distinct(T.simple_terms(F.col("text"))).alias("asked_terms")] if known else []
        texts = ix.rows.select("chunk_id", "search_text", vector, *own_terms).join(search.sized(hits.select("chunk_id").distinct(), n), "chunk_id", "left_semi")
        hits = search.sized(hits, n).join(texts, "chunk_id").join(questions.select("query_id", F.col("text").alias("question"), *asked_terms), "query_id")
        hits = hits.select("*", "chunk_id.*")
        if models.reranker is None:
            hits = hits.withColumn("rerank_score", F.lit(None).cast("double")).withColumn("final", F.col("position"))
        else:
            head = models.reranker.scored(hits.where(F.col("position") <= s.rerank_candidates))
            rest = hits.where(F.col("position") > s.rerank_candidates).withColumn("rerank_score", F.lit(None).cast("double"))
            hits = fuse.reranked(head.unionByName(rest), s.rerank_candidates)
        hits = hits.withColumn("terms", F.when(F.col("final") <= 3 * s.top_k, F.col("own_terms") if known else F.array_distinct(T.simple_terms(F.col("search_text")))))
        hits = materialized(hits.where(F.col("final") <= max(1, 3 * s.top_k)).drop("search_text", "question", "own_terms", "asked_terms"), "hits")
    with timed(timings, "select"):
        relevance = F.coalesce("rerank_score", "score")
        pool = hits.select("query_id", F.col("final").alias("position"), relevance.alias("relevance"), "terms", "embedding")
        chosen = diversified(pool, s.top_k, s.mmr_lambda)
        first = fuse.confidence(hits)
        kept = chosen.join(hits.select("query_id", F.col("final").alias("position"), "document_id", "idx", F.col("rerank_score").alias("relevance")), ["query_id", "position"])
        kept = materialized(kept.join(first, "query_id").withColumn("position", F.col("pick")), "kept")
    around = chunks.join(search.sized(kept.select("document_id").distinct(), n), "document_id", "left_semi")
    spans = passages.merged(passages.expanded(around, kept.drop("confidence"), s.window))
    out = passages.ordered(passages.built(spans, around), kept, documents)
    return out.join(kept.select("query_id", "confidence").distinct(), "query_id").select(
        "query_id", "id", "document_id", "title", "section", "start", "end", F.round("relevance", 6).alias("relevance"), "text", "chunk_ids",
        F.round("confidence", 6).alias("confidence"), "page_start", "page_end",
    )


def keyed(chunks: DataFrame) -> DataFrame:
    """``chunks`` with (document_id, idx) as chunk_id, the order in which ties are broken."""
    return chunks.withColumn("chunk_id", F.struct("document_id", "idx"))


def diversified(pool: DataFrame, keep: int, trade: float) -> DataFrame:
    """Maximal marginal relevance over (query_id, position, relevance, terms, embedding), a pool of a few dozen rows a query, in
    pandas. Rows are alike by the product of their vectors where every row of the pool has one, else by the Jaccard similarity of their terms."""
    import numpy as np
    import pandas as pd

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("position").reset_index(drop=True)
        low, high = frame["relevance"].min(), frame["relevance"].max()
        rel = [(r - low) / (high - low) if high > low else 1.0 for r in frame["relevance"]]
        n, left, chosen = len(frame), list(range(len(frame))), []
        if all(v is not None for v in frame["embedding"]):
            vectors = np.stack([np.asarray(v, float) for v in frame["embedding"]])
            alike = vectors @ vectors.T
        else:
            sets = [set(t) for t in frame["terms"]]
            alike = np.array([[len(a & b) / len(a | b) if a | b else 0.0 for b in sets] for a in sets]).reshape(n, n)
        while left and len(chosen) < keep:
            best = max(left, key=lambda i: (round(rel[i] if not chosen else trade * rel[i] - (1 - trade) * max(alike[i, j] for j in chosen), 9), -i))
            chosen.append(best)
            left.remove(best)
        return pd.DataFrame({"query_id": frame["query_id"].iloc[chosen], "pick": range(1, len(chosen) + 1), "position": frame["position"].iloc[chosen]})

    return pool.groupBy("query_id").applyInPandas(pick, f"query_id {dict(pool.dtypes)['query_id']}, pick int, position int")


def document_chunks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Chunks of ``documents``, written once, and the documents (document_id, title)."""
    docs = table(spark, sf_dir, "documents")
    rows = chunks_of_texts(docs.select("doc_id", "text")).withColumnRenamed("doc_id", "document_id")
    documents = docs.select(F.col("doc_id").alias("document_id"), F.col("source").alias("title"))
    rows = rows.join(documents, "document_id")
    rows = rows.withColumn("search_text", T.search_text(F.col("title"), F.col("section"), F.lit(""), F.col("text")))
    rows = rows.withColumn("idx", F.col("idx").cast("long")).withColumn("chunk_id", F.concat("document_id", F.lit(":"), "idx"))
    return materialized(rows, "chunks"), documents


def searched(spark: SparkSession, sf_dir: str, settings: Settings | None = None) -> DataFrame:
    """Passages of ``documents`` for the texts of ``benchmark``."""
    rows, documents = document_chunks(spark, sf_dir)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return hybrid(rows, asked, documents, settings)
