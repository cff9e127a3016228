"""Queries of the saved index that changes, of scoped search, cover density, and the vector index."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lanternq.operators import cover, search
from lanternq.operators.segments import SegmentIndex
from lanternq.plans.registry import query, table
from lanternq.operators.vectors import PARTS, SHORT_LIST, VectorIndex
from lanternq.plans.retrieval_queries import _BM25, _P, _top, _vectors, question_terms
from lanternq.plans.text_queries import TERMS
from lanternq.sources.tables import materialized, shared_dir


def _new_index(spark) -> SegmentIndex:
    return SegmentIndex.created(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")


def _chunks(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), F.col("text").alias("search_text"))


@query(f"WITH {_P}, {_BM25} SELECT * FROM {_top('bs', 10)}")
def bm25_pruned(spark, sf):
    """BM25 from a saved index: only the buckets of the questions' terms are read, and only the blocks of chunks whose bound
    reaches the score that a question has already found."""
    return _new_index(spark).appended(_chunks(spark, sf)).lexical_search(question_terms(spark, sf), 10, pruned=True)


_LEFT = "(SELECT * FROM documents WHERE doc_id % 5 <> 0)"


@query(f"WITH {_P.replace('FROM documents', f'FROM {_LEFT}')}, {_BM25} SELECT * FROM {_top('bs', 10)}")
def index_changes(spark, sf):
    """BM25 over an index that came in two segments and lost a fifth of its documents: statistics are those of what is left."""
    rows = _chunks(spark, sf)
    index = _new_index(spark).appended(rows.where("document_id % 3 <> 0")).appended(rows.where("document_id % 3 = 0"))
    index = index.deleted(rows.where("document_id % 5 = 0").select("document_id"))
    return index.lexical_search(question_terms(spark, sf), 10)


_SCOPES = """sc AS (SELECT item_id AS query_id, CASE item_id % 3 WHEN 0 THEN NULL WHEN 1 THEN coalesce(l, []) ELSE [] END AS ids FROM benchmark b LEFT JOIN
  (SELECT source, list(doc_id) AS l FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 100 GROUP BY source) s ON s.source = 'src' || (b.item_id % 20))"""


@query(f"WITH {_P}, {_BM25}, {_SCOPES}, f AS (SELECT bs.* FROM bs JOIN sc USING (query_id) WHERE ids IS NULL OR list_contains(ids, chunk_id)) SELECT * FROM {_top('f', 10)}")
def scoped_search(spark, sf):
    """Questions with scopes of their own in one batch: a third may see all documents, a third a hundred documents of one source
    (as many as a request may name), a third none. Statistics stay those of all documents."""
    docs = table(spark, sf, "documents")
    first = docs.select("source", "doc_id", F.row_number().over(W.partitionBy("source").orderBy("doc_id")).alias("r")).where("r <= 100")
    lists = first.groupBy("source").agg(F.collect_list("doc_id").alias("l"))
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("src"), F.col("item_id") % 20).alias("source")).join(lists, "source", "left")
    none = F.array().cast("array<bigint>")
    ids = F.when(F.col("query_id") % 3 == 1, F.coalesce("l", none)).when(F.col("query_id") % 3 == 2, none)
    index = _new_index(spark).appended(_chunks(spark, sf))
    return index.lexical_search(question_terms(spark, sf), 10, scopes=asked.select("query_id", ids.alias("document_ids")))


_COVER = f"""w AS (SELECT doc_id AS chunk_id, unnest(l) AS term, least(generate_subscripts(l, 1), {cover.LAST_POSITION}) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS l FROM documents)),
wq AS (SELECT DISTINCT * FROM w WHERE term IN (SELECT term FROM q) QUALIFY row_number() OVER (PARTITION BY chunk_id, term ORDER BY pos) <= {cover.WORD_POSITIONS}),
cd AS (SELECT query_id, chunk_id, round({cover.WEIGHT} * n / ({cover.WEIGHT} * n + 1), 6) AS score FROM (SELECT query_id, chunk_id, count(DISTINCT pos)::DOUBLE AS n FROM q JOIN wq USING (term) GROUP BY ALL))"""


@query(f"WITH q AS (SELECT DISTINCT query_id, term FROM (SELECT item_id AS query_id, unnest({TERMS.format('text')}) AS term FROM benchmark)), {_COVER} SELECT * FROM {_top('cd', 10)}")
def cover_density_topk(spark, sf):
    """Cover density of any word of a question, from places counted within each document's row."""
    documents = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("search_text"))
    return cover.top(question_terms(spark, sf), documents, 10)


@query()
def ann_recall(spark, sf):
    """Recall of the vector index against exact search, and the share of all vectors that it scored exactly, for each question.
    These vectors have no clusters, so three quarters of the cells are probed: their codes are read, not scored. Codes have a byte for two
    components, so that short lists of a fixed length are enough however many vectors there are."""
    rows, asked = _vectors(spark, sf)
    index = VectorIndex.saved(rows, f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}", parts=2 * PARTS)
    short = max(10, min(SHORT_LIST * 10, index.n * 9 // 100))
    pairs = materialized(index.scored(asked, 10, probes=max(1, 3 * len(index.quantizer.centres) // 4), short=short), "scored-pairs")
    near = search.top(pairs, 10).select("query_id", "chunk_id", F.lit(1).alias("hit"))
    found = search.dense_top(asked, rows, 10).join(near, ["query_id", "chunk_id"], "left").groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    share = pairs.groupBy("query_id").agg(F.round(F.count("*") / F.lit(max(index.n, 1)), 6).alias("scored"))
    return found.join(share, "query_id", "left")
