"""Queries of indexing, search, fusion, passages and evaluation. Documents are chunks of their own for
search, benchmark passages are the questions, and lines of documents are the chunks of passages."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lanternq.config import Settings
from lanternq.functions import text as T
from lanternq.functions import vectors as V
from lanternq.operators import evals, fuse, index, passages, search
from lanternq.operators.models import HashingDense, HashingSparse, Models
from lanternq.plans import cascade
from lanternq.plans.cascade import searched
from lanternq.plans.registry import query, table
from lanternq.plans.text_queries import TERMS
from lanternq.sources.tables import materialized

S = Settings()
MD5 = "('0x' || substr(md5(term), 1, 8))::BIGINT % {0}"
_P = f"""t AS (SELECT doc_id AS chunk_id, unnest({TERMS.format('text')}) AS term FROM documents),
p AS (SELECT chunk_id, term, count(*) AS tf FROM t GROUP BY ALL),
ln AS (SELECT doc_id AS chunk_id, len({TERMS.format('text')}) AS length FROM documents),
st AS (SELECT count(*) AS n, avg(length) AS a FROM ln),
q AS (SELECT DISTINCT query_id, term FROM (SELECT item_id AS query_id, unnest({TERMS.format('text')}) AS term FROM benchmark)),
qp AS (SELECT query_id, term, count(*) AS tf FROM (SELECT item_id AS query_id, unnest({TERMS.format('text')}) AS term FROM benchmark) GROUP BY ALL)"""
_BM25 = f"""df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
bs AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / a))), 6) AS score
  FROM q JOIN p USING (term) JOIN df USING (term) JOIN ln USING (chunk_id), st GROUP BY ALL)"""


def _top(name: str, k: int, where: str = "score > 0") -> str:
    return f"(SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {name} WHERE {where} QUALIFY rank <= {k})"


def chunks(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("search_text"))


def questions(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("chunk_id"), F.col("text").alias("search_text"))


def question_terms(spark, sf):
    return index.term_rows(questions(spark, sf)).withColumnRenamed("chunk_id", "query_id")


WORDS = Models(None, None, None)


def indexed(spark, sf, models=WORDS, analyzer="simple", only=None):
    """The documents, analysed and encoded once and written for the searches of one query."""
    return cascade.indexed(chunks(spark, sf), models, analyzer, text=False, only=only)


def asked(spark, sf, models=WORDS, analyzer="simple"):
    return cascade.indexed(questions(spark, sf), models, analyzer, queries=F.lit(True), name="questions", text=False)


def as_questions(rows):
    return rows.withColumnRenamed("chunk_id", "query_id")


def lexical(spark, sf, k, analyzer="simple", allowed=None, ix=None, q=None):
    q = q or asked(spark, sf, analyzer=analyzer)
    ix = ix or indexed(spark, sf, analyzer=analyzer, only=search.wanted(q.postings) if analyzer == "english" else None)
    rows = ix.rows if allowed is None else ix.rows.join(allowed.select("chunk_id").distinct(), "chunk_id", "left_semi")
    return search.bm25_top(as_questions(q.postings), rows, ix.postings, ix.n, ix.avg_length, k, S.bm25_k1, S.bm25_b, q.terms)


def sparse(spark, sf, k, dim=30000, ix=None, q=None):
    own = Models(None, HashingSparse(dim), None)
    ix, q = ix or indexed(spark, sf, own), q or asked(spark, sf, own)
    return search.sparse_top(as_questions(search.arrays(q.rows)), search.arrays(ix.rows), k)


def dense(spark, sf, k, dim=256, ix=None, q=None):
    """Weights of the hashing encoder are positive, so questions and chunks either share a bucket or score zero; these are left out."""
    own = Models(HashingDense(dim), None, None)
    ix, q = ix or indexed(spark, sf, own), q or asked(spark, sf, own)
    return search.dense_top(as_questions(q.rows.select("chunk_id", "embedding")), ix.rows, k, complete=ix.complete).where("score > 0")


@query(f"WITH {_P} SELECT chunk_id, term, tf FROM p")
def build_postings(spark, sf):
    return index.postings(chunks(spark, sf))


@query(f"WITH {_P} SELECT n, round(a, 6) AS avg_length FROM st")
def corpus_stats(spark, sf):
    return index.corpus_stats(index.chunk_lengths(chunks(spark, sf))).select("n", F.round("avg_length", 6).alias("avg_length"))


@query(f"WITH {_P}, {_BM25} SELECT * FROM {_top('bs', 10)}")
def bm25_topk(spark, sf):
    return lexical(spark, sf, 10)


@query()
def bm25_english(spark, sf):
    """BM25 with the stemming analyzer, which SQL does not express."""
    return lexical(spark, sf, 10, "english")


@query(f"WITH {_P}, {_BM25}, f AS (SELECT bs.* FROM bs JOIN documents d ON d.doc_id = bs.chunk_id WHERE d.lang = 'en') SELECT * FROM {_top('f', 10)}")
def doc_filter_semi(spark, sf):
    allowed = table(spark, sf, "documents").where("lang = 'en'").select(F.col("doc_id").alias("chunk_id"))
    return lexical(spark, sf, 10, allowed=allowed)


_SPARSE = f"""sx AS (SELECT chunk_id, {MD5.format(30000)} AS b, sum(tf)::DOUBLE AS w FROM p GROUP BY ALL), sq AS (SELECT query_id, {MD5.format(30000)} AS b, sum(tf)::DOUBLE AS w FROM qp GROUP BY ALL),
ss AS (SELECT query_id, chunk_id, round(sum(sx.w * sq.w), 6) AS score FROM sq JOIN sx USING (b) GROUP BY ALL)"""
_DENSE = f"""dx0 AS (SELECT chunk_id, {MD5.format(256)} AS b, sum(1 + ln(tf)) AS w FROM p GROUP BY ALL), dx AS (SELECT chunk_id, b, w / sqrt(sum(w * w) OVER (PARTITION BY chunk_id)) AS w FROM dx0),
dq0 AS (SELECT query_id, {MD5.format(256)} AS b, sum(1 + ln(tf)) AS w FROM qp GROUP BY ALL), dq AS (SELECT query_id, b, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS w FROM dq0),
ds AS (SELECT query_id, chunk_id, round(sum(dx.w * dq.w), 6) AS score FROM dq JOIN dx USING (b) GROUP BY ALL)"""


@query(f"WITH {_P}, {_SPARSE} SELECT query_id, chunk_id, score FROM ss")
def sparse_dot(spark, sf):
    """Sparse products of all pairs of question and document that share a bucket."""
    encoder = HashingSparse(30000)
    rows = lambda df: search.arrays(encoder.documents(index.with_posts(df).select("chunk_id", "posts"), "sparse"))
    return search.sparse_products(as_questions(rows(questions(spark, sf))), rows(chunks(spark, sf)))


@query(f"WITH {_P}, {_SPARSE} SELECT * FROM {_top('ss', 10)}")
def sparse_topk(spark, sf):
    return sparse(spark, sf, 10)


@query(f"WITH {_P}, {_DENSE} SELECT chunk_id, b AS bucket, round(w, 6) AS w FROM dx")
def hash_dense(spark, sf):
    return index.hashed_dense(index.postings(chunks(spark, sf))).withColumn("w", F.round("w", 6))


@query(f"WITH {_P}, {_SPARSE} SELECT chunk_id, b AS bucket, w FROM sx")
def hash_sparse(spark, sf):
    return index.hashed_sparse(index.postings(chunks(spark, sf)))


@query(f"WITH {_P}, {_DENSE} SELECT chunk_id, count(*) AS filled, round(sum(w * w), 6) AS norm FROM dx GROUP BY chunk_id")
def embed_chunks(spark, sf):
    rows = index.hashed_dense(index.postings(chunks(spark, sf)))
    return rows.groupBy("chunk_id").agg(F.count("*").alias("filled"), F.round(F.sum(F.col("w") * F.col("w")), 6).alias("norm"))


@query()
def hash_blake2b(spark, sf):
    """Hashed dense vectors with the 64-bit BLAKE2b bucket function, which SQL engines lack."""
    from lanternq.functions.buckets import with_buckets

    posts = index.postings(chunks(spark, sf))
    return index.hashed_dense(posts, 256, with_buckets(posts, 256)).withColumn("w", F.round("w", 6))


_E = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


def _vectors(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return rows, rows.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")


@query(f"SELECT * FROM (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round({_E}, 6) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_E}, 6) DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0) WHERE rank <= 10")
def dense_topk(spark, sf):
    rows, asked = _vectors(spark, sf)
    return search.dense_top(asked, rows, 10)


@query(f"SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round({_E}, 6) AS similarity FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0")
def dense_similarity(spark, sf):
    rows, asked = _vectors(spark, sf)
    return search.dense_products(asked, rows).select("query_id", "chunk_id", F.round("score", 6).alias("similarity"))


@query("SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS norm, round(v[1], 6) AS first FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / greatest(sqrt(list_sum(list_transform(embedding, lambda y: (y::DOUBLE) * (y::DOUBLE)))), 1e-12)) AS v FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 3) AS embedding FROM embeddings))")
def l2_normalize(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", V.l2_normalized(F.transform("embedding", lambda x: x.cast("double") * 3)).alias("v"))
    return rows.select("vec_id", F.round(V.dot(F.col("v"), F.col("v")), 6).alias("norm"), F.round(F.col("v")[0], 6).alias("first"))


@query("SELECT vec_id, round(1 / (1 + exp(-(embedding[1]::DOUBLE * 10))), 6) AS p FROM embeddings")
def sigmoid_scores(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.round(V.sigmoid(F.col("embedding")[0].cast("double") * 10), 6).alias("p"))


@query("SELECT query_id, chunk_id, score, rank FROM (SELECT label::BIGINT AS query_id, vec_id AS chunk_id, round(embedding[1]::DOUBLE, 6) AS score, row_number() OVER (PARTITION BY label ORDER BY round(embedding[1]::DOUBLE, 6) DESC, vec_id) AS rank FROM embeddings WHERE round(embedding[1]::DOUBLE, 6) > 0) WHERE rank <= 7")
def topk_positive(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("query_id"), F.col("vec_id").alias("chunk_id"), F.col("embedding")[0].cast("double").alias("score"))
    return search.top(rows, 7, positive_only=True)


K = S.candidates_per_retriever
_LISTS = f"""lists AS (SELECT 'lexical:0' AS list_name, 1 AS list_ord, * FROM {_top('bs', K)} UNION ALL SELECT 'dense:0', 0, * FROM {_top('ds', K)} UNION ALL SELECT 'sparse:0', 2, * FROM {_top('ss', K)})"""


BOTH = Models(reranker=None)


def candidate_lists(spark, sf, k=K):
    lists, ix, q = None, indexed(spark, sf, BOTH), asked(spark, sf, BOTH)
    for n, (name, find) in enumerate((("dense:0", dense), ("lexical:0", lexical), ("sparse:0", sparse))):
        rows = find(spark, sf, k, ix=ix, q=q).withColumn("list_name", F.lit(name)).withColumn("list_ord", F.lit(n))
        lists = rows if lists is None else lists.unionByName(rows)
    return lists


@query(f"WITH {_P}, {_BM25}, {_SPARSE}, {_DENSE}, {_LISTS} SELECT query_id, list_name, chunk_id, score, rank FROM lists")
def hybrid_candidates(spark, sf):
    return candidate_lists(spark, sf).select("query_id", "list_name", "chunk_id", "score", "rank")


@query(f"WITH {_P}, {_DENSE}, h AS (SELECT query_id, chunk_id, rank FROM {_top('ds', 5)}) SELECT query_id, 'dense:hyde' AS list_name, chunk_id, rank FROM h")
def hyde_variant(spark, sf):
    """A hypothetical answer (here the question itself) embedded as a document, as one more dense list."""
    return dense(spark, sf, 5).select("query_id", F.lit("dense:hyde").alias("list_name"), "chunk_id", "rank")


def _fused_sql(weight: str) -> str:
    return f"""fs AS (SELECT query_id, chunk_id, round(sum({weight} / (60 + rank)), 9) AS score, min(struct_pack(o := list_ord, r := rank)) AS f, count(*) AS lists FROM lists GROUP BY ALL),
fu AS (SELECT query_id, chunk_id, score, lists, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, f) AS position FROM fs)"""


@query(f"WITH {_P}, {_BM25}, {_SPARSE}, {_DENSE}, {_LISTS}, {_fused_sql('1.0::DOUBLE')} SELECT query_id, chunk_id, score, position, lists::INTEGER AS lists FROM fu")
def rrf_fuse(spark, sf):
    return fuse.fused(candidate_lists(spark, sf)).select("query_id", "chunk_id", "score", "position", F.size("ranks").alias("lists"))


@query(f"""WITH {_P}, {_BM25}, {_SPARSE}, {_DENSE}, {_LISTS}, {_fused_sql("CASE list_ord WHEN 0 THEN 2.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END")} SELECT query_id, chunk_id, score, position FROM fu""")
def rrf_weighted(spark, sf):
    return fuse.fused(candidate_lists(spark, sf), 60, {"lexical": 0.5, "dense": 2.0}).select("query_id", "chunk_id", "score", "position")


def overlap_reranked(spark, sf, head=S.rerank_candidates, lists=None):
    """Fused hits with the overlap score of the first ``head`` of each question; only their documents are analysed."""
    terms = lambda rows, id_, out: rows.select(F.col("chunk_id").alias(id_), T.simple_terms(F.col("search_text")).alias(out))
    hits = materialized(fuse.fused(candidate_lists(spark, sf) if lists is None else lists).drop("ranks"), "fused")
    first = hits.where(F.col("position") <= head)
    wanted = chunks(spark, sf).join(search.small(first.select("chunk_id").distinct()), "chunk_id", "left_semi")
    scored = first.join(terms(questions(spark, sf), "query_id", "qt"), "query_id").join(terms(wanted, "chunk_id", "ct"), "chunk_id")
    scored = scored.withColumn("rerank_score", F.round(T.overlap_share(F.col("qt"), F.col("ct")), 6)).drop("qt", "ct")
    rest = hits.where(F.col("position") > head).withColumn("rerank_score", F.lit(None).cast("double"))
    return fuse.reranked(scored.unionByName(rest), head)


_RERANK = f"""rs AS (SELECT fu.*, CASE WHEN position <= 40 THEN round(len(list_intersect(qt, ct)) / len(qt), 6) END AS rerank_score FROM fu
  JOIN (SELECT item_id AS query_id, list_distinct({TERMS.format('text')}) AS qt FROM benchmark) USING (query_id) JOIN (SELECT doc_id AS chunk_id, list_distinct({TERMS.format('text')}) AS ct FROM documents) USING (chunk_id)),
rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY position > 40, rerank_score DESC NULLS LAST, position) AS final FROM rs)"""
_HYBRID = f"WITH {_P}, {_BM25}, {_SPARSE}, {_DENSE}, {_LISTS}, {_fused_sql('1.0::DOUBLE')}, {_RERANK}"


@query(f"{_HYBRID} SELECT query_id, chunk_id, rerank_score, position, final FROM rr")
def rerank_head(spark, sf):
    return overlap_reranked(spark, sf).select("query_id", "chunk_id", "rerank_score", "position", "final")


@query(f"{_HYBRID} SELECT query_id, CASE WHEN position <= 5 THEN round(len(list_intersect(qt, ct)) / len(qt), 6) END AS overlap, chunk_id FROM rr JOIN (SELECT item_id AS query_id, list_distinct({TERMS.format('text')}) AS qt FROM benchmark) USING (query_id) JOIN (SELECT doc_id AS chunk_id, list_distinct({TERMS.format('text')}) AS ct FROM documents) USING (chunk_id)")
def overlap_rerank(spark, sf):
    return overlap_reranked(spark, sf, 5).select("query_id", "chunk_id", F.col("rerank_score").alias("overlap"))


@query(f"{_HYBRID} SELECT query_id, rerank_score AS confidence FROM rr WHERE final = 1")
def confidence(spark, sf):
    return fuse.confidence(overlap_reranked(spark, sf))


_POOL = f"""pool AS (SELECT query_id, chunk_id, rank AS position, score AS relevance, embedding FROM (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, b.embedding, round({_E}, 6) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_E}, 6) DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0) WHERE rank <= 18),
sim AS (SELECT a.query_id, a.position AS i, b.position AS j, {_E} AS s FROM pool a JOIN pool b USING (query_id)),
rel AS (SELECT *, CASE WHEN hi > lo THEN (relevance - lo) / (hi - lo) ELSE 1 END AS rel FROM (SELECT *, min(relevance) OVER (PARTITION BY query_id) AS lo, max(relevance) OVER (PARTITION BY query_id) AS hi FROM pool))"""


def pool(spark, sf, k=18):
    rows, asked = _vectors(spark, sf)
    hits = search.dense_top(asked, rows, k)
    return hits.join(rows, "chunk_id").select("query_id", F.col("rank").alias("position"), "chunk_id", F.col("score").alias("relevance"), "embedding")


@query(f"WITH {_POOL} SELECT query_id, i, j, round(s, 6) AS similarity FROM sim WHERE i < j")
def mmr_pairwise_sim(spark, sf):
    rows = pool(spark, sf)
    a = rows.select("query_id", F.col("position").alias("i"), F.col("embedding").alias("ea"))
    b = rows.select("query_id", F.col("position").alias("j"), F.col("embedding").alias("eb"))
    return a.join(b, "query_id").where("i < j").select("query_id", "i", "j", F.round(V.dot(F.col("ea"), F.col("eb")), 6).alias("similarity"))


@query(f"""WITH RECURSIVE {_POOL},
w AS (SELECT query_id, 1 AS pick, position, [position] AS c FROM rel QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(rel, 6) DESC, position) = 1
  UNION ALL SELECT query_id, pick + 1, position, c || [position] FROM (SELECT w.query_id, w.pick, w.c, r.position,
    row_number() OVER (PARTITION BY w.query_id ORDER BY round(0.75 * r.rel - 0.25 * m.s, 6) DESC, r.position) AS n
    FROM w JOIN rel r ON r.query_id = w.query_id JOIN (SELECT w.query_id, sim.i, max(sim.s) AS s FROM w JOIN sim ON sim.query_id = w.query_id AND list_contains(w.c, sim.j) GROUP BY ALL) m
      ON m.query_id = w.query_id AND m.i = r.position WHERE w.pick < 6 AND NOT list_contains(w.c, r.position)) WHERE n = 1)
SELECT w.query_id, pick, chunk_id FROM w JOIN pool USING (query_id, position)""")
def mmr_select(spark, sf):
    return fuse.mmr(pool(spark, sf), S.top_k, S.mmr_lambda)


_LINES = """c AS (SELECT doc_id AS document_id, n - 1 AS idx, l[n] AS text, CASE WHEN (n - 1) // 3 % 4 = 3 THEN NULL ELSE 's' || (n - 1) // 3 END AS section, ((n - 1) // 5 + 1)::INTEGER AS page FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))),
h AS (SELECT document_id % 7 AS query_id, document_id, idx, CASE WHEN (document_id + idx) % 9 = 0 THEN NULL ELSE (document_id * 13 + idx * 7) % 100 / 100 END AS relevance, row_number() OVER (PARTITION BY document_id % 7 ORDER BY (document_id * 37 + idx * 11) % 101, document_id, idx) AS position FROM c WHERE (document_id * 31 + idx * 17) % 11 = 0)"""
_WIN = """x AS (SELECT *, lag(section, 1) OVER o AS a1, lag(section, 2) OVER o AS a2, lead(section, 1) OVER o AS b1, lead(section, 2) OVER o AS b2, max(idx) OVER (PARTITION BY document_id) AS m FROM c WINDOW o AS (PARTITION BY document_id ORDER BY idx)),
e AS (SELECT document_id, idx, section, idx - CASE WHEN idx >= 1 AND a1 IS NOT DISTINCT FROM section THEN CASE WHEN idx >= 2 AND a2 IS NOT DISTINCT FROM section THEN 2 ELSE 1 END ELSE 0 END AS start,
  idx + CASE WHEN idx + 1 <= m AND b1 IS NOT DISTINCT FROM section THEN CASE WHEN idx + 2 <= m AND b2 IS NOT DISTINCT FROM section THEN 2 ELSE 1 END ELSE 0 END AS "end" FROM x),
w AS (SELECT h.query_id, h.document_id, h.idx, h.relevance, h.position, e.section, e.start, e."end" FROM h JOIN e USING (document_id, idx))"""
_MERGE = """mb AS (SELECT *, max("end") OVER (PARTITION BY query_id, document_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, lag(section) OVER (PARTITION BY query_id, document_id ORDER BY start, "end") AS ps FROM w),
mi AS (SELECT *, sum((b IS NULL OR start > b + 1 OR ps IS DISTINCT FROM section)::INTEGER) OVER (PARTITION BY query_id, document_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS i FROM mb),
m AS (SELECT query_id, document_id, min(start) AS start, max("end") AS "end", first(section) AS section, max(coalesce(relevance, 0)) AS relevance FROM mi GROUP BY query_id, document_id, i)"""


def lines(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n", -1)).alias("idx", "text"))
    third = F.floor(F.col("idx") / 3)
    return rows.select(
        "document_id", F.col("idx").cast("long").alias("idx"), "text", F.when(third % 4 != 3, F.concat(F.lit("s"), third)).alias("section"),
        (F.floor(F.col("idx") / 5) + 1).cast("int").alias("page_start"), (F.floor(F.col("idx") / 5) + 1).cast("int").alias("page_end"),
        F.concat("document_id", F.lit(":"), "idx").alias("chunk_id"),
    )


def line_hits(spark, sf):
    rows = lines(spark, sf).where("(document_id * 31 + idx * 17) % 11 = 0").withColumn("query_id", F.col("document_id") % 7)
    order = W.partitionBy("query_id").orderBy((F.col("document_id") * 37 + F.col("idx") * 11) % 101, "document_id", "idx")
    relevance = F.when((F.col("document_id") + F.col("idx")) % 9 != 0, (F.col("document_id") * 13 + F.col("idx") * 7) % 100 / 100)
    return rows.select("query_id", "document_id", "idx", relevance.alias("relevance"), F.row_number().over(order).alias("position"))


@query(f"WITH {_LINES} SELECT document_id, idx, text FROM c WHERE idx IN (0, 1, 7)")
def neighbors(spark, sf):
    rows = lines(spark, sf)
    wanted = rows.select("document_id").distinct().withColumn("idx", F.explode(F.array(*[F.lit(x).cast("long") for x in (0, 1, 7)])))
    return passages.neighbors(rows, wanted).select("document_id", "idx", "text")


@query(f'WITH {_LINES}, {_WIN} SELECT query_id, document_id, idx, section, start, "end" FROM w')
def window_expand(spark, sf):
    return passages.expanded(lines(spark, sf), line_hits(spark, sf), 2).select("query_id", "document_id", "idx", "section", "start", "end")


def spans(spark, sf):
    return passages.merged(passages.expanded(lines(spark, sf), line_hits(spark, sf), 2))


@query(f"WITH {_LINES}, {_WIN}, {_MERGE} SELECT * FROM m")
def span_merge(spark, sf):
    return spans(spark, sf)


_JOINED = "list_reduce(list(c.text ORDER BY idx), lambda l, r: CASE WHEN list_filter(range(least(length(l), length(r), 2000), 20, -1), lambda k: ends_with(l, left(r, k)))[1] IS NULL THEN l || chr(10) || chr(10) || r ELSE l || substr(r, list_filter(range(least(length(l), length(r), 2000), 20, -1), lambda k: ends_with(l, left(r, k)))[1] + 1) END)"


@query(f"""WITH {_LINES}, {_WIN}, {_MERGE} SELECT query_id, m.document_id, start, "end", {_JOINED} AS text, string_agg(m.document_id || ':' || idx, ',' ORDER BY idx) AS chunk_ids, min(page) AS page_start, max(page) AS page_end
FROM m JOIN c ON c.document_id = m.document_id AND idx BETWEEN start AND "end" GROUP BY query_id, m.document_id, start, "end" """)
def passage_build(spark, sf):
    return passages.built(spans(spark, sf), lines(spark, sf)).select("query_id", "document_id", "start", "end", "text", F.array_join("chunk_ids", ",").alias("chunk_ids"), "page_start", "page_end")


@query(f"""WITH {_LINES}, {_WIN}, {_MERGE}, f AS (SELECT query_id, document_id, min(position) AS p FROM h GROUP BY ALL)
SELECT m.query_id, m.document_id, start, relevance, CASE WHEN m.document_id % 5 = 0 THEN 'Untitled' ELSE d.source END AS title, row_number() OVER (PARTITION BY m.query_id ORDER BY relevance DESC, f.p, start) - 1 AS id FROM m JOIN f ON f.query_id = m.query_id AND f.document_id = m.document_id JOIN documents d ON d.doc_id = m.document_id""")
def passage_order(spark, sf):
    titled = table(spark, sf, "documents").where("doc_id % 5 <> 0").select(F.col("doc_id").alias("document_id"), F.col("source").alias("title"))
    return passages.ordered(spans(spark, sf), line_hits(spark, sf), titled).select("query_id", "document_id", "start", "relevance", "title", F.col("id").cast("long").alias("id"))


def qrels(spark, sf):
    """Documents that hold a benchmark passage verbatim (grade 2) or are of its language by length parity (grade 0)."""
    d, b = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text"), table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    return passages.holding(d, b).select("query_id", "doc", (F.col("doc") % 3).cast("int").alias("grade"))


_QRELS = "qr AS (SELECT item_id AS query_id, doc_id AS doc, (doc_id % 3)::INTEGER AS grade FROM documents d, benchmark b WHERE contains(d.text, b.text))"


def _metrics_sql(ranking: str) -> str:
    return f"""mj AS (SELECT qr.query_id, qr.doc, grade, r.rank, row_number() OVER (PARTITION BY qr.query_id ORDER BY grade DESC, qr.doc) AS ideal FROM qr LEFT JOIN {ranking} r ON r.query_id = qr.query_id AND r.chunk_id = qr.doc),
mm AS (SELECT query_id, round(CASE WHEN sum(CASE WHEN ideal <= 10 THEN (2 ** grade - 1) / log2(ideal + 1) END) > 0 THEN coalesce(sum(CASE WHEN rank <= 10 THEN (2 ** grade - 1) / log2(rank + 1) END), 0) / sum(CASE WHEN ideal <= 10 THEN (2 ** grade - 1) / log2(ideal + 1) END) ELSE 0 END, 6) AS ndcg10,
  round(coalesce(1 / min(CASE WHEN rank <= 10 THEN rank END), 0), 6) AS mrr10,
  round(count_if(grade > 0 AND rank <= 10) / nullif(count_if(grade > 0), 0), 6) AS recall10, round(count_if(grade > 0 AND rank <= 100) / nullif(count_if(grade > 0), 0), 6) AS recall100 FROM mj GROUP BY query_id)"""


_EVAL = f"WITH {_P}, {_BM25}, bt AS {_top('bs', 100)}, {_QRELS}, {_metrics_sql('bt')}"


def _evaluated(spark, sf):
    return evals.metrics(lexical(spark, sf, 100).select("query_id", F.col("chunk_id").alias("doc"), "rank"), qrels(spark, sf))


@query(f"{_EVAL} SELECT query_id, ndcg10 FROM mm")
def eval_ndcg(spark, sf):
    return _evaluated(spark, sf).select("query_id", "ndcg10")


@query(f"{_EVAL} SELECT query_id, mrr10 FROM mm")
def eval_mrr(spark, sf):
    return _evaluated(spark, sf).select("query_id", "mrr10")


@query(f"{_EVAL} SELECT query_id, recall10, recall100 FROM mm")
def eval_recall(spark, sf):
    return _evaluated(spark, sf).select("query_id", "recall10", "recall100")


@query()
def eval_sweep(spark, sf):
    """Six configurations over the same questions: one list each, two hybrids, and the reranked hybrid."""
    ix, q = indexed(spark, sf, BOTH), asked(spark, sf, BOTH)
    found = {n: materialized(f(spark, sf, 100, ix=ix, q=q), n) for n, f in (("lexical", lexical), ("dense", dense), ("sparse", sparse))}

    def ranked(*names):
        lists = None
        for n, name in enumerate(names):
            rows = found[name].withColumn("list_name", F.lit(name)).withColumn("list_ord", F.lit(n))
            lists = rows if lists is None else lists.unionByName(rows)
        return lists

    def hybrid(*names):
        return fuse.fused(ranked(*names))

    configs = {n: df.select("query_id", F.col("chunk_id").alias("doc"), "rank") for n, df in found.items()}
    for name, parts in (("lexical+dense", ("lexical", "dense")), ("all", ("lexical", "dense", "sparse"))):
        configs[name] = hybrid(*parts).select("query_id", F.col("chunk_id").alias("doc"), F.col("position").alias("rank"))
    configs["all+rerank"] = overlap_reranked(spark, sf, 50, ranked("dense", "lexical", "sparse").where(F.col("rank") <= K)).select("query_id", F.col("chunk_id").alias("doc"), F.col("final").alias("rank"))
    rankings = None
    for name, df in configs.items():
        rows = df.withColumn("config", F.lit(name))
        rankings = rows if rankings is None else rankings.unionByName(rows)
    return evals.sweep(rankings, qrels(spark, sf))


@query()
def hybrid_search(spark, sf):
    """The whole cascade: three lists, fusion, reranking, diversification, and passages."""
    return searched(spark, sf)


@query()
def ask_loop(spark, sf):
    """Whole turns: the last message of each conversation as the question to the documents, planned, retrieved, graded,
    asked again where evidence is weak, and answered by the extractive generator or declined."""
    from lanternq.operators.dialog import started
    from lanternq.plans.ask import answered
    from lanternq.plans.cascade import document_chunks

    rows, documents = document_chunks(spark, sf)
    out = answered(started(table(spark, sf, "conversations")), rows, documents.withColumn("status", F.lit("ready")))
    return out.select("turn_id", "status", "content", F.size("blocks").alias("blocks"), F.transform("sources", lambda x: x["document_id"]).alias("sources"), F.transform("citations", lambda c: c["passage"]).alias("cited"), "rounds")
