"""Steps whose memory or rows stay bounded as tables grow, against plain versions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F


def test_short_lists_do_not_grow_with_the_vectors(spark, tmp_path):
    """Vectors without clusters, some of them copies: a fixed number is scored exactly, and recall stays."""
    from lanternq.plans import all_queries

    x = np.random.default_rng(3).normal(size=(2500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[1000:1030] = x[1000]
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = all_queries.QUERIES["ann_recall"](spark, str(tmp_path)).collect()
    assert len(rows) == 25 and np.mean([r["recall"] for r in rows]) >= 0.9
    assert max(round(r["scored"] * len(x)) for r in rows) <= 80


def test_parsing_goes_by_pieces_of_bounded_size(spark, monkeypatch):
    """No content is lost or moved where a batch is cut: long, empty and missing ones among them."""
    import pyarrow as pa

    from lanternq.sources import parse

    texts = ["x" * 5, None, "", "y" * 300, "z", "é" * 40, "w" * 99, None, "v"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["key", "content"])
    pieces = list(parse.cut_by_bytes(batch, "content", 100))
    assert [x for p in pieces for x in p.column("content").to_pylist()] == texts and len(pieces) > 3
    assert all(p.num_rows == 1 or sum(len((x or "").encode()) for x in p.column("content").to_pylist()) <= 100 for p in pieces)
    assert list(parse.cut_by_bytes(batch.slice(0, 0), "content", 100)) == []
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "page_id long, html string")
    got = parse.parsed_with(docs, "page_id", "html", lambda t: (t[:3], [{"text": t, "page": None, "heading_level": None}] if t else [])).collect()
    assert {r["page_id"]: (r["title"], r["error"]) for r in got} == {i: ((t or "")[:3], None if t else "no extractable text") for i, t in enumerate(texts)}


def test_ingest_parses_pages_once(spark, sf):
    from lanternq.plans import all_queries

    assert "MapInArrow" not in all_queries.QUERIES["ingest_pipeline"](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_sparse_products_of_all_pairs_that_share_a_key(spark, sf):
    """Questions in several blocks; repeated keys, empty and missing lists; no join and no shuffle of pairs."""
    from lanternq.operators import search
    from lanternq.plans import all_queries

    draw = np.random.default_rng(5)
    made = lambda n: [[f"k{x}" for x in draw.integers(0, 40, draw.integers(0, 6))] for _ in range(n)]
    asked, rows = [*made(50), [], None], [*made(200), [], None]
    frame = lambda side, name: spark.createDataFrame([(i, x, None if x is None else [float(len(k)) for k in x]) for i, x in enumerate(side)], f"{name} long, keys array<string>, weights array<double>")
    got = {(r["query_id"], r["chunk_id"]): r["score"] for r in search.sparse_products(frame(asked, "query_id"), frame(rows, "chunk_id"), 20).collect()}
    sums = {(q, c): float(sum(len(a) * len(b) for a in x or () for b in y or () if a == b)) for q, x in enumerate(asked) for c, y in enumerate(rows)}
    assert got == {k: v for k, v in sums.items() if v}
    plan = all_queries.QUERIES["sparse_dot"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "hashpartitioning" not in plan


def test_broad_questions_meet_chunks_without_a_join_of_postings(spark, tmp_path):
    """Questions whose terms lie in most buckets give what the postings give, with deletions and scopes, and no pairs are shuffled."""
    from lanternq.operators import search
    from lanternq.operators.segments import SegmentIndex

    draw = np.random.default_rng(9)
    text = lambda n: " ".join(f"w{x}" for x in draw.integers(0, 60, n))
    rows = spark.createDataFrame([(i, i, text(int(draw.integers(0, 30)))) for i in range(120)], "chunk_id long, document_id long, search_text string")
    ix = SegmentIndex.created(spark, str(tmp_path / "ix"), buckets=4).appended(rows.where("chunk_id < 70")).appended(rows.where("chunk_id >= 70"))
    ix = ix.deleted(rows.where("chunk_id % 7 = 0").select("document_id"))
    terms = spark.createDataFrame([(q, w) for q in range(6) for w in text(12).split()], "query_id long, term string")
    scopes = spark.createDataFrame([(0, list(range(40))), (1, [])], "query_id long, document_ids array<long>")
    for given in (None, scopes):
        got = ix.lexical_search(terms, 5, scopes=given)
        assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
        pairs = ix.pairs(terms, 5, scopes=given).groupBy("query_id", "chunk_id").agg(F.sum("s").alias("score"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, search.top(pairs, 5, positive_only=True).collect()))
