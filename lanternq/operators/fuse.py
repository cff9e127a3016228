"""Fusion of ranked lists, reranking of the head, and diversification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fused(lists: DataFrame, k: int = 60, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted reciprocal-rank fusion of (query_id, list_name, list_ord, rank, chunk_id). A list's weight goes by
    the part of its name before ``:`` and is 1.0 by default. Ties keep the order of first appearance: earliest
    list, then rank in it. Returns (query_id, chunk_id, score, ranks, position)."""
    weight: Column = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.split("list_name", ":")[0] == name, F.lit(float(w))).otherwise(weight)
    out = lists.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(weight / (k + F.col("rank"))), 9).alias("score"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("list_name", "rank")))).alias("ranks"),
        F.min(F.struct("list_ord", "rank")).alias("first_"),
    )
    position = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "first_"))
    return out.withColumn("position", position).drop("first_")


def reranked(hits: DataFrame, head: int) -> DataFrame:
    """Hits (query_id, chunk_id, position, rerank_score) with the first ``head`` of each query in the order of
    rerank_score and the rest behind them as they were; the rest has no rerank_score."""
    rows = hits.withColumn("tail_", F.col("position") > head).withColumn("rerank_score", F.when(~F.col("tail_"), F.col("rerank_score")))
    order = W.partitionBy("query_id").orderBy("tail_", F.desc("rerank_score"), "position")
    return rows.withColumn("final", F.row_number().over(order)).drop("tail_")


def confidence(hits: DataFrame) -> DataFrame:
    """(query_id, confidence): the rerank_score of each query's first hit."""
    return hits.groupBy("query_id").agg(F.min_by("rerank_score", "final").alias("confidence"))


def mmr(pool: DataFrame, keep: int, trade: float = 0.75) -> DataFrame:
    """Maximal marginal relevance over (query_id, position, chunk_id, relevance, embedding), a pool of a few
    dozen rows a query. Relevance is scaled to 0..1 within the pool (1 where it is flat). Returns
    (query_id, pick, chunk_id); ties go to the earlier position."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    rows = pool.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("position", "chunk_id", "relevance", "embedding"))).alias("p"))
    low, high = F.array_min(F.transform("p", lambda x: x["relevance"])), F.array_max(F.transform("p", lambda x: x["relevance"]))
    rows = rows.withColumn("low", low).withColumn("high", high)
    rel = lambda x: F.when(F.col("high") > F.col("low"), (x["relevance"] - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(F.lit(1.0))
    rows = rows.withColumn("p", F.transform("p", lambda x: F.struct(x["position"].alias("position"), x["chunk_id"].alias("chunk_id"), rel(x).alias("rel"), x["embedding"].alias("embedding"))))

    def pick(chosen: Column, _: Column) -> Column:
        def value(x: Column) -> Column:
            near = F.array_max(F.transform(chosen, lambda c: dot(c["embedding"], x["embedding"])))
            return F.round(F.when(F.size(chosen) == 0, x["rel"]).otherwise(trade * x["rel"] - (1 - trade) * near), 6)

        left = F.filter("p", lambda x: ~F.exists(chosen, lambda c: c["position"] == x["position"]))
        best = F.reduce(
            F.transform(left, lambda x: F.struct(value(x).alias("v"), (-x["position"]).alias("o"), x.alias("x"))),
            F.lit(None).cast("struct<v: double, o: int, x: struct<position: int, chunk_id: bigint, rel: double, embedding: array<float>>>"),
            lambda a, x: F.when(a.isNull() | (x["v"] > a["v"]) | ((x["v"] == a["v"]) & (x["o"] > a["o"])), x).otherwise(a),
        )
        return F.when(F.size(left) > 0, F.array_append(chosen, best["x"])).otherwise(chosen)

    chosen = F.aggregate(F.sequence(F.lit(1), F.lit(keep)), F.slice("p", 1, 0), pick)
    out = rows.select("query_id", F.posexplode(chosen).alias("pick", "x"))
    return out.select("query_id", (F.col("pick") + 1).alias("pick"), F.col("x.chunk_id").alias("chunk_id"))
