"""Ranking metrics over rankings (query_id, doc, rank) and judgements (query_id, doc, grade)."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lanternq.sources.tables import materialized


def metrics(rankings: DataFrame, qrels: DataFrame) -> DataFrame:
    """(query_id, ndcg10, mrr10, recall10, recall100) of every judged query. Gains are 2^grade - 1; the first
    listed document counts for MRR whatever its grade; recall is null for a query without positive grades."""
    hits = qrels.join(rankings, ["query_id", "doc"], "left")
    ideal_rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("grade"), "doc"))
    rows = hits.withColumn("ideal", ideal_rank)
    gain = lambda rank: F.when(rank <= 10, (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(rank + 1))
    best, got = F.sum(gain(F.col("ideal"))), F.coalesce(F.sum(gain(F.col("rank"))), F.lit(0.0))
    first = F.min(F.when(F.col("rank") <= 10, F.col("rank")))
    positive = F.sum((F.col("grade") > 0).cast("int"))
    recall = lambda k: F.when(positive > 0, F.sum(((F.col("grade") > 0) & (F.col("rank") <= k)).cast("int").cast("double")) / positive)
    zero = F.lit(0.0)
    return rows.groupBy("query_id").agg(
        F.round(F.when(best > 0, got / best).otherwise(zero), 6).alias("ndcg10"),
        F.round(F.coalesce(1 / first, zero), 6).alias("mrr10"),
        F.round(F.when(positive > 0, F.coalesce(recall(10), zero)), 6).alias("recall10"),
        F.round(F.when(positive > 0, F.coalesce(recall(100), zero)), 6).alias("recall100"),
    )


def sweep(rankings: DataFrame, qrels: DataFrame) -> DataFrame:
    """Means of the metrics for each config of rankings (config, query_id, doc, rank), rounded to four places.
    A judged query that a config finds nothing for counts with zeros."""
    configs = rankings.select("config").distinct()
    judged = qrels.select("query_id", "doc", "grade").crossJoin(F.broadcast(configs))
    key = lambda df: df.withColumn("query_id", F.struct("config", "query_id"))
    rows = metrics(key(rankings).select("query_id", "doc", "rank"), key(judged).select("query_id", "doc", "grade"))
    means = [F.round(F.avg(c), 4).alias(c) for c in ("ndcg10", "mrr10", "recall10", "recall100")]
    return rows.groupBy(F.col("query_id.config").alias("config")).agg(*means)


def slug(name: str) -> str:
    """A name that may serve as a file name."""
    return name.replace("/", "__")


def report(dataset: str, configs: dict[str, Callable[[], DataFrame]], qrels: DataFrame, documents: int) -> dict:
    """Metrics of each config and its milliseconds a query: ``configs`` give rankings (query_id, doc, rank), each
    computed and timed on its own. The result is what ``as_json`` and ``as_text`` write."""
    asked, results = qrels.select("query_id").distinct().count(), []
    for name, ranking in configs.items():
        began = time.perf_counter()
        found = materialized(ranking().select("query_id", "doc", "rank"), f"ranking-{slug(name).replace('+', '_')}")
        took = time.perf_counter() - began
        row = sweep(found.withColumn("config", F.lit(name)), qrels).first()
        means = {c: (row[c] if row is not None else 0.0) for c in ("ndcg10", "mrr10", "recall10", "recall100")}
        results.append({"config": name, **means, "ms_per_query": round(1000 * took / max(asked, 1))})
    return {"dataset": dataset, "queries": asked, "documents": documents, "results": results}


def as_json(found: dict) -> str:
    return json.dumps(found, indent=2)


def as_text(found: dict) -> str:
    """The results as a table, names to the left and numbers to the right."""
    columns = ["config", "ndcg10", "mrr10", "recall10", "recall100", "ms_per_query"]
    cells = [columns, *[[str(r[c]) for c in columns] for r in found["results"]]]
    widths = [max(len(r[i]) for r in cells) for i in range(len(columns))]
    lines = ["  ".join(v.ljust(w) if i == 0 else v.rjust(w) for i, (v, w) in enumerate(zip(r, widths))).rstrip() for r in cells]
    return "\n".join([f"{found['dataset']}: {found['queries']} queries, {found['documents']} documents", *lines])
