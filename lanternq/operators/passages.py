"""Passages around hits: neighbour windows, merged spans, and their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lanternq.functions.text import overlap_joined
from lanternq.operators.search import small

#: Words inside a passage by which it meets the texts that may have it.
SEED_WORDS = 3


def _seeds(words: Column) -> Column:
    """Hashes of the runs of SEED_WORDS words; ``words`` is evaluated once."""

    def runs(w: Column) -> Column:
        first = F.slice(w, F.lit(1), F.greatest(F.size(w) - SEED_WORDS + 1, F.lit(0)))
        return F.transform(first, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, SEED_WORDS)]))

    return F.transform(F.array(words), runs)[0]


def holding(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """``documents`` (doc, text) and ``passages`` (query_id, passage) where the text has the passage verbatim. They meet by
    a hash of words inside the passage, which a text that has it has as words of its own; only passages of fewer
    words are held against every text."""
    words = F.split(F.btrim("passage"), r"\s+", -1)
    asked = passages.withColumn("seed_", F.when(F.size(words) >= SEED_WORDS + 2, F.get(_seeds(F.slice(words, 2, SEED_WORDS)), F.lit(0))))
    runs = documents.withColumn("seed_", F.explode(F.array_distinct(_seeds(F.split("text", r"\s+", -1)))))
    found = runs.join(small(asked.where("seed_ IS NOT NULL")), "seed_").where(F.contains("text", "passage")).drop("seed_")
    short = asked.where("seed_ IS NULL").drop("seed_")
    if not short.limit(1).count():
        return found
    return found.unionByName(documents.join(small(short), F.contains("text", "passage")))


def neighbors(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Chunks at the wanted (document_id, idx), in order; indices without a chunk are skipped."""
    return chunks.join(wanted.select("document_id", "idx").distinct(), ["document_id", "idx"], "left_semi")


def expanded(chunks: DataFrame, hits: DataFrame, window: int) -> DataFrame:
    """Hits (query_id, document_id, idx, relevance) with start and end: up to ``window`` chunks on either side while
    they are contiguous and of the same section (no section equals no section)."""
    order = W.partitionBy("document_id").orderBy("idx")
    here = F.struct("idx", "section")
    rows = chunks.select("document_id", "idx", "section")
    reach = {}
    for name, step, sign in (("start", F.lag, -1), ("end", F.lead, 1)):
        ok, at = F.lit(True), F.col("idx")
        for k in range(1, window + 1):
            other = step(here, k).over(order)
            ok = ok & (other["idx"] == F.col("idx") + sign * k) & other["section"].eqNullSafe(F.col("section"))
            at = F.when(F.coalesce(ok, F.lit(False)), F.col("idx") + sign * k).otherwise(at)
        reach[name] = at
    return hits.join(rows.select("document_id", "idx", "section", *[c.alias(n) for n, c in reach.items()]), ["document_id", "idx"])


def merged(spans: DataFrame) -> DataFrame:
    """Spans (query_id, document_id, start, end, section, relevance) merged where they touch or overlap within one
    section; relevance is the largest, null counting as 0."""
    order = W.partitionBy("query_id", "document_id").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    breaks = before.isNull() | (F.col("start") > before + 1) | ~F.lag("section").over(order).eqNullSafe(F.col("section"))
    rows = spans.withColumn("island", F.sum(breaks.cast("int")).over(order))
    out = rows.groupBy("query_id", "document_id", "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.first("section").alias("section"), F.max(F.coalesce("relevance", F.lit(0.0))).alias("relevance")
    )
    return out.drop("island")


def joined_text(parts: Column) -> Column:
    """Texts joined in order, each common border written once."""
    return F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.element_at(parts, 1), lambda done, part: overlap_joined(done, part))


def built(spans: DataFrame, chunks: DataFrame) -> DataFrame:
    """Spans with text, chunk_ids, page_start and page_end of their chunks."""
    met = spans.join(chunks.select(F.col("document_id"), "idx", "chunk_id", "text", "page_start", "page_end"), "document_id").where("idx BETWEEN start AND end")
    keys = ["query_id", "document_id", "start", "end", "section", "relevance"]
    rows = met.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("idx", "chunk_id", "text"))).alias("l"),
        F.min(F.least(F.coalesce("page_start", "page_end"), F.coalesce("page_end", "page_start"))).alias("page_start"),
        F.max(F.greatest(F.coalesce("page_start", "page_end"), F.coalesce("page_end", "page_start"))).alias("page_end"),
    )
    return rows.select(*keys, joined_text(F.transform("l", lambda x: x["text"])).alias("text"), F.transform("l", lambda x: x["chunk_id"]).alias("chunk_ids"), "page_start", "page_end")


def ordered(passages: DataFrame, hits: DataFrame, documents: DataFrame) -> DataFrame:
    """Passages numbered from 0 by relevance, then by the first hit of their document, then start; with the document's title."""
    first = hits.groupBy("query_id", "document_id").agg(F.min("position").alias("first_hit"))
    rows = passages.join(first, ["query_id", "document_id"]).join(documents.select("document_id", "title"), "document_id", "left")
    number = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.coalesce("relevance", F.lit(0.0))), "first_hit", "start")) - 1
    return rows.withColumn("id", number).withColumn("title", F.coalesce("title", F.lit("Untitled"))).drop("first_hit")
