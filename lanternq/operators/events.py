"""Event streams of a chat: encoding, decoding, folding into turns, and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def encoded(event: Column, payload: Column) -> Column:
    """One server-sent event with a JSON payload."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), F.to_json(payload), F.lit("\n\n"))


def decoded(stream: Column) -> Column:
    """Array of (event, data) in a stream: events end at a blank line, several data lines join, other lines and
    events without data are dropped."""
    events = F.split(F.regexp_replace(stream, "\r\n", "\n"), "\n\n", -1)

    def read(text: Column) -> Column:
        lines = F.split(text, "\n", -1)
        value = lambda line, n: F.regexp_replace(F.substring(line, n + 1, F.length(line)), "^ ", "")
        named = F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit("event:"))), lambda x: F.trim(value(x, 6)))
        data = F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit("data:"))), lambda x: value(x, 5))
        return F.struct(F.coalesce(F.get(named, F.size(named) - 1), F.lit("message")).alias("event"), F.array_join(data, "\n").alias("data"))

    return F.filter(F.transform(events, read), lambda e: e["data"] != "")


def folded_answers(events: DataFrame, key: str = "turn_id") -> DataFrame:
    """(key, blocks): the text of each answer's blocks from events (key, pos, kind, block, text), in order; blocks
    without text in between are empty."""
    parts = events.where("kind = 'text'").groupBy(key, "block").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "").alias("text"))
    rows = parts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("block", "text"))).alias("m"), F.max("block").alias("last"))
    return rows.select(key, F.transform(F.sequence(F.lit(0).cast("long"), F.col("last")), lambda b: F.coalesce(F.col("m")[b], F.lit(""))).alias("blocks"))


def numbered_blocks(events: DataFrame, key: str = "turn_id") -> DataFrame:
    """Raw events (key, pos, kind) with block: the number of text blocks opened so far, from 0."""
    order = W.partitionBy(key).orderBy("pos")
    return events.withColumn("block", F.sum((F.col("kind") == "block_start").cast("int")).over(order) - 1)


def cited_sources(citations: DataFrame, sources: DataFrame, key: str = "turn_id") -> DataFrame:
    """(key, source, n): sources in the order of their first citation, numbered from 1; all sources in their own order
    where a turn cites none. A number stays with a cited passage even where its source is unknown."""
    first = citations.groupBy(key, "passage").agg(F.min("pos").alias("at"))
    first = first.withColumn("n", F.row_number().over(W.partitionBy(key).orderBy("at")))
    cited = first.join(sources.select(key, F.col("id").alias("passage")), [key, "passage"]).select(key, F.col("passage").alias("source"), "n")
    rest = sources.join(first.select(key).distinct(), key, "left_anti")
    rest = rest.withColumn("n", F.row_number().over(W.partitionBy(key).orderBy("id"))).select(key, F.col("id").alias("source"), "n")
    return cited.unionByName(rest)


def with_markers(text: Column, numbers: Column) -> Column:
    """``text`` with a link for each distinct number, in order, before its trailing white space."""
    marks = F.array_join(F.transform(F.array_distinct(numbers), lambda n: F.concat(F.lit("["), n, F.lit("](#cite-"), n, F.lit(")"))), "")
    trailing = F.regexp_extract(text, r"(\s*)$", 1)
    body = F.substring(text, F.lit(1), F.length(text) - F.length(trailing))
    return F.when(F.size(numbers) == 0, text).otherwise(F.concat(body, marks, trailing))


def highlighted(text: Column, quotes: Column) -> Column:
    """Array of (start, end) of the first occurrence of each quote, white space counting alike, without those that
    overlap an earlier one. Starts are from 0."""
    pattern = lambda q: F.concat(F.lit("\\Q"), F.regexp_replace(F.regexp_replace(q, r"\\E", r"\\E\\\\E\\Q"), r"\s+", r"\\E\\s+\\Q"), F.lit("\\E"))

    def place(q: Column) -> Column:
        found = F.regexp_substr(text, pattern(q))
        return F.struct((F.instr(text, found) - 1).alias("start"), (F.instr(text, found) - 1 + F.length(found)).alias("end"))

    wanted = F.filter(F.transform(quotes, lambda q: F.regexp_replace(q, r"^\s+|\s+$", "")), lambda q: q != "")
    spans = F.array_sort(F.filter(F.transform(wanted, place), lambda s: s["start"].isNotNull()))
    start = F.array().cast("array<struct<start: int, end: int>>")
    return F.aggregate(spans, start, lambda done, s: F.when((F.size(done) == 0) | (F.element_at(done, -1)["end"] <= s["start"]), F.array_append(done, s)).otherwise(done))


def folded_turns(events: DataFrame, key: str = "turn_id") -> DataFrame:
    """(key, status, error, blocks, n_retrievals, n_citations) after all events (key, pos, event, block, text, status).
    An answer event outweighs what was streamed: it sets status and blocks."""
    answer = events.where("event = 'answer'").groupBy(key).agg(F.max_by("status", "pos").alias("answered"), F.max_by("text", "pos").alias("content"))
    failed = F.max(F.when(F.col("event") == "error", F.col("text")))
    counts = events.groupBy(key).agg(
        F.count_if(F.col("event") == "retrieval").alias("n_retrievals"), F.count_if(F.col("event") == "citation").alias("n_citations"), failed.alias("error")
    )
    text = folded_answers(events.where("event = 'delta'").withColumn("kind", F.lit("text")), key)
    rows = counts.join(answer, key, "left").join(text, key, "left")
    status = F.when(F.col("error").isNotNull(), "failed").otherwise(F.coalesce("answered", F.lit("running")))
    blocks = F.when(F.col("content").isNotNull(), F.array("content")).otherwise(F.coalesce("blocks", F.array().cast("array<string>")))
    return rows.select(key, status.alias("status"), "error", blocks.alias("blocks"), "n_retrievals", "n_citations")


def shown_sources(sources: Column, citations: Column) -> Column:
    """The sources to print below an answer: those cited, in their own order, or all if none is cited."""
    cited = F.transform(citations, lambda c: c["passage"])
    return F.when(F.size(cited) == 0, sources).otherwise(F.filter(sources, lambda s: F.array_contains(cited, s["id"])))
