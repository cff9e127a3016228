"""Blocks to chunks: section paths, pieces, and packing under a token budget with overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lanternq.functions.text import sentences, token_count

PIECES = "array<struct<s: string, t: int>>"
LEVELS = range(0, 10)


def section_paths(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """``blocks`` (key, pos, text, heading_level) with section: the open headings at each block, joined by `` > ``.
    A heading of one level closes all of that level and below, so level L counts if it was set after every
    heading of a lower number."""
    order = W.partitionBy(key).orderBy("pos")
    last = {lv: F.last(F.when(F.col("heading_level") == lv, F.struct("pos", "text")), ignorenulls=True).over(order) for lv in LEVELS}
    rows = blocks.withColumns({f"h{lv}_": c for lv, c in last.items()})
    shown = []
    for lv in LEVELS:
        above = [F.coalesce(F.col(f"h{k}_.pos"), F.lit(-1)) for k in range(lv)]
        open_ = F.col(f"h{lv}_.pos") > F.greatest(F.lit(-1), F.lit(-1), *above)
        shown.append(F.when(open_, F.col(f"h{lv}_.text")))
    return rows.withColumn("section", F.nullif(F.concat_ws(" > ", *shown), F.lit(""))).drop(*[f"h{lv}_" for lv in LEVELS])


def _piece(text: Column) -> Column:
    return F.struct(text.alias("s"), token_count(text).cast("int").alias("t"))


def pieces(text: Column, budget: int) -> Column:
    """A paragraph as one piece if it fits, else its sentences; a sentence that is still too long is cut every
    0.7 * budget words."""
    step = max(1, int(budget * 0.7))

    def cut(sentence: Column) -> Column:
        w = F.filter(F.split(sentence, r"\s+", -1), lambda x: x != "")
        at = F.when(F.size(w) > 0, F.sequence(F.lit(1), F.size(w), F.lit(step))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: _piece(F.array_join(F.slice(w, i, F.lit(step)), " ")))

    parts = F.flatten(F.transform(sentences(text), lambda s: F.when(token_count(s) <= budget, F.array(_piece(s))).otherwise(cut(s))))
    return F.when(token_count(text) <= budget, F.array(_piece(text))).otherwise(parts)


def _tokens(items: Column) -> Column:
    return F.aggregate(items, F.lit(0), lambda n, x: n + x["t"])


def _suffix(items: Column, most: Column) -> Column:
    """The longest end of ``items`` whose tokens add up to ``most`` or less."""
    kept = lambda own: F.aggregate(
        F.reverse(own),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("t"), F.lit(True).alias("go")),
        lambda a, x: F.when(a["go"] & (a["t"] + x["t"] <= most), F.struct((a["n"] + 1).alias("n"), (a["t"] + x["t"]).alias("t"), F.lit(True).alias("go"))).otherwise(
            F.struct(a["n"].alias("n"), a["t"].alias("t"), F.lit(False).alias("go"))
        ),
        lambda a: a["n"],
    )
    # Each argument is bound once; a lambda would evaluate what it is given again at every use.
    ending = lambda own, n: F.when(n > 0, F.slice(own, F.size(own) - n + 1, n)).otherwise(F.array().cast(PIECES))
    return F.transform(F.array(items), lambda own: F.transform(F.array(kept(own)), lambda n: ending(own, n))[0])[0]


def packed(items: Column, budget: int, overlap: int) -> Column:
    """Array of (text, tokens): pieces packed in order up to ``budget`` tokens. A chunk starts with the last
    sentences of the one before, up to ``overlap`` tokens and as far as they leave room."""
    empty = F.array().cast(PIECES)
    chunk = lambda cur, n: F.struct(F.regexp_replace(F.array_join(F.transform(cur, lambda x: x["s"]), " "), r"^\s+|\s+$", "").alias("text"), n.alias("tokens"))

    def add(state: Column, piece: Column) -> Column:
        cur, n = state["cur"], state["n"]  # the tokens of a chunk are carried along
        full = (F.size(cur) > 0) & (n + piece["t"] > budget)
        tail = _suffix(F.transform(sentences(F.element_at(cur, -1)["s"]), _piece), F.lit(overlap)) if overlap > 0 else empty
        rest = _suffix(tail, F.lit(budget) - piece["t"]) if overlap > 0 else empty
        begun = F.transform(F.array(rest), lambda own: F.struct(F.array_append(own, piece).cast(PIECES).alias("cur"), (_tokens(own) + piece["t"]).alias("n")))[0]
        return F.transform(
            F.array(F.when(full, begun).otherwise(F.struct(F.array_append(cur, piece).cast(PIECES).alias("cur"), (n + piece["t"]).alias("n")))),
            lambda x: F.struct(x["cur"].alias("cur"), x["n"].alias("n"), F.when(full, F.array_append(state["done"], chunk(cur, n))).otherwise(state["done"]).alias("done")),
        )[0]

    start = F.struct(empty.alias("cur"), F.lit(0).alias("n"), F.array().cast("array<struct<text: string, tokens: int>>").alias("done"))
    return F.aggregate(items, start, add, lambda s: F.when(F.size(s["cur"]) > 0, F.array_append(s["done"], chunk(s["cur"], s["n"]))).otherwise(s["done"]))


def exploded(rows: DataFrame, column: str, pos: str, name: str) -> DataFrame:
    """``rows`` with a row for each element of an array that is long to compute. (An inner ``posexplode`` would have the optimizer compute it
    again in a filter for rows that have elements.)"""
    return rows.select(*[c for c in rows.columns if c != column], F.posexplode_outer(column).alias(pos, name)).where(F.col(pos).isNotNull())


def chunked(blocks: DataFrame, budget: int, overlap: int, key: str = "doc_id") -> DataFrame:
    """(key, idx, section, text, tokens, page_start, page_end) from blocks (key, pos, text, heading_level, page).
    A heading starts a new run; chunks never span two runs, and headings are no text of a chunk."""
    rows = section_paths(blocks, key)
    run = F.sum(F.col("heading_level").isNotNull().cast("int")).over(W.partitionBy(key).orderBy("pos"))
    rows = rows.withColumn("run", run).where("heading_level IS NULL").withColumn("p", pieces(F.col("text"), budget))
    runs = rows.groupBy(key, "run").agg(F.first("section").alias("section"), F.sort_array(F.collect_list(F.struct("pos", "p"))).alias("l"), F.min("page").alias("page_start"), F.max("page").alias("page_end"))
    runs = runs.withColumn("c", packed(F.flatten(F.transform("l", lambda x: x["p"])), budget, overlap))
    out = exploded(runs.select(key, "run", "section", "page_start", "page_end", "c"), "c", "n", "chunk")
    idx = F.row_number().over(W.partitionBy(key).orderBy("run", "n")) - 1
    return out.select(key, idx.alias("idx"), "section", "chunk.text", "chunk.tokens", "page_start", "page_end")
