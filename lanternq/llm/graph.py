"""Connected components of a link table, by alternating stars over tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternq.llm.common import sent, written


def _stars(edges: DataFrame, rows: int) -> DataFrame:
    """One large-star and one small-star step over ``rows`` edges (u, v) with u > v. The centre of a large star may
    have a great many edges: what its edges need to know, its least neighbour, is sent to them where that is
    bounded, and centres that are their own least node need nothing."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    large = edges.join(sent(least.withColumnRenamed("u", "v"), rows), "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(sent(low, rows), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
    return small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """``links`` has two columns of one orderable type. Returns (node, root) for every linked node that
    is not itself the least node of its component, root being that least node.

    Each step is written to the shared folder and reread, so lineage stays short and a lost executor
    costs one step. Steps are few (logarithmic in the longest chain). Null ends and links of a node
    to itself are no links."""
    a, b = links.columns
    edges = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), name)
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = mark(edges)
    while before[0]:
        edges = written(_stars(edges, before[0]), name)
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
