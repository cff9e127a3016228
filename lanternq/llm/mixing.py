"""Mixing sources to target weights by fitting a token budget exactly.

*Targets.* Sources in code point order (null last) weigh 1, 2, 3, repeating, and share the size of the
whole corpus; none gets more than ``max_epochs`` times its own size, and what is above is shared among
the others by weight.

*Budget.* A source's documents are counted by exact length. Whole passes over a source are taken
first; what is left of its target is less than its size. Every length gives the same share of its
documents (rounded down), long lengths then fill up, and a bounded-knapsack dynamic programme (a bit
set of reachable sums, lengths split into powers of two) fits the last ``dp_budget`` words from the
documents that are left, as closely as any choice of them can. The result is a number of documents
for every length, so the work depends on the lengths that occur and not on the documents.

*Choice.* Within a source and length the documents are taken in the order of a seeded hash of
doc_id (of the text where there is none). Ranks come from counts of 256 hash ranges, so that a length which a third of all documents
share is ranked in 256 tasks and not in one.

Defined results: null and blank texts have size 0, take nothing and belong to their source; null
sources are one source; sources of other types count by their text; very long texts count by their
size; repeated rows are documents of their own; an empty table gives no rows; extra columns are ignored, or kept as they are by ``mixed_rows``.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lanternq.llm.common import words, written

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = 7
#: Words that the dynamic programme fits in each source.
DP_BUDGET = 50_000
RANGES = 256
#: Sources and sizes up to which their table is sent to every task.
PLAN_ROWS = 300_000


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, most: int = MAX_EPOCHS) -> list[float]:
    """The target of each source, given in order: shares of the sum by weight, none above ``most`` times its size."""
    total, weight = sum(sizes), [weights[k % len(weights)] for k in range(len(sizes))]
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while free:
        unit = left / sum(weight[k] for k in free)
        full = {k for k in free if unit * weight[k] > most * sizes[k]}
        if not full:
            for k in free:
                out[k] = unit * weight[k]
            break
        for k in full:
            out[k] = float(most * sizes[k])
        left -= sum(out[k] for k in full)
        free -= full
    return out


def fit(lengths: list[int], counts: list[int], budget: int, dp_budget: int = DP_BUDGET) -> list[int]:
    """How many documents of each length to take so that their lengths add up to ``budget`` as nearly as
    can be. ``budget`` must be at most the sum of all lengths."""
    total = sum(n * c for n, c in zip(lengths, counts))
    if total <= budget:
        return list(counts)
    share = max(0.0, (budget - dp_budget / 2) / total) if total else 0.0
    take = [min(c, int(c * share)) if n else 0 for n, c in zip(lengths, counts)]
    rest = budget - sum(n * t for n, t in zip(lengths, take))
    order = sorted((k for k in range(len(lengths)) if lengths[k]), key=lambda k: -lengths[k])
    for k in order:  # long lengths first, down to what the programme fits
        if rest <= dp_budget:
            break
        more = min(counts[k] - take[k], (rest - dp_budget) // lengths[k] + 1, rest // lengths[k])
        if more > 0:
            take[k] += more
            rest -= more * lengths[k]
    # Reachable sums as bits; a part is 2**i documents of one length. A sum above twice ``rest`` is never
    # nearer to it than taking nothing, so very long documents do not widen the bit set.
    most = min(rest + max(lengths), 2 * rest)
    mask = (1 << (most + 1)) - 1
    reach, trail = 1, []
    for k in sorted(order, key=lambda k: lengths[k]):
        left, part = counts[k] - take[k], 1
        left = min(left, most // lengths[k])
        while left > 0:
            part = min(part, left)
            grown = (reach | (reach << (part * lengths[k]))) & mask
            if grown != reach:
                trail.append((k, part, reach))
                reach = grown
            left -= part
            part *= 2
        if (reach >> rest) & 1:
            break
    below = (reach & ((1 << (rest + 1)) - 1)).bit_length() - 1
    above = reach >> (rest + 1)
    at = below
    if above:
        over = (above & -above).bit_length() + rest
        at = over if over - rest < rest - below else below
    for k, part, before in reversed(trail):
        if not (before >> at) & 1:
            take[k] += part
            at -= part * lengths[k]
    return take


def _measured(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, source, size, th_ and o_ (the seeded order) of every row."""
    order = _order(seed, F.col("doc_id"), F.col("text"))
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.size(words(F.col("text"))).cast("long").alias("size"), F.xxhash64("text").alias("th_"), order.alias("o_"))


def _order(seed: int, doc_id: Column, text: Column) -> Column:
    """The seeded order of documents; those without doc_id go by their texts."""
    return F.when(doc_id.isNull(), F.xxhash64(F.lit(seed), text)).otherwise(F.xxhash64(F.lit(seed), doc_id))


def _range(order: Column) -> Column:
    """The hash range that comes first in the order of documents."""
    return F.pmod(order, F.lit(RANGES)).cast("int")


def _ranked(docs: DataFrame, weights: tuple[int, ...], most: int, seed: int, dp_budget: int) -> tuple[DataFrame, DataFrame]:
    """Every row of ``docs`` with its rank among those of its source and size, and the quota of each source
    and size (epochs for all, one more for the first ``more``)."""
    spark = docs.sparkSession
    rows = written(_measured(docs, seed), "mixing")
    counts = rows.groupBy("source", "size").count()
    per_source = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("count")).alias("s")).collect()  # one row a source
    ranked = sorted(per_source, key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be")))
    want = targets([r["s"] for r in ranked], weights, most)
    plan = spark.createDataFrame(
        [(r["source"], r["s"], t, min(most, int(t // r["s"])) if r["s"] else 0) for r, t in zip(ranked, want)],
        "source string, source_size long, target double, epochs int",
    )
    same = F.col("c.source").eqNullSafe(F.col("p.source"))
    table = counts.alias("c").join(plan.alias("p"), same).select("c.*", "source_size", "target", "epochs")

    def fitted(group):
        group = group.sort_by("size")
        row = group.slice(0, 1).to_pylist()[0]
        budget = round(row["target"]) - row["epochs"] * row["source_size"]
        n, c = group.column("size").to_pylist(), group.column("count").to_pylist()
        more = fit(n, c, min(budget, row["source_size"]), dp_budget) if budget > 0 else [0] * len(n)
        return group.drop_columns(["count"]).append_column("more", pa.array(more, pa.int64()))

    quota = table.groupBy("source").applyInArrow(fitted, "source string, size long, source_size long, target double, epochs int, more long")
    quota = written(quota, "mixing-quota")
    rows = rows.withColumn("b_", _range(F.col("o_")))
    ranges = rows.groupBy("source", "size", "b_").count()
    ahead = F.coalesce(F.sum("count").over(W.partitionBy("source", "size").orderBy("b_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.withColumn("ahead", ahead)
    key = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source")) & (F.col(f"{a}.size") == F.col(f"{b}.size"))
    ranges = ranges.alias("r").join(quota.alias("q"), key("r", "q")).select("r.source", "r.size", "b_", "ahead", "source_size", "target", "epochs", "more")
    out = rows.alias("d").join(ranges.alias("g"), key("d", "g") & (F.col("d.b_") == F.col("g.b_")))
    within = F.row_number().over(W.partitionBy("d.source", "d.size", "d.b_").orderBy("o_", "doc_id", "th_"))
    out = out.withColumn("rank", F.col("ahead") + within)
    return out.select("doc_id", "th_", "o_", "d.b_", "d.source", "d.size", "source_size", "target", "epochs", "more", "rank"), quota


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_EPOCHS, seed: int = SEED, dp_budget: int = DP_BUDGET) -> DataFrame:
    """doc_id, source, size, source_size, target, times and taken of every row of ``docs``."""
    rows, _ = _ranked(docs, weights, most, seed, dp_budget)
    rows = rows.withColumn("times", F.col("epochs") + (F.col("rank") <= F.col("more")).cast("int"))
    return rows.select("doc_id", "source", "size", "source_size", "target", "times", (F.col("size") * F.col("times")).alias("taken"))


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row."""
    return mixture(docs, **options).select("doc_id", "size", "source_size", "target", "taken")


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_EPOCHS, seed: int = SEED, dp_budget: int = DP_BUDGET) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their columns as they were.

    Texts are not shuffled: each source and size has one last row that is taken once more, and a document
    compares itself with that row. The table of these rows is sent to all tasks if it is small, which
    follows the number of lengths and not of documents. Only rows that repeat the last row itself
    are counted out one by one."""
    rows, quota = _ranked(docs, weights, most, seed, dp_budget)
    at = ["source", "size", "b_", "o_", "doc_id", "th_"]
    ties = rows.groupBy(*at).agg(F.bool_or(F.col("rank") == F.col("more")).alias("last"), F.count("*").alias("rows_"), F.count_if(F.col("rank") <= F.col("more")).alias("taken_"))
    last = ties.where("last").select("source", "size", F.struct("b_", "o_", "doc_id", "th_").alias("last_"), "rows_", "taken_")
    same = F.col("q.source").eqNullSafe(F.col("l.source")) & (F.col("q.size") == F.col("l.size"))
    plan = quota.alias("q").join(last.alias("l"), same, "left").select(F.col("q.source").alias("source_"), F.col("q.size").alias("size_"), "epochs", "last_", "rows_", "taken_")
    plan = written(plan.where("size_ > 0 AND (epochs > 0 OR last_ IS NOT NULL)"), "mixing-plan")
    if plan.limit(PLAN_ROWS + 1).count() <= PLAN_ROWS:
        plan = F.broadcast(plan)
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row_"))
    order = _order(seed, F.col("row_.doc_id"), F.col("row_.text"))
    own = own.withColumns({"n_": F.size(words(F.col("row_.text"))).cast("long"), "own_": F.struct(_range(order).alias("b_"), order.alias("o_"), F.col("row_.doc_id").alias("doc_id"), F.xxhash64("row_.text").alias("th_"))})
    joined = own.join(plan, F.col("row_.source").cast("string").eqNullSafe(F.col("source_")) & (F.col("n_") == F.col("size_")))
    first = F.coalesce(F.col("own_") <= F.col("last_"), F.lit(False))
    shared = F.coalesce((F.col("own_") == F.col("last_")) & (F.col("taken_") < F.col("rows_")), F.lit(False))
    joined = joined.withColumns({"times_": F.col("epochs") + first.cast("int"), "shared_": shared})
    if plan.where("taken_ < rows_").limit(1).count():
        tied = joined.where("shared_").withColumn("k_", F.row_number().over(W.partitionBy("own_").orderBy(F.to_json("row_"))))
        tied = tied.withColumn("times_", F.col("epochs") + (F.col("k_") <= F.col("taken_")).cast("int")).drop("k_")
        joined = joined.where("NOT shared_").unionByName(tied)
    return joined.where("times_ > 0").withColumn("copy_", F.explode(F.sequence(F.lit(1), F.col("times_")))).select("row_.*")
