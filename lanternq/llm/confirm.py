"""Confirmation of near-duplicate candidates by the exact Jaccard similarity of their shingle sets.

Only sets that have a candidate are fetched. They are dealt out by candidate component, never as pairs:
small components share a task up to about ``open_rows`` sets, larger ones are cut into parts of that
size. A task compares the candidates among its sets and returns a spanning forest of the confirmed
links, at most one row a set; a candidate whose ends are connected already is not compared, so a
group of near copies costs about one comparison a set.

A cut component is first compared within its parts, the component's least set being in all of them. Only
if that leaves it in several pieces do its parts meet in pairs. No pair of candidates is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternq.llm.common import sent, text_or_empty, written
from lanternq.llm.graph import components
from lanternq.llm.shingles import shingle_set, word_array

#: Sets and shingles that a part has at most (a set that has more is a part of its own).
OPEN_ROWS = 1024
OPEN_SHINGLES = 2_000_000


def similar_to(own: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of ``others`` have Jaccard similarity ``percent`` or more with ``own``; all are sorted and distinct."""
    sizes = np.array([len(o) for o in others], np.int64)
    fits = 100 * np.minimum(sizes, len(own)) >= percent * np.maximum(sizes, len(own))
    at, done = np.flatnonzero(fits), 0
    while done < len(at):
        more = max(1, int(np.searchsorted(np.cumsum(sizes[at[done:]]), OPEN_SHINGLES)))
        part = at[done : done + more]
        flat = np.concatenate([others[k] for k in part])
        hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
        common = np.add.reduceat(hit.astype(np.int64), np.concatenate([[0], np.cumsum(sizes[part])[:-1]]))
        fits[part] = 100 * common >= percent * (sizes[part] + len(own) - common)
        done += more
    return fits


def confirmed_forest(words: np.ndarray, sets: list[np.ndarray], piece: np.ndarray, side: np.ndarray | None, percent: int, radius: int, first: int) -> list[tuple[int, int]]:
    """Links that connect what confirmed candidates connect. Sets of one ``piece`` are
    connected already; if ``side`` is given, only sets of different sides are compared."""
    _, at, own = np.unique(piece, return_index=True, return_inverse=True)
    root, links = at[own], []
    for i in range(len(sets)):
        at = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
        if side is not None:
            at = at[side[at] != side[i]]
        bits = np.bitwise_count(words[at] ^ words[i])
        at = at[(bits[:, 0] <= first) & (bits.sum(1, dtype=np.int64) <= radius)]
        for k in at[similar_to(sets[i], [sets[k] for k in at], percent)] if len(at) else ():
            if root[k] != root[i]:
                links.append((i, int(k)))
                root[root == root[k]] = root[i]
    return links


def _open_sets(docs: DataFrame, open_: DataFrame, shingle: int) -> DataFrame:
    """``open_`` (id, g, n, words, least) with s, the set of shingles; each set is read from one of its rows."""
    keys = open_.select("id", F.col("least.doc_id").alias("own_id"), F.col("least.th_").alias("own_th"))
    rows = keys.count()
    texts = docs.select(F.col("doc_id").alias("of_id"), F.col("text").alias("of_text"))
    texts = texts.join(sent(keys, rows), F.col("of_id").eqNullSafe(F.col("own_id")) & (F.xxhash64("of_text") == F.col("own_th")))

    def listed(it):
        for batch in it:
            sets = [shingle_set(x.as_py(), shingle).view(np.int64) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.list_(pa.int64()))], ["id", "s"])

    found = texts.select("id", text_or_empty("of_text").alias("text")).mapInArrow(listed, "id binary, s array<long>")
    found = written(found, "near-sets")
    if found.count() > rows:  # rows that repeat both doc_id and text
        found = found.groupBy("id").agg(F.first("s").alias("s"))
    return found.join(open_.select("id", "g", "n", "words"), "id")


def confirmed(docs: DataFrame, distinct: DataFrame, near: DataFrame, percent: int, radius: int, first: int, shingle: int = 5, open_rows: int = OPEN_ROWS) -> DataFrame:
    """Rows (a, b) that connect the sets which candidates of similarity ``percent`` or more connect.
    ``distinct``: id, n, words and least; ``near``: (node, root) of the candidate components."""
    groups = near.select(F.col("node").alias("id"), F.col("root").alias("g")).unionByName(near.select(F.col("root").alias("id"), F.col("root").alias("g")).distinct())
    open_ = written(distinct.join(groups, "id"), "near-open")
    parts = F.greatest(F.ceil(F.count("*") / open_rows), F.ceil(F.sum("n") / OPEN_SHINGLES)).cast("int")
    sizes = written(open_.groupBy("g").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"), parts.alias("parts")), "near-sizes")
    small = sizes.where("parts = 1").agg(F.sum("rows"), F.sum("shingles")).first()
    packs = max(1, -(-(small[0] or 0) // open_rows), -(-(small[1] or 0) // OPEN_SHINGLES))
    sets = _open_sets(docs, open_, shingle).join(sizes.select("g", "parts"), "g")
    single = F.col("parts") == 1
    own = F.when(single, F.pmod(F.xxhash64("g"), F.lit(packs))).otherwise(F.pmod(F.xxhash64("id"), F.col("parts").cast("long"))).cast("int")
    sets = written(sets.select("id", "g", "words", "s", "parts", F.when(~single, F.col("g")).alias("whole"), own.alias("own")), "near-dealt")
    task = _task(percent, radius, first)
    everywhere = F.when((F.col("id") == F.col("g")) & (F.col("parts") > 1), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("own"))
    once = sets.withColumn("i", F.explode(everywhere)).withColumn("j", F.col("i")).withColumn("piece", F.col("id")).withColumn("side", F.lit(0))
    found = written(once.select("whole", "i", "j", "id", "g", "words", "s", "piece", "side").groupBy("whole", "i", "j").applyInArrow(task, "a binary, b binary"), "near-confirmed")
    cut = sizes.where("parts > 1").select("g")
    if not cut.limit(1).count():
        return found
    roots = written(components(found, "near-pieces"), "near-pieces")
    pieces = open_.select("id", "g").join(F.broadcast(cut) if cut.count() <= 10_000 else cut, "g").join(roots, F.col("id") == F.col("node"), "left").withColumn("piece", F.coalesce("root", "id"))
    unsettled = pieces.groupBy("g").agg(F.min("piece").alias("low"), F.max("piece").alias("high")).where("low <> high").select("g")
    rest = sets.join(unsettled, "g").join(pieces.select("id", "piece"), "id").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("o <> own")
    rest = rest.withColumns({"i": F.least("own", "o"), "j": F.greatest("own", "o"), "side": F.col("own")})
    more = rest.select("whole", "i", "j", "id", "g", "words", "s", "piece", "side").groupBy("whole", "i", "j").applyInArrow(task, "a binary, b binary")
    return found.unionByName(written(more, "near-confirmed"))


def _task(percent: int, radius: int, first: int):
    def compared(key, table):
        table = table.combine_chunks()
        if key[0].as_py() is None:  # small components, compared one by one
            table = table.sort_by("g")
        number = lambda name: np.unique(table.column(name).to_numpy(zero_copy_only=False).astype("S16"), return_inverse=True)[1]
        words = word_array(table.column("words"))
        s = table.column("s").combine_chunks()
        flat, ends = s.flatten().to_numpy().view(np.uint64), np.cumsum([0, *s.value_lengths().to_pylist()])
        sets = [flat[a:b] for a, b in zip(ends, ends[1:])]
        group, piece = number("g"), number("piece")
        side = table.column("side").to_numpy() if key[1].as_py() != key[2].as_py() else None
        links = []
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sets)]
        for a, b in zip(cuts, cuts[1:]):
            own = slice(a, b)
            got = confirmed_forest(words[own], sets[own], piece[own], None if side is None else side[own], percent, radius, first)
            links += [(a + i, a + k) for i, k in got]
        ids = table.column("id")
        take = lambda n: ids.take(pa.array([x[n] for x in links], pa.int64()))
        return pa.table({"a": take(0), "b": take(1)})

    return compared
