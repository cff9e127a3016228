"""SimHash near-duplicates by tiled exact comparison.

*Fingerprints.* Texts are lower-cased (A-Z only) and cut into words at ASCII white space; each 4-word
shingle, repeats included, is hashed with XXH64 (seed 42), and a bit of the fingerprint is set where
over half of the hashes have it. Arrow batches of texts go to Python once and 8 bytes per text come
back. Bits are counted for a whole batch at a time: eight masked shifts of the hash array keep eight
byte counters per machine word, summed over runs of up to 255 hashes.

*Links.* Equal fingerprints are collapsed first, so groups of copies cost one row. Distinct
fingerprints are dealt into tiles by their number of set bits: neighbouring bit counts share a tile up
to ``tile_rows``, and one bit count that has more is cut by a hash. Two tiles meet in one task unless
their bit counts differ by more than the radius; that bounds a task's rows by two tiles. A task cuts
its tiles again into runs of fingerprints sorted by the bit counts of their four 16-bit quarters and
skips pairs of runs whose counts differ by more than the radius in sum, which no pair within the radius
can do. What remains is compared exactly: exclusive-or and bit count over numpy blocks. A task returns
no pairs but a spanning forest of the links it has found, at most one row for each fingerprint, so
dense groups of near copies stay small. Components of all forests follow by alternating stars.

The comparison is exact, so its work grows with the square of the number of distinct fingerprints, and
the rows dealt to tiles with that square divided by ``tile_rows``; the README gives figures.

*Near duplicates by similarity.* ``keep_one`` takes fingerprints of two words (128 bits) over the set of
5-word shingles and a radius wide enough for a Jaccard similarity of 0.8, and ``confirm`` then keeps the
links whose sets have that similarity.

Defined results: null, empty and blank texts have fingerprint zero and are linked to one another
like any other (in ``keep_one`` to one another only); a document that is linked to none is its own
component; repeated rows give repeated results; a null doc_id never names a component unless all its
documents have none; an empty table gives no rows; extra columns are ignored, or kept as they are by
``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternq.llm import confirm
from lanternq.llm.common import sent, text_or_empty, written
from lanternq.llm.graph import components
from lanternq.llm.shingles import SHINGLE, fingerprint_array, fingerprint_words, set_digest, word_array

RADIUS = 4
#: Fingerprints in a tile, and in the runs that a task sorts a tile into.
TILE_ROWS = 32_768
RUN_ROWS = 32
#: Small inputs are cut into so many tiles, so that all cores have tiles to compare.
LEAST_TILES = 16
#: Fingerprints that one run is compared with at a time; the block stays in a core's cache.
BLOCK = 4096
#: Near duplicates by similarity: bits of 128 in which texts of that similarity differ at most, bits of the
#: first word alone, words in a shingle, and the similarity itself.
WIDE_RADIUS = 32
FIRST_RADIUS = 18
WIDE_SHINGLE = 5
PERCENT = 80


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (as a signed long) of every row."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = batch.column("text")
            fp = fingerprint_array((texts[i].as_py() for i in range(len(texts))), shingle)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    rows = docs.select("doc_id", text_or_empty().alias("text"))
    return rows.mapInArrow(batches, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


def _merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of a[i] and b[i]; ``root`` names the least index of each class."""
    while len(a):
        a, b = root[a], root[b]
        differ = a != b
        if not differ.any():
            return
        a, b = a[differ], b[differ]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root[:] = up


def forest(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS, first: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, parent), as indexes into the rows of ``left`` and then ``right``, that connect what exact
    comparison of two tiles (or of one with itself) connects: one for each node that is not the first of its
    class. A row is a fingerprint of one or more 64-bit words; the first words may differ in ``first`` bits."""
    first = radius if first is None else first
    quarters = lambda x: np.bitwise_count(x.view(np.uint16).reshape(-1, 4)).astype(np.int16)

    def arranged(x: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        q = quarters(np.ascontiguousarray(x[:, 0]))
        order = np.lexsort(q.T[::-1])
        q, cut = q[order], np.arange(0, len(x), RUN_ROWS)
        return x[order], order + shift, np.minimum.reduceat(q, cut), np.maximum.reduceat(q, cut)

    x, names, low, high = arranged(left, 0)
    y, other, ylow, yhigh = (x, names, low, high) if right is None else arranged(right, len(left))
    root = np.arange(len(left) + (0 if right is None else len(right)))
    xs, ys = np.ascontiguousarray(x[:, 0]), np.ascontiguousarray(y[:, 0])
    member = np.arange(len(y)) // RUN_ROWS
    for k in range(len(low)):
        gap = np.maximum(0, np.maximum(ylow - high[k], low[k] - yhigh)).sum(1)
        near = gap <= first
        if right is None:
            near[:k] = False
        met = np.flatnonzero(near[member])
        start = k * RUN_ROWS
        run = xs[start : start + RUN_ROWS, None]
        for c in range(0, len(met), BLOCK):
            at = met[c : c + BLOCK]
            i, j = np.nonzero(np.bitwise_count(run ^ ys[at]) <= first)
            i, j = i + start, at[j]
            if x.shape[1] > 1 and len(i):
                close = np.bitwise_count(x[i] ^ y[j]).sum(1, dtype=np.int64) <= radius
                i, j = i[close], j[close]
            _merge(root, names[i], other[j])
    own = np.flatnonzero(root != np.arange(len(root)))
    return own, root[own]


def _bins(sizes: dict[int, int], tile_rows: int) -> list[tuple[int, int, int]]:
    """(least, greatest bit count, tiles) of runs of bit counts that hold about ``tile_rows`` nodes or one bit count."""
    bins, held = [], []
    for n in sorted(sizes):
        if held and sum(sizes[m] for m in held) + sizes[n] > tile_rows:
            bins.append(held)
            held = []
        held.append(n)
    bins += [held] if held else []
    return [(b[0], b[-1], -(-sum(sizes[m] for m in b) // tile_rows)) for b in bins]


def links(nodes: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS, first: int | None = None) -> DataFrame:
    """Rows (a, b) that connect the ``nodes`` (id, words: an array of longs) whose words differ in ``radius`` bits
    or fewer, and the first words in ``first`` or fewer. A tile is packed into one row before it is sent to the
    tiles that it meets."""
    count = F.aggregate("words", F.lit(0), lambda s, x: s + F.bit_count(x).cast("int"))
    counted = nodes.select("id", "words", count.alias("count"))
    sizes = dict(counted.groupBy("count").count().collect())  # 65 rows a word at most
    bins = _bins(sizes, max(1, min(tile_rows, sum(sizes.values()) // LEAST_TILES)))
    pairs = [(k, m) for k in range(len(bins)) for m in range(k, len(bins)) if bins[m][0] - bins[k][1] <= radius]
    kind = dict(nodes.dtypes)["id"]
    if not pairs:
        return nodes.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    # A tile meets, as the left side, those of its own bin and of the bins above, and as the right side those below.
    meets = [(own, k, m, bins[o][2]) for k, m in pairs for own, o in dict.fromkeys(((k, m), (m, k)))]
    plan = nodes.sparkSession.createDataFrame(meets, "bin int, n int, m int, other_tiles int")  # some thousand rows at most
    own_bin = F.coalesce(*[F.when(F.col("count") <= high, F.lit(k)) for k, (_, high, _) in enumerate(bins)])
    own_tiles = F.element_at(F.array(*[F.lit(tiles) for _, _, tiles in bins]), F.col("bin") + 1)
    dealt = counted.withColumn("bin", own_bin).withColumn("own", F.pmod(F.xxhash64("id"), own_tiles.cast("long")).cast("int"))
    tiles = dealt.groupBy("bin", "own").agg(F.collect_list(F.struct("id", "words")).alias("tile"))
    rows = written(tiles, "simhash-tiles").join(F.broadcast(plan), "bin")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("other_tiles") - 1)))
    is_left, within = F.col("bin") == F.col("n"), F.col("n") == F.col("m")
    rows = rows.select(
        "tile",
        "n",
        "m",
        F.when(within, F.least("own", "other")).when(is_left, F.col("own")).otherwise(F.col("other")).alias("i"),
        F.when(within, F.greatest("own", "other")).when(is_left, F.col("other")).otherwise(F.col("own")).alias("j"),
        F.when(within, F.col("own") != F.least("own", "other")).otherwise(~is_left).alias("right"),
    )

    def compared(key, table):
        sides = {}
        for k in range(len(table)):
            tile = table.column("tile")[k].values
            sides[table.column("right")[k].as_py()] = (tile.field("id"), word_array(tile.field("words")))
        names = pa.concat_arrays([sides[k][0] for k in sorted(sides)])
        if key[0].as_py() == key[1].as_py() and key[2].as_py() == key[3].as_py():
            a, b = forest(sides[False][1], None, radius, first)
        elif len(sides) < 2:
            a = b = np.empty(0, np.int64)
        else:
            a, b = forest(sides[False][1], sides[True][1], radius, first)
        return pa.table({"a": names.take(pa.array(a)), "b": names.take(pa.array(b))})

    return rows.groupBy("n", "m", "i", "j").applyInArrow(compared, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, tile_rows: int = TILE_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id of the component) of every row."""
    rows = written(fingerprints(docs, shingle), "simhash")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    nodes = distinct.select(F.col("fp").alias("id"), F.array("fp").alias("words"))
    roots = components(links(nodes, radius, tile_rows), "simhash-links").withColumnRenamed("node", "fp")
    classes = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    out = rows.join(classes.join(names, "root").select("fp", "component_id"), "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, th_ (a hash that tells rows of one doc_id apart), id (a digest of the set of shingles), n (its
    size) and words (its fingerprint) of every row."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts, ids, sizes, words = batch.column("text"), [], [], []
            for own, fp in fingerprint_words(texts[i].as_py() for i in range(len(texts))):
                ids.append(set_digest(own))
                sizes.append(len(own))
                words.append(fp)
            columns = [pa.array(ids, pa.binary()), pa.array(sizes, pa.int32()), pa.array(words, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th_"), *columns], ["doc_id", "th_", "id", "n", "words"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("th_"), text_or_empty().alias("text"))
    return rows.mapInArrow(batches, f"doc_id {dict(docs.dtypes)['doc_id']}, th_ long, id binary, n int, words array<long>")


def similar(docs: DataFrame, percent: int = PERCENT, radius: int = WIDE_RADIUS, first: int = FIRST_RADIUS, tile_rows: int = TILE_ROWS) -> tuple[DataFrame, DataFrame]:
    """doc_id, th_ and id of every row of ``docs``, and id, least (the row of id that stays) and root of every
    distinct set: sets have one root if links of Jaccard similarity ``percent`` or more connect them."""
    rows = written(_sets(docs, WIDE_SHINGLE), "near")
    row = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "th_")  # rows without doc_id come last
    distinct = rows.groupBy("id").agg(F.min(row).alias("least"), F.first("n").alias("n"), F.first("words").alias("words"))
    distinct = written(distinct, "near-distinct")
    near = components(links(distinct.where("n > 0"), radius, tile_rows, first), "near-links")
    links_ = confirm.confirmed(docs, distinct, near, percent, radius, first)
    roots = components(links_, "near-links").withColumnRenamed("node", "id")
    return rows, distinct.select("id", "least").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One row of each group of near duplicates of ``docs``, with its columns as they were: that of the smallest
    doc_id. Only keys of rows that go meet the documents, so texts are moved only if these keys are many."""
    rows, classes = similar(docs, **options)
    chosen = classes.groupBy("root").agg(F.min("least").alias("row")).select(F.col("row.doc_id").alias("own_id"), F.col("row.th_").alias("own_th"))
    key = lambda a, b: a["doc_id"].eqNullSafe(b["own_id"]) & (a["th_"] == b["own_th"])
    counted = written(rows.groupBy("doc_id", "th_").agg(F.count("*").alias("times")), "near-rows")
    chosen = counted.join(chosen, key(counted, chosen), "left").withColumn("stays", F.col("own_th").isNotNull())
    keys = written(chosen.where("times > 1 OR NOT stays").select(F.col("doc_id").alias("own_id"), F.col("th_").alias("own_th"), "stays"), "near-keys")
    sizes = {r["stays"]: r["count"] for r in keys.groupBy("stays").count().collect()}
    out, th = docs, F.xxhash64(docs["text"])
    if sizes:
        n = sum(sizes.values())
        out = docs.join(sent(keys, n), docs["doc_id"].eqNullSafe(keys["own_id"]) & (th == keys["own_th"]), "left_anti")
    if True in sizes:  # rows that repeat both doc_id and text: one of them stays
        again = keys.where("stays")
        same = docs.join(sent(again, sizes[True]), docs["doc_id"].eqNullSafe(again["own_id"]) & (th == again["own_th"]), "left_semi")
        whole = same.select(F.struct(*[same[c] for c in docs.columns]).alias("row_"), same["doc_id"].alias("k_"), F.xxhash64(same["text"]).alias("h_"))
        # Which of them is the least in all columns, as text: the same in every run.
        out = out.unionByName(whole.groupBy("k_", "h_").agg(F.min_by("row_", F.to_json("row_")).alias("row_")).select("row_.*"))
    return out
