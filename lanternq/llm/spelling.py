"""Spelling variants: words that differ by one edit, found by forward and reversed sorted dictionaries.

*Words.* Maximal runs of letters (A-Z, a-z and U+00C0 to U+00FF) in lower case (A-Z only). One in ``TYPOS`` of the
pairs of document and run, chosen by a checksum, loses one letter. What has ``LEAST_LENGTH`` letters and ``LEAST_COUNT``
occurrences or more is a word. Runs are counted by Spark's own functions, so a word is one row after the map side.

*Blocks.* One edit leaves the first half of a word intact or the second half. So two near words share a prefix of half
the length, or else a suffix: they lie side by side in one range of the forward dictionary, or of the one that is
sorted from the back. A block is such a range: the words of ``m`` letters (and, for an inserted letter, of ``m`` + 1)
that share ``p`` first and ``s`` last letters. A block of more than ``BLOCK_ROWS`` words is subdivided: the edit
lies in the first or in the second half of what is not shared, so sharing as much of it makes two smaller blocks.
The last division leaves one free letter, which the alphabet bounds, so every block becomes small and no pair is lost.

*Scan.* Each partition is sorted by block, a task compares the rows of a block that are ``d`` places apart, for d = 1, 2, ...,
in numpy, and verifies each pair exactly. A pair may share both halves; it counts where its common prefix says, so no pair
is found twice and nothing has to be deduplicated. Near pairs are aggregated by word at once.

Defined results: null and empty texts have no words; very long texts and runs are read whole; a null doc_id counts as an empty
one; repeated rows count once each; ties between near words of equal count go to the smaller in code-point order; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternq.llm.common import sent, written

#: Fixed values of the contract.
TYPOS = 31
LEAST_LENGTH = 7
LEAST_COUNT = 2
FORM_TIMES = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a block above which it is subdivided. The alphabet has 26 + 64 letters, so no undivisible block is larger.
BLOCK_ROWS = 128
#: Cells of a matrix of letters that a task compares at a time.
CELLS = 4_000_000
_KEY = ("insert", "m", "p", "s", "q", "head", "tail")


def words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, typos: int = TYPOS) -> DataFrame:
    """(word, n) of all texts."""
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{least_length},}}"), F.lit(0))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(found).alias("r"))
    runs = runs.select("d", F.when(F.col("r").rlike("[A-Z]"), F.translate("r", UPPER, LOWER)).otherwise(F.col("r")).alias("r"))
    runs = runs.select("r", F.crc32(F.encode(F.concat("d", F.lit(":"), "r"), "UTF-8")).alias("h"))
    at = (F.col("h") % F.length("r")).cast("int")
    cut = F.concat(F.substring(F.col("r"), F.lit(1), at), F.substring(F.col("r"), at + 2, F.length("r")))
    kept = runs.select(F.when(F.col("h") % typos == 0, cut).otherwise(F.col("r")).alias("word")).where(F.length("word") >= least_length)
    return kept.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _blocks(rows: DataFrame) -> DataFrame:
    """``rows`` with their block (head, tail: what its words share)."""
    return rows.withColumns({"head": F.substring(F.col("word"), F.lit(1), F.col("p")), "tail": F.when(F.col("s") > 0, F.right("word", F.col("s"))).otherwise("")})


def _divided(rows: DataFrame) -> DataFrame:
    """The two halves of each block: ``head`` longer by half of what is free, or ``tail`` by the other half. In the second, pairs
    with a common prefix of ``q`` letters or more do not count, as the first has them."""
    free = F.col("m") - F.col("p") - F.col("s")
    more = F.greatest(F.floor(free / 2), F.lit(1)).cast("int")
    first = F.struct((F.col("p") + more).alias("p"), F.col("s").alias("s"), F.col("q").alias("q"))
    second = F.struct(F.col("p").alias("p"), (F.col("s") + F.greatest(free - more, F.lit(1))).alias("s"), F.least("q", F.col("p") + more).alias("q"))
    halves = rows.select("word", "n", "insert", "m", F.explode(F.array(first, second)).alias("half"))
    return _blocks(halves.select("word", "n", "insert", "m", "half.*"))


def dictionaries(vocabulary: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """Each word in its blocks of the forward dictionary (a shared prefix of half the letters) and of the reversed one."""
    length = F.length("word")
    kinds = [F.struct(F.lit(False).alias("insert"), length.alias("m")), F.struct(F.lit(True).alias("insert"), length.alias("m")), F.struct(F.lit(True).alias("insert"), (length - 1).alias("m"))]
    rows = vocabulary.select("word", "n", F.explode(F.array(*kinds)).alias("k")).where(F.col("k.m") >= least_length)
    whole = rows.select("word", "n", "k.*", F.lit(0).alias("p"), F.lit(0).alias("s"), F.lit(2**31 - 1).alias("q"))
    return _divided(whole)


def subdivided(rows: DataFrame, most: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` in blocks of at most ``most`` words each, or of one free letter. Only words of larger blocks go on to the
    next division."""
    done, key = None, list(_KEY)
    while True:
        rows = written(rows, "spelling-blocks")
        divisible = F.col("m") - F.col("p") - F.col("s") > F.when(F.col("insert"), 0).otherwise(1)
        large = written(rows.groupBy(*key).count().where((F.col("count") > most) & divisible).select(*key), "spelling-large")
        n = large.count()
        if not n:
            return rows if done is None else done.unionByName(rows)
        own = rows.join(sent(large, n), key, "left_anti")
        done = own if done is None else done.unionByName(own)
        rows = _divided(rows.join(sent(large, n), key, "left_semi"))


def _same(column: pa.ChunkedArray) -> np.ndarray:
    """Whether each row but the first equals the one before."""
    return pc.equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy()


def near_rows(word: np.ndarray, own: np.ndarray, insert: bool, m: int, q: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (i, j) of near words among rows sorted by block; ``first`` marks where a block begins."""
    size = np.fromiter(map(len, word), np.int64, len(word))
    wide = word.astype(f"<U{m + 1}").view(np.uint32).reshape(len(word), m + 1)
    back = np.array([w[::-1] for w in word], f"<U{m + 1}").view(np.uint32).reshape(len(word), m + 1)
    start = np.flatnonzero(first)
    end = np.repeat(np.append(start[1:], len(word)), np.diff(np.append(start, len(word))))
    a, b = [], []
    at, d = np.arange(len(word)), 1
    while True:
        at = at[at + d < end[at]]
        if not len(at):
            break
        i = at
        if insert:
            i = i[size[i] != size[i + d]]
        for k in range(0, len(i), max(1, CELLS // (m + 1))):
            x = i[k : k + max(1, CELLS // (m + 1))]
            y = x + d
            differ = wide[x, :m] != wide[y, :m]
            prefix = np.where(differ.any(1), differ.argmax(1), m)
            if insert:
                other = back[x, :m] != back[y, :m]
                near = prefix + np.where(other.any(1), other.argmax(1), m) >= m
            else:
                near = differ.sum(1) == 1
            near &= prefix < q[x]
            a.append(x[near])
            b.append(y[near])
        d += 1
    none = np.empty(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _scanned(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Near pairs, in both directions, of whole blocks in their order."""
    same = np.ones(len(rows) - 1, bool)
    for c in _KEY:
        same &= _same(rows.column(c))
    first = np.concatenate([[True], ~same])
    kind = np.concatenate([[True], ~(_same(rows.column("insert")) & _same(rows.column("m")))])
    word, n, q = rows.column("word").to_numpy(), rows.column("n").to_numpy(), rows.column("q").to_numpy()
    starts = np.flatnonzero(kind)
    for start, stop in zip(starts, np.append(starts[1:], len(rows))):
        m, insert = rows.column("m")[int(start)].as_py(), rows.column("insert")[int(start)].as_py()
        heads = start + np.flatnonzero(first[start:stop])
        step = max(1, CELLS // (m + 1))
        while len(heads):  # blocks of about so many cells at a time
            k = int(np.searchsorted(heads, heads[0] + step))
            to = heads[k] if k < len(heads) else stop
            own = slice(heads[0], to)
            i, j = near_rows(word[own], n[own], insert, m, q[own], first[own])
            i, j = i + heads[0], j + heads[0]
            if len(i):
                x, y = np.concatenate([i, j]), np.concatenate([j, i])
                yield pa.RecordBatch.from_arrays([pa.array(word[x], pa.string()), pa.array(word[y], pa.string()), pa.array(n[y])], ["word", "near", "near_n"])
            heads = heads[k:]


def near_pairs(blocks: DataFrame) -> DataFrame:
    """(word, near, near_n): every word with each of its near words, one row each."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]) if held is not None else rows
            same = np.ones(max(0, len(rows) - 1), bool)
            for c in _KEY:
                same &= _same(rows.column(c)) if len(rows) > 1 else True
            breaks = np.flatnonzero(~same)
            cut = int(breaks[-1]) + 1 if len(breaks) else 0  # the last block may go on in the next batch
            if cut:
                yield from _scanned(rows.slice(0, cut).combine_chunks())
            held = rows.slice(cut).combine_chunks()
        if held is not None and len(held):
            yield from _scanned(held)

    dealt = blocks.select("word", "n", *_KEY).repartition(*_KEY).sortWithinPartitions(*_KEY, "word")
    return dealt.mapInArrow(scan, "word string, near string, near_n long")


def rooted(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form (word, form): forms are followed to the last. Each is ten times as frequent, so chains
    are short, and they halve with each round. Only words that are a form and have one themselves are looked up."""
    rows = forms.select("word", F.col("form").alias("root"))
    while True:
        rows = written(rows, "spelling-roots")
        on = rows.select(F.col("root").alias("word")).distinct().join(rows, "word").select(F.col("word").alias("root"), F.col("root").alias("on_"))
        on = written(on, "spelling-on")
        n = on.count()
        if not n:
            return rows
        rows = rows.join(sent(on, n), "root", "left").select("word", F.coalesce("on_", "root").alias("root"))


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, typos: int = TYPOS, times: int = FORM_TIMES, most: int = BLOCK_ROWS) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of ``docs``."""
    vocabulary = written(words(docs.select("doc_id", "text"), least_length, least_count, typos), "spelling-words")
    pairs = near_pairs(subdivided(dictionaries(vocabulary, least_length), most))
    best: Column = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word")))
    near = pairs.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    rows = vocabulary.join(near, "word", "left")
    has = -F.col("best.n") >= times * F.col("n")
    rows = rows.select("word", F.when(has, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, -F.col("best.n")).alias("form_n"))
    rows = written(rows, "spelling-forms")
    roots = rooted(rows.where("form IS NOT NULL").select("word", "form"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
