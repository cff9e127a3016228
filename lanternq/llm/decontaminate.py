"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

*Seeds.* The word n-grams of each test item. How rare one is follows from the frequency of its words
in the whole corpus (the product of their shares), not from its own count: a leaked item makes its
own n-grams frequent, and those are the ones to find. Seeds above ``rare`` expected occurrences a
word are dropped, but each item keeps its ``least_seeds`` rarest. Where seed and text meet, the text
around the meeting point (as long as the item, plus slack for insertions on both sides) is a
passage; overlapping passages of one item merge.

*Alignment.* Each passage is aligned with the item word by word (Smith-Waterman, linear gaps). The
best local score, as a share of the item's score with itself, is the row's ``score``; rows at
``threshold`` or more are leaks. Changed, inserted and dropped words lower the score gradually.

The test set is taken in blocks whose built tables have a bounded size, known before they are sent to the tasks (an item
that is larger is a block with others of its hash); every block meets all documents. A document's text goes to Python once for the word counts and once for
the search; nothing but counts of the items' words and the leaks is shuffled.

Defined results: texts and items without words leak nothing; an item with fewer words than n is its
own single seed; repeated documents and repeated items give repeated rows; an empty table on either
side gives no rows; extra columns are ignored, or kept as they are by ``keep_clean``.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lanternq.llm.common import sent, text_or_empty, written

WORD = re.compile(r"\w+")
N = 3
#: Expected occurrences of a seed per word of text above which it is dropped.
RARE = 2e-7
LEAST_SEEDS = 8
SLACK = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.5
#: Bytes of one block's tables as they are built and sent: about so many for a word (its n-gram and where it occurs).
BUILT_BYTES = 280
BLOCK_BYTES = 64_000_000


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


@dataclass(frozen=True)
class Item:
    item_id: object
    words: tuple[str, ...]


def grams(words: list[str] | tuple[str, ...], n: int) -> Iterator[tuple[str, ...]]:
    return zip(*[words[k:] for k in range(n)])


def rare_seeds(items: list[Item], counts: dict[str, int], total: int, n: int = N, rare: float = RARE, least: int = LEAST_SEEDS) -> dict[tuple, list[tuple[int, int]]]:
    """Seed -> [(index of item, position in item)]."""
    seeds = defaultdict(list)
    for at, item in enumerate(items):
        if not item.words:
            continue
        size = min(n, len(item.words))
        own = [(math.prod(counts.get(w, 0) / max(total, 1) for w in g), k, g) for k, g in enumerate(grams(item.words, size))]
        own.sort()
        for rank, (share, k, g) in enumerate(own):
            if share <= rare or rank < least:
                seeds[g].append((at, k))
    return dict(seeds)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best Smith-Waterman score of two sequences of word numbers, and where in ``passage`` it ends."""
    ramp = GAP * np.arange(len(passage) + 1)
    above = np.zeros(len(passage) + 1, np.int64)
    best, end = 0, 0
    for word in item:
        row = np.maximum(above + GAP, 0)
        row[1:] = np.maximum(row[1:], above[:-1] + np.where(passage == word, MATCH, MISMATCH))
        above = np.maximum.accumulate(row - ramp) + ramp
        top = int(above.argmax())
        if above[top] > best:
            best, end = int(above[top]), top
    return best, end


def leaks_in(words: list[str], items: list[Item], seeds: dict, sizes: list[int], threshold: float = THRESHOLD) -> list[tuple[int, float, int, int]]:
    """(index of item, score, first word, end word of the passage) of each item that ``words`` leak."""
    met = defaultdict(set)
    for size in sizes:
        found = seeds.keys() & grams(words, size)
        if found:
            for p, g in enumerate(grams(words, size)):
                if g in found:
                    for at, k in seeds[g]:
                        met[at].add(p - k)
    out = []
    for at, diagonals in sorted(met.items()):
        own = items[at].words
        slack = math.ceil(SLACK * len(own))
        spans: list[list[int]] = []
        for d in sorted(diagonals):
            a, b = max(0, d - slack), min(len(words), d + len(own) + slack)
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(b, spans[-1][1])
            else:
                spans.append([a, b])
        number: dict[str, int] = {}
        item = np.array([number.setdefault(w, len(number)) for w in own])
        best = (0, 0, 0)
        for a, b in spans:
            score, end = align(item, np.array([number.get(w, -1) for w in words[a:b]]))
            if score > best[0]:
                best = (score, max(a, a + end - len(own) - slack), a + end)
        share = best[0] / (MATCH * len(own))
        if share >= threshold:
            out.append((at, share, best[1], best[2]))
    return out


def _word_counts(texts: DataFrame, wanted) -> tuple[dict[str, int], int]:
    """Occurrences of the wanted words in all texts, and of all words."""

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total, counts = wanted.value, 0, Counter()
        for batch in it:
            column = batch.column("text")
            for i in range(len(column)):
                w = words_of(column[i].as_py())
                total += len(w)
                for word, c in Counter(w).items():
                    if word in own:
                        counts[word] += c
        yield pa.RecordBatch.from_pydict({"word": ["", *counts], "n": [total, *counts.values()]}, schema=pa.schema([("word", pa.string()), ("n", pa.int64())]))

    rows = texts.select("text").mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n")).collect()
    found = dict(rows)  # no more rows than the block has words
    return found, found.pop("", 0) or 0


def leaks(docs: DataFrame, benchmark: DataFrame, n: int = N, rare: float = RARE, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each document and item that it leaks: doc_id, item_id, score (0 to 1), first_word and end_word."""
    spark = docs.sparkSession
    items = benchmark.select("item_id", text_or_empty().alias("text"))
    size = items.agg(F.sum(F.regexp_count("text", F.lit(r"(?U)\w+")) * BUILT_BYTES + F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    doc_type, item_type = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id {doc_type}, item_id {item_type}, score double, first_word long, end_word long"
    kinds = (to_arrow_type(benchmark.schema["item_id"].dataType), pa.float64(), pa.int64(), pa.int64())
    out = None
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        own = [Item(r["item_id"], tuple(words_of(r["text"]))) for r in rows]
        wanted = spark.sparkContext.broadcast({w for item in own for w in item.words})
        counts, total = _word_counts(texts, wanted) if own else ({}, 0)
        seeds = rare_seeds(own, counts, total, n, rare)
        sent = spark.sparkContext.broadcast((own, seeds, sorted({len(g) for g in seeds})))

        def searched(it: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items_, seeds_, sizes_ = sent.value
            for batch in it:
                column, ids = batch.column("text"), batch.column("doc_id")
                at, rest = [], []
                for i in range(len(column)):
                    for item, score, first, end in leaks_in(words_of(column[i].as_py()), items_, seeds_, sizes_, threshold):
                        at.append(i)
                        rest.append((items_[item].item_id, score, first, end))
                data = [ids.take(pa.array(at, pa.int64())), *[pa.array([r[k] for r in rest], kind) for k, kind in enumerate(kinds)]]
                yield pa.RecordBatch.from_arrays(data, ["doc_id", "item_id", "score", "first_word", "end_word"])

        found = texts.mapInArrow(searched, schema)
        out = found if out is None else out.unionByName(found)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that leak no item, with their columns as they were. Rows are told apart by
    doc_id and text, so a clean row stays where another row of its doc_id leaks."""
    keyed = docs.select(F.struct("doc_id", F.xxhash64("text").alias("th")).alias("key"), "text")
    found = leaks(keyed.select(F.to_json("key", {"ignoreNullFields": "false"}).alias("doc_id"), "text"), benchmark, **options)
    bad = written(found.select(F.from_json("doc_id", f"doc_id {dict(docs.dtypes)['doc_id']}, th long").alias("key")).distinct().select(F.col("key.doc_id").alias("bad_id_"), F.col("key.th").alias("bad_th_")), "leaks")
    return docs.join(sent(bad, bad.count()), docs["doc_id"].eqNullSafe(bad["bad_id_"]) & (F.xxhash64(docs["text"]) == bad["bad_th_"]), "left_anti")
