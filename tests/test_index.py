"""The saved index that changes, scoped questions, and cover density, against plain Python."""

from __future__ import annotations

import itertools
import math
import random
import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lanternq.functions.text import STOPWORDS
from lanternq.operators import cover, index, search
from lanternq.operators.segments import SegmentIndex, Versions

WORDS = "fox den sky blue whale krill tower town bread salt water flour the of a".split()
CHUNKS = "chunk_id long, document_id long, search_text string"


def _terms(text):
    return [w for w in re.findall("[a-z0-9]+", (text or "").lower()) if w not in STOPWORDS]


def _corpus(n, seed=1):
    draw = random.Random(seed)
    return [(k, k // 2, " ".join(draw.choice(WORDS) for _ in range(draw.randint(0, 30))) if k % 17 else None) for k in range(n)]


def _bm25(rows, questions, k, scopes=None):
    n = len(rows)
    avg = sum(len(_terms(t)) for *_, t in rows) / n if n else 1.0
    df = Counter(w for *_, t in rows for w in set(_terms(t)))
    out = []
    for q, text in questions:
        found = []
        for c, d, t in rows:
            if scopes and scopes.get(q) is not None and d not in scopes[q]:
                continue
            tf, length = Counter(_terms(t)), len(_terms(t))
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * length / avg)) for w in set(_terms(text)) if tf[w])
            if round(s, 6) > 0:
                found.append((-round(s, 6), c))
        out += [(q, c, r + 1) for r, (s, c) in enumerate(sorted(found)[:k])]
    return sorted(out)


QUESTIONS = [(1, "the blue whale and krill"), (2, "bread of flour, water and salt"), (3, "tower"), (4, "of the"), (5, "unknown words")]


@pytest.fixture(scope="module")
def asked(spark):
    rows = spark.createDataFrame(QUESTIONS, "query_id long, text string")
    return index.term_rows(rows, "simple", "query_id", "text").withColumnRenamed("chunk_id", "query_id")


def _ranks(df):
    return sorted((r["query_id"], r["chunk_id"], r["rank"]) for r in df.collect())


def _files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*") if p.is_file() and "versions" not in str(p)}


@pytest.mark.parametrize("pruned", [True, False])
def test_changes_equal_a_rebuild_and_touch_nothing_old(spark, asked, tmp_path, pruned):
    path, rows = str(tmp_path / "index"), _corpus(300)
    frame = lambda part: spark.createDataFrame(part, CHUNKS)
    gone = lambda ids: spark.createDataFrame([(i,) for i in ids], "document_id long")
    found = lambda ix: _ranks(ix.lexical_search(asked, 5, pruned=pruned))
    first = SegmentIndex.created(spark, path, buckets=8, block_chunks=4)
    assert found(first) == [] and first.n == 0 and first.avg_length == 1.0
    one = first.appended(frame(rows[:200]))
    assert found(one) == _bm25(rows[:200], QUESTIONS, 5)
    before = _files(path)
    two = one.appended(frame(rows[200:]))
    assert {k: v for k, v in _files(path).items() if k in before} == before
    assert found(two) == _bm25(rows, QUESTIONS, 5)
    three = two.deleted(gone([*range(0, 150, 3), 10_000]))
    left = [r for r in rows if r[1] % 3]
    assert found(three) == _bm25(left, QUESTIONS, 5) and three.n == len(left)
    again = [r for r in rows if r[1] == 3]
    four = three.appended(frame(again))  # a deleted document comes back
    assert found(four) == _bm25(left + again, QUESTIONS, 5)
    five = four.compacted()
    assert len(five.content["segments"]) == 1 and five.content["gone"] == [] and found(five) == found(four)
    assert found(SegmentIndex.opened(spark, path, 1)) == _bm25(rows[:200], QUESTIONS, 5)  # a reader keeps its version
    assert SegmentIndex.opened(spark, path).number == five.number
    empty = five.deleted(five.chunks().select("document_id"))
    assert empty.n == 0 and found(empty) == []


def test_a_killed_change_leaves_the_version_before(spark, asked, tmp_path, monkeypatch):
    path, rows = str(tmp_path / "index"), _corpus(60)
    one = SegmentIndex.created(spark, path).appended(spark.createDataFrame(rows[:40], CHUNKS))
    monkeypatch.setattr(Versions, "write", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        one.appended(spark.createDataFrame(rows[40:], CHUNKS))
    monkeypatch.undo()
    assert SegmentIndex.opened(spark, path).number == 1
    assert _ranks(SegmentIndex.opened(spark, path).lexical_search(asked, 5)) == _bm25(rows[:40], QUESTIONS, 5)
    one.appended(spark.createDataFrame(rows[40:], CHUNKS))
    with pytest.raises(FileExistsError):  # the second of two writers from one version
        one.appended(spark.createDataFrame(rows[40:], CHUNKS))


def test_searches_read_the_buckets_of_their_terms_and_few_blocks(spark, tmp_path):
    draw = random.Random(2)
    rows = [(k, k, " ".join(draw.choice(WORDS) for _ in range(10)) + (" rare blue whale krill" * 3 if k in (5, 77, 400) else "")) for k in range(1500)]
    ix = SegmentIndex.created(spark, str(tmp_path / "index"), buckets=32, block_chunks=8).appended(spark.createDataFrame(rows, CHUNKS))
    terms = spark.createDataFrame([(1, w) for w in ("rare", "blue", "whale", "krill")], "query_id long, term string")
    plan = ix.pairs(terms, 3, pruned=False)._jdf.queryExecution().executedPlan().toString()
    wanted = {int(r[0]) for r in terms.select(F.conv(F.substring(F.md5("term"), 1, 8), 16, 10).cast("long") % 32).collect()}
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (IN|=)", plan) and len(wanted) < 5
    read = {int(re.search(r"bucket=(\d+)", f[0])[1]) for f in ix.postings().where(F.col("bucket").isin(list(wanted))).select(F.input_file_name()).distinct().collect()}
    assert read <= wanted
    few, all_ = ix.pairs(terms, 3, pruned=True).count(), ix.pairs(terms, 3, pruned=False).count()
    assert few < 0.2 * all_
    found = _ranks(ix.lexical_search(terms, 3, pruned=True))
    assert found == _ranks(ix.lexical_search(terms, 3, pruned=False)) and {c for _, c, _ in found} == {5, 77, 400}


def test_questions_with_scopes_of_their_own(spark, asked, tmp_path):
    rows = _corpus(200)
    ix = SegmentIndex.created(spark, str(tmp_path / "index"), block_chunks=4).appended(spark.createDataFrame(rows, CHUNKS))
    scopes = {1: [3, 4, 5, 50], 2: [], 3: None}
    given = spark.createDataFrame([*scopes.items()], "query_id long, document_ids array<long>")
    for pruned in (True, False):
        assert _ranks(ix.lexical_search(asked, 5, scopes=given, pruned=pruned)) == _bm25(rows, QUESTIONS, 5, scopes)


def _cover(text, words, every):
    at = [(k + 1, w) for k, w in enumerate(re.findall("[a-z0-9]+", (text or "").lower())) if w in words]
    if not every:
        return 0.1 * len(at)
    spans = [(i, j) for i, j in itertools.combinations_with_replacement(range(len(at)), 2) if {w for _, w in at[i : j + 1]} == words]
    least = [s for s in spans if not any(o != s and s[0] <= o[0] and o[1] <= s[1] for o in spans)]
    return sum(0.1 / (1 + (at[j][0] - at[i][0]) - (j - i)) for i, j in least)


@pytest.mark.parametrize("every", [False, True])
def test_cover_density_equals_all_stretches(spark, every):
    rows = _corpus(120, 4)
    questions = [(1, ["fox", "den"]), (2, ["blue", "whale", "krill"]), (3, ["salt"]), (4, ["absent", "fox"])]
    terms = spark.createDataFrame([(q, w) for q, ws in questions for w in ws], "query_id long, term string")
    positions = cover.positional_postings(spark.createDataFrame(rows, CHUNKS))
    got = {(r["query_id"], r["chunk_id"]): round(r["score"], 9) for r in cover.scores(terms, positions, every).collect()}
    want = {}
    for q, ws in questions:
        for c, _, t in rows:
            if r := _cover(t, set(ws), every):
                want[q, c] = round(r / (r + 1), 9)
    assert got == want and len(want) > 50
    stemmed = cover.positional_postings(spark.createDataFrame([(1, 1, "The runs of foxes")], CHUNKS), "english").collect()
    assert sorted((r["term"], r["pos"]) for r in stemmed) == [("fox", 4), ("run", 2)]


def test_bounds_of_positions(spark):
    rows = spark.createDataFrame([(1, 1, "fox " * 400), (2, 2, "den " * 16_400 + "fox"), (3, 3, "")], CHUNKS)
    terms = spark.createDataFrame([(1, "fox"), (2, "den"), (3, None)], "query_id long, term string")
    got = {(r["query_id"], r["chunk_id"]): r["score"] for r in search.top(cover.scores(terms, cover.positional_postings(rows)), 5).collect()}
    assert got == {(1, 1): round(25.6 / 26.6, 6), (1, 2): round(0.1 / 1.1, 6), (2, 2): round(25.6 / 26.6, 6)}
