"""Products of questions and chunks in blocks of bounded size, against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from lanternq.operators import search


def sets(seed, n, words, most):
    draw = random.Random(seed)
    return [sorted({f"w{min(int(draw.expovariate(0.05)), words)}" for _ in range(draw.randrange(most))}) for _ in range(n)]


def test_shared_keys_of_all_pairs(spark):
    """Every pair is there, with questions in several blocks, common and rare keys, empty and missing lists."""
    asked, rows = [*sets(1, 60, 90, 30), [], None], [*sets(2, 300, 120, 60), [], None]
    frames = [spark.createDataFrame([(i, x) for i, x in enumerate(side)], f"{name} long, keys array<string>") for side, name in ((asked, "query_id"), (rows, "chunk_id"))]
    got = search.shared_keys(*frames, query_block=25)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    found = {(r["query_id"], r["chunk_id"]): r for r in got.collect()}
    assert len(found) == len(asked) * len(rows) == got.count()
    for (q, c), r in found.items():
        a, b = asked[q], rows[c]
        assert r["shared"] == len(set(a or ()) & set(b or ()))
        assert (r["asked"], r["own"]) == (None if a is None else len(a), None if b is None else len(b))


def test_jaccard_terms_makes_no_nested_loop(spark, sf):
    from lanternq.plans import all_queries

    assert "NestedLoop" not in all_queries.QUERIES["jaccard_terms"](spark, sf)._jdf.queryExecution().executedPlan().toString()


def vectors(spark, name, side, seed):
    draw = random.Random(seed)
    rows = [(i, x, None if x is None else [float(draw.randrange(1, 4)) for _ in x]) for i, x in enumerate(side)]
    return rows, spark.createDataFrame(rows, f"{name} long, keys array<string>, weights array<double>")


def test_sparse_top_is_exact_and_shuffles_no_pairs(spark):
    """Whole lists with many ties and copies, for questions in several blocks, with scopes, against all pairs."""
    asked, chunks = [*sets(3, 70, 90, 30), []], [*sets(4, 400, 120, 60), *[["w1", "w2"]] * 150, None]
    a, queries = vectors(spark, "query_id", asked, 5)
    b, rows = vectors(spark, "chunk_id", chunks, 6)
    rows = rows.selectExpr("*", "chunk_id % 3 AS document_id")
    seen = {0: [0, 1], 1: [], 2: None}
    scopes = spark.createDataFrame(list(seen.items()), "query_id long, document_ids array<long>")
    for given in (None, scopes):
        got: dict = {}
        for r in search.sparse_top(queries, rows, 7, query_block=30, scopes=given).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((-r["score"], r["chunk_id"]))
        for q, keys, w in a:
            own = Counter(dict(zip(keys, w)))
            scores = [(-sum(own[k] * v for k, v in zip(ks or (), vs or ())), c) for c, ks, vs in b if given is None or seen.get(q) is None or c % 3 in seen[q]]
            assert got.get(q, []) == sorted(x for x in scores if x[0] < 0)[:7]


def test_searches_join_no_question_to_every_posting(spark, sf):
    """Lexical and sparse lists come from products in tasks; only k rows for each question and task are shuffled."""
    from lanternq.plans import all_queries

    for name in ("bm25_topk", "sparse_topk"):
        plan = all_queries.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "Join" not in plan.split("MapInArrow")[0], name


def test_dense_encoder_sends_no_terms_to_python(spark):
    from lanternq.operators import index
    from lanternq.operators.models import HashingDense

    texts = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(sets(8, 3000, 500, 40))], "chunk_id long, search_text string").coalesce(1)
    out = HashingDense(16).documents(index.with_posts(texts), "v")
    assert "MapInArrow" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = index.hashed_dense(index.postings(texts), 16).groupBy("chunk_id").agg({"*": "count"})
    flat = out.selectExpr("chunk_id", "posexplode(v) AS (bucket, w)").where("w <> 0").withColumn("bucket", F.col("bucket").cast("long"))
    far = flat.join(index.hashed_dense(index.postings(texts), 16).withColumnRenamed("w", "x"), ["chunk_id", "bucket"], "full").where("coalesce(abs(w - x), 1) > 1e-9")
    assert not far.count() and want.count() == flat.select("chunk_id").distinct().count()


def test_cover_top_equals_scores_of_positions(spark):
    """Words behind the last place that is told apart, more places than are kept of a word, copies and empty texts."""
    from lanternq.operators import cover

    draw = random.Random(9)
    words = [f"w{i}" for i in range(30)] + ["the", "of"]
    texts = [" ".join(draw.choices(words, k=draw.choice((0, 5, 40, 400)))) for _ in range(60)]
    filler = " ".join(["zz"] * 16_380)
    texts += [f"{filler} w1 w2 w3 w1 w2 w4", f"w1 w2 {filler} w3 w1 w5 w6", " ".join(["w1"] * 300), f"{' '.join(['w1'] * 255)} {filler} w1 w1 w2", f"{' '.join(['w2'] * 256)} {filler} w2", None]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, search_text string")
    terms = spark.createDataFrame([(q, w) for q in range(12) for w in draw.sample(words[:30], 1 + q % 5)] + [(99, "w1"), (99, "w2"), (98, "absent")], "query_id long, term string")
    want = search.top(cover.scores(terms, cover.positional_postings(chunks)), 8, positive_only=True).collect()
    got = cover.top(terms, chunks, 8)
    assert sorted(got.collect()) == sorted(want) and len(want) > 80


def test_cover_query_shuffles_no_positions(spark, sf):
    from lanternq.plans import all_queries

    plan = all_queries.QUERIES["cover_density_topk"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "Join" not in plan


def test_overlaps_are_found_from_a_seed(spark):
    """Longest common borders of repetitive texts, quoting marks and wide characters, without trying every length."""
    from lanternq.functions.text import overlap_joined

    def joined(a, b):
        n = next((n for n in range(min(len(a), len(b), 2000), 20, -1) if a.endswith(b[:n])), None)
        return a + b[n:] if n else a + "\n\n" + b

    draw, rows = random.Random(1), []
    for _ in range(400):
        kind = draw.choice(["a", "ab", "ab\\EQ", "xyz\n ", "é😀b"])
        a = "".join(draw.choices(kind, k=draw.randrange(120)))
        k = draw.randrange(100)
        rows.append((a, (a[-k:] if k and draw.random() < 0.7 else "") + "".join(draw.choices(kind, k=draw.randrange(60)))))
    long = "".join(draw.choices("abc ", k=9000))
    rows += [(long, long[-k:] + "Q") for k in (1999, 2000, 2001)] + [("q" * 3000, "q" * 3000), ("q" * 21, "q" * 21)]
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", overlap_joined(F.col("a"), F.col("b")).alias("j"))
    assert "sequence(" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert all(r["j"] == joined(r["a"], r["b"]) for r in df.collect())


def test_chunks_are_packed_once(spark, sf):
    from lanternq.plans import all_queries

    plan = all_queries.QUERIES["chunk_overlap"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[a-z0-9]+") <= 1 and "isnotnull(aggregate" not in plan and "size(aggregate" not in plan


def test_dense_products_of_all_pairs(spark, sf):
    from lanternq.plans import all_queries

    asked, rows = [[1.0, 2.0], None, [0.5, -1.0]], [[3.0, 1.0], [2.0, 2.0], None, [0.0, 4.0]]
    frames = [spark.createDataFrame(list(enumerate(side)), f"{name} long, embedding array<double>") for side, name in ((asked, "query_id"), (rows, "chunk_id"))]
    got = {(r["query_id"], r["chunk_id"]): r["score"] for r in search.dense_products(*frames, query_block=2).collect()}
    assert got == {(q, c): None if a is None or b is None else a[0] * b[0] + a[1] * b[1] for q, a in enumerate(asked) for c, b in enumerate(rows)}
    assert "NestedLoop" not in all_queries.QUERIES["dense_similarity"](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_sweep_indexes_the_documents_once(spark, sf, monkeypatch):
    from lanternq.plans import retrieval_queries as R

    made, whole = [], R.cascade.indexed
    monkeypatch.setattr(R.cascade, "indexed", lambda *a, **b: made.append(b.get("name", "index")) or whole(*a, **b))
    R.eval_sweep(spark, sf)
    assert sorted(made) == ["index", "questions"]


def _bm25(texts, asked, k, form, seen=lambda q, c: True):
    """Brute force: {query_id: [(chunk_id, score)]}; missing texts are chunks without a length."""
    import math

    from lanternq.functions.text import STOPWORDS

    def terms(text):
        return Counter(form(w) for w in re.findall("[a-z0-9]+", (text or "").lower()) if w not in STOPWORDS)

    own = {c: terms(t) for c, t in texts.items()}
    average = sum(map(Counter.total, own.values())) / sum(t is not None for t in texts.values())
    found = {}
    for q, text in asked.items():
        scores: Counter = Counter()
        for term in sorted(terms(text)):
            df = sum(term in x for x in own.values())
            for c, x in own.items():
                if x[term]:
                    scores[c] += math.log(1 + (len(texts) - df + 0.5) / (df + 0.5)) * x[term] * 2.2 / (x[term] + 1.2 * (0.25 + 0.75 * x.total() / average))
        found[q] = sorted(((c, round(s, 6)) for c, s in scores.items() if s > 0 and seen(q, c)), key=lambda x: (-x[1], x[0]))[:k]
    return {q: rows for q, rows in found.items() if rows}


def _forms(seed, n, most):
    draw = random.Random(seed)
    roots = ["run", "nation", "hope", "rate", "fly", "cat", "able", "relate", "b", "42", "the"]
    return [" ".join(draw.choice(roots) + draw.choice(["", "s", "ing", "ed", "al", "ally", "fulness"]) for _ in range(draw.randrange(most))) for _ in range(n)]


def _listed(rows, key="query_id"):
    got: dict = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(r[key], []).append((r["chunk_id"], r["score"]))
    return got


def _close(got, want):
    return got.keys() == want.keys() and all([c for c, _ in got[q]] == [c for c, _ in want[q]] and all(abs(a[1] - b[1]) < 2e-6 for a, b in zip(got[q], want[q])) for q in want)


def test_bm25_of_both_analyzers_shuffles_no_postings(spark, tmp_path, monkeypatch):
    """Stems that several forms of one text have, missing and empty texts, in many pieces, with all or too many stems asked for; the plan joins nothing to postings."""
    from lanternq.functions.stem import stem
    from lanternq.operators import index
    from lanternq.plans import all_queries

    monkeypatch.setattr(index, "WORDS", 40, raising=False)
    texts, asked = dict(enumerate([*_forms(11, 300, 30), "", None, None, " ".join(["hoping"] * 90)])), dict(enumerate([*_forms(12, 25, 6), "absent words", None]))
    for name, key, rows in (("documents", "doc_id", texts), ("benchmark", "item_id", asked)):
        spark.createDataFrame(list(rows.items()), f"{key} long, text string").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, form in (("bm25_english", stem), ("bm25_topk", str)):
        got = all_queries.QUERIES[name](spark, str(tmp_path))
        assert _close(_listed(got.collect()), _bm25(texts, asked, 10, form)), name
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "Join" not in plan.split("MapInArrow")[0], name
    monkeypatch.setattr(search.wanted, "__defaults__", (3,))
    assert _close(_listed(all_queries.QUERIES["bm25_english"](spark, str(tmp_path)).collect()), _bm25(texts, asked, 10, stem))


def test_stems_of_the_cascade_join_no_postings(spark):
    from lanternq.config import Settings
    from lanternq.functions.stem import stem
    from lanternq.operators.models import Models
    from lanternq.plans import cascade

    texts, asked, words = dict(enumerate(_forms(13, 120, 30))), dict(enumerate(_forms(14, 12, 6))), Models(None, None, None)
    rows = cascade.keyed(spark.createDataFrame([(f"d{c % 5}", c, t) for c, t in texts.items()], "document_id string, idx long, search_text string"))
    ix = cascade.indexed(rows, words, "english")
    variants = spark.createDataFrame([(q, 0, t) for q, t in asked.items()], "query_id long, variant int, text string")
    scopes = spark.createDataFrame([(0, ["d1", "d3"]), (1, []), (2, None)], "query_id long, document_ids array<string>")
    for given, seen in ((None, {}), (scopes, {0: (1, 3), 1: ()})):
        lists = cascade.candidates(ix, variants, Settings(), "english", words, scopes=given)
        got = {q: [(c["idx"], s) for c, s in found] for q, found in _listed(lists.collect()).items()}
        keyed = {(c % 5, c): t for c, t in texts.items()}
        want = _bm25(keyed, asked, Settings().candidates_per_retriever, stem, lambda q, c: q not in seen or c[0] in seen[q])
        assert _close(got, {q: [(c[1], s) for c, s in found] for q, found in want.items()})
        assert "Join" not in lists._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]


def test_words_that_no_step_changes_are_their_own_stems():
    """The early way out gives what all steps give, and suffixes are still found: words of every ending, with vowels and doubled letters before it."""
    from lanternq.functions import stem as S

    draw = random.Random(15)
    for _ in range(3000):
        word = "".join(draw.choices("abdehilnorstuy'", k=draw.randrange(3, 9))) + draw.choice(["", *S.ENDS])
        if S.stem(word) != word:
            assert word.endswith(S.ENDS) or word[0] == "'"
    known = {"thatblean": "thatblean", "stopping": "stop", "happily": "happili", "nationally": "nation", "hopefulness": "hope", "skies": "sky", "abilities": "abil", "conditional": "condit", "rolling": "roll", "generously": "generous"}
    assert {w: S.stem(w) for w in known} == known


def test_all_questions_meet_chunks_in_one_pass(spark):
    """However many questions there are: lists of a turn loop, whose questions grow with its chunks, read the chunks once for thousands of them."""
    asked, chunks = sets(16, 5000, 90, 8), sets(17, 40, 120, 60)
    queries, rows = vectors(spark, "query_id", asked, 18)[1], vectors(spark, "chunk_id", chunks, 19)[1]
    plan = search.sparse_top(queries, rows, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    units = queries.selectExpr("query_id", "array(1D, query_id) AS embedding"), rows.selectExpr("chunk_id", "array(2D, chunk_id) AS embedding")
    assert search.dense_top(*units, 3)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_common_keys_left_out_at_first_lose_nothing(spark, monkeypatch):
    """Many small blocks, so least scores are known early: common and rare keys, keys that stand twice, negative weights, ties, scopes and few hits, against all pairs."""
    draw = random.Random(20)
    monkeypatch.setattr(search, "ROWS", 50)
    for low in (1, -2):
        side = lambda n, most: [[f"w{min(int(draw.expovariate(0.15)), 60)}" for _ in range(draw.randrange(most))] for _ in range(n)]  # noqa: B023, E731
        weighed = lambda x: [draw.choice([low, 1, 1, 2, 3]) * 1.0 for _ in x]  # noqa: B023, E731
        a = [(q, x, weighed(x)) for q, x in enumerate([*side(60, 25), [], ["absent"], ["w50"]])]
        b = [(c, x, weighed(x)) for c, x in enumerate([*side(900, 40), *[["w1", "w2"]] * 60, []])]
        queries = spark.createDataFrame(a, "query_id long, keys array<string>, weights array<double>")
        rows = spark.createDataFrame(b, "chunk_id long, keys array<string>, weights array<double>").selectExpr("*", "chunk_id % 3 AS document_id").coalesce(1)
        seen = {0: [0, 1], 1: [], 2: None}
        for given in (None, spark.createDataFrame(list(seen.items()), "query_id long, document_ids array<long>")):
            got = _listed(search.sparse_top(queries, rows, 7, scopes=given).collect())
            for q, keys, w in a:
                scores = [(c, sum(x * y for k, x in zip(keys, w) for o, y in zip(ks, vs) if k == o)) for c, ks, vs in b if given is None or seen.get(q) is None or c % 3 in seen[q]]
                assert got.get(q, []) == sorted((x for x in scores if x[1] > 0), key=lambda x: (-x[1], x[0]))[:7]


def test_screened_products_are_exact(spark):
    """Single precision only tells which pairs are multiplied: near ties that it cannot tell apart, copies, no numbers, huge and tiny numbers."""
    import numpy as np

    draw = np.random.default_rng(21)
    base = draw.normal(size=(4, 8))
    plain = np.concatenate([base[draw.integers(0, 4, 900)] * (1 + draw.integers(0, 9, (900, 1)) * 1e-7), draw.normal(size=(300, 8))])
    for scale, hole in ((1.0, False), (1e20, False), (1e-20, False), (1.0, True)):
        rows, asked = plain * 30, draw.normal(size=(50, 8)) * scale
        if hole:
            rows[5, 2], asked[3, 1] = np.nan, np.inf
        frames = [spark.createDataFrame([(n, x.tolist()) for n, x in enumerate(side)], f"{name} long, embedding array<double>") for side, name in ((asked, "query_id"), (rows, "chunk_id"))]
        got = _listed(search.dense_top(frames[0], frames[1].coalesce(1), 9, block=128).collect())
        with np.errstate(invalid="ignore"):
            score = np.round(asked @ rows.T, 6)
        score[np.isnan(score)] = -np.inf
        for q in range(50):
            want = sorted(((c, s) for c, s in enumerate(score[q].tolist())), key=lambda x: (-x[1], x[0]))[:9]
            assert len(got[q]) == 9 and np.allclose([s for _, s in got[q]], [s for _, s in want], rtol=1e-12, atol=1.1e-6), (scale, hole, q)
            assert got[q] == sorted(got[q], key=lambda x: (-x[1], x[0]))


def test_reranking_takes_no_terms_anew(spark):
    """Pairs that bring the terms of both texts have the scores of those that don't, and no text is taken apart for them."""
    from lanternq.operators.models import OverlapReranker

    pairs = spark.createDataFrame([("bb aa bb the", "aa cc"), ("xx", "aa"), ("", "aa"), ("aa bb", ""), ("aa", None)], "question string, search_text string")
    known = pairs.selectExpr("*", "array_distinct(filter(split(question, ' '), x -> x NOT IN ('', 'the'))) AS asked_terms", "array_sort(filter(split(search_text, ' '), x -> x <> '')) AS own_terms")
    scored = [OverlapReranker().scored(x).select("question", "search_text", "rerank_score") for x in (pairs, known)]
    assert sorted(map(str, scored[0].collect())) == sorted(map(str, scored[1].collect()))
    assert "regexp_extract_all" not in scored[1]._jdf.queryExecution().analyzed().toString()


def test_postings_are_met_once(spark, monkeypatch):
    """Document frequencies are counted for the weights of all questions once, though their blocks are counted and read."""
    texts = spark.createDataFrame(list(enumerate(_forms(22, 50, 20))), "chunk_id long, search_text string")
    from lanternq.operators import index

    met = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            met.add(batch.num_rows)
            yield batch

    rows = index.with_posts(texts)
    posts = rows.selectExpr("chunk_id", "inline(posts)").coalesce(1)
    n, posts = posts.count(), posts.mapInArrow(seen, "chunk_id long, term string, tf long")
    asked = spark.createDataFrame([(q, w) for q in range(5) for w in ("run", "rate", "cat")], "query_id long, term string")
    search.bm25_top(asked, rows, posts, 50, 10.0, 3, asked=15).collect()
    assert met.value == n
