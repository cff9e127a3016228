"""Files by format, the store, model plug-ins, approximate search, and whole turns of a dialogue."""

from __future__ import annotations

import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanternq.config import Settings
from lanternq.operators import dialog as D
from lanternq.operators import evals, index, models, search
from lanternq.operators.store import Store
from lanternq.plans.ask import answered, asked_of_folder, continued
from lanternq.plans.cascade import HYDE, diversified, hybrid
from lanternq.sources import files as X
from lanternq.sources import parse as P


def _docx(text: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:body></w:document>')
    return out.getvalue()


def test_folder_to_chunks(spark, tmp_path):
    def lines(content: bytes):
        if content == b"broken":
            raise ValueError("no PDF")
        return "", [{"page": 1, "n": 0, "text": "Big Head", "size": 20.0, "top": 0.0, "bottom": 20.0}] + [
            {"page": 1, "n": n, "text": f"line {n}", "size": 10.0, "top": 20.0 + n * 12, "bottom": 30.0 + n * 12} for n in range(1, 5)
        ]

    put = {
        "a_note.txt": b"One paragraph.\r\n\r\nTwo \xff bytes.", "sub/b.MD": b"# Head\n\ntext of b", "c.html": b"<title>See</title><h1>H</h1><p>html text</p>", "d.docx": _docx("docx text"),
        "e.pdf": b"pdf", "f.pdf": b"broken", "g.exe": b"x", "noext": b"y", "h.txt": b" \n ", "i.txt": b"One paragraph.\r\n\r\nTwo \xff bytes.", "j.docx": b"no zip", "k.txt": b"z" * 2_000_000,
    }
    (tmp_path / "sub").mkdir()
    for name, content in put.items():
        (tmp_path / name).write_bytes(content)
    found = X.read_folder(spark, str(tmp_path), most_mb=1)
    documents, chunks = X.ingested(found, pdf=lines)
    got = {r["path"].rsplit("/", 1)[1]: r for r in documents.collect()}
    assert set(got) == {n.rsplit("/", 1)[-1] for n in put} - {"i.txt"}  # the same content as a_note.txt
    assert {n for n, r in got.items() if r["status"] == "ready"} == {"a_note.txt", "b.MD", "c.html", "d.docx", "e.pdf"}
    assert [got[n]["error"] for n in ("g.exe", "noext", "h.txt", "f.pdf", "k.txt")] == [
        "Unsupported file type: .exe", "Unsupported file type: no extension", "no extractable text", "no PDF", "file too large"]
    assert got["j.docx"]["error"]
    assert (got["a_note.txt"]["title"], got["c.html"]["title"], got["e.pdf"]["title"], got["e.pdf"]["pages"]) == ("a note", "See", "Big Head", 1)
    texts = {r["document_id"]: r for r in chunks.collect()}
    assert texts[got["e.pdf"]["document_id"]]["text"] == "line 1 line 2 line 3 line 4"
    assert texts[got["a_note.txt"]["document_id"]]["text"] == "One paragraph. Two � bytes."
    assert texts[got["b.MD"]["document_id"]]["search_text"].startswith("b > Head")
    assert all(r["chunk_count"] == (1 if r["status"] == "ready" else 0) for r in got.values())
    assert X.parsed(found, registry=documents)[0].where("status = 'ready'").count() == 0


def test_line_size(spark):
    rows = spark.createDataFrame([([3.0, 1.0, 2.0],), ([1.0, 4.0],), ([],)], "g array<double>")
    assert [r[0] for r in rows.select(P.line_size(F.col("g"))).collect()] == [2.0, 2.5, 0.0]


def _corpus(spark):
    texts = {"whale": "The blue whale is the largest animal. It eats krill.", "tower": "The tower stands in the old town. It was built in 1890.", "bread": "Bread needs flour, water and salt. It bakes for an hour."}
    rows = [(f"{d}:0", d, 0, None, t, t, 1, 1) for d, t in texts.items()]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id string, idx long, section string, text string, search_text string, page_start int, page_end int")
    return chunks, spark.createDataFrame([(d, d.title(), "ready") for d in texts], "document_id string, title string, status string")


TURNS = "turn_id long, question string, history array<string>"


def test_turns_are_answered_or_declined(spark):
    chunks, documents = _corpus(spark)
    turns = spark.createDataFrame([(1, "What does the blue whale eat?", []), (2, "zyx qwv", []), (3, "How is bread baked with flour and salt", [])], TURNS)
    got = {r["turn_id"]: r for r in answered(turns, chunks, documents, settings=Settings(min_relevance=0.3)).collect()}
    assert {t: (r["status"], r["rounds"]) for t, r in got.items()} == {1: ("answered", 1), 2: ("no_evidence", 2), 3: ("answered", 1)}
    assert got[1]["sources"][0]["document_id"] == "whale" and got[1]["sources"][0]["location"] == "p. 1"
    assert got[1]["blocks"][0] == "The blue whale is the largest animal." and got[1]["citations"][0]["passage"] == 0
    assert got[1]["content"] == "".join(got[1]["blocks"])
    assert got[2]["content"] == D.NO_EVIDENCE and got[2]["blocks"] == [D.NO_EVIDENCE]
    assert {s["relevance"] for s in got[2]["sources"]} == {0.0}  # the closest passages by vector are shown, whatever their scores
    none = answered(turns, chunks, documents.withColumn("status", F.lit("failed"))).collect()
    assert {(r["status"], r["content"]) for r in none} == {("chitchat", D.NO_DOCUMENTS)}


class _Scripted(D.Extractive):
    """Plans small talk for turn 1 and a search for turn 2, finds better words for turn 3, and refuses turn 4."""

    def plan(self, turns):
        plan = F.when(F.col("turn_id") == 1, '{"needs_retrieval": false, "standalone_question": "hi", "reply": "Hello."}')
        plan = plan.when(F.col("turn_id") == 2, '{"needs_retrieval": true, "standalone_question": "blue whale krill", "search_queries": ["krill"], "hypothetical_answer": "tower"}')
        return turns.select("turn_id", D.parsed_plan(plan).alias("plan"))

    def reformulate(self, turns):
        return turns.where("turn_id = 3").select("turn_id", F.array(F.lit("old town tower")).alias("new"))

    def answer(self, turns):
        refused = turns.where("turn_id = 4").select("turn_id", F.lit(0).alias("pos"), F.lit("refusal").alias("kind"), F.lit("").alias("text"), F.lit(None).cast("int").alias("passage"))
        return super().answer(turns.where("turn_id <> 4")).unionByName(refused)


def test_planned_turns(spark):
    chunks, documents = _corpus(spark)
    turns = spark.createDataFrame([(1, "hi", []), (2, "and that one?", []), (3, "qqq", []), (4, "bread flour", [])], TURNS)
    got = {r["turn_id"]: r for r in answered(turns, chunks, documents, _Scripted(), Settings(min_relevance=0.01)).collect()}
    assert (got[1]["status"], got[1]["content"], got[1]["sources"]) == ("chitchat", "Hello.", [])
    assert got[2]["status"] == "answered" and {s["document_id"] for s in got[2]["sources"]} >= {"whale", "tower"}  # the hypothetical answer found the tower
    assert (got[3]["status"], got[3]["rounds"], got[3]["sources"][0]["document_id"]) == ("no_evidence", 2, "tower")  # reranking is by the question, in which there is no word
    assert (got[4]["status"], got[4]["content"], got[4]["citations"]) == ("failed", D.FAILED + D.REFUSED, [])


def test_models_plug_in(spark):
    chunks, documents = _corpus(spark)
    asked = spark.createDataFrame([(1, "anything")], "query_id long, text string")
    load = lambda: lambda texts: [[1.0, 0.0] if "tower" in t or "anything" in t else [0.0, 1.0] for t in texts]
    rank = lambda: lambda questions, texts: [2.0 if "tower" in t else -2.0 for t in texts]
    own = models.Models(models.ModelEncoder(load), None, models.ModelReranker(rank))
    got = hybrid(chunks, asked, documents, models=own).collect()
    assert got[0]["document_id"] == "tower" and got[0]["confidence"] == pytest.approx(1 / (1 + np.exp(-2)), abs=1e-6)
    plain = hybrid(chunks, asked, documents, models=models.Models(models.ModelEncoder(load), None, None)).collect()
    assert plain[0]["confidence"] is None and plain[0]["relevance"] in (None, 0.0)
    variants = spark.createDataFrame([(1, 0, "krill"), (1, 1, "salt"), (1, HYDE, "tower")], "query_id long, variant int, text string")
    assert {r["document_id"] for r in hybrid(chunks, asked, documents, variants=variants).collect()} == {"whale", "bread", "tower"}
    allowed = spark.createDataFrame([("bread:0",)], "chunk_id string")
    assert {r["document_id"] for r in hybrid(chunks, asked, documents, variants=variants, allowed=allowed).collect()} == {"bread"}


def _plain_mmr(rel, alike, keep, trade):
    low, high = min(rel), max(rel)
    rel = [(r - low) / (high - low) if high > low else 1.0 for r in rel]
    chosen, left = [], list(range(len(rel)))
    while left and len(chosen) < keep:
        score = lambda i: rel[i] if not chosen else trade * rel[i] - (1 - trade) * max(alike[i][j] for j in chosen)
        best = max(left, key=lambda i: (round(score(i), 9), -i))
        chosen.append(best)
        left.remove(best)
    return [i + 1 for i in chosen]


def test_pools_are_diversified_by_vectors_or_else_by_terms(spark):
    draw = np.random.default_rng(5)
    rows, want = [], {}
    for q in range(6):
        n, holed = 9, q % 2
        v = draw.normal(size=(n, 5))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        terms = [sorted(set(draw.choice(list("abcdefgh"), 4).tolist())) for _ in range(n)]
        rel = draw.random(n).round(3).tolist()
        for i in range(n):
            rows.append((q, i + 1, rel[i], terms[i], None if holed and i == 3 else v[i].tolist()))
        jaccard = [[len(set(a) & set(b)) / len(set(a) | set(b)) for b in terms] for a in terms]
        want[q] = _plain_mmr(rel, jaccard if holed else (v @ v.T).tolist(), 5, 0.6)
    pool = spark.createDataFrame(rows, "query_id long, position int, relevance double, terms array<string>, embedding array<double>")
    got = {}
    for r in sorted(diversified(pool, 5, 0.6).collect()):
        got.setdefault(r["query_id"], []).append(r["position"])
    assert got == want


def test_turns_with_scopes_of_their_own(spark):
    chunks, documents = _corpus(spark)
    turns = spark.createDataFrame([(n, "What does the blue whale eat?", []) for n in (1, 2, 3, 4)], TURNS)
    scopes = spark.createDataFrame([(1, ["tower", "bread"]), (2, []), (3, None)], "turn_id long, document_ids array<string>")
    steps: dict[str, int] = {}
    got = {r["turn_id"]: r for r in answered(turns, chunks, documents, settings=Settings(min_relevance=0.3), scopes=scopes, timings=steps).collect()}
    assert {t: r["status"] for t, r in got.items()} == {1: "no_evidence", 2: "no_evidence", 3: "answered", 4: "answered"}
    assert {s["document_id"] for s in got[1]["sources"]} <= {"tower", "bread"} and got[2]["sources"] == []
    assert got[3]["sources"][0]["document_id"] == "whale" and {"index", "retrieve", "rerank", "select"} >= set(steps) >= {"retrieve", "rerank"}


class _Recording(D.Extractive):
    """Says how much of the history it got."""

    def answer(self, turns):
        said = F.concat_ws("|", F.size("history"), F.get("history", F.lit(0))["role"], F.get("history", F.lit(0))["text"])
        row = turns.select("turn_id", said.alias("text"))
        return row.select("turn_id", F.posexplode(F.array(F.struct(F.lit("block_start").alias("kind"), F.lit("").alias("text")), F.struct(F.lit("text").alias("kind"), F.col("text")))).alias("pos", "e")).select(
            "turn_id", "pos", "e.*", F.lit(None).cast("int").alias("passage"))


def test_threads_go_on_with_their_recent_history(spark, tmp_path):
    chunks, documents = _corpus(spark)
    long_ = [(1, k, "assistant" if k % 2 else "user", f"m{k}") for k in range(11)] + [(1, 11, "user", "What does the blue whale eat?")]
    short = [(2, 0, "assistant", "hello"), (2, 1, "user", "How is bread baked with flour and salt")]
    messages = spark.createDataFrame(long_ + short, "conv_id long, turn int, role string, text string")
    answers, threads = continued(messages, chunks, documents, generator=_Recording())
    got = {r["turn_id"]: r["content"] for r in answers.collect()}
    assert got == {1: "8|user|m4", 2: "0"} or got == {1: "7|user|m4", 2: "0"}
    last = {r["conv_id"]: (r["turn"], r["role"], r["text"]) for r in threads.orderBy("turn").collect()}
    assert last == {1: (12, "assistant", got[1]), 2: (2, "assistant", got[2])}
    (tmp_path / "whale.txt").write_text("The blue whale eats krill.")
    (tmp_path / "odd.exe").write_bytes(b"x")
    read, answers, threads = asked_of_folder(str(tmp_path), messages.where("conv_id = 1"))
    assert {r["status"] for r in read.collect()} == {"ready", "failed"}
    assert answers.first()["status"] == "answered" and "krill" in answers.first()["content"] and threads.count() == 13


def test_vectors_are_kept_over_runs(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()

    def load():
        def model(texts):
            for t in texts:
                with open(seen / f"{abs(hash(t))}-{t[:5]}", "a") as out:
                    out.write("x")
            return [[float(len(t)), 1.0] for t in texts]

        return model

    encoder = models.CachedEncoder(models.ModelEncoder(load), str(tmp_path / "kept"), "org/model")
    rows = lambda *texts: index.with_posts(spark.createDataFrame([*enumerate(texts)], "chunk_id int, search_text string"))
    encoded = lambda df: {r["chunk_id"]: r["v"] for r in encoder.documents(df, "v").collect()}
    times = lambda: sum(len(p.read_text()) for p in seen.iterdir())
    want = {0: [1.0, 1.0], 1: [2.0, 1.0], 2: [1.0, 1.0], 3: [0.0, 1.0]}
    assert encoded(rows("a", "bb", "a", None)) == want and times() == 3  # equal texts once
    assert encoded(rows("a", "bb", "a", None)) == want and times() == 3  # nothing is encoded again
    assert encoded(rows("a", "ccc")) == {0: [1.0, 1.0], 1: [3.0, 1.0]} and times() == 4
    assert {p.name for p in (tmp_path / "kept").iterdir()} == {"org__model"}


def test_store(spark, tmp_path):
    schema = "id string, hash string, title string, filename string, pages int, chunk_count int, status string, error string, created_at timestamp"
    docs = spark.createDataFrame([(d, f"h{d}", d, f"{d}.txt", None, 1, "ready", None) for d in "ab"], schema.rsplit(",", 1)[0]).withColumn("created_at", F.timestamp_seconds(F.ascii("id")))
    rows = [(f"{d}:{i}", d, i, None, t, t, None, None) for d, ts in (("a", ["red fox", "fox den"]), ("b", ["blue sky", "fox"])) for i, t in enumerate(ts)]
    chunks = spark.createDataFrame(rows, "id string, document_id string, idx long, section string, text string, search_text string, page_start int, page_end int")
    store = Store(docs, chunks).saved(str(tmp_path / "one"))
    ids = lambda df: [r[0] for r in df.collect()]
    one = lambda name, *v: spark.createDataFrame([(x,) for x in v], f"{name} string")
    assert ids(store.listed()) == ["b", "a"] and ids(store.documents_by_hash(one("hash", "ha", "x"))) == ["a"] and ids(store.documents_by_id(one("id", "b"))) == ["b"]
    asked = spark.createDataFrame([(1, "the fox")], "query_id long, text string")
    found = store.lexical_search(asked, 5).orderBy("rank").collect()
    assert [r["chunk_id"] for r in found] == ["b:1", "a:0", "a:1"]
    only = store.lexical_search(asked, 5, one("document_id", "a")).orderBy("rank").collect()
    assert [(r["chunk_id"], r["score"]) for r in only] == [(r["chunk_id"], r["score"]) for r in found[1:]]  # statistics stay those of the whole index
    assert store.lexical_search(asked, 5, one("document_id", "a").limit(0)).count() == 0
    fox = index.with_posts(spark.createDataFrame([(1, "fox")], "query_id long, search_text string"))
    assert {r["chunk_id"] for r in store.sparse_search(store.sparse.queries(fox, "sparse"), 9).collect()} >= {"a:0", "a:1", "b:1"}
    vectors = store.dense.queries(fox, "embedding")
    assert store.dense_search(vectors, 1).first()["chunk_id"] == "b:1"
    assert {r["chunk_id"] for r in store.dense_search(vectors, 9, one("document_id", "a")).collect()} == {"a:0", "a:1"}
    assert store.dense_search(vectors, 9, one("document_id", "a").limit(0)).count() == 0
    less = store.without(one("document_id", "a"))
    assert ids(less.documents) == ["b"] and less.chunks.count() == 2
    assert store.with_chunks(chunks).chunks.count() == 4
    change = docs.where("id = 'a'").withColumn("title", F.lit("new")).withColumn("filename", F.lit("new.txt"))
    assert store.upserted(change).documents_by_id(one("id", "a")).first()["filename"] == "a.txt"
    assert store.upserted(change, whole=True).documents_by_id(one("id", "a")).first()["filename"] == "new.txt"
    assert [r["id"] for r in Store.loaded(spark, str(tmp_path / "one")).neighbors(spark.createDataFrame([("a", 1), ("a", 9)], "document_id string, idx long")).collect()] == ["a:1"]


def test_approximate_search_prunes_and_finds(spark, sf, tmp_path):
    from lanternq.operators.vectors import VectorIndex
    from lanternq.plans import all_queries

    rows = all_queries.QUERIES["ann_recall"](spark, sf).collect()
    assert np.mean([r["recall"] for r in rows]) >= 0.9
    assert max(r["scored"] for r in rows) <= 0.1
    kind = "embedding array<float>"
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], f"query_id long, {kind}")
    empty = VectorIndex.saved(spark.createDataFrame([], f"chunk_id long, {kind}"), str(tmp_path / "empty"))
    assert empty.n == 0 and empty.top(asked, 3).collect() == []
    holed = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], f"chunk_id long, {kind}")
    assert search.dense_top(asked, holed, 3).count() == 0  # one vector is missing, so there is no dense index
    assert [(r["query_id"], r["chunk_id"]) for r in VectorIndex.saved(holed, str(tmp_path / "holed")).top(asked, 3).collect()] == [(1, 1), (1, 3)]  # this one leaves it out


def test_vector_index_on_clusters(spark, tmp_path):
    from lanternq.operators.vectors import VectorIndex

    draw = np.random.default_rng(1)
    centres = draw.normal(size=(30, 20))
    x = centres[draw.integers(0, 30, 3000)] + 0.35 * draw.normal(size=(3000, 20))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(f"v{i:04d}", v.tolist()) for i, v in enumerate(x)], "chunk_id string, embedding array<double>")
    asked = rows.where("chunk_id LIKE 'v%00'").withColumnRenamed("chunk_id", "query_id")
    index = VectorIndex.saved(rows, str(tmp_path / "v"))
    assert len(index.quantizer.centres) == 55 and index.rows.where("cell IS NOT NULL").count() == 3000
    pairs = index.scored(asked, 10)
    assert pairs.groupBy("query_id").count().agg(F.max("count")).first()[0] <= 80  # of 3,000
    found = {(r["query_id"], r["chunk_id"]) for r in search.top(pairs, 10).collect()}
    names = [f"v{i:04d}" for i in range(3000)]
    want = {(names[q], names[c]) for q in range(0, 3000, 100) for c in np.argsort(-np.round(x[q] @ x.T, 6), kind="stable")[:10]}
    assert len(found & want) / len(want) >= 0.95
    again = VectorIndex.opened(spark, str(tmp_path / "v"), "cell int, chunk_id string, code binary, embedding array<double>")
    assert {(r["query_id"], r["chunk_id"]) for r in again.top(asked, 10).collect()} == found


def test_report_and_requests(spark):
    qrels = spark.createDataFrame([(1, 10, 1), (2, 20, 1)], "query_id long, doc long, grade int")
    ranking = spark.createDataFrame([(1, 10, 1), (2, 30, 1)], "query_id long, doc long, rank int")
    found = evals.report("a/b", {"dense": lambda: ranking}, qrels, 3)
    assert (found["queries"], found["results"][0]["mrr10"], found["results"][0]["recall10"]) == (2, 1.0, 0.5) or found["results"][0]["recall10"] == 0.5
    assert json.loads(evals.as_json(found)) == found and evals.as_text(found).splitlines()[1].startswith("config")
    assert evals.slug("a/b") == "a__b"
    rows = spark.createDataFrame([("x" * 4000, "a" * 64, ["d"] * 100), ("x" * 4001, None, None), ("", None, None), (None, None, None), ("x", "a\n", None), ("x", "", None), ("x", None, ["d"] * 101)], "m string, t string, d array<string>")
    assert [r[0] for r in rows.select(D.valid_request(F.col("m"), F.col("t"), F.col("d"))).collect()] == [True, False, False, False, False, False, False]
