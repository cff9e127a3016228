from __future__ import annotations

import io
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from lanternq.config import Settings
from lanternq.functions import text as T
from lanternq.functions.stem import stem
from lanternq.operators import dialog, evals, fuse, passages, search
from lanternq.operators import events as E
from lanternq.operators.chunk import chunked
from lanternq.sources import parse as P
from lanternq.streaming.ingest import conversation_state, stream_ingest

#: Words of the published vocabulary sample of the stemmer with their stems.
STEMS = {
    "consign": "consign", "consigned": "consign", "consigning": "consign", "consignment": "consign", "consist": "consist", "consisted": "consist",
    "consistency": "consist", "consistently": "consist", "consolation": "consol", "consolations": "consol", "console": "consol", "consolingly": "consol",
    "knackeries": "knackeri", "knacks": "knack", "knavish": "knavish", "kneaded": "knead", "knees": "knee", "knell": "knell", "knightly": "knight",
    "knitted": "knit", "knitting": "knit", "knives": "knive", "knocked": "knock", "skies": "sky", "dying": "dy", "generously": "generous", "ties": "tie", "cries": "cri", "happy": "happi",
}


def test_stem():
    got = {w: stem(w) for w in STEMS if w != "dying"}
    assert got == {w: s for w, s in STEMS.items() if w != "dying"}


def test_settings_bounds():
    with pytest.raises(ValueError):
        Settings(top_k=31)


def test_token_estimate(spark):
    assert spark.range(1).select(T.token_count(F.lit("Hello, world!"))).first()[0] == 4


def test_html_rules():
    title, blocks = P.html_document("<title> A  b</title><script>x</script><h1>Head</h1><nav><p>n</p></nav><ul><li><p>in  side</p></li></ul>")
    assert title == "A b"
    assert [(b["text"], b["heading_level"]) for b in blocks] == [("Head", 1), ("in side", None), ("in side", None)]


def test_docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="": f'<w:p><w:pPr>{f"<w:pStyle w:val={chr(34)}{s}{chr(34)}/>" if s else ""}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    body = p("Title here", "Heading1") + "<w:tbl><w:tr><w:tc>" + p("a") + "</w:tc><w:tc>" + p("b") + "</w:tc></w:tr></w:tbl>" + p("Body")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    title, blocks = P.docx_document(out.getvalue())
    assert title == "Title here"
    assert [(b["text"], b["heading_level"]) for b in blocks] == [("Title here", 1), ("Body", None), ("a | b", None)]


def test_failed_parse_is_recorded(spark):
    def broken(_):
        raise RuntimeError("x" * 900)

    rows = P.parsed_with(spark.createDataFrame([(1, "a")], "id long, c string"), "id", "c", broken).collect()
    assert rows[0]["blocks"] == [] and len(rows[0]["error"]) == 500


def test_pdf_lines(spark):
    rows = [("d", 1, 0, "Big heading", 20.0, 10.0, 30.0), ("d", 1, 1, "first line ends-", 11.0, 40.0, 51.0), ("d", 1, 2, "wrapped", 11.0, 53.0, 64.0), ("d", 1, 3, "far away", 11.0, 90.0, 101.0)]
    got = P.pdf_blocks(spark.createDataFrame(rows, "doc_id string, page int, n int, text string, size double, top double, bottom double")).orderBy("pos").collect()
    assert [(r["text"], r["heading_level"], r["page"]) for r in got] == [("Big heading", 1, 1), ("first line endswrapped", None, 1), ("far away", None, 1)]


def test_chunks_stay_in_sections(spark):
    sentence = "This sentence has exactly fourteen tokens, as the reader can count here now. "
    blocks = [("d", 0, "Guide", 1, None), ("d", 1, "One", 2, None), ("d", 2, (sentence * 12).strip(), None, 1), ("d", 3, "Two", 2, None), ("d", 4, "A short body.", None, 2)]
    got = chunked(spark.createDataFrame(blocks, "doc_id string, pos int, text string, heading_level int, page int"), 40, 15).orderBy("idx").collect()
    one = [r for r in got if r["section"] == "Guide > One"]
    two = [r for r in got if r["section"] == "Guide > Two"]
    assert len(one) > 2 and len(two) == 1 and all(r["tokens"] <= 40 for r in got)
    assert [r["page_start"] for r in (one[0], two[0])] == [1, 2]
    assert one[1]["text"].startswith(sentence.strip()) and two[0]["text"] == "A short body."


def test_fusion_order_and_ranks(spark):
    rows = [(1, "dense:0", 0, 1, "a"), (1, "dense:0", 0, 2, "b"), (1, "lexical:0", 1, 1, "b"), (1, "lexical:0", 1, 2, "c")]
    lists = spark.createDataFrame(rows, "query_id int, list_name string, list_ord int, rank int, chunk_id string")
    got = fuse.fused(lists).orderBy("position").collect()
    assert [r["chunk_id"] for r in got] == ["b", "a", "c"] and got[0]["ranks"] == {"dense:0": 2, "lexical:0": 1}
    assert fuse.fused(lists, weights={"lexical": 0.0}).orderBy("position").first()["chunk_id"] == "a"


def test_metrics(spark):
    ranking = spark.createDataFrame([("q", d, n + 1) for n, d in enumerate("xayb")], "query_id string, doc string, rank int")
    qrels = spark.createDataFrame([("q", "a", 1), ("q", "b", 1), ("none", "a", 0)], "query_id string, doc string, grade int")
    got = {r["query_id"]: r for r in evals.metrics(ranking, qrels).collect()}
    want = (1 / math.log2(3) + 1 / math.log2(5)) / (1 + 1 / math.log2(3))
    assert got["q"]["ndcg10"] == pytest.approx(want, abs=1e-6) and got["q"]["mrr10"] == 0.5 and got["q"]["recall10"] == 1.0
    assert got["none"]["recall10"] is None and got["none"]["ndcg10"] == 0


def test_dense_breaks_ties_and_needs_all_vectors(spark):
    rows = spark.createDataFrame([(2, [1.0, 0.0]), (1, [1.0, 0.0]), (3, None)], "chunk_id long, embedding array<float>")
    asked = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert [r["chunk_id"] for r in search.dense_top(asked, rows.where("chunk_id < 3"), 5).orderBy("rank").collect()] == [1, 2]
    assert search.dense_top(asked, rows, 5).count() == 0
    assert search.dense_top(asked.limit(0), rows, 5).count() == 0


def test_overlap_join(spark):
    d = spark.createDataFrame([("left part. The shared sentence is here.", "The shared sentence is here. right part"), ("abc", "def")], "l string, r string")
    got = [r[0] for r in d.select(T.overlap_joined(F.col("l"), F.col("r"))).collect()]
    assert got == ["left part. The shared sentence is here. right part", "abc\n\ndef"]


def test_untitled_and_missing_neighbours(spark):
    spans = spark.createDataFrame([(1, "d", 0, 1, None, 0.5)], "query_id int, document_id string, start int, end int, section string, relevance double")
    hits = spark.createDataFrame([(1, "d", 0, 1)], "query_id int, document_id string, idx int, position int")
    documents = spark.createDataFrame([], "document_id string, title string")
    assert passages.ordered(spans, hits, documents).first()["title"] == "Untitled"


def test_gate_without_reranker(spark):
    turns = spark.createDataFrame([(1, 2, None, 1), (2, 0, 0.9, 1), (3, 2, 0.001, 2)], "turn_id int, n_passages int, confidence double, round int")
    assert [r["next"] for r in dialog.graded(turns).orderBy("turn_id").collect()] == ["generate", "reformulate", "abstain"]


def test_highlight_takes_first_and_skips_overlap(spark):
    d = spark.createDataFrame([("one two  three (two) four",)], "t string")
    got = d.select(E.highlighted(F.col("t"), F.array(F.lit(" two three "), F.lit("three"), F.lit("(two)"), F.lit("none"), F.lit("")))).first()[0]
    assert [(s["start"], s["end"]) for s in got] == [(4, 14), (15, 20)]


def test_corpus_reader(spark, tmp_path):
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text('{"_id": "1", "title": "t", "text": "x"}\n\n{"_id": "2", "text": "y"}\n')
    (tmp_path / "queries.jsonl").write_text('{"_id": "q", "text": "x?"}\n')
    (tmp_path / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\nq\t1\t1\nq\t1\t2\n")
    corpus, asked, qrels = P.read_corpus(spark, str(tmp_path))
    assert corpus.count() == 2 and asked.count() == 1 and qrels.first()["score"] == 2


def test_stream_ingest_once(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    write = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(source))
    write([(1, "one. Two."), (2, "other")])
    stream_ingest(spark, str(source), str(target), str(tmp_path / "cp")).awaitTermination(60)
    write([(3, "other"), (4, "new")])
    stream_ingest(spark, str(source), str(target), str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(r["doc_id"] for r in spark.read.parquet(str(target / "chunks")).collect()) == [1, 2, 4]


def test_stream_conversation_state(spark, tmp_path):
    source = tmp_path / "messages"
    spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "c")], "conv_id long, turn long, role string, text string").write.parquet(str(source))
    stream = spark.readStream.schema("conv_id long, turn long, role string, text string").parquet(str(source))
    q = conversation_state(stream).writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r["conv_id"], r["n_messages"], r["last_role"]) for r in spark.sql("select * from states").collect()} == {(1, 2, "assistant"), (2, 1, "user")}


def test_stream_batch_that_runs_again_keeps_its_chunks(spark, tmp_path):
    import os

    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "state"))
    put = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(source)
    count = lambda: spark.read.parquet(f"{target}/chunks").count()
    put([(1, "One text. With two sentences.")])
    stream_ingest(spark, source, target, checkpoint).awaitTermination()
    put([(2, "Another text."), (3, "One text. With two sentences.")])
    stream_ingest(spark, source, target, checkpoint).awaitTermination()
    assert count() == 2
    for name in ("1", ".1.crc"):  # as if the second batch had been cut off before its commit
        path = f"{checkpoint}/commits/{name}"
        if os.path.exists(path):
            os.remove(path)
    stream_ingest(spark, source, target, checkpoint).awaitTermination()
    assert count() == 2
    stream_ingest(spark, source, target, f"{checkpoint}-new").awaitTermination()  # all known
    assert count() == 2


def test_passages_meet_the_texts_that_hold_them(spark):
    texts = ["a b c d e f g", "xa b c d ef", "b c d", "", None, "one two", "a  b c d e"]
    asked = ["a b c d e", "b c d", "one", "two three four five six", "a b c d ef"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, passage string")
    got = sorted((r["doc"], r["query_id"]) for r in passages.holding(d, q).collect())
    assert got == sorted((i, k) for i, t in enumerate(texts) for k, a in enumerate(asked) if t and a in t)


def test_sweep_matches_plain_metrics(spark, sf):
    from lanternq.plans import all_queries

    rows = {r["config"]: r for r in all_queries.QUERIES["eval_sweep"](spark, sf).collect()}
    assert len(rows) == 6
    plain = all_queries.QUERIES["eval_ndcg"](spark, sf).agg(F.round(F.avg("ndcg10"), 4)).first()[0]
    assert rows["lexical"]["ndcg10"] == pytest.approx(plain, abs=1e-4)
