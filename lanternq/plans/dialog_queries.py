"""Queries of the registry, the dialogue, its events and conversation state."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanternq.operators import dialog as D
from lanternq.operators import events as E
from lanternq.operators import index, passages
from lanternq.plans.registry import query, table
from lanternq.plans.retrieval_queries import lines
from lanternq.sources.tables import materialized


def registry(spark, sf, where="true"):
    """The documents, some of them failed. Queries that add to a registry start from a part of it (``where``)."""
    d = table(spark, sf, "documents").where(where)
    status = F.when(F.col("doc_id") % 2 == 0, "ready").when(F.col("doc_id") % 5 == 0, "failed").otherwise("processing")
    return d.select(
        F.col("doc_id").alias("id"), F.sha2("text", 256).alias("hash"), F.col("source").alias("title"), F.concat("source", F.lit(".txt")).alias("filename"),
        F.lit(None).cast("int").alias("pages"), (F.col("doc_id") % 4).cast("int").alias("chunk_count"), status.alias("status"), F.lit(None).cast("string").alias("error"),
    )


_PART = "doc_id % 3 = 0"
_R = "rg AS (SELECT doc_id AS id, sha256(text) AS hash, source AS title, source || '.txt' AS filename, NULL::INTEGER AS pages, (doc_id % 4)::INTEGER AS chunk_count, CASE WHEN doc_id % 2 = 0 THEN 'ready' WHEN doc_id % 5 = 0 THEN 'failed' ELSE 'processing' END AS status, NULL::VARCHAR AS error FROM documents)"
_RP = _R.replace("FROM documents)", f"FROM documents WHERE {_PART})")


@query(f"WITH {_RP} SELECT doc_id, hash FROM (SELECT doc_id, sha256(text) AS hash, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1 AND hash NOT IN (SELECT hash FROM rg WHERE status <> 'failed')")
def register_dedupe(spark, sf):
    incoming = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("hash"), F.col("doc_id").alias("order"))
    return index.to_register(incoming, registry(spark, sf, _PART)).select("doc_id", "hash")


@query(f"WITH {_RP}, ch AS (SELECT doc_id AS id, 'new ' || lang AS title, 'other.txt' AS filename, 7 AS pages, 9 AS chunk_count, 'ready' AS status, NULL AS error FROM documents WHERE doc_id % 4 = 0) SELECT coalesce(rg.id, ch.id) AS id, coalesce(ch.title, rg.title) AS title, coalesce(rg.filename, ch.filename) AS filename, CASE WHEN ch.id IS NULL THEN rg.pages ELSE ch.pages END AS pages, coalesce(ch.chunk_count, rg.chunk_count) AS chunk_count, coalesce(ch.status, rg.status) AS status FROM rg FULL JOIN ch ON rg.id = ch.id")
def doc_upsert(spark, sf):
    changes = table(spark, sf, "documents").where("doc_id % 4 = 0").select(
        F.col("doc_id").alias("id"), F.lit("h").alias("hash"), F.concat(F.lit("new "), "lang").alias("title"), F.lit("other.txt").alias("filename"),
        F.lit(7).alias("pages"), F.lit(9).alias("chunk_count"), F.lit("ready").alias("status"), F.lit(None).cast("string").alias("error"),
    )
    return index.upserted(registry(spark, sf, _PART), changes).select("id", "title", "filename", "pages", "chunk_count", "status")


_L = "li AS (SELECT doc_id || ':' || (n - 1) AS id, doc_id AS document_id, n - 1 AS idx, l[n] AS text FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"


def _chunks(spark, sf):
    return lines(spark, sf).select(F.col("chunk_id").alias("id"), "document_id", "idx", "text")


@query(f"WITH {_L} SELECT id, document_id, idx, CASE WHEN document_id % 2 = 0 THEN text ELSE 'again' END AS text FROM li")
def chunk_append_idempotent(spark, sf):
    rows = _chunks(spark, sf)
    new = rows.withColumn("text", F.lit("again"))
    return index.appended(rows.where("document_id % 2 = 0"), new.unionByName(new))


@query(f"WITH {_L} SELECT id, document_id, idx FROM li WHERE document_id % 7 <> 0")
def delete_cascade(spark, sf):
    gone = table(spark, sf, "documents").where("doc_id % 7 = 0").select(F.col("doc_id").alias("document_id"))
    return index.without_documents(_chunks(spark, sf), gone).select("id", "document_id", "idx")


@query(f"WITH {_R} SELECT id, status FROM rg WHERE hash IN (SELECT sha256(text) FROM documents)")
def find_by_hash(spark, sf):
    wanted = table(spark, sf, "documents").select(F.sha2("text", 256).alias("hash")).distinct()
    return registry(spark, sf).join(wanted, "hash", "left_semi").select("id", "status")


@query(f"WITH {_R} SELECT id, title, status, chunk_count FROM rg")
def list_documents(spark, sf):
    """The registry, newest first, with creation times made from the id."""
    made = registry(spark, sf).withColumn("created_at", F.timestamp_seconds(F.col("id") * 7919 % 1009))
    return index.newest_first(made).select("id", "title", "status", "chunk_count")


@query(f"WITH {_L} SELECT id, document_id, idx, text FROM li")
def index_roundtrip(spark, sf):
    """Chunks written to Parquet, clustered by document, and read back."""
    return materialized(_chunks(spark, sf), "index", "document_id", "idx")


@query("SELECT name, size_ok, status FROM (SELECT page_id || ['.html', '.exe'][page_id % 2 + 1] AS name, length(html) <= 3000 AS size_ok, CASE WHEN page_id % 2 = 1 THEN 415 WHEN length(html) > 3000 THEN 413 ELSE 202 END AS status FROM pages)")
def upload_validation(spark, sf):
    from lanternq.sources.parse import file_format

    rows = table(spark, sf, "pages").select(F.concat("page_id", F.when(F.col("page_id") % 2 == 0, ".html").otherwise(".exe")).alias("name"), (F.length("html") <= 3000).alias("size_ok"))
    return rows.withColumn("status", F.when(file_format(F.col("name")).isNull(), 415).when(~F.col("size_ok"), 413).otherwise(202))


def chat_events(spark, sf):
    """An event log from conversations: a system row is a retrieval, a user row a citation or an error, an
    assistant row a delta, and the last assistant row of every third conversation the answer."""
    from pyspark.sql import Window as W

    rows = table(spark, sf, "conversations").withColumn("last", F.max("turn").over(W.partitionBy("conv_id")))
    event = (
        F.when(F.col("role") == "system", "retrieval")
        .when((F.col("role") == "assistant") & (F.col("turn") == F.col("last")) & (F.col("conv_id") % 3 == 0), "answer")
        .when(F.col("role") == "assistant", "delta")
        .when((F.col("conv_id") % 11 == 5) & (F.col("turn") == F.col("last")), "error")
        .otherwise("citation")
    )
    return rows.select(F.col("conv_id").alias("turn_id"), F.col("turn").alias("pos"), event.alias("event"), (F.floor(F.col("turn") / 4)).cast("long").alias("block"), "text", F.lit("answered").alias("status"))


_EV = "ev AS (SELECT conv_id AS turn_id, turn AS pos, CASE WHEN role = 'system' THEN 'retrieval' WHEN role = 'assistant' AND turn = m AND conv_id % 3 = 0 THEN 'answer' WHEN role = 'assistant' THEN 'delta' WHEN conv_id % 11 = 5 AND turn = m THEN 'error' ELSE 'citation' END AS event, turn // 4 AS block, text, 'answered' AS status FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS m FROM conversations))"


@query(f"WITH {_EV} SELECT turn_id, pos, 'event: ' || event || chr(10) || 'data: ' || to_json(struct_pack(block := block, n := length(text))) || chr(10) || chr(10) AS message FROM ev")
def sse_encode(spark, sf):
    return chat_events(spark, sf).select("turn_id", "pos", E.encoded(F.col("event"), F.struct("block", F.length("text").alias("n"))).alias("message"))


@query(f"WITH {_EV} SELECT turn_id, pos::INTEGER AS pos, event, block, length(text)::BIGINT AS n FROM ev")
def sse_decode(spark, sf):
    """A conversation's events as one stream with CRLF line ends, decoded again."""
    rows = chat_events(spark, sf).withColumn("m", E.encoded(F.col("event"), F.struct("pos", "block", F.length("text").alias("n"))))
    stream = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]), "")
    rows = rows.groupBy("turn_id").agg(F.replace(stream, F.lit("\n"), F.lit("\r\n")).alias("stream"))
    rows = rows.select("turn_id", F.explode(E.decoded(F.col("stream"))).alias("e")).select("turn_id", "e.event", F.from_json("e.data", "pos int, block bigint, n bigint").alias("d"))
    return rows.select("turn_id", "event", "d.pos", "d.block", "d.n")


@query(f"WITH {_EV}, b AS (SELECT turn_id, block, string_agg(text, '' ORDER BY pos) AS t FROM ev WHERE event IN ('delta', 'answer') GROUP BY ALL), s AS (SELECT turn_id, unnest(range(0, max(block) + 1)) AS block FROM b GROUP BY turn_id) SELECT turn_id, block::INTEGER AS block, coalesce(t, '') AS text FROM s LEFT JOIN b USING (turn_id, block)")
def answer_fold(spark, sf):
    rows = chat_events(spark, sf).where("event IN ('delta', 'answer')").withColumn("kind", F.lit("text"))
    return E.folded_answers(rows).select("turn_id", F.posexplode("blocks").alias("block", "text"))


@query("SELECT conv_id AS turn_id, turn AS pos, sum((role = 'user')::INTEGER) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT - 1 AS block FROM conversations")
def citation_map(spark, sf):
    kind = F.when(F.col("role") == "user", "block_start").otherwise("citation")
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("turn_id"), F.col("turn").alias("pos"), kind.alias("kind"))
    return E.numbered_blocks(rows).select("turn_id", "pos", "block")


@query(f"""WITH {_EV}, c AS (SELECT turn_id, count_if(event = 'retrieval') AS n_retrievals, count_if(event = 'citation') AS n_citations, max(CASE WHEN event = 'error' THEN text END) AS error, arg_max(CASE WHEN event = 'answer' THEN text END, pos) AS answer, string_agg(CASE WHEN event = 'delta' THEN text END, '' ORDER BY pos) AS streamed FROM ev GROUP BY turn_id)
SELECT turn_id, CASE WHEN error IS NOT NULL THEN 'failed' WHEN answer IS NOT NULL THEN 'answered' ELSE 'running' END AS status, error, coalesce(answer, streamed, '') AS shown, n_retrievals, n_citations FROM c""")
def turn_reduce(spark, sf):
    return E.folded_turns(chat_events(spark, sf)).select("turn_id", "status", "error", F.array_join("blocks", "").alias("shown"), "n_retrievals", "n_citations")


def _citations(spark, sf):
    """Every user row cites a passage; some passages are not among the four sources."""
    rows = table(spark, sf, "conversations").where("role = 'user'")
    return rows.select(F.col("conv_id").alias("turn_id"), F.col("turn").alias("pos"), (F.length("text") % 5).cast("long").alias("passage"), F.floor(F.col("turn") / 4).cast("long").alias("block"))


def _sources(spark, sf):
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("turn_id")).distinct().withColumn("id", F.explode(F.array(*[F.lit(x).cast("long") for x in range(4)])))


_CS = """ci AS (SELECT conv_id AS turn_id, turn AS pos, length(text) % 5 AS passage, turn // 4 AS block FROM conversations WHERE role = 'user'),
so AS (SELECT DISTINCT conv_id AS turn_id, id FROM conversations, range(4) AS r(id)),
fi AS (SELECT turn_id, passage, row_number() OVER (PARTITION BY turn_id ORDER BY min(pos)) AS n FROM ci GROUP BY turn_id, passage),
cs AS (SELECT fi.turn_id, passage AS source, n FROM fi JOIN so ON so.turn_id = fi.turn_id AND so.id = passage UNION ALL SELECT turn_id, id, id + 1 FROM so WHERE turn_id NOT IN (SELECT turn_id FROM fi))"""


@query(f"WITH {_CS} SELECT * FROM cs")
def cited_sources(spark, sf):
    return E.cited_sources(_citations(spark, sf), _sources(spark, sf)).withColumn("n", F.col("n").cast("long"))


@query(f"""WITH {_CS}, m AS (SELECT turn_id, block, string_agg('[' || n || '](#cite-' || n || ')', '' ORDER BY p) AS marks FROM (SELECT ci.turn_id, block, n, min(pos) AS p FROM ci JOIN cs ON cs.turn_id = ci.turn_id AND cs.source = passage GROUP BY ALL) GROUP BY turn_id, block)
SELECT turn_id, block, 'text' || marks || ' ' || chr(10) AS marked FROM m""")
def citation_markers(spark, sf):
    numbers = E.cited_sources(_citations(spark, sf), _sources(spark, sf)).withColumnRenamed("source", "passage")
    rows = _citations(spark, sf).join(numbers, ["turn_id", "passage"]).groupBy("turn_id", "block").agg(F.sort_array(F.collect_list(F.struct("pos", "n"))).alias("l"))
    return rows.select("turn_id", "block", E.with_markers(F.lit("text \n"), F.transform("l", lambda x: x["n"])).alias("marked"))


@query()
def citation_highlight(spark, sf):
    """Each benchmark passage, as quotes of 40 characters one after the other, found again in the documents that hold it."""
    documents = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text")
    pairs = passages.holding(documents, table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage")))
    pairs = pairs.select(F.col("doc").alias("doc_id"), F.col("query_id").alias("item_id"), "text", "passage")
    quotes = F.transform(F.sequence(F.lit(0), F.floor((F.length("passage") - 1) / 40).cast("int")), lambda i: F.substring(F.col("passage"), i * 40 + 1, F.lit(40)))
    return pairs.select("doc_id", "item_id", F.explode(E.highlighted(F.col("text"), quotes)).alias("s")).select("doc_id", "item_id", "s.start", "s.end")


def _plan_json():
    return (
        F.when(F.col("conv_id") % 5 == 0, F.lit("{broken"))
        .otherwise(F.to_json(F.struct((F.col("conv_id") % 3 != 0).alias("needs_retrieval"), F.col("text").alias("standalone_question"), F.array(*[F.concat(F.lit(f"q{i} "), "lang_") for i in range(4)]).alias("search_queries"), F.when(F.col("conv_id") % 2 == 0, "hello").alias("reply"))))
    )


def _turns(spark, sf):
    return table(spark, sf, "conversations").where("role = 'user'").withColumn("lang_", (F.col("conv_id") % 4).cast("string")).withColumn("json", _plan_json())


@query("SELECT conv_id, turn, conv_id % 5 <> 0 AS valid, CASE WHEN conv_id % 5 <> 0 THEN text END AS question, CASE WHEN conv_id % 5 <> 0 THEN 4 END AS n FROM conversations WHERE role = 'user'")
def json_plan_parse(spark, sf):
    rows = _turns(spark, sf).withColumn("plan", D.parsed_plan(F.col("json")))
    return rows.select("conv_id", "turn", F.col("plan").isNotNull().alias("valid"), F.col("plan.standalone_question").alias("question"), F.when(F.col("plan").isNotNull(), F.size("plan.search_queries")).alias("n"))


@query("""SELECT turn_id, route, CASE WHEN route = 'chitchat' THEN '' WHEN conv_id % 5 = 0 THEN text ELSE concat_ws(' / ', text, 'q0 ' || conv_id % 4, 'q1 ' || conv_id % 4, 'q2 ' || conv_id % 4) END AS asked FROM (SELECT conv_id, text, conv_id || ':' || turn AS turn_id,
CASE WHEN conv_id % 13 = 0 THEN 'chitchat' WHEN conv_id % 5 = 0 THEN 'retrieve' WHEN conv_id % 3 = 0 AND conv_id % 2 = 0 THEN 'chitchat' ELSE 'retrieve' END AS route FROM conversations WHERE role = 'user')""")
def plan_queries(spark, sf):
    rows = _turns(spark, sf).select(F.concat("conv_id", F.lit(":"), "turn").alias("turn_id"), F.col("text").alias("question"), (F.col("conv_id") % 13 != 0).alias("ready"), D.parsed_plan(F.col("json")).alias("plan"))
    return D.planned(rows).select("turn_id", "route", F.array_join("queries", " / ").alias("asked"))


@query("""SELECT doc_id AS turn_id, round, CASE WHEN NOT weak THEN 'generate' WHEN round < 2 THEN 'reformulate' ELSE 'abstain' END AS next FROM (SELECT doc_id, (doc_id % 2 + 1)::INTEGER AS round, CASE WHEN doc_id % 4 = 0 THEN true WHEN doc_id % 3 = 0 THEN false ELSE (doc_id % 7) / 100 < 0.02 END AS weak FROM documents)""")
def relevance_gate(spark, sf):
    turns = table(spark, sf, "documents").select(F.col("doc_id").alias("turn_id"), (F.col("doc_id") % 4).alias("n_passages"), F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 7 / 100).alias("confidence"), (F.col("doc_id") % 2 + 1).cast("int").alias("round"))
    return D.graded(turns).select("turn_id", "round", "next")


@query("""SELECT item_id AS turn_id, CASE WHEN item_id % 3 = 0 THEN 1 ELSE 2 END AS round, CASE WHEN item_id % 3 = 0 OR item_id % 3 = 1 THEN 'generate' ELSE 'abstain' END AS next FROM benchmark""")
def corrective_loop(spark, sf):
    """Questions with a third each that find evidence at once, after reformulation, and never."""
    turns = table(spark, sf, "benchmark").select(F.col("item_id").alias("turn_id"), F.col("text").alias("question"), F.array("text").alias("queries"))

    def retrieve(asked):
        found = (F.col("turn_id") % 3 == 0) | ((F.col("turn_id") % 3 == 1) & (F.size("queries") > 1))
        return asked.select("turn_id", F.when(found, 2).otherwise(0).alias("n_passages"), F.when(found, 0.5).alias("confidence"))

    def reformulate(weak):
        return weak.select("turn_id", F.array(F.lit("other words")).alias("new"))

    return D.corrective_loop(turns, retrieve, reformulate).select("turn_id", "round", "next")


@query("SELECT doc_id, id FROM (SELECT doc_id, unnest(range(0, doc_id % 6)) AS id FROM documents) WHERE id < 3")
def abstain_sources(spark, sf):
    rows = table(spark, sf, "documents").where("doc_id % 6 > 0").select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("doc_id") % 6 - 1)).alias("id"))
    return D.abstained(rows)


@query("SELECT conv_id, turn, role FROM (SELECT *, max((role = 'user')::INTEGER) OVER (PARTITION BY conv_id ORDER BY turn) AS started FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 4) WHERE started = 1")
def history_window(spark, sf):
    return D.history(table(spark, sf, "conversations"), 4).select("conv_id", "turn", "role")


@query("SELECT conv_id, count(*)::INTEGER AS n, string_agg(role, ',' ORDER BY turn) AS roles, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id")
def thread_history(spark, sf):
    rows = D.threads(table(spark, sf, "conversations"))
    chars = F.aggregate("messages", F.lit(0).cast("long"), lambda n, x: n + F.length(x["text"]))
    return rows.select("conv_id", F.size("messages").alias("n"), F.array_join(F.transform("messages", lambda x: x["role"]), ",").alias("roles"), chars.alias("chars"))


@query()
def ingest_pipeline(spark, sf):
    """Pages from HTML to chunks: parsed, registered by hash, cut and counted, with failures as a status."""
    from lanternq.operators.chunk import chunked
    from lanternq.sources.parse import html_document, parsed_with

    pages = table(spark, sf, "pages").select("page_id", "html")
    first = index.to_register(pages.select("page_id", "html", F.sha2("html", 256).alias("hash"), F.col("page_id").alias("order")), spark.createDataFrame([], "hash string, status string"))
    parsed = materialized(parsed_with(first, "page_id", "html", html_document), "parsed")  # parsed once for status and chunks
    blocks = parsed.select(F.col("page_id").alias("doc_id"), F.posexplode("blocks").alias("pos", "b")).select("doc_id", "pos", "b.*")
    counts = chunked(blocks, 320, 48).groupBy(F.col("doc_id").alias("page_id")).agg(F.count("*").alias("chunks"), F.sum("tokens").alias("tokens"))
    status = F.when(F.col("error").isNull(), "ready").otherwise("failed")
    return parsed.join(counts, "page_id", "left").select("page_id", "title", status.alias("status"), "error", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("tokens", F.lit(0)).alias("tokens"))


@query("SELECT conv_id, count(*) AS n_messages, arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id")
def conversation_fold(spark, sf):
    """The final state of each conversation, in batch; the streaming module keeps the same state."""
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.max_by("role", "turn").alias("last_role"))


_REQ = "rq AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN '' ELSE text END AS message, CASE conv_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'conv-' || conv_id WHEN 2 THEN 'conv ' || conv_id ELSE repeat('a', 60 + turn) END AS thread_id, CASE WHEN conv_id % 3 <> 0 THEN 97 + turn END AS n FROM conversations)"


@query(rf"WITH {_REQ} SELECT conv_id, turn, coalesce(length(message) BETWEEN 1 AND 4000, false) AND (thread_id IS NULL OR regexp_full_match(thread_id, '[A-Za-z0-9_-]{{1,64}}')) AND (n IS NULL OR n <= 100) AS valid FROM rq")
def request_validation(spark, sf):
    """Every message as a request, some of them empty, with thread ids and document lists within and beyond the bounds."""
    c, t = F.col("conv_id"), F.col("turn")
    message = F.when(t % 5 == 4, "").otherwise(F.col("text"))
    thread = F.when(c % 4 == 0, F.lit(None).cast("string")).when(c % 4 == 1, F.concat(F.lit("conv-"), c)).when(c % 4 == 2, F.concat(F.lit("conv "), c)).otherwise(F.repeat(F.lit("a"), (60 + t).cast("int")))
    documents = F.when(c % 3 != 0, F.array_repeat(F.lit("d"), (97 + t).cast("int")))
    return table(spark, sf, "conversations").select("conv_id", "turn", D.valid_request(message, thread, documents).alias("valid"))


@query("SELECT conv_id AS turn_id, arg_max(text, turn) AS question, count(*) - 1 AS before FROM conversations GROUP BY conv_id")
def turn_start(spark, sf):
    return D.started(table(spark, sf, "conversations")).select("turn_id", "question", F.size("history").cast("long").alias("before"))


def _answers(spark, sf):
    """An answer for each conversation: three in four have sources, every other one cites, every third has blocks."""
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.max_by("text", "turn").alias("content"), F.count("*").alias("n"))
    one = lambda i: F.struct(i.cast("int").alias("id"), F.lit("d").alias("document_id"), F.lit("t").alias("title"), F.lit("").alias("location"), F.lit("").alias("text"), F.lit(1.0).alias("relevance"))
    sources = F.transform(F.sequence(F.lit(0), (F.col("conv_id") % 4 - 1).cast("int"), F.lit(1)), one)
    cite = F.array(F.struct(F.lit(0).cast("long").alias("block"), (F.col("n") % 3).cast("int").alias("passage"), F.lit("q").alias("text")))
    return rows.select(
        F.col("conv_id").alias("turn_id"), F.lit("answered").alias("status"), "content", F.when(F.col("conv_id") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).alias("blocks"),
        F.when(F.col("conv_id") % 4 > 0, sources).alias("sources"), F.when(F.col("conv_id") % 2 == 0, cite).alias("citations"),
    )


_AN = "an AS (SELECT conv_id AS turn_id, arg_max(text, turn) AS content, count(*) AS n, conv_id % 4 AS k FROM conversations GROUP BY conv_id)"


@query(f"WITH {_AN} SELECT turn_id, CASE WHEN turn_id % 3 = 0 THEN 'a|b' ELSE content END AS blocks, k AS sources, (turn_id % 2 = 0)::BIGINT AS citations FROM an")
def finish_answer(spark, sf):
    out = D.finished(_answers(spark, sf))
    return out.select("turn_id", F.array_join("blocks", "|").alias("blocks"), F.size("sources").cast("long").alias("sources"), F.size("citations").cast("long").alias("citations"))


@query(f"WITH {_AN} SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT turn_id, n, 'assistant', content FROM (SELECT an.turn_id, an.content, m + 1 AS n FROM an JOIN (SELECT conv_id, max(turn) AS m FROM conversations GROUP BY conv_id) t ON t.conv_id = an.turn_id)")
def thread_append(spark, sf):
    return D.with_answers(table(spark, sf, "conversations"), D.finished(_answers(spark, sf)))


@query(f"WITH {_AN} SELECT turn_id, string_agg(id, ',' ORDER BY id) AS shown FROM (SELECT turn_id, n, unnest(range(k)) AS id FROM an WHERE k > 0) WHERE turn_id % 2 = 1 OR id = n % 3 GROUP BY turn_id")
def shown_sources(spark, sf):
    """What is printed below each answer that shows any source."""
    out = D.finished(_answers(spark, sf)).withColumn("shown", E.shown_sources(F.col("sources"), F.col("citations"))).where(F.size("shown") > 0)
    return out.select("turn_id", F.array_join(F.transform("shown", lambda x: x["id"]), ",").alias("shown"))


@query("SELECT doc_id, left(source || ' ' || text, 200) AS title FROM documents")
def prompt_title(spark, sf):
    from lanternq.operators.context import prompt_title as cut

    return table(spark, sf, "documents").select("doc_id", cut(F.concat_ws(" ", "source", "text")).alias("title"))


@query("SELECT page_id, replace(url, '/', '__') AS slug FROM pages")
def slug_names(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.replace("url", F.lit("/"), F.lit("__")).alias("slug"))


@query(r"""SELECT d.doc_id, CASE WHEN d.doc_id % 4 = 1 THEN 'failed' ELSE 'ready' END AS status, CASE WHEN d.doc_id % 4 = 1 THEN 'Unsupported file type: .exe' END AS error, 'file ' || d.doc_id AS title
FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY '/in/file_' || doc_id || '.' || ['txt', 'exe', 'TXT', 'md'][doc_id % 4 + 1]) AS n FROM documents) d WHERE n = 1 AND regexp_matches(text, '\S')""")
def ingest_files(spark, sf):
    """Documents as files of three kinds, one of them unsupported: registered by content, read, and their status.
    Texts of nothing but white space are left out here: they are one failed file."""
    from lanternq.sources.files import parsed

    suffix = F.get(F.array(*[F.lit(x) for x in ("txt", "exe", "TXT", "md")]), (F.col("doc_id") % 4).cast("int"))
    files = table(spark, sf, "documents").where(F.col("text").rlike(r"\S")).select(F.concat(F.lit("/in/file_"), "doc_id", F.lit("."), suffix).alias("path"), F.col("text").cast("binary").alias("content"))
    documents, _ = parsed(files)
    return documents.select(F.regexp_extract("path", r"_(\d+)\.", 1).cast("long").alias("doc_id"), "status", "error", "title")
