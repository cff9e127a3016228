"""Whole turns of a dialogue: plan, retrieve, grade, ask again or answer, for a table of turns at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternq.config import Settings
from lanternq.functions import text as T
from lanternq.operators import dialog as D
from lanternq.operators import events as E
from lanternq.operators.models import Models
from lanternq.plans.cascade import HYDE, hybrid, indexed, keyed
from lanternq.sources import files
from lanternq.sources.tables import materialized


def answered(
    turns: DataFrame, chunks: DataFrame, documents: DataFrame, generator: D.Generator | None = None, settings: Settings | None = None,
    analyzer: str = "simple", models: Models | None = None, allowed: DataFrame | None = None, scopes: DataFrame | None = None,
    timings: dict[str, int] | None = None,
) -> DataFrame:
    """The answer event (turn_id, status, content, blocks, sources, citations) of each turn (turn_id, question,
    history), with the rounds of retrieval it took.

    Turns meet chunks (as ``hybrid`` takes them) of documents (document_id, title, status). The status is ``chitchat``
    (nothing retrieved: no ready document, or a planned reply), ``no_evidence`` (the first passages are shown),
    ``failed`` (the generator refused or failed) or ``answered``. A turn whose plan failed searches for its
    question; one whose reformulation failed searches for it again; one for which the generator says nothing is answered
    with an empty text. ``scopes`` (turn_id, document_ids) are the documents that a turn may see, all without a row or list. Of a
    history of messages (with a role) models get the last ones, from the first of the user among them on. ``timings`` is
    filled with the milliseconds of each step of retrieval."""
    s, generator = settings or Settings(), generator or D.Extractive()
    ready = documents.where("status = 'ready'").limit(1).count() > 0
    if "role" in getattr(turns.schema["history"].dataType.elementType, "names", []):
        turns = turns.withColumn("history", D.recent(F.col("history")))
    turns = turns.join(generator.plan(turns), "turn_id", "left").withColumn("ready", F.lit(ready))
    turns = materialized(turns.join(D.planned(turns, s), "turn_id"), "turns")
    talk = turns.where("route = 'chitchat'").select("turn_id", F.lit("chitchat").alias("status"), F.when(F.col("ready"), F.col("plan.reply")).otherwise(F.lit(D.NO_DOCUMENTS)).alias("content"))
    asked = turns.where("route = 'retrieve'")
    usable = F.lit(s.query_expansion) & F.col("plan").isNotNull()
    standalone = F.when(usable, F.col("plan.standalone_question"))
    asked = asked.select("turn_id", F.coalesce(standalone, "question").alias("question"), "history", "queries", F.when(usable, F.col("plan.hypothetical_answer")).alias("hypothetical"))
    ix = indexed(keyed(chunks).select("chunk_id", "document_id", "search_text"), models, analyzer)
    if scopes is not None:
        scopes = scopes.select(F.col("turn_id").alias("query_id"), "document_ids")
    rounds: list[DataFrame] = []

    def retrieve(rows: DataFrame) -> DataFrame:
        variants = rows.select(F.col("turn_id").alias("query_id"), F.posexplode(T.deduplicated_queries(F.col("queries"))).alias("variant", "text"))
        if not rounds:  # a hypothetical answer serves the first round only
            given = asked.where("coalesce(hypothetical, '') <> ''")
            variants = variants.unionByName(given.select(F.col("turn_id").alias("query_id"), F.lit(HYDE).alias("variant"), F.col("hypothetical").alias("text")))
        questions = rows.select(F.col("turn_id").alias("query_id"), F.col("question").alias("text"))
        found = hybrid(chunks, questions, documents, s, analyzer, variants, models, allowed, ix, scopes, timings)
        rounds.append(materialized(found.withColumnRenamed("query_id", "turn_id").withColumn("round", F.lit(len(rounds) + 1)), "passages"))
        counts = rounds[-1].groupBy("turn_id").agg(F.count("*").alias("n_passages"), F.max("confidence").alias("confidence"))
        return rows.select("turn_id").join(counts, "turn_id", "left").withColumn("n_passages", F.coalesce("n_passages", F.lit(0)))

    ends = materialized(D.corrective_loop(asked.select("turn_id", "question", "queries"), retrieve, generator.reformulate, s), "ends")
    passages = rounds[0]
    for more in rounds[1:]:
        passages = passages.unionByName(more)
    source = F.struct(
        F.col("id").cast("int").alias("id"), F.col("document_id").cast("string").alias("document_id"), "title",
        T.location(F.col("page_start"), F.col("page_end"), F.col("section")).alias("location"), "text", F.col("relevance").cast("double").alias("relevance"),
    )
    met = passages.join(ends.select("turn_id", "round"), ["turn_id", "round"]).groupBy("turn_id").agg(F.sort_array(F.collect_list(source)).alias("passages"))
    graded = asked.join(ends, "turn_id").join(met, "turn_id", "left").withColumn("passages", F.coalesce("passages", F.array().cast(f"array<{D.SOURCE}>")))
    graded = materialized(graded, "graded")
    none = graded.where("next = 'abstain'").select("turn_id", F.lit("no_evidence").alias("status"), F.lit(D.NO_EVIDENCE).alias("content"), F.slice("passages", 1, 3).alias("sources"), "round")
    told = generated(graded.where("next = 'generate'"), generator)
    out = told.unionByName(none, allowMissingColumns=True).unionByName(talk, allowMissingColumns=True)
    return D.finished(out).join(out.select("turn_id", F.coalesce("round", F.lit(0)).alias("rounds")), "turn_id")


def continued(messages: DataFrame, chunks: DataFrame, documents: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """The answers to the last message of each thread (conv_id, turn, role, text), and the threads with these answers appended."""
    answers = materialized(answered(D.started(messages), chunks, documents, **options), "answers")
    return answers, D.with_answers(messages, answers)


def asked_of_folder(folder: str, messages: DataFrame, pdf=None, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From files to answers: the files below ``folder`` are read, parsed, chunked and asked. Returns the documents, with those that
    failed, and what ``continued`` gives."""
    s = options.get("settings") or Settings()
    documents, chunks = files.ingested(files.read_folder(messages.sparkSession, folder, most_mb=s.max_upload_mb), s, pdf)
    return documents, *continued(messages, chunks, documents, **options)


def generated(turns: DataFrame, generator: D.Generator) -> DataFrame:
    """(turn_id, status, content, blocks, sources, citations, round) of turns (turn_id, ..., passages, round) that are to be answered."""
    events = materialized(E.numbered_blocks(generator.answer(turns)), "answer-events")
    told = E.folded_answers(events.where("kind = 'text'"))
    cited = events.where("kind = 'citation' AND passage IS NOT NULL").groupBy("turn_id").agg(F.sort_array(F.collect_list(F.struct("pos", F.struct("block", "passage", "text").alias("c")))).alias("l"))
    cited = cited.select("turn_id", F.transform("l", lambda x: x["c"]).cast(f"array<{D.CITATION}>").alias("citations"))
    why = F.when(F.col("kind") == "refusal", F.lit(D.REFUSED)).otherwise(F.col("text"))
    broken = events.where("kind IN ('refusal', 'error')").groupBy("turn_id").agg(F.min_by(why, "pos").alias("why"))
    rows = turns.select("turn_id", F.col("passages").alias("sources"), "round").join(told, "turn_id", "left").join(cited, "turn_id", "left").join(broken, "turn_id", "left")
    bad = F.col("why").isNotNull()
    content = F.when(bad, F.concat(F.lit(D.FAILED), "why")).otherwise(F.array_join("blocks", ""))
    return rows.select(
        "turn_id", F.when(bad, "failed").otherwise("answered").alias("status"), content.alias("content"), F.when(~bad, F.col("blocks")).alias("blocks"),
        "sources", F.when(~bad, F.col("citations")).alias("citations"), "round",
    )
