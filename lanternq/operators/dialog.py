"""Dialogue steps over tables of turns: planning, the relevance gate, the corrective loop and history."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lanternq.config import Settings
from lanternq.functions.text import sentences, simple_terms

PLAN = "needs_retrieval boolean, standalone_question string, search_queries array<string>, hypothetical_answer string, reply string"


# What a turn without an answer says.
NO_DOCUMENTS = "Upload a document first, then ask about it."
NO_EVIDENCE = "I couldn't find information about this in your documents. The closest passages I found are listed below; try rephrasing or uploading a document that covers the topic."
FAILED = "Sorry, I couldn't generate an answer: "
REFUSED = "The model declined to answer this request."
# Bounds of a request.
MESSAGE_CHARS, THREAD_ID, REQUEST_DOCUMENTS = 4000, "^[A-Za-z0-9_-]{1,64}$", 100

SOURCE = "struct<id: int, document_id: string, title: string, location: string, text: string, relevance: double>"
CITATION = "struct<block: long, passage: int, text: string>"


class Generator(Protocol):
    """What a language model has to offer; rows in, rows out.

    ``plan``: turns (turn_id, question, history) to (turn_id, plan), plan null where planning failed.
    ``reformulate``: turns (turn_id, question, queries) to (turn_id, new array<string>), without the turns it failed for.
    ``answer``: turns (turn_id, question, history, passages array) to events (turn_id, pos, kind, text, passage) of
    kinds block_start, text, citation, refusal and error."""

    def plan(self, turns: DataFrame) -> DataFrame: ...

    def reformulate(self, turns: DataFrame) -> DataFrame: ...

    def answer(self, turns: DataFrame) -> DataFrame: ...


class Extractive:
    """A deterministic generator that needs no model: the question is the plan, its longest words in order are the
    other query, and the answer is the first sentence of each of the first passages, cited."""

    def __init__(self, passages: int = 3, words: int = 8) -> None:
        self.passages, self.words = passages, words

    def plan(self, turns: DataFrame) -> DataFrame:
        return turns.select("turn_id", F.from_json(F.lit(None).cast("string"), PLAN).alias("plan"))

    def reformulate(self, turns: DataFrame) -> DataFrame:
        terms = F.array_distinct(simple_terms(F.col("question")))
        longest = F.slice(F.array_sort(F.transform(terms, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), 1, self.words)
        return turns.select("turn_id", F.array(F.array_join(F.transform(longest, lambda x: x["t"]), " ")).alias("new"))

    def answer(self, turns: DataFrame) -> DataFrame:
        rows = turns.select("turn_id", F.posexplode(F.slice("passages", 1, self.passages)).alias("n", "p"))
        first = F.get(sentences(F.col("p.text")), F.lit(0))
        said = F.array(
            F.struct(F.lit("block_start").alias("kind"), F.lit("").alias("text"), F.lit(None).cast("int").alias("passage")),
            F.struct(F.lit("text").alias("kind"), F.coalesce(first, F.lit("")).alias("text"), F.lit(None).cast("int").alias("passage")),
            F.struct(F.lit("citation").alias("kind"), F.coalesce(first, F.lit("")).alias("text"), F.col("p.id").alias("passage")),
        )
        return rows.select("turn_id", "n", F.posexplode(said).alias("m", "e")).select("turn_id", (F.col("n") * 3 + F.col("m")).alias("pos"), "e.*")


def parsed_plan(text: Column) -> Column:
    """A plan from a model's JSON; null where it is malformed or has no standalone question."""
    plan = F.from_json(text, PLAN, {"mode": "PERMISSIVE"})
    return F.when(plan["standalone_question"].isNotNull() & plan["needs_retrieval"].isNotNull(), plan)


def planned(turns: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Turns (turn_id, question, ready, plan) with route and queries. Without ready documents a turn is small talk;
    without a plan (none asked for, or malformed) the question itself is the query; small talk needs both no
    retrieval and a reply; else the standalone question and the first three search queries are asked."""
    expand = (settings or Settings()).query_expansion
    plan = F.col("plan")
    talk = ~plan["needs_retrieval"] & (F.coalesce(plan["reply"], F.lit("")) != "")
    none = plan.isNull() | ~F.lit(expand)
    route = F.when(~F.col("ready"), "chitchat").when(none, "retrieve").when(talk, "chitchat").otherwise("retrieve")
    first = F.concat(F.array(plan["standalone_question"]), F.slice(F.coalesce(plan["search_queries"], F.array().cast("array<string>")), 1, 3))
    queries = F.when(route == "chitchat", F.array().cast("array<string>")).when(none, F.array("question")).otherwise(first)
    return turns.select("turn_id", route.alias("route"), queries.alias("queries"))


def graded(turns: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Turns (turn_id, n_passages, confidence, round) with next: generate, reformulate or abstain. No passages is
    weak evidence; no confidence (no reranker) is strong; else confidence decides."""
    s = settings or Settings()
    weak = F.when(F.col("n_passages") == 0, True).when(F.col("confidence").isNull(), False).otherwise(F.col("confidence") < s.min_relevance)
    step = F.when(~weak, "generate").when(F.col("round") < s.max_retrieval_rounds, "reformulate").otherwise("abstain")
    return turns.withColumn("next", step)


def corrective_loop(turns: DataFrame, retrieve: Callable[[DataFrame], DataFrame], reformulate: Callable[[DataFrame], DataFrame], settings: Settings | None = None) -> DataFrame:
    """Retrieves for all turns (turn_id, question, queries), grades, and asks again for the weak ones with
    reformulated queries (the question and the first three new ones). ``retrieve`` returns (turn_id,
    n_passages, confidence); ``reformulate`` returns (turn_id, new array<string>). The rounds are at most
    three and unrolled. Returns (turn_id, round, n_passages, confidence, next)."""
    s = settings or Settings()
    open_, done = turns.select("turn_id", "question", "queries"), None
    for number in range(1, s.max_retrieval_rounds + 1):
        got = graded(retrieve(open_).withColumn("round", F.lit(number)), s)
        final = got if number == s.max_retrieval_rounds else got.where("next <> 'reformulate'")
        done = final if done is None else done.unionByName(final)
        if number < s.max_retrieval_rounds:
            if not got.where("next = 'reformulate'").limit(1).count():
                break
            weak = open_.join(got.where("next = 'reformulate'").select("turn_id"), "turn_id", "left_semi")
            new = reformulate(weak)
            first = F.concat(F.array("question"), F.slice(F.coalesce("new", F.array().cast("array<string>")), 1, 3))
            open_ = weak.join(new, "turn_id", "left").select("turn_id", "question", first.alias("queries"))
    return done


def history(messages: DataFrame, last: int = 8) -> DataFrame:
    """The last messages (conv_id, turn, role, text) of each conversation from the first user turn among them on."""
    recent = messages.withColumn("back", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))).where(F.col("back") <= last)
    started = F.max((F.col("role") == "user").cast("int")).over(W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0))
    return recent.withColumn("started", started).where("started = 1").drop("back", "started")


def recent(messages: Column, last: int = 8) -> Column:
    """The same of an array of messages in order (with a role)."""
    tail = F.slice(messages, F.greatest(F.size(messages) - last, F.lit(0)) + 1, F.lit(last))
    first = F.array_position(F.transform(tail, lambda m: m["role"] == "user"), F.lit(True)).cast("int")
    return F.when(first > 0, F.slice(tail, first, F.lit(last))).otherwise(F.slice(messages, F.lit(1), F.lit(0)))


def threads(messages: DataFrame) -> DataFrame:
    """(conv_id, messages): the messages of each conversation in order."""
    rows = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return messages.groupBy("conv_id").agg(rows.alias("messages"))


def abstained(passages: DataFrame, most: int = 3) -> DataFrame:
    """The passages that an answer without evidence shows."""
    return passages.where(F.col("id") < most)


def valid_request(message: Column, thread_id: Column, document_ids: Column) -> Column:
    """Whether a request is well-formed: the message has 1 to 4,000 characters, the thread id, if any, is one of up to
    64 plain characters, and the document ids, if any, are at most 100."""
    said = F.coalesce(F.length(message).between(1, MESSAGE_CHARS), F.lit(False))
    return said & (thread_id.isNull() | thread_id.rlike(THREAD_ID.replace("$", r"\z"))) & (document_ids.isNull() | (F.size(document_ids) <= REQUEST_DOCUMENTS))


def started(messages: DataFrame) -> DataFrame:
    """(turn_id, question, history) for each thread (conv_id, turn, role, text): its last message is the question, the
    ones before it, in order, are the history. All else of a turn starts afresh."""
    rows = threads(messages)
    before = F.slice("messages", F.lit(1), F.size("messages") - 1)
    return rows.select(F.col("conv_id").alias("turn_id"), F.element_at("messages", -1)["text"].alias("question"), before.alias("history"))


def finished(answers: DataFrame) -> DataFrame:
    """The answer event of each turn (turn_id, status, content, blocks, sources, citations): without blocks the content
    is the only one, and missing sources and citations are empty."""
    blocks = F.when(F.coalesce(F.size("blocks"), F.lit(0)) > 0, F.col("blocks")).otherwise(F.array(F.coalesce("content", F.lit(""))))
    filled = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>"))
    return answers.select(
        "turn_id", "status", F.coalesce("content", F.lit("")).alias("content"), blocks.alias("blocks"),
        filled("sources", SOURCE).alias("sources"), filled("citations", CITATION).alias("citations"),
    )


def with_answers(messages: DataFrame, answers: DataFrame) -> DataFrame:
    """``messages`` (conv_id, turn, role, text) with the content of each answer (turn_id, content) as the next message
    of its thread."""
    last = messages.groupBy("conv_id").agg(F.max("turn").alias("last"))
    new = answers.join(last, answers["turn_id"] == last["conv_id"], "left")
    turn = (F.coalesce(F.col("last"), F.lit(-1)) + 1).cast(messages.schema["turn"].dataType)
    new = new.select(F.col("turn_id").alias("conv_id"), turn.alias("turn"), F.lit("assistant").alias("role"), F.col("content").alias("text"))
    return messages.select("conv_id", "turn", "role", "text").unionByName(new)
