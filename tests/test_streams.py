"""Streams with state, in several batches, out of order and started again, against the batch operators."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from lanternq.operators import events as E
from lanternq.streaming import threads

MESSAGES = "conv_id long, turn int, role string, text string"
EVENTS = "turn_id long, pos long, event string, block long, text string, status string"


@pytest.fixture(scope="module")
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", threads.ROCKSDB)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def _run(spark, folder, checkpoint, schema, made):
    """All rows that one start of the query gives, by batch."""
    got = []
    stream = made(spark.readStream.schema(schema).parquet(str(folder)))
    query = stream.writeStream.outputMode("update").foreachBatch(lambda df, n: got.extend((n, r) for r in df.collect())).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    query.awaitTermination(100)
    assert query.exception() is None
    return got


def test_thread_histories_go_on_after_a_restart(store, tmp_path):
    spark = store
    first = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "x")]
    second = [(1, 2, "user", "c"), (1, 1, "assistant", "b"), (3, 1, "assistant", None)]  # one comes again
    earlier = spark.createDataFrame([(2, -1, "system", "s"), (9, 0, "user", "old")], MESSAGES)
    made = lambda df: threads.thread_histories(df, earlier=earlier)
    last: dict[int, list] = {}
    for part in (first, second):
        spark.createDataFrame(part, MESSAGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        new: dict[int, list] = {}
        for _, r in _run(spark, tmp_path / "in", tmp_path / "check", MESSAGES, made):
            new.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
        last |= new
    assert last == {1: [(0, "user", "a"), (1, "assistant", "b"), (2, "user", "c")], 2: [(-1, "system", "s"), (0, "user", "x")], 3: [(1, "assistant", None)]}


def test_turns_from_events_in_any_order(store, tmp_path):
    spark, draw, rows = store, random.Random(3), []
    for turn in range(12):
        pos = 0
        for kind in ["retrieval"] * draw.randint(0, 2) + [draw.choice(["delta", "delta", "citation"]) for _ in range(6)] + draw.choice([["answer"], ["error"], []]):
            text = f"t{turn}.{pos} " if kind != "retrieval" else None
            rows.append((turn, pos, kind, draw.randint(0, 2) if kind == "delta" else None, text, draw.choice(["answered", "no_evidence"]) if kind == "answer" else None))
            pos += 1
    want = {r["turn_id"]: r for r in E.folded_turns(spark.createDataFrame(rows, EVENTS)).collect()}
    draw.shuffle(rows)
    last = {}
    for part in (rows[:40], rows[30:]):  # some events come twice
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        last |= {r["turn_id"]: r for _, r in _run(spark, tmp_path / "in", tmp_path / "check", EVENTS, threads.turn_states)}
    assert {t: tuple(last[t][c] for c in r.__fields__) for t, r in want.items()} == {t: tuple(r) for t, r in want.items()}


def test_a_silent_turn_fails(store, tmp_path):
    spark, got = store, {}
    rows = [(1, 0, "delta", 0, "a", None), (2, 0, "answer", None, "done", "answered")]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = threads.turn_states(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in")), silence_ms=500)
    put = lambda df, n: got.update({r["turn_id"]: (r["status"], r["blocks"]) for r in df.collect()})
    query = stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="300 milliseconds").start()
    end = time.time() + 60
    while time.time() < end and got.get(1, ("",))[0] != "failed" and query.exception() is None:
        time.sleep(0.3)
    query.stop()
    assert got == {1: ("failed", ["a"]), 2: ("answered", ["done"])}
