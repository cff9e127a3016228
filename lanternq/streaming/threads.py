"""State of conversations as streams: the messages of each thread, and turns folded from their events.

Both keep their state in the state store of the query, so a query that is started again from its checkpoint goes on where it
was. They need the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MESSAGE = "role string, text string"
EVENT = "event string, block long, text string, status string"


class _Messages(StatefulProcessor):
    """Messages of a thread by turn. One that comes again replaces itself, so a batch that runs again changes nothing."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.messages = handle.getMapState("messages", "turn int", MESSAGE, self.ttl_ms)

    def _put(self, frame: pd.DataFrame) -> None:
        for turn, role, text in zip(frame["turn"], frame["role"], frame["text"]):
            self.messages.updateValue((int(turn),), (role, text))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            self._put(frame)
        own = sorted((k[0], *v) for k, v in self.messages.iterator())
        yield pd.DataFrame({"conv_id": [key[0]] * len(own), "turn": [m[0] for m in own], "role": [m[1] for m in own], "text": [m[2] for m in own]})

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self._put(initialState)

    def close(self) -> None:
        pass


def thread_histories(messages: DataFrame, ttl_ms: int | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """A stream of messages (conv_id long, turn int, role, text) as a stream of whole histories: the rows of every thread that got a
    message, in order. ``earlier`` are messages that are there before the first batch; with ``ttl_ms`` messages are forgotten after that time."""
    return messages.groupBy("conv_id").transformWithStateInPandas(
        statefulProcessor=_Messages(ttl_ms), outputStructType=f"conv_id long, turn int, {MESSAGE}", outputMode="Update",
        timeMode="ProcessingTime" if ttl_ms else "None", initialState=None if earlier is None else earlier.groupBy("conv_id"),
    )


class _Turns(StatefulProcessor):
    """Events of a turn by position, whatever the order in which they come; a turn that stays silent fails."""

    def __init__(self, silence_ms: int | None):
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getMapState("events", "pos long", EVENT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for e in frame.astype(object).where(frame.notna(), None).itertuples(index=False):
                self.events.updateValue((int(e.pos),), (e.event, None if e.block is None else int(e.block), e.text, e.status))
        turn = self._folded()
        if self.silence_ms:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
            if turn["status"] == "running":
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silence_ms)
        yield self._row(key, turn)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        turn = self._folded()
        if turn["status"] == "running":
            yield self._row(key, turn | {"status": "failed", "error": "no events"})

    def _folded(self) -> dict:
        events = sorted((k[0], *v) for k, v in self.events.iterator())
        errors = [text for _, event, _, text, _ in events if event == "error" and text is not None]
        answers = [(text, status) for _, event, _, text, status in events if event == "answer"]
        blocks: dict[int, str] = {}
        for _, event, block, text, _ in events:
            if event == "delta":
                blocks[block or 0] = blocks.get(block or 0, "") + (text or "")
        streamed = [blocks.get(b, "") for b in range(max(blocks) + 1)] if blocks else []
        named = [status for _, status in answers if status is not None]
        said = [text for text, _ in answers if text is not None]
        return {
            "status": "failed" if errors else named[-1] if named else "running", "error": max(errors) if errors else None, "blocks": [said[-1]] if said else streamed,
            "n_retrievals": sum(e[1] == "retrieval" for e in events), "n_citations": sum(e[1] == "citation" for e in events),
        }

    @staticmethod
    def _row(key, turn: dict) -> pd.DataFrame:
        return pd.DataFrame({"turn_id": [key[0]], **{k: [v] for k, v in turn.items()}})

    def close(self) -> None:
        pass


def turn_states(events: DataFrame, silence_ms: int | None = None) -> DataFrame:
    """A stream of events (turn_id long, pos long, event, block, text, status) as a stream of turns, as ``events.folded_turns`` gives them.
    With ``silence_ms`` a running turn without events for that time fails."""
    return events.groupBy("turn_id").transformWithStateInPandas(
        statefulProcessor=_Turns(silence_ms), outputMode="Update", timeMode="ProcessingTime" if silence_ms else "None",
        outputStructType="turn_id long, status string, error string, blocks array<string>, n_retrievals long, n_citations long",
    )
