"""Incremental ingestion and conversation state with Structured Streaming."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lanternq.functions.text import content_hash
from lanternq.operators.chunk import chunked, exploded
from lanternq.sources.parse import text_blocks


def chunks_of_texts(docs: DataFrame, budget: int = 320, overlap: int = 48) -> DataFrame:
    """Chunks of plain texts (doc_id, text)."""
    blocks = exploded(docs.select("doc_id", text_blocks(F.col("text")).alias("blocks")), "blocks", "pos", "text")
    blocks = blocks.withColumn("heading_level", F.lit(None).cast("int")).withColumn("page", F.lit(None).cast("int"))
    return chunked(blocks, budget, overlap)


def stream_ingest(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str = "doc_id long, text string"):
    """Starts a query that reads Parquet files as they arrive in ``source`` and appends the chunks of texts not
    ingested before to ``target``. A batch that is run again writes its own folder again and ignores the hashes
    of its first attempt; a new checkpoint adds folders of its own and skips what earlier ones ingested."""
    run = hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def batch(df: DataFrame, number: int) -> None:
        rows = df.withColumn("hash", content_hash(F.col("text"))).dropDuplicates(["hash"])
        try:
            seen = spark.read.schema("hash string, run string, batch long").parquet(f"{target}/hashes")
        except AnalysisException as missing:  # nothing ingested yet
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
        else:
            earlier = seen.where((F.col("run") != run) | (F.col("batch") != number)).select("hash")
            rows = rows.join(earlier.distinct(), "hash", "left_anti")
        rows = rows.persist()
        try:
            chunks_of_texts(rows).write.mode("overwrite").parquet(f"{target}/chunks/run={run}/batch={number}")
            rows.select("hash").write.mode("overwrite").parquet(f"{target}/hashes/run={run}/batch={number}")
        finally:
            rows.unpersist()

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def conversation_state(messages: DataFrame) -> DataFrame:
    """A stream of messages (conv_id, turn, role, text) as a stream of states (conv_id, n_messages, last_role)."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, turn, role = state.get if state.exists else (0, -1, "")
        for frame in frames:
            n += len(frame)
            last = frame.sort_values("turn").iloc[-1]
            if int(last["turn"]) >= turn:
                turn, role = int(last["turn"]), str(last["role"])
        state.update((n, turn, role))
        yield pd.DataFrame({"conv_id": [key[0]], "n_messages": [n], "last_role": [role]})

    out = "conv_id long, n_messages long, last_role string"
    return messages.groupBy("conv_id").applyInPandasWithState(fold, out, "n long, turn long, role string", "update", GroupStateTimeout.NoTimeout)
