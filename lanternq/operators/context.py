"""Contextual headers: one line about a chunk's place in its document, from a pluggable function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a document that a contextualizer is given.
DOCUMENT_CHARS = 400_000

#: Characters of a title that a model is given.
TITLE_CHARS = 200


def prompt_title(title: Column) -> Column:
    return F.left(title, F.lit(TITLE_CHARS))


def first_sentence(document: str, chunk: str) -> str:
    """A deterministic stand-in for a model: the document's first sentence, none for the chunk that holds it."""
    first = document.split(". ", 1)[0][:120].replace("\n", " ")
    return "" if chunk.startswith(first[:40]) else first


def contextualized(chunks: DataFrame, contextualizer: Callable[[str, str], str]) -> DataFrame:
    """(doc_id, idx, context) for chunks (doc_id, idx, text, document); a failure gives an empty context."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for document, text in zip(batch.column("document").to_pylist(), batch.column("text").to_pylist()):
                try:
                    out.append(contextualizer(document or "", text or "").strip())
                except Exception:  # a model that fails costs the context, not the chunk
                    out.append("")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("idx"), pa.array(out, pa.string())], ["doc_id", "idx", "context"])

    rows = chunks.select("doc_id", "idx", F.left("document", F.lit(DOCUMENT_CHARS)).alias("document"), "text")
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(apply, f"doc_id {kinds['doc_id']}, idx {kinds['idx']}, context string")
