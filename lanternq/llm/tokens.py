"""Token counts: batch encoding in Arrow functions that return lengths only.

*Safe boundaries.* The pre-tokenizer of a byte-level BPE never puts white space after other characters
into one piece, so a text may be cut before every run of white space without changing its tokens.
Parts that are still long (``LONG_BYTES``; scripts without spaces, minified code) are also cut where a letter or digit meets a sign that only ever begins a piece; signs that occur in a special
string of the vocabulary never count. What has no boundary at all stays whole, as the library needs it.

*Batches.* The texts of Arrow batches are pooled up to ``POOL_BYTES``, a longer text in several pools. The
distinct parts of a pool whose counts are not known yet go to the library in calls of about
``CALL_BYTES`` bytes of UTF-8, and only lengths are taken back. Counts of short parts, which repeat a
great deal, are kept in a bounded table for each Python worker.

Defined results: null and empty texts have no tokens; very long texts are counted whole; repeated rows
are counted one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternq.llm.common import text_or_empty

LIMIT = 512
#: Bytes of texts that are cut at a time, and of parts in one call of the library.
POOL_BYTES = 2_000_000
CALL_BYTES = 256_000
#: Bytes above which a part is cut further.
LONG_BYTES = 4096
#: Parts whose counts a worker keeps; longer ones are counted but not kept.
KEPT_PARTS = 300_000
KEPT_BYTES = 64
VOCABULARY = "byte_bpe_50k.json"
#: A part: white space, then what follows up to the next of it. Four separators are white space to Python only.
PART = re.compile(r"[^\S\x1c-\x1f]*(?:[\S\x1c-\x1f]+|\Z)")
BOUNDARY = re.compile(r"(?<=[\S\x1c-\x1f])(?=[^\S\x1c-\x1f])")
#: Signs before which a long part may be cut after a letter or digit: none begins a contraction.
SIGNS = "()[]{};:,=+*/\\\"&%$@~^<>|!?.、。，！？；：「」（）"

_state: dict[str, tuple] = {}


def _tokenizer(path: str) -> tuple:
    """The library's tokenizer, the table of kept counts and the pattern of further cuts."""
    if path not in _state:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path)
        found.no_truncation()
        found.no_padding()
        special = set("".join(t.content for t in found.get_added_tokens_decoder().values()))
        signs = "".join(c for c in SIGNS if c not in special)
        _state[path] = (found, {}, re.compile(rf"(?<=[^\W_])(?=[{re.escape(signs)}])"))
    return _state[path]


def parts(text: str, cut: re.Pattern, most: int) -> Iterator[list[str]]:
    """The parts of ``text`` between safe boundaries, in lists of about ``most`` characters or fewer."""
    start = 0
    while start < len(text):
        end = len(text)
        if end - start > most:  # up to a boundary; a part that is longer itself stays whole
            end = next((m.start() for m in BOUNDARY.finditer(text, start + most)), end)
        own = PART.findall(text, start, end)
        if max(map(len, own)) > LONG_BYTES // 4:
            own = [x for part in own for x in (cut.split(part) if len(part) > LONG_BYTES // 4 else (part,))]
        yield own if own[-1] else own[:-1]
        start = end


def balanced(items: list[str], most: int = CALL_BYTES) -> Iterator[list[str]]:
    """``items`` in order, in lists of about ``most`` bytes of UTF-8."""
    batch, size = [], 0
    for item in items:
        n = len(item) if item.isascii() else len(item.encode("utf-8", "surrogatepass"))
        if batch and size + n > most:
            yield batch
            batch, size = [], 0
        batch.append(item)
        size += n
    if batch:
        yield batch


def count_tokens(texts: list[str], path: str, call_bytes: int = CALL_BYTES, pool_bytes: int = POOL_BYTES) -> list[int]:
    """Tokens of each text, as the library counts them without added special tokens."""
    tokenizer, kept, cut = _tokenizer(path)
    counts = [0] * len(texts)
    pool: list[tuple[int, list[str]]] = []
    size = 0

    def drained() -> None:
        nonlocal pool, size
        unseen = set().union(*(own for _, own in pool)).difference(kept)
        passing: dict[str, int] = {}
        for batch in balanced(list(unseen), call_bytes):
            for part, got in zip(batch, tokenizer.encode_batch_fast(batch, add_special_tokens=False)):
                (kept if len(part) <= KEPT_BYTES else passing)[part] = len(got)
        for at, own in pool:
            counts[at] += sum(passing[x] if x in passing else kept[x] for x in own) if passing else sum(map(kept.__getitem__, own))
        if len(kept) > KEPT_PARTS:
            kept.clear()
        pool, size = [], 0

    for at, text in enumerate(texts):
        for own in parts(text, cut, pool_bytes // 4):
            pool.append((at, own))
            size += sum(map(len, own))
            if size >= pool_bytes // 2:  # characters; a text of other scripts has two or three bytes in each
                drained()
    if pool:
        drained()
    return counts


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row. No shuffle; the text goes to Python once."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pa.array(count_tokens(batch.column("text").to_pylist(), path), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), n], ["doc_id", "n_bytes", "n_tokens"])

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), text_or_empty().alias("text"))
    out = rows.mapInArrow(counted, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
