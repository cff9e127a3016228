"""Alignment of two tokenizers over a corpus, by segments that are aligned once each.

*Segments.* Texts, with a space before them, are cut before runs of white space, where no token of either vocabulary can
reach across: the pre-tokenizer of A always cuts there, and no piece of B has such a character after another one. ``cutting``
verifies both for every white-space character; a run that begins with a character that fails (the carriage return of the
given vocabularies, which follows signs inside pieces) is not cut. So tokens of a text are those of its segments in order.

*Blocks.* Documents are pooled up to ``BLOCK_CHARS`` characters, a longer one alone. A block keeps its distinct segments once,
with the times they occur, and each document as numbers of them. From there on the work follows distinct segments of
blocks, not occurrences; texts are read once and never shuffled.

*Once each.* Rows of one segment lie side by side after a sort, so each distinct segment is tokenised by both libraries and aligned
once, and keeps its places (block and number). Segments of more than ``DEALT_BLOCKS`` blocks would gather in one task; their blocks
are dealt over several, and each of these aligns the segment once. Many segments go to one call, joined, and are told apart again by their
bytes, which also verifies the cuts and that both libraries give back the text. The overlapping pairs of ids are counted over
the corpus, a segment's as often as it occurs. The counts meet the segments again (sent to the tasks as sorted arrays up to
``SENT_PAIRS`` counted pairs, by a join beyond). Alignments return to the blocks in packed arrays, and each document adds up its segments.

Defined results: a text that is null or empty, or that B does not give back (it has a character that B writes in another way),
has no tokens: zeros and an empty digest, and it adds nothing to the counts. Very long texts are aligned whole; repeated
rows count once each; rows without doc_id are rows like others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternq.llm.common import written

VOCABULARY_A = "byte_bpe_50k.json"
VOCABULARY_B = "piece_bpe_32k.model"
#: Characters of the documents of a block, and of the segments that go to one call of the libraries.
BLOCK_CHARS = 16_000_000
CALL_CHARS = 32_000
#: Blocks up to which the rows of one segment meet in one task, and places of segments that are packed at a time.
DEALT_BLOCKS = 20_000
PACKED_PLACES = 500_000
#: Counted pairs of ids up to which their counts are sent to every task; 17 bytes each.
SENT_PAIRS = 4_000_000
SPACE_PIECE = "▁"
#: White space as both libraries have it; four separators are white space to Python only.
SEPARATORS = "\x1c\x1d\x1e\x1f"
WHITE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace() and not 0x1C <= c <= 0x1F)


def _byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, others in order from 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


class Tokenizers:
    """Both libraries, the bytes of every id, and where texts may be cut."""

    def __init__(self, a: str, b: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a), SentencePieceProcessor(model_file=b)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        values, added = _byte_values(), self.a.get_added_tokens_decoder()
        entries = [self.a.id_to_token(k) or "" for k in range(self.a.get_vocab_size())]
        self.a_bytes = [x.encode() if k in added else bytes(map(values.__getitem__, x)) for k, x in enumerate(entries)]
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(SPACE_PIECE, " ").encode() for k, p in enumerate(pieces)]
        self.b_space = self.b.piece_to_id(SPACE_PIECE)
        self.a_size, self.b_size = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        plain = [p for k, p in enumerate(pieces) if not self.b.is_byte(k)]
        self.cuts = "".join(w for w in WHITE if self.cutting(w, plain))
        white, cut = (re.escape(x) for x in (WHITE, self.cuts))
        uncut = re.escape("".join(w for w in WHITE if w not in self.cuts)) or "(?!)"
        more = rf"(?:[{uncut}][{white}]*[^{white}]*)*" if uncut != "(?!)" else ""
        self.segment = re.compile(rf"[{white}]*+[^{white}]++{more}|[{white}]+" if cut else r"(?s:.+)")
        # The same with the classes of Python, which are faster, for texts without the four separators.
        self.common = re.compile(rf"\s*+\S++{more.replace(f'[{white}]', chr(92) + 's').replace(f'[^{white}]', chr(92) + 'S')}|\s+" if cut else r"(?s:.+)")
        self.kept: dict[str, bool] = {}

    def cutting(self, w: str, pieces: list[str]) -> bool:
        """Whether no token of A or B has ``w`` behind another character that is no white space; nor, unless it is the space
        itself, behind the space that B adds."""
        alone = all(self.a.pre_tokenizer.pre_tokenize_str(x + w + y)[0][1] == (0, len(x)) for x in "a1." for y in "a1.")
        if w == " ":
            return alone and not any(re.search(rf"[^{SPACE_PIECE}]{SPACE_PIECE}", p) for p in pieces)
        return alone and not any(w in p[1:] for p in pieces)

    def segments(self, text: str) -> list[str]:
        return (self.segment if any(c in text for c in SEPARATORS) else self.common).findall(text)

    def given_back(self, text: str) -> bool:
        """Whether B writes every character of ``text`` as it is; characters are tried once each."""
        own = set(text)
        for c in own.difference(self.kept):
            self.kept[c] = self._b_text(self.b.encode("a" + c)) == (" a" + c).encode("utf-8", "surrogatepass")
        return all(map(self.kept.__getitem__, own))

    def _b_text(self, ids: list[int]) -> bytes:
        return b"".join(map(self.b_bytes.__getitem__, ids))

    def encoded(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A and of B for a text that begins with white space, its first space being the one that B adds."""
        a = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids
        b = self.b.encode(text[1:]) if text[0] == " " and len(text) > 1 else self.b.encode(text)[1:] if text[0] != " " else [self.b_space]
        whole = text.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != whole or self._b_text(b) != whole:
            raise ValueError(f"a vocabulary does not give back {text[:80]!r}")
        return np.array(a, np.int64), np.array(b, np.int64)


@lru_cache(1)
def tokenizers(a: str, b: str) -> Tokenizers:
    return Tokenizers(a, b)


def aligned(texts: list[str], t: Tokenizers) -> Iterator[tuple[int, int, int, np.ndarray, str]]:
    """n_a, n_b, n_groups, links (a << 32 | b) and groups of each segment of ``texts``, which no token crosses when they are joined."""
    a, b = t.encoded("".join(texts))
    ends = np.cumsum(np.fromiter((len(x.encode()) for x in texts), np.int64, len(texts)))
    a_end, b_end = np.cumsum(t.a_size[a]), np.cumsum(t.b_size[b])
    a_to, b_to = np.searchsorted(a_end, ends) + 1, np.searchsorted(b_end, ends) + 1
    if (a_end[a_to - 1] != ends).any() or (b_end[b_to - 1] != ends).any():
        raise ValueError("a token crosses segments")
    # Every stretch between neighbouring ends of tokens is the overlap of one token of A with one of B.
    both = np.union1d(a_end, b_end)
    link = (a[np.searchsorted(a_end, both)] << 32) | b[np.searchsorted(b_end, both)]
    link_to = np.searchsorted(both, ends) + 1
    common = np.intersect1d(a_end, b_end, assume_unique=True)
    group_to = (np.searchsorted(common, ends) + 1).tolist()
    ga, gb = (np.searchsorted(a_end, common) + 1).tolist(), (np.searchsorted(b_end, common) + 1).tolist()
    names_a, names_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
    i = j = k = l = 0
    for n, (i2, j2, l2) in enumerate(zip(a_to.tolist(), b_to.tolist(), link_to.tolist())):
        parts, x, y = [], i, j
        for g in range(k, group_to[n]):
            parts.append(",".join(names_a[x : ga[g]]) + "|" + ",".join(names_b[y : gb[g]]))
            x, y = ga[g], gb[g]
        yield i2 - i, j2 - j, len(parts), link[l:l2], ";".join(parts)
        i, j, k, l = i2, j2, group_to[n], l2


def _squeezed(*arrays: np.ndarray) -> bytes:
    return pa.compress(b"".join(x.tobytes() for x in arrays), codec="zstd", asbytes=True)


def _released(data: bytes, size: int) -> memoryview:
    return memoryview(pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True))


def blocks(docs: DataFrame, paths: tuple[str, str], block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows of documents (block, doc_id, n: how many segments, at: their numbers in order, packed) and of the distinct segments
    of each block (block, number, seg, times)."""
    kind = dict(docs.dtypes)["doc_id"]
    names = ["block", "doc_id", "n", "at", "number", "seg", "times"]

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, task = tokenizers(*paths), TaskContext.get().partitionId() << 32
        ids, ats, size, done, id_type = [], [], 0, 0, None
        numbers: defaultdict[str, int] = defaultdict()
        numbers.default_factory = numbers.__len__

        def drained() -> Iterator[pa.RecordBatch]:
            nonlocal ids, ats, size, done
            block, n, m, null = task | done, len(ids), len(numbers), pa.nulls
            times = np.bincount(np.concatenate(ats), minlength=m).astype(np.int64)
            packed = [pa.array(list(map(len, ats)), pa.int32()), pa.array(list(map(_squeezed, ats)), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(ids, id_type), *packed, null(n, pa.int32()), null(n, pa.string()), null(n, pa.int64())], names)
            words = list(numbers)
            for k in range(0, m, 50_000):
                own = words[k : k + 50_000]
                some = len(own)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(some, block)), null(some, id_type), null(some, pa.int32()), null(some, pa.binary()), pa.array(np.arange(k, k + some, dtype=np.int32)), pa.array(own, pa.string()), pa.array(times[k : k + some])], names)
            numbers.clear()
            ids, ats, size, done = [], [], 0, done + 1

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            texts, own = batch.column("text"), batch.column("doc_id")
            for k in range(batch.num_rows):
                text = texts[k].as_py()
                found = t.segments(" " + text) if text and t.given_back(text) else []
                if ids and size + len(text or "") > block_chars:
                    yield from drained()
                ids.append(own[k].as_py())
                ats.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
                size += len(text or "")
        if ids:
            yield from drained()

    return docs.select("doc_id", "text").mapInArrow(pooled, f"block long, doc_id {kind}, n int, at binary, number int, seg string, times long")


def segments(rows: DataFrame, paths: tuple[str, str], call_chars: int = CALL_CHARS, dealt_blocks: int = DEALT_BLOCKS) -> DataFrame:
    """seg, n (occurrences), n_a, n_b, n_groups, links, groups and places (block, number) of every distinct segment."""
    parts = -(-rows.where("at IS NOT NULL").select("block").distinct().count() // dealt_blocks)
    own = rows.where("seg IS NOT NULL").select("seg", "block", "number", "times", F.pmod(F.xxhash64("block"), F.lit(max(1, parts)).cast("long")).alias("part"))
    names = ["seg", "n", "n_a", "n_b", "n_groups", "links", "groups", "block", "number"]

    def aligned_runs(table: pa.Table, t: Tokenizers) -> pa.RecordBatch:
        seg = table.column("seg").combine_chunks()
        starts = np.flatnonzero(np.concatenate([[True], ~pc.equal(seg.slice(1), seg.slice(0, len(seg) - 1)).to_numpy(zero_copy_only=False)]))
        texts = seg.take(pa.array(starts)).to_pylist()
        got: list = [None] * len(texts)
        held, size = [], 0
        calls = [[k] for k, x in enumerate(texts) if x[-1] in WHITE]  # only the end of a text; joined, its white space would go on
        for k, x in enumerate(texts):
            if x[-1] not in WHITE:
                held.append(k)
                size += len(x)
                if size >= call_chars:
                    calls.append(held)
                    held, size = [], 0
        for call in [*calls, held] if held else calls:
            for k, one in zip(call, aligned([texts[k] for k in call], t)):
                got[k] = one
        numbers = [pa.array([x[c] for x in got], pa.int64()) for c in range(3)]
        links = [x[3] for x in got]
        flat = pa.ListArray.from_arrays(np.cumsum([0, *map(len, links)]).astype(np.int32), pa.array(np.concatenate(links)))
        cut = np.append(starts, len(seg)).astype(np.int32)
        places = [pa.ListArray.from_arrays(cut, table.column(c).combine_chunks()) for c in ("block", "number")]
        n = pa.array(np.add.reduceat(table.column("times").to_numpy(), starts))
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), n, *numbers, flat, pa.array([x[4] for x in got], pa.string()), *places], names)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, held = tokenizers(*paths), None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            seg = table.column("seg")
            breaks = np.flatnonzero(~pc.equal(seg.slice(1), seg.slice(0, len(seg) - 1)).to_numpy()) if len(seg) > 1 else []
            cut = int(breaks[-1]) + 1 if len(breaks) else 0  # the last segment may go on in the next batch
            if cut:
                yield aligned_runs(table.slice(0, cut), t)
            held = table.slice(cut)
        if held is not None and len(held):
            yield aligned_runs(held, t)

    dealt = own.repartition("seg", "part").sortWithinPartitions("seg").drop("part")
    return dealt.mapInArrow(align, "seg string, n long, n_a long, n_b long, n_groups long, links array<long>, groups string, block array<long>, number array<int>")


def pair_counts(found: DataFrame) -> DataFrame:
    """link, count (over the corpus) and best (whether no other pair of the same id of B has a higher count)."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("links")
            n = np.repeat(batch.column("n").to_numpy(), np.diff(lists.offsets.to_numpy()))
            link, at = np.unique(lists.flatten().to_numpy(), return_inverse=True)
            total = np.zeros(len(link), np.int64)
            np.add.at(total, at, n)
            yield pa.RecordBatch.from_arrays([pa.array(link), pa.array(total)], ["link", "count"])

    counts = found.select("n", "links").mapInArrow(summed, "link long, count long").groupBy("link").agg(F.sum("count").alias("count"))
    counts = written(counts.withColumn("b", F.col("link").bitwiseAND(0xFFFFFFFF)), "alignment-counts")
    highest = counts.groupBy("b").agg(F.max("count").alias("most"))  # no more rows than B has ids
    return counts.join(F.broadcast(highest), "b").select("link", "count", (F.col("count") == F.col("most")).alias("best"))


SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


NAMES = ["n_a", "n_b", "n_groups", "n_links", "groups", "block", "number", "n_best", "count_sum"]


def _valued(batches: Iterator[pa.RecordBatch], link: np.ndarray, count: np.ndarray, best: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Segments with what the counts of their links add up to."""
    for batch in batches:
        lists = batch.column("links")
        at = np.searchsorted(link, lists.flatten().to_numpy())
        cut = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        own = {"n_links": pa.array(np.diff(cut).astype(np.int64))}
        for name, x in (("n_best", best.astype(np.int64)), ("count_sum", count)):
            own[name] = pa.array(np.diff(np.concatenate([[0], np.cumsum(x[at])])[cut]))
        yield pa.RecordBatch.from_arrays([own[c] if c in own else batch.column(c) for c in NAMES], NAMES)


def _packed(batches: Iterator[pa.RecordBatch], places: int) -> Iterator[pa.RecordBatch]:
    """(block, n, bytes of groups, data): the segments of each block among about ``places`` places, as packed arrays."""
    schema = pa.schema([("block", pa.int64()), ("n", pa.int64()), ("chars", pa.int64()), ("data", pa.binary())])
    held, size = [], 0

    def drained() -> Iterator[pa.RecordBatch]:
        nonlocal held, size
        table = pa.Table.from_batches(held).combine_chunks()
        lists = table.column("block").chunk(0)
        row = np.repeat(np.arange(len(table)), np.diff(lists.offsets.to_numpy()))
        block, number = lists.flatten().to_numpy(), table.column("number").chunk(0).flatten().to_numpy()
        order = np.argsort(block, kind="stable")
        ends = np.flatnonzero(np.append(np.diff(block[order]) != 0, True)) + 1
        sums, groups = [table.column(c).to_numpy() for c in SUMS], table.column("groups").to_pylist()
        start = 0
        for end in ends.tolist():
            at = order[start:end]
            own = row[at]
            text = np.frombuffer("\n".join(map(groups.__getitem__, own.tolist())).encode(), np.uint8)
            data = _squeezed(*(x[own] for x in sums), number[at], text)
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((int(block[at[0]]), end - start, len(text), data), schema.types)], schema.names)
            start = end
        held, size = [], 0

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += len(batch.column("number").flatten())
        if size >= places:
            yield from drained()
    if held:
        yield from drained()


def returned(found: DataFrame, sent_pairs: int = SENT_PAIRS, places: int = PACKED_PLACES) -> DataFrame:
    """The alignments of each block's segments with n_links, n_best and count_sum of their links, packed: (block, n, chars, data)."""
    counts = written(pair_counts(found), "alignment-pairs")
    schema = "block long, n long, chars long, data binary"
    if counts.count() > sent_pairs:
        row = F.struct("seg", F.col("block")[0])  # of one segment in several tasks, each has blocks of its own
        rows = found.withColumn("row_", row).withColumn("n_links", F.size("links").cast("long"))
        links = rows.select("row_", F.explode("links").alias("link")).join(counts, "link")
        sums = links.groupBy("row_").agg(F.count_if("best").alias("n_best"), F.sum("count").alias("count_sum"))
        return rows.join(sums, "row_").select(*NAMES).mapInArrow(lambda batches: _packed(batches, places), schema)
    table = counts.toArrow().sort_by("link")  # a counted bound
    sent = found.sparkSession.sparkContext.broadcast([table.column(c).to_numpy() for c in ("link", "count", "best")])
    rows = found.select("links", *[c for c in NAMES if c in found.columns])
    return rows.mapInArrow(lambda batches: _packed(_valued(batches, *sent.value), places), schema)


def composed(rows: DataFrame, packs: DataFrame) -> DataFrame:
    """Every document with the sums over its segments and the digest of its groups."""
    kind = dict(rows.dtypes)["doc_id"]

    def compose(docs, table):
        total = sum(table.column("n").to_pylist())
        numbers, groups = np.zeros((len(SUMS), total), np.int64), [""] * total
        for n, chars, data in zip(*(table.column(c).to_pylist() for c in ("n", "chars", "data"))):
            own = _released(data, 52 * n + chars)
            at = np.frombuffer(own, np.int32, n, 48 * n)
            numbers[:, at] = np.frombuffer(own, np.int64, 6 * n).reshape(6, n)
            for k, text in zip(at.tolist(), str(own[52 * n :], "utf-8").split("\n")):
                groups[k] = text
        sums, digests = [], []
        for n, data in zip(docs.column("n").to_pylist(), docs.column("at")):
            at = np.frombuffer(_released(data.as_py(), 4 * n), np.int32) if n else np.empty(0, np.int32)
            sums.append(numbers[:, at].sum(1))
            digests.append(hashlib.sha256(";".join(map(groups.__getitem__, at.tolist())).encode()).hexdigest() if n else "")
        out = np.array(sums, np.int64).reshape(-1, len(SUMS)).T
        return pa.Table.from_arrays([docs.column("doc_id"), *map(pa.array, out), pa.array(digests, pa.string())], names=["doc_id", *SUMS, "groups_sha256"])

    kinds = ", ".join(f"{c} long" for c in SUMS)
    of_docs = rows.where("at IS NOT NULL").select("block", "doc_id", "n", "at").groupBy("block")
    own = packs.withColumnRenamed("block", "of").groupBy("of")
    return of_docs.cogroup(own).applyInArrow(compose, f"doc_id {kind}, {kinds}, groups_sha256 string")


def alignments(docs: DataFrame, a: str, b: str, block_chars: int = BLOCK_CHARS, sent_pairs: int = SENT_PAIRS, dealt_blocks: int = DEALT_BLOCKS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of ``docs``."""
    rows = written(blocks(docs, (a, b), block_chars), "alignment-blocks", "zstd")
    found = written(segments(rows, (a, b), dealt_blocks=dealt_blocks), "alignment-segments", "zstd")
    return composed(rows, returned(found, sent_pairs))
