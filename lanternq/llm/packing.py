"""Best-fit packing of documents into sequences of a fixed number of tokens, by local search with exchanges.

*Pieces.* A document is its token ids and one more that ends it; only one longer than a sequence is cut, into pieces of a
whole sequence and a last one. Ids come from the library word by word: the vocabulary's pre-tokenizer drops white space
and no token crosses it. Ids of words are kept in a bounded table for each Python worker. A word of Latin-1 characters
that is not known goes to the library's model in runs of letters, what lies between them through the whole library; other words
go through the library as they are.

*Packing.* A piece of a whole sequence is one. The others are dealt into groups of about ``GROUP_PIECES`` by a hash of their
row number, so groups are even whatever the documents. In its group every piece goes to the fullest sequence that has room,
long ones first. Then sequences with room are searched, the emptiest first: a document moves to another one, or is exchanged for
one shorter document, or two, or two for one, whatever moves most tokens, where that increases the sum of squared fills. A sequence
whose documents are all gone is dropped. The search ends when the group has no more sequences than its tokens need, or nothing
increases the sum any more. What is still loosely filled goes on to a next round with other groups, until one group has
all of it or a round saves nothing. Rows carry lengths and checksums; ids and texts are never shuffled.

Defined results: a null or empty text is the ending id alone; very long texts are cut whole; repeated rows and rows without
doc_id are documents of their own; equal lengths are taken in the order of rows; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternq.llm.common import written

VOCABULARY = "word_bpe_49k.json"
SEQUENCE = 2048
END = 0
GROUP_PIECES = 16_384
#: Words kept by a worker, their longest, and characters of a text that are split at a time.
KEPT_WORDS = 500_000
KEPT_CHARS = 64
SLICE = 2_000_000
#: Exchanges of a group; documents of an emptied sequence that are tried in twos.
STEPS = 20_000
PAIRED = 24
#: A sequence with less room than this share is left alone by later rounds.
LOOSE = 1 / 64
_LETTERS = "a-zA-ZªµºÀ-ÖØ-öø-ÿ"
#: No token has a letter before another character, or after one that is no apostrophe.
_RUNS = re.compile(f"(?<=[{_LETTERS}])(?=[^{_LETTERS}])|(?<=[^{_LETTERS}'])(?=[{_LETTERS}])")
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_SPACE = re.compile(rf"[^\S{_SEPARATORS}]")
_WORD = re.compile(rf"[\S{_SEPARATORS}]+")


class Words(dict):
    """Little-endian ids (four bytes each) of words between white space, looked up or made."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        from lanternq.llm.alignment import _byte_values

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.names = {b: c for c, b in _byte_values().items()}

    def __missing__(self, word: str) -> bytes:
        plain = len(word) <= KEPT_CHARS and max(word) <= "\xff" and not any(s in word for s in self.special)
        if plain:
            runs = _RUNS.split(word)
            found = b"".join(self.run(r) for r in runs) if len(runs) == 1 else b"".join(map(self.__getitem__, runs))
        else:
            found = self.whole(word)
        if len(word) <= KEPT_CHARS:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = found
        return found

    def whole(self, word: str) -> bytes:
        return np.array(self.library.encode_batch_fast([word], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def run(self, run: str) -> bytes:
        """A run of letters is one word to the model, in lower case and as a byte-level string; other runs take the whole way."""
        if not re.fullmatch(f"[{_LETTERS}]+", run):
            return self.whole(run)
        own = run.lower()
        own = own if own.isascii() else "".join(map(self.names.__getitem__, own.encode()))
        return np.array([t.id for t in self.library.model.tokenize(own)], "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        found, start = [], 0
        while start < len(text):
            end = len(text)
            if end - start > SLICE:
                cut = _SPACE.search(text, start + SLICE)
                end = cut.start() if cut else end
            part = text[start:end] if start or end < len(text) else text
            own = _WORD.findall(part) if any(c in part for c in _SEPARATORS) else part.split()
            found.append(b"".join(map(self.__getitem__, own)))
            start = end
        return found[0] if len(found) == 1 else b"".join(found)


_words: dict[str, Words] = {}


def words_of(path: str) -> Words:
    if path not in _words:
        _words[path] = Words(path)
    return _words[path]


def pieces(docs: DataFrame, path: str, sequence: int = SEQUENCE, end: int = END) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every row of ``docs``."""
    kind = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last = words_of(path), np.array([end], "<u4").tobytes()
        for batch in batches:
            texts, rows, lengths, crcs = batch.column("text"), [], [], []
            for k in range(batch.num_rows):
                ids = words.ids(texts[k].as_py() or "") + last
                for at in range(0, len(ids), 4 * sequence):
                    own = ids[at : at + 4 * sequence]
                    rows.append((k, at // (4 * sequence)))
                    lengths.append(len(own) // 4)
                    crcs.append(zlib.crc32(own))
            row, piece = np.array(rows, np.int64).reshape(-1, 2).T
            columns = [batch.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(piece * sequence), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(length: np.ndarray, room: int) -> np.ndarray:
    """A bin for each item: long items first, each into the fullest bin that has room for it."""
    own, by_free, filled, bins = np.empty(len(length), np.int64), {}, 0, 0
    for k in np.argsort(-length, kind="stable").tolist():
        n = int(length[k])
        fits = filled >> n  # bit c: a bin with room for n + c
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            bin_ = by_free[free].pop()
            if not by_free[free]:
                filled &= ~(1 << free)
        else:
            free, bin_, bins = room, bins, bins + 1
        own[k] = bin_
        free -= n
        if free:
            by_free.setdefault(free, []).append(bin_)
            filled |= 1 << free
    return own


def _exchange(give: np.ndarray, length: np.ndarray, own: np.ndarray, free: np.ndarray, room: int) -> tuple[int, list[int], list[int], int] | None:
    """What moves most tokens out of a bin with items of lengths ``give``, into one of the bins ``own`` of items ``length``,
    sorted by bin and length, with ``free`` room each: (tokens, indexes of ``give``, indexes of ``length``, bin)."""
    best: tuple[int, list[int], list[int], int] | None = None

    def tried(sums: np.ndarray, names: list[list[int]]) -> None:
        nonlocal best
        moved = sums[:, None] - length[None, :]
        moved = np.where((moved > 0) & (moved <= free[None, :]), moved, 0)
        at = int(moved.argmax())
        a, b = divmod(at, len(length))
        if moved[a, b] > (best[0] if best else 0):
            best = (int(moved[a, b]), names[a], [b], int(own[b]))

    widest = int(free.argmax())
    fits = np.flatnonzero(give <= free[widest])
    if len(fits):  # a move: the longest item that fits anywhere
        a = int(fits[give[fits].argmax()])
        best = (int(give[a]), [a], [], int(own[widest]))
    tried(give, [[a] for a in range(len(give))])
    few = np.argsort(give, kind="stable")[:PAIRED]
    if len(few) > 1:
        i, j = np.triu_indices(len(few), 1)
        sums = give[few[i]] + give[few[j]]
        keep = np.flatnonzero(sums <= room + length.max())
        for k in range(0, len(keep), 32):
            at = keep[k : k + 32]
            tried(sums[at], [[int(few[i[x]]), int(few[j[x]])] for x in at])
    if best is None:  # one for two of one bin: for each first item the shortest second that leaves room
        key = own * (2 * room) + length
        for a in np.unique(give)[::-1]:
            least = np.maximum(a - length - free, 1)
            at = np.searchsorted(key, own * (2 * room) + least)
            at = np.where(at == np.arange(len(key)), at + 1, at)
            inside = at < len(key)
            at = np.where(inside, at, 0)
            moved = np.where(inside & (own[at] == own) & (least <= length[at]), a - length - length[at], 0)
            moved = np.where(moved > 0, moved, 0)
            b = int(moved.argmax())
            if moved[b] > (best[0] if best else 0):
                best = (int(moved[b]), [int(np.flatnonzero(give == a)[0])], [b, int(at[b])], int(own[b]))
    return best


def emptied(length: np.ndarray, own: np.ndarray, room: int, steps: int = STEPS) -> np.ndarray:
    """``own`` with as few bins as moves and exchanges between bins with room make of them."""
    own = own.copy()
    fill = np.bincount(own, weights=length).astype(np.int64)
    need = -(-int(length.sum()) // room)
    while np.count_nonzero(fill) > need and steps > 0:
        before = np.count_nonzero(fill)
        for giver in np.argsort(fill, kind="stable").tolist():
            if fill[giver] in (0, room) or np.count_nonzero(fill) <= need:
                continue
            while fill[giver] and steps > 0:
                steps -= 1
                item = np.flatnonzero((fill[own] < room) & (own != giver) & (fill[own] >= fill[giver]))
                if not len(item):
                    break
                item = item[np.lexsort((length[item], own[item]))]
                mine = np.flatnonzero(own == giver)
                found = _exchange(length[mine], length[item], own[item], room - fill[own[item]], room)
                if found is None:
                    break
                moved, out, into, taker = found
                own[mine[out]] = taker
                own[item[into]] = giver
                fill[giver] -= moved
                fill[taker] += moved
        if np.count_nonzero(fill) == before:
            break
    return own


def _grouped(rows: DataFrame, groups: int, turn: int, room: int) -> DataFrame:
    """``rows`` (length, row_, ...) with their sequence, place in it and its room."""

    def packed(key, table):
        table = table.sort_by("row_")
        length = table.column("length").to_numpy()
        own = emptied(length, best_fit(length, room), room)
        order = np.argsort(own, kind="stable")
        ends = np.cumsum(length[order])
        first = np.concatenate([[True], own[order][1:] != own[order][:-1]])
        begin = np.maximum.accumulate(np.where(first, ends - length[order], 0))
        offset = np.empty(len(own), np.int64)
        offset[order] = ends - length[order] - begin
        fill = np.bincount(own, weights=length).astype(np.int64)
        base = ((turn << 31) + key[0].as_py()) << 24
        out = table.drop_columns(["group_"])
        for name, values in (("sequence_id", base + own), ("offset", offset), ("free_", room - fill[own])):
            out = out.append_column(name, pa.array(values, pa.int64()))
        return out

    kinds = ", ".join(f"`{n}` {k}" for n, k in rows.dtypes)
    dealt = rows.withColumn("group_", F.pmod(F.xxhash64(F.lit(turn), "row_"), F.lit(groups).cast("long")))
    return dealt.groupBy("group_").applyInArrow(packed, f"{kinds}, sequence_id long, offset long, free_ long")


def packed(docs: DataFrame, path: str, sequence: int = SEQUENCE, end: int = END, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    rows = written(pieces(docs, path, sequence, end).withColumn("row_", F.monotonically_increasing_id()), "packing-pieces")
    names = rows.columns
    done = rows.where(F.col("length") == sequence).select(*names, (-1 - F.col("row_")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left = rows.where(F.col("length") < sequence)
    n, turn = left.count(), 1
    while n:
        groups = -(-n // group_pieces)
        got = written(_grouped(left, groups, turn, sequence), "packing-round")
        loose = got.where(F.col("free_") >= sequence * LOOSE)
        more = loose.count() if groups > 1 else 0
        last = more in (0, n)
        done = done.unionByName((got if last else got.where(F.col("free_") < sequence * LOOSE)).drop("free_"))
        if last:
            break
        left, n, turn = loose.select(*names), more, turn + 1
    return done.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
