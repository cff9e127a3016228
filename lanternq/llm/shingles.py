"""Word shingles of texts and the fingerprints of their hashes, in numpy; what the SimHash operator and its
confirmation share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

SHINGLE = 4
SEED = 42
#: Hashes after which a batch's bits are counted.
FLUSH = 400_000
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle of ``text``, in order."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    joined = b" ".join(w)
    if len(w) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts = [0, *ends[: len(w) - shingle].tolist()]
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())]), ">u8").astype(np.uint64)


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each run of ``sizes`` hashes the 64 bits that over half of them have; 0 for empty runs."""
    out = np.zeros(len(sizes), np.uint64)
    own = np.flatnonzero(sizes)
    if not len(own):
        return out
    n = sizes[own]
    begin = np.concatenate([[0], np.cumsum(n)[:-1]])
    parts = -(-n // 255)
    first = np.concatenate([[0], np.cumsum(parts)[:-1]])
    cuts = np.repeat(begin, parts) + 255 * (np.arange(parts.sum()) - np.repeat(first, parts))
    bits = np.zeros(len(own), np.uint64)
    for b in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(b)) & _LANES, cuts)
        counts = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for byte in range(8):
            bits |= (2 * counts[:, byte] > n).astype(np.uint64) << np.uint64(8 * byte + b)
    out[own] = bits
    return out


def fingerprint_array(texts: Iterator[str], shingle: int = SHINGLE) -> np.ndarray:
    done, held, sizes, total = [], [], [], 0

    def flush() -> None:
        nonlocal held, sizes, total
        done.append(majority(np.concatenate(held) if held else np.empty(0, np.uint64), np.array(sizes, np.int64)))
        held, sizes, total = [], [], 0

    for text in texts:
        h = shingle_hashes(text, shingle)
        held.append(h)
        sizes.append(len(h))
        total += len(h)
        if total >= FLUSH:
            flush()
    flush()
    return np.concatenate(done).view(np.int64)


def shingle_set(text: str, shingle: int = 5) -> np.ndarray:
    """The distinct hashes, sorted."""
    return np.unique(shingle_hashes(text, shingle))


def set_digest(own: np.ndarray) -> bytes:
    """128 bits that stand for a set of hashes."""
    return xxhash.xxh3_128_digest(own.tobytes())


def mixed(hashes: np.ndarray) -> np.ndarray:
    """Another 64 bits of each hash, for the second word of a fingerprint (two rounds of multiply and shift)."""
    z = (hashes ^ (hashes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprint_words(texts: Iterable[str], shingle: int = 5) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(set of shingles, fingerprint of two words) of each text; bits are counted for many texts at a time."""
    held: list[np.ndarray] = []

    def counted() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        hashes, sizes = np.concatenate(held), np.array([len(s) for s in held], np.int64)
        words = np.stack([majority(hashes, sizes), majority(mixed(hashes), sizes)], axis=1).view(np.int64)
        yield from zip(held, words)

    total = 0
    for text in texts:
        held.append(shingle_set(text, shingle))
        total += len(held[-1])
        if total >= FLUSH:
            yield from counted()
            held, total = [], 0
    if held:
        yield from counted()


def word_array(column) -> np.ndarray:
    """Rows of words (all of one length) from an Arrow column of lists."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy().view(np.uint64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 1), np.uint64)
