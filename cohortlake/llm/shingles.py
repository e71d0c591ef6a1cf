"""Word shingles of texts as sets of 64-bit hashes, for whole batches at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

from cohortlake.llm.common import mix64, texts

#: Odd multipliers, one for each place of a shingle.
PLACES = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
#: What a byte adds to a word's hash, before it is multiplied with a power of BASE for its place.
BYTES = mix64(np.arange(1000, 1256, dtype=np.uint64))
BASE = int(PLACES[7])
INVERSE = pow(BASE, -1, 1 << 64)
SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
AS_IS = bytes(range(256))
LOWER = AS_IS.lower()
#: Bytes that are hashed together; longer texts are hashed alone.
TOGETHER = 1 << 19


@lru_cache(maxsize=4)
def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(column: list[bytes | None], table: bytes = AS_IS) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of all words of all texts, and the number of words of each text. ``table`` translates bytes first.
    A hash is a polynomial in the word's bytes, so all words are hashed by one running sum over the bytes."""
    hashes, counts, part, size = [], [], [], 0
    for text in column:
        part.append(text or b"")
        size += len(part[-1]) + 1
        if size >= TOGETHER:
            _hash(part, table, hashes, counts)
            part, size = [], 0
    _hash(part, table, hashes, counts)
    return np.concatenate(hashes), np.concatenate(counts)


def split_words(column: list[bytes | None]) -> tuple[list[bytes], np.ndarray]:
    """All words of all texts, A-Z in lower case, and the number of words of each text."""
    joined = b" ".join(t or b"" for t in column).lower()
    space = SPACE[np.frombuffer(b" " + joined + b" ", np.uint8)]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    upto = np.cumsum([len(t or b"") + 1 for t in column], dtype=np.int64)
    return joined.split(), np.diff(np.searchsorted(starts, upto + 1), prepend=0)


def _hash(part: list[bytes], table: bytes, hashes: list, counts: list) -> None:
    data = np.frombuffer(b" " + b" ".join(part).translate(table) + b" ", np.uint8)
    space = SPACE[data]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    n = 1 << max(20, int(data.size).bit_length())
    total = BYTES[data]
    total *= powers(BASE, n)[:data.size]
    np.cumsum(total, out=total)
    h = total[ends - 1] - total[starts - 1]
    h *= powers(INVERSE, n)[starts]
    hashes.append(mix64(h ^ (ends - starts).astype(np.uint64)))
    upto = np.cumsum([len(t) + 1 for t in part]) if part else np.zeros(0, np.int64)
    counts.append(np.diff(np.searchsorted(starts, upto + 1), prepend=0))


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` hashes in a row."""
    n = h.size - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += h[k:k + n] * PLACES[k]
    return mix64(total)


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """Per text its distinct shingles, ascending. A text of fewer words has its whole sequence as one, a text without
    words has none."""
    h, sizes = word_hashes(texts(column), LOWER)
    all_windows = rolling(h, width)
    out, at = [], 0
    for n in sizes.tolist():
        if n >= width:
            out.append(np.unique(all_windows[at:at + n - width + 1]))
        elif n:
            out.append(mix64((h[at:at + n] * PLACES[:n]).sum(dtype=np.uint64, keepdims=True) + PLACES[-n - 1:-n]))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out
