"""5. Benchmark decontamination by edit distance: CGK embedding, bit-sampling LSH, exact verification.

A document is contaminated by an item if some stretch of it is within ``RATE`` * item length edits of the item; texts
are sequences of words (lower case, without ASCII punctuation), an edit inserts, deletes or replaces one.

The CGK embedding walks over a sequence: each step writes the current word and moves on or stays, by a random bit for
that step and word. Walks over two sequences meet again after an edit, so that few edits become few Hamming
differences. A walk of 2L steps covers some L words. An item of n words is indexed by all its segments of L words, L the
power of two up to (n + 1) / 2, ``SEGMENT`` at most, from the one at its start to the one that ends with it. With all
offsets in the index, windows of a document need to start at every (L / 2)th word only: of a leak, two windows or more meet
the segments that they are copies of, wherever its edits lie. Per walk, ``TABLES`` samples of ``SAMPLED`` of all its steps are
hashed; a window that agrees with a segment in one of them is a candidate if enough words around it are the item's, and
counts if the exact edit distance (free ends on the document's side) is low enough. ``WALKS`` * ``TABLES`` repetitions reach the
recall measured in the tests. Items of up to six words are found by any two words in a row (one has no edit), so all.

Items are handled in blocks of at most ``AT_ONCE`` words, each broadcast and matched with all documents, so no bound on
their number is assumed. Documents never move.

Cases: items without words match nothing, null and empty texts have no windows; equal items and repeated documents are
all reported; an empty table on either side gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortlake.llm.common import mix64, slices, tidied, texts
from cohortlake.llm.shingles import word_hashes

RATE = 0.2
SEGMENT = 32
WALKS = 4
TABLES = 16
SAMPLED = 3
#: Least steps between two of a sample: neighbouring ones often show the same word.
APART = 3
AT_ONCE = 1 << 17
STEP = 1 << 16  # words whose windows are walked together
_TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in bytes(range(256)).lower())


def words(text: bytes | None) -> np.ndarray:
    return word_hashes([text], _TABLE)[0]


# -- embedding and hashing -------------------------------------------------------------------------------------------

def length_of(n: int) -> int:
    """The words of an item's segments."""
    return min(n, 2) if n < 7 else min(SEGMENT, 1 << ((n + 1) // 2).bit_length() - 1)


def stride(low: int) -> int:
    """From so many words on a document starts one window, for segments of ``low`` words."""
    return max(1, low // 2)


@lru_cache
def samples(low: int) -> list[list[np.ndarray]]:
    """Per walk and table, the steps that are sampled for segments of ``low`` words."""
    if low <= 2:
        return [[np.arange(low)]]
    rng = np.random.default_rng(low)
    apart = min(APART, (2 * low - 1) // SAMPLED)
    spread = np.arange(SAMPLED) * (apart - 1)
    return [[np.sort(rng.choice(2 * low - spread[-1], SAMPLED, replace=False)) + spread for _ in range(TABLES)] for _ in range(WALKS)]


def moves(h: np.ndarray, walk: int) -> np.ndarray:
    """64 random bits of each word, one for each step."""
    return mix64(h ^ mix64(np.array([walk + 1], np.uint64)))


def hashes(h: np.ndarray, bits: np.ndarray, starts: np.ndarray, low: int, walk: int) -> list[np.ndarray]:
    """By table, the hash of the sampled steps of the windows from ``starts``. ``h`` goes on for 2 * SEGMENT words after the
    last start; ``bits`` are its moves."""
    wanted: dict[int, list[tuple[int, int]]] = {}
    for table, steps in enumerate(samples(low)[walk]):
        for k, step in enumerate(steps.tolist()):
            wanted.setdefault(step, []).append((k, table))
    out = [np.full(starts.size, table, np.uint64) for table in range(len(samples(low)[walk]))]
    at = starts.copy()
    for step in range(max(wanted) + 1):
        if step in wanted:
            word, last = h[at], None
            for k, table in sorted(wanted[step]):
                if k != last:
                    part, last = word * _PLACES[k], k
                out[table] += part
        at += ((bits[at] >> np.uint64(step)) & np.uint64(1)).astype(np.int64)
    return out


_PLACES = mix64(np.arange(101, 101 + SAMPLED, dtype=np.uint64)) | np.uint64(1)
_TOP = np.uint64(0x9E3779B97F4A7C15)


def slot(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys * _TOP) >> np.uint64(64 - bits)).astype(np.int64)


class Index:
    """The segments of a block of items by the hashes of their samples."""

    def __init__(self, items: list[tuple[int, np.ndarray]], rate: float = RATE):
        self.items = items
        sizes = np.array([h.size for _, h in items], np.int64)
        self.sizes, self.most = sizes, (rate * sizes).astype(np.int64)
        segments: dict[int, list[np.ndarray]] = {}  # (item, offset) by the segments' length
        for k, n in enumerate(sizes.tolist()):
            if n:
                at = np.arange(n - length_of(n) + 1)
                segments.setdefault(length_of(n), []).append(np.column_stack([np.full(at.size, k), at]))
        # what follows a segment in its item follows it here too, as it does in a document
        gap = np.zeros(2 * SEGMENT, np.uint64)
        h = np.concatenate([x for _, item in items for x in (item, gap)] or [gap])
        firsts = np.cumsum(sizes + gap.size) - sizes - gap.size
        self.tables, self.segments = {}, {low: np.concatenate(own) for low, own in segments.items()}
        for walk in range(WALKS):
            bits = moves(h, walk)
            for low, own in self.segments.items():
                if walk < len(samples(low)):
                    self.tables[low, walk] = []
                    for sig in hashes(h, bits, firsts[own[:, 0]] + own[:, 1], low, walk):
                        order = np.argsort(sig, kind="stable")
                        hit = np.zeros(1 << min(20, sig.size.bit_length() + 3), bool)
                        hit[slot(sig, hit.size.bit_length() - 1)] = True
                        self.tables[low, walk].append((hit, sig[order], order.astype(np.int32)))
        # which words each item has, as bits of a filter
        self.bits = max(12, int(sizes.sum()).bit_length() + 4)
        self.has = np.zeros(1 << self.bits, bool)
        self.salts = mix64(np.arange(1, len(items) + 1, dtype=np.uint64))
        for salt, (_, item) in zip(self.salts, items):
            self.has[slot(mix64(item ^ salt), self.bits)] = True

    def candidates(self, h: np.ndarray, count: int, sizes: np.ndarray | None = None) -> np.ndarray:
        """Rows (start, item, offset) for the windows from the first ``count`` words, of documents of ``sizes`` words."""
        sizes = np.array([count]) if sizes is None else sizes
        place = np.arange(count) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        found: dict[int, list[np.ndarray]] = {}
        for a in range(0, count, STEP):
            b = min(a + STEP, count)
            part = h[a:b + 2 * SEGMENT + 1]
            starts = {low: np.flatnonzero(place[a:b] % stride(low) == 0) for low in self.segments}
            for walk in range(WALKS):
                bits = moves(part, walk)
                for low in self.segments:
                    if (low, walk) not in self.tables:
                        continue
                    for sig, (hit, known, own) in zip(hashes(part, bits, starts[low], low, walk), self.tables[low, walk]):
                        maybe = np.flatnonzero(hit[slot(sig, hit.size.bit_length() - 1)])
                        lo, hi = np.searchsorted(known, sig[maybe], "left"), np.searchsorted(known, sig[maybe], "right")
                        maybe, lo, n = maybe[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
                        if maybe.size:
                            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
                            found.setdefault(low, []).append(np.repeat(starts[low][maybe] + a, n) << 32 | own[at])
        out = []
        for low, parts in found.items():
            pairs = np.unique(np.concatenate(parts))
            rows = np.column_stack([pairs >> 32, self.segments[low][pairs & 0xFFFFFFFF]])
            out += [own[self.enough(h[:count], own)] for own in np.split(rows, range(STEP >> 3, len(rows), STEP >> 3))]
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), np.int64)

    def enough(self, h: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Whether the stretch around each candidate has as many words of the item as any stretch that is close enough."""
        # segments of one item in one place share a stretch
        key, back = np.unique((rows[:, 0] - rows[:, 2] + (1 << 20)) * len(self.items) + rows[:, 1], return_inverse=True)
        item, at = key % len(self.items), key // len(self.items) - (1 << 20)
        n, most = self.sizes[item], self.most[item]
        left = np.maximum(at - most, 0)
        width = np.minimum(at + n + most, h.size) - left
        ends = np.cumsum(width)
        words = h[np.arange(ends[-1]) + np.repeat(left - ends + width, width)]
        own = self.has[slot(mix64(words ^ np.repeat(self.salts[item], width)), self.bits)]
        return (np.add.reduceat(own, ends - width, dtype=np.int64) >= n - most)[back]


# -- verification ----------------------------------------------------------------------------------------------------

def distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """The least edit distance between the item and any stretch of the text, and where that stretch ends."""
    steps = np.arange(text.size + 1)
    row = np.zeros(text.size + 1, np.int64)
    for k, w in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = k
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (text != w))
        row = np.minimum.accumulate(new - steps) + steps
    end = int(row.argmin())
    return int(row[end]), end


def leaks(h: np.ndarray, found: np.ndarray, items: list[tuple[int, np.ndarray]], rate: float) -> list[tuple[int, int, int, int]]:
    """(item_id, words of the item, distance, word where the stretch ends) of a document's candidates (start, item, offset)."""
    out = []
    for k in np.unique(found[:, 1]):
        item_id, item = items[k]
        most = int(rate * item.size)
        starts = np.unique(found[found[:, 1] == k][:, 0] - found[found[:, 1] == k][:, 2])
        best = None
        done = -1
        for s in starts.tolist():
            a, b = max(0, s - most), min(h.size, s + item.size + most)
            if b <= done:
                continue
            # candidates that lie close together share one stretch
            while True:
                more = starts[(starts - most <= b) & (starts + item.size + most > b)]
                if not more.size or b - a > 8 * item.size + 64:
                    break
                b = min(h.size, int(more[-1]) + item.size + most)
                if b == h.size:
                    break
            done = b
            text = h[a:b]
            if np.isin(item, text).sum() < item.size - most:
                continue
            d, end = distance(item, text)
            if d <= most and (best is None or d < best[2]):
                best = (item_id, int(item.size), d, a + end)
        if best:
            out.append(best)
    return out


# -- the operator ----------------------------------------------------------------------------------------------------

def blocks_of(items: DataFrame, text: str, item_id: str, at_once: int):
    """The items in blocks of at most ``at_once`` words (one item at least)."""
    block, size = [], 0
    for row in items.select(F.col(item_id).alias("i"), F.col(text).cast("binary").alias("t")).where("i is not null and t is not null").orderBy("i", "t").toLocalIterator():
        h = words(bytes(row["t"]))
        if block and size + h.size > at_once:
            yield block
            block, size = [], 0
        if h.size:
            block.append((row["i"], h))
            size += h.size
    if block:
        yield block


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id",
                  rate: float = RATE, at_once: int = AT_ONCE) -> DataFrame:
    """(doc_id, item_id, item_words, distance, end_word): each document and item with a stretch close enough, the closest."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, item_words int, distance int, end_word int"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = None

    def search(block):
        index = spark.sparkContext.broadcast(Index(block, rate))

        def run(batches):
            ix = index.value
            for batch in batches:
                for part in slices(batch, "text", 4 << 20):
                    h, sizes = word_hashes(texts(part.column("text")), _TABLE)
                    ends = np.cumsum(sizes)
                    found = ix.candidates(np.concatenate([h, np.zeros(2 * SEGMENT + 1, np.uint64)]), int(ends[-1]), sizes)
                    of = np.searchsorted(ends, found[:, 0], "right")
                    cuts = np.searchsorted(of, np.arange(sizes.size + 1))
                    ids, rows = part.column("doc_id").to_pylist(), []
                    for d in np.unique(of):
                        own = found[cuts[d]:cuts[d + 1]] - np.array([ends[d] - sizes[d], 0, 0])
                        rows += [(ids[d], *x) for x in leaks(h[ends[d] - sizes[d]:ends[d]], own, ix.items, rate)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], ["doc_id", "item_id", "item_words", "distance", "end_word"])
        return rows.mapInArrow(tidied(run), schema)

    for block in blocks_of(items, item_text, item_id, at_once):
        found = search(block)
        out = found if out is None else out.union(found)
    return out if out is not None else spark.createDataFrame([], schema)


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents without a leak of any item, whole and with all columns. Rows without an id stay."""
    bad = contamination(docs, items, **options).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
