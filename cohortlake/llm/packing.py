"""12. Packing into sequences of at most 1024 tokens: order-preserving dynamic programming over cuts.

The documents of a range of ids are one stream of tokens in ascending order of doc_id. Windows follow each other in that
stream, and each ends at a cut: the end of a document (free), the end of a sentence (a small penalty, as it truncates the
document), or a place inside a sentence longer than ``STRETCH`` tokens (a larger one). The cuts minimise padding plus
penalties over the whole stream: with f(j) the least cost of all that ends at j,

    f(j) = penalty(j) + min over cuts i of  f(i) + padding(j - i),   0 < j - i <= 1024,

where the padding of n tokens is 1024 - n, or 0 if n is a power of two. As f(i) + 1024 - (j - i) is f(i) + i plus what depends on j
alone, its least value over the last 1024 tokens comes from a monotone queue of f(i) + i; the eleven powers of two
are looked up one by one. A cut costs constant time, amortised.

Chains of best predecessors run together after some windows. Whenever all chains from the last 1024 tokens meet in one cut, the
windows before it are final: they go out and their tokens are freed, so memory follows the longest document and not the task.

Streams are Spark tasks over ranges of ids, so each range ends with one window of its own. ``sequence_id`` is the number of the task
times 2^32 plus the number of its window: unique and ascending with doc_id, not dense. A task that is repeated gives the
same rows.

Cases: a null or empty text is its end token alone; rows of equal id follow each other in order of their texts; a null id comes
first and is null again; a text longer than a window is cut; a table without rows gives none. Other columns are not read.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from cohortlake.llm.common import slices
from cohortlake.llm.token_files import TOKENIZER, encoder

WIDTH = 1024
#: What a cut costs, in tokens of padding.
SENTENCE, WORD = 2, 24
#: Places this far apart are cuts where no sentence ends for so long.
STRETCH = 64
#: A task looks for final windows after so many tokens.
SETTLE = 1 << 20
PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def padding(n: int, width: int = WIDTH) -> int:
    return 0 if n & (n - 1) == 0 else width - n


class Windows:
    """The best windows of a stream, given its cuts in ascending order with their penalties."""

    def __init__(self, width: int = WIDTH):
        self.width = width
        self.at, self.cost, self.back = [0], [0], [-1]  # of each cut since the last final one: place, f, best predecessor
        self.place = {0: 0}
        self.queue = deque([0])  # cuts with ascending f + place, the least one first
        self.powers = [1 << k for k in range(width.bit_length()) if 1 << k <= width]

    def add(self, cuts: list[int], penalties: list[int]) -> None:
        at, cost, back, place, queue, width = self.at, self.cost, self.back, self.place, self.queue, self.width
        for j, penalty in zip(cuts, penalties):
            while j - at[queue[0]] > width:
                queue.popleft()
            best = queue[0]
            least = cost[best] + width - j + at[best]
            for n in self.powers:
                i = place.get(j - n)
                if i is not None and cost[i] < least:
                    least, best = cost[i], i
            k = len(at)
            least += penalty
            at.append(j)
            cost.append(least)
            back.append(best)
            place[j] = k
            while queue and cost[queue[-1]] + at[queue[-1]] >= least + j:
                queue.pop()
            queue.append(k)

    def chain(self, k: int) -> list[int]:
        ends = []
        while k > 0:
            ends.append(self.at[k])
            k = self.back[k]
        return ends[::-1]

    def settled(self) -> list[int]:
        """The ends of the windows that every continuation has; they are forgotten here."""
        last, open_cuts = self.at[-1], set()
        k = len(self.at) - 1
        while k >= 0 and last - self.at[k] < self.width:
            open_cuts.add(k)
            k -= 1
        while len(open_cuts) > 1:  # the latest one can be an ancestor of none, so it steps back
            k = max(open_cuts)
            open_cuts.remove(k)
            open_cuts.add(self.back[k] if k else 0)
        base = open_cuts.pop()
        ends = self.chain(base)
        if base:
            self.at, self.cost = self.at[base:], self.cost[base:]
            self.back = [max(-1, b - base) for b in self.back[base:]]
            self.place = {j: k for k, j in enumerate(self.at)}
            self.queue = deque(q - base for q in self.queue if q >= base)
        return ends

    def rest(self) -> list[int]:
        """The ends of the windows up to the last cut, which has to end one."""
        return self.chain(len(self.at) - 1)


def cuts_of(stops: np.ndarray, texts: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """All cuts after ``begin`` with their penalties: ends of texts, ends of sentences, and places in long sentences."""
    gaps = np.diff(stops, prepend=begin)
    extra = (gaps - 1) // STRETCH
    inside = np.repeat(stops - gaps, extra) + STRETCH * (1 + np.arange(int(extra.sum())) - np.repeat(np.cumsum(extra) - extra, extra))
    places = np.concatenate([stops, inside])
    costs = np.concatenate([np.where(np.isin(stops, texts), 0, SENTENCE), np.full(inside.size, WORD)])
    order = np.argsort(places, kind="stable")
    return places[order], costs[order]


class Stream:
    """Takes encoded documents, gives pieces of the windows that are final."""

    def __init__(self, width: int):
        self.windows, self.width = Windows(width), width
        self.done, self.number, self.fresh = 0, 0, 0  # place of the last final cut, windows before it, tokens not looked at
        self.ids, self.begin = [], 0                  # tokens kept, from place ``begin`` on
        self.docs, self.starts, self.sizes = [], [], []
        self.end = 0

    def add(self, doc_ids: list, sizes: np.ndarray, ids: np.ndarray, stops: np.ndarray) -> None:
        starts = self.end + np.cumsum(sizes) - sizes
        places, costs = cuts_of(self.end + stops, starts + sizes, self.end)
        self.windows.add(places.tolist(), costs.tolist())
        self.docs += doc_ids
        self.starts += starts.tolist()
        self.sizes += sizes.tolist()
        self.ids.append(ids)
        self.end += ids.size
        self.fresh += ids.size

    def pieces(self, last: bool = False) -> list[tuple]:
        """(doc_id, start, ids, doc_tokens, window, offset) of windows that became final."""
        ends = self.windows.rest() if last else self.windows.settled()
        self.fresh = 0
        if not ends:
            return []
        ids = np.concatenate(self.ids).astype("<u4", copy=False)
        ends, starts = np.array(ends), np.array(self.starts)
        stop = int(ends[-1])
        first = np.unique(np.concatenate([[self.done], ends[:-1], starts[(starts > self.done) & (starts < stop)]]))
        window = np.searchsorted(ends, first, "right")
        of = np.searchsorted(starts, first, "right") - 1
        offset = first - np.concatenate([[self.done], ends])[window]
        rows = []
        for a, b, w, d, o in zip(first.tolist(), [*first[1:].tolist(), stop], (self.number + window).tolist(), of.tolist(), offset.tolist()):
            rows.append((self.docs[d], a - self.starts[d], ids[a - self.begin:b - self.begin].tobytes(), self.sizes[d], w, o))
        self.number += len(ends)
        self.done = stop
        keep = int(np.searchsorted(starts, stop, "right")) - 1  # the document that goes on, or the last one
        self.docs, self.starts, self.sizes = self.docs[keep:], self.starts[keep:], self.sizes[keep:]
        self.ids, self.begin = [ids[stop - self.begin:].copy()], stop
        return rows


def batches_of(rows: list[tuple], task: int):
    for i in range(0, len(rows), 4096):
        doc, start, ids, size, window, offset = zip(*rows[i:i + 4096])
        whole = [pa.array(x, pa.int64()) for x in (doc, start, [len(x) // 4 for x in ids])]
        yield pa.RecordBatch.from_arrays([*whole, pa.array(ids, pa.binary()), *(pa.array(x, pa.int64()) for x in (size, [(task << 32) + w for w in window], offset))],
                                         [x.split()[0] for x in PIECES.split(", ")])


def pack(docs: DataFrame, tokenizer: str | None = None, text: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per piece of a document in a sequence: doc_id, start and length in the document's tokens, the ids
    (little-endian unsigned 32-bit integers), the document's number of tokens, sequence_id, and the offset in the sequence."""
    path = tokenizer or public_tokenizers.path(TOKENIZER)

    def run(batches):
        enc, stream, task = encoder(path), Stream(width), TaskContext.get().partitionId()
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                stream.add(part.column("doc_id").to_pylist(), *enc.coded(part.column("text")))
                if stream.fresh >= SETTLE:
                    yield from batches_of(stream.pieces(), task)
        yield from batches_of(stream.pieces(last=True), task)

    ordered = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, PIECES)


def digests(docs: DataFrame) -> DataFrame:
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
