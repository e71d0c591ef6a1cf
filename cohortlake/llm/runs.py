"""11. Periodic runs of words: online dyadic square catching.

A square is a stretch of 2p words whose halves are equal. The words of all documents of a slice are one stream, with a
separator of its own after each document, and are appended in pieces to a ``Catcher``. For every level k, each completed
block of 2^k words ending at b has a catcher for the periods p of 2^k to 2^(k+1)-1, one for every word that comes at b+p-1:

* that word and the block's last one begin a suffix comparison: how many words before b equal those before b+p (at most 2^k);
* every word appended later advances a comparison that is still open, of the words from b on with those from b+p on (at
  most 2^(k+1));
* once both lengths together reach p, the words between their ends are squares of period p. They are reported, and again
  when they have grown.

A first half begins in exactly one block of its level, at most 2^k words before the block's end, so no square is missed, and
the last block that ends inside a run follows it to its end. Squares of one period that share p words or more are parts of
one stretch; stretches of a period that is a multiple of a smaller one are left out. What stays are the maximal runs.

All words of a piece meet one block end per level, so a piece costs one vectorised comparison a level, and the open
comparisons cost what they match. Two words within one known long run of period q open none if q divides p (what they would
find is that run), or if q <= p and the run goes on for q words on both sides (q equal words in a row would make q no
smallest period, so fewer than p words match).

Cases: a null or empty text has no words and no runs; rows of equal id or text are treated one by one; a table without rows
gives none. A null id counts as empty text where ids are hashed (``repeated``). Other columns go along in ``row`` if asked for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from cohortlake.llm.common import remainder, slices, texts

#: Words appended to the catchers at once; bounds the temporary arrays of one step.
PIECE = 1 << 16
#: Known stretches of so many words keep later levels from comparing inside them.
KNOWN = 64
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def matching(words: np.ndarray, x: np.ndarray, y: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """How many words from x on equal those from y on, at most ``most`` each; going up (step 1) or down (-1). Widths double
    for the pairs that still match."""
    found, live, width = np.zeros(x.size, np.int64), np.flatnonzero(most > 0), 1
    while live.size:
        width = min(width, max(1, (1 << 20) // live.size))
        left = most[live] - found[live]
        ahead = np.arange(width)
        inside = ahead < left[:, None]
        ahead = np.where(inside, ahead, 0)
        base = found[live][:, None] + ahead
        same = (words[x[live][:, None] + step * base] == words[y[live][:, None] + step * base]) & inside
        got = np.where(same.all(1), width, same.argmin(1))
        found[live] += got
        live = live[(got == width) & (found[live] < most[live])]
        width = min(2 * width, 1024)
    return found


class Catcher:
    """Squares with periods up to ``longest`` in a stream of word numbers. ``append`` reports the squares that new words
    complete or extend, as rows (start, end, period)."""

    def __init__(self, longest: int):
        self.levels = max(0, int(longest).bit_length())
        self.longest, self.n = longest, 0
        self.words = np.zeros(1 << 12, np.int64)
        # the known stretch that holds a word: its period (0: none), start and end
        self.period, self.start, self.stop = (np.zeros(1 << 12, np.int64) for _ in range(3))
        self.open = [np.zeros((0, 4), np.int64) for _ in range(self.levels)]  # b, p, words before, words after

    def grow(self, size: int) -> None:
        if size > self.words.size:
            more = np.zeros(max(size, 2 * self.words.size) - self.words.size, np.int64)
            self.words, self.period, self.start, self.stop = (np.concatenate([a, more]) for a in (self.words, self.period, self.start, self.stop))

    def begun(self, old: int, k: int) -> np.ndarray:
        """The comparisons that the words from ``old`` on begin with the block ends of level k."""
        j = np.arange(max(old, (2 << k) - 1), self.n)
        b = (((j + 1) >> k) - 1) << k
        hit = self.words[j] == self.words[b - 1]
        hit &= j + 1 - b <= self.longest
        j, b = j[hit], b[hit]
        p, q, s, e = j + 1 - b, self.period[j], self.start[j], self.stop[j]
        known = (q > 0) & (s < b) & ((p % np.maximum(q, 1) == 0) | ((q <= p) & (s + q < b) & (j + q < e)))
        j, b, p = (a[~known] for a in (j, b, p))
        h = 1 + matching(self.words, b - 2, j - 1, np.full(j.size, (1 << k) - 1), -1)
        return np.stack([b, p, h, np.zeros_like(h)], 1)

    def append(self, new: np.ndarray) -> np.ndarray:
        old = self.n
        self.n += new.size
        self.grow(self.n)
        self.words[old:self.n] = new
        squares = []
        for k in range(self.levels):
            rows = np.concatenate([self.open[k], self.begun(old, k)])
            if not rows.size:
                continue
            b, p, h, t = rows.T
            room = np.minimum((2 << k) - t, self.n - (b + p + t))
            more = matching(self.words, b + t, b + p + t, room, 1)
            rows[:, 3] = t = t + more
            self.open[k] = rows[(more == room) & (t < 2 << k)]
            seen = (h + t >= p) & ((more > 0) | (b + p > old))
            found = np.stack([b - h, b + p + t, p], 1)[seen]
            if found.size:
                squares.append(found)
                self.note(found)
        return np.concatenate(squares) if squares else np.zeros((0, 3), np.int64)

    def note(self, found: np.ndarray) -> None:
        """Keeps long stretches in mind, joined with what is known of them from earlier words."""
        for s, e, p in merged(found).tolist():
            if e - s >= max(KNOWN, 4 * p):
                if self.period[s] == p and self.stop[s] - s >= p:  # two stretches that share less are two runs
                    s = int(self.start[s])
                self.period[s:e], self.start[s:e], self.stop[s:e] = p, s, e


def merged(squares: np.ndarray) -> np.ndarray:
    """The stretches that squares make up: those of one period that share a period's length or more are one."""
    if not squares.size:
        return squares
    s, e, p = squares[np.lexsort((squares[:, 0], squares[:, 2]))].T
    far = np.maximum.accumulate(e + p * (int(e.max()) + 1)) - p * (int(e.max()) + 1)  # the furthest end so far, within a period
    first = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (s[1:] + p[1:] > far[:-1])]))
    return np.stack([s[first], np.maximum.reduceat(e, first), p[first]], 1)


def primitive(words: np.ndarray, start: int, p: int) -> bool:
    """No smaller period divides p in the stretch that begins here (and has 2p words at least)."""
    rest, d = p, 2
    divisors = []
    while d * d <= rest:
        if rest % d == 0:
            divisors.append(d)
            while rest % d == 0:
                rest //= d
        d += 1
    if rest > 1:
        divisors.append(rest)
    part = words[start:start + 2 * p]
    return not any(np.array_equal(part[p // d:], part[:-(p // d)]) for d in divisors)


def runs_of(numbers: list[np.ndarray], exponent: int, least: int) -> list[np.ndarray]:
    """The runs of each sequence of (non-negative) word numbers as rows (start, length, period), by start, then period."""
    sizes = np.array([x.size for x in numbers], np.int64)
    stream = np.full(int(sizes.sum()) + sizes.size, -1, np.int64)
    first = np.cumsum(sizes + 1) - sizes - 1
    stream[first + sizes] = -1 - np.arange(sizes.size)  # equal to nothing else
    for f, x in zip(first.tolist(), numbers):
        stream[f:f + x.size] = x
    catcher = Catcher(int(sizes.max(initial=0)) // exponent)
    squares = [catcher.append(stream[i:i + PIECE]) for i in range(0, stream.size, PIECE)]
    found = merged(np.concatenate([np.zeros((0, 3), np.int64), *squares]))
    s, e, p = found.T
    found = found[e - s >= np.maximum(least, exponent * p)]
    found = found[[primitive(stream, s, p) for s, _, p in found.tolist()]] if len(found) else found
    s, e, p = found[np.lexsort((found[:, 2], found[:, 0]))].T
    at = np.searchsorted(s, np.append(first, stream.size))
    rows = np.stack([s, e - s, p], 1)
    return [rows[a:b] - [f, 0, 0] for a, b, f in zip(at, at[1:], first.tolist())]


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The text without the words that a run holds after its first period, joined by single blanks."""
    if not len(runs):
        return b" ".join(words)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
    np.add.at(cover, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()])


def find(docs: DataFrame, text: str = "text", exponent: int = 4, least: int = 6, keep: list[str] | None = None) -> DataFrame:
    """Per document the columns ``keep`` (default: doc_id), n_words, its runs (start, length and period in words, by start,
    then period) and the text with each run collapsed to one period. A run has ``exponent`` periods (2 or more) and ``least``
    words at least, and no neighbouring word continues it."""
    if exponent < 2:
        raise ValueError("runs have two periods at least")
    keep = ["doc_id"] if keep is None else keep
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text}`").alias("text"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words = [t.split() if t else [] for t in texts(part.column("text"))]
                sizes = np.cumsum([0, *map(len, words)])
                flat = pa.array([w for ws in words for w in ws], pa.binary()).dictionary_encode()
                codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                found = runs_of([codes[a:b] for a, b in zip(sizes, sizes[1:])], exponent, least)
                ends = np.cumsum([0, *map(len, found)])
                rows = np.concatenate(found)
                runs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c) for c in rows.T], fields=list(RUN_TYPE.value_type)))
                short = pa.array([collapsed(w, r) for w, r in zip(words, found)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(np.diff(sizes)), runs, short.cast(pa.string())], ["row", "n_words", "runs", "collapsed"])
    # a type and not its text: names of kept columns may need quotes
    own = StructType.fromDDL(f"n_words bigint, runs {RUNS}, collapsed string")
    out = given.mapInArrow(run, StructType([given.schema["row"], *own.fields]))
    return out.select(*[F.col("row").getField(c).alias(c) for c in keep], "n_words", "runs", "collapsed")


def repeated(text: str = "text", doc_id: str = "doc_id") -> Column:
    """The text, with a period planted where crc32 of the id is a multiple of 10: from word a on, every word is the one p
    words before it, as the query's contract says."""
    h = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))

    def planted(ws: Column) -> Column:
        n, g = F.size(ws).cast("long"), F.floor(h / 10)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        cycle = F.slice(ws, (a + 1).cast("int"), p.cast("int"))
        tail = F.slice(F.flatten(F.array_repeat(cycle, F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
        return F.array_join(F.concat(F.slice(ws, F.lit(1), a.cast("int")), tail), " ")
    has = F.regexp_like(F.col(text), F.lit(r"[^\x20\x09-\x0D]"))
    return F.when((remainder(doc_id, 10) == 0) & has, F.element_at(F.transform(F.array(words), planted), 1)).otherwise(F.col(text))


def digests(docs: DataFrame) -> DataFrame:
    """Per document its number of runs, the longest one (ties: least start, then period), and hashes of all runs and of
    the collapsed text."""
    found = find(docs.select("doc_id", repeated().alias("text")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"], r["period"])))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    one = found.select("doc_id", "runs", "collapsed", best.alias("best"))
    return one.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.less")).alias("length"), F.col("best.period").alias("period"),
        F.floor(-1000 * F.col("best.less") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
