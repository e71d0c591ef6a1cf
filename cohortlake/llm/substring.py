"""3. Substring dedup by fixed-block anchors: words go that lie in a repeat of ``WINDOW`` words or more of earlier text.

A block is half a window, rounded up, so that every window of a document holds one whole block of the document's
fixed, non-overlapping blocks. The fixed blocks are the index; the rolling blocks at every word of all documents
probe it. Where a window is repeated, both its places are hits: at the one lies a fixed block, at the other the rolling
block equal to it. Hits are extended over all windows that hold them, and these windows are matched exactly: a window
goes if the same words start earlier (lower doc_id; or same document, lower position). Runs of such windows are the maximal
exact repeats. Everything is judged on the input, not on what is left of it.

Blocks move as packed arrays, one per task and bucket of hashes: sorted hashes by their low bytes and the steps of their
high bits, places in 20 bits. A block found more than once in a task is a hit already
and moves once, so no bucket ever gets more of one block than there are tasks, however often it occurs; likewise a
window, of which each task sends on its earliest place alone and knows that the others go.

Cases: a null or empty text has no words, texts shorter than a window lose none; rows of equal id are the same
document, so they don't make each other go; a null id is later than all others; an empty table gives an empty one.
What goes is kept by id and a hash of the text, so that rows of one id or without one lose only words of their own.
A text that loses nothing stays as it is; else its words are joined by one blank. Other columns stay; one with
the name of a result column is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cohortlake.functions.skew import lookup
from cohortlake.llm.common import release, slices, tidied, texts, whole_rows, words_of, written
from cohortlake.llm.shingles import rolling, word_hashes

WINDOW = 20
#: Words of a task that are packed together; a bound on memory only.
CHUNK = 1 << 20
#: Buckets of hashes for each shuffle partition; a bucket is what one call matches.
BUCKETS = 8
#: Bits of a block's hash that are kept within its bucket; blocks that agree in these alone are told apart by their windows.
KEY_BITS = 36
SHIFT, MASK = np.uint64(32), np.uint64(0xFFFFFFFF)
LAST = (1 << 63) - 1  # a null id


# -- packing ---------------------------------------------------------------------------------------------------------

def planes(x: np.ndarray, bytes_each: int) -> bytes:
    """The lowest bytes of the numbers, all first bytes together, then all second bytes: compresses better."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :bytes_each].T).tobytes()


def numbers(data: bytes, bytes_each: int) -> np.ndarray:
    out = np.zeros((len(data) // bytes_each, 8), np.uint8)
    out[:, :bytes_each] = np.frombuffer(data, np.uint8).reshape(bytes_each, -1).T
    return out.view("<u8").ravel().astype(np.uint64)


def sorted_bytes(x: np.ndarray) -> bytes:
    """Ascending numbers below 2 ** KEY_BITS: the low bytes as they are; of the high bits one bit a number and one a step."""
    low = 3 if x.size >= 512 else 4
    high = (x >> np.uint64(8 * low)).astype(np.int64)
    bits = np.zeros(x.size + (1 << (KEY_BITS - 8 * low)), np.uint8)
    bits[high + np.arange(x.size)] = 1
    return bytes([low]) + planes(x, low) + np.packbits(bits).tobytes()


def sorted_numbers(data: bytes, size: int) -> np.ndarray:
    low = data[0]
    at = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=1 + low * size)))
    return numbers(data[1:1 + low * size], low) | ((at - np.arange(size)).astype(np.uint64) << np.uint64(8 * low))


def place_bytes(x: np.ndarray) -> bytes:
    """Places in a chunk: 20 bits each, or 4 bytes where a long text makes the chunk longer."""
    if x.size and x.max() >> 20:
        return b"\4" + planes(x, 4)
    top = np.append(x >> 16, 0).astype(np.uint8)[:x.size + x.size % 2]
    return b"\2" + planes(x, 2) + (top[0::2] | top[1::2] << 4).tobytes()


def place_numbers(data: bytes, size: int) -> np.ndarray:
    if data[0] == 4:
        return numbers(data[1:], 4).astype("<u4")
    top = np.frombuffer(data, np.uint8, offset=1 + 2 * size)
    top = np.stack([top & 15, top >> 4], axis=1).ravel()[:size]
    return (numbers(data[1:1 + 2 * size], 2) | top.astype(np.uint64) << np.uint64(16)).astype("<u4")


def groups(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First positions and sizes of runs of equal keys."""
    starts = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if sorted_keys.size else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, sorted_keys.size))


def windows(sizes: np.ndarray, width: int) -> np.ndarray:
    """The places, in all texts put together, where so many words of one text start."""
    ends = np.cumsum(sizes)
    ok = np.ones(int(ends[-1]) if ends.size else 0, bool)
    for k in range(1, width):
        late = ends - k
        ok[late[sizes >= k]] = False
    return np.flatnonzero(ok)


# -- 1. blocks -------------------------------------------------------------------------------------------------------

def blocks(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    """Rows (bucket, chunk, kind, size, data) with kind 0: hash and place of the chunk's blocks in a bucket, 1: places that are
    hits already, 2: ids, keys and sizes of the chunk's documents."""
    block = (window + 1) // 2
    names = ["bucket", "chunk", "kind", "size", "data", "more", "fixed"]

    def pack(ids, keys, sizes, hashes, chunk):
        sizes = np.array(sizes, np.int64)
        h = np.concatenate(hashes)
        place = windows(sizes, block)
        firsts = np.repeat(np.cumsum(sizes) - sizes, sizes)
        long = np.repeat(sizes >= window, sizes)
        place = place[long[place]]
        hb = rolling(h, block)[place] if h.size >= block else np.zeros(0, np.uint64)
        fixed = (place - firsts[place]) % block == 0
        order = np.argsort(hb, kind="stable")
        hb, place, fixed = hb[order], place[order], fixed[order]
        starts, counts = groups(hb)
        many = np.repeat(counts > 1, counts)
        if starts.size:
            any_fixed = np.logical_or.reduceat(fixed, starts)
        rows = [(chunk % buckets, chunk, 2, len(ids), planes(np.array(ids + keys, np.int64).view(np.uint64), 8), sizes.astype("<i8").tobytes(), None)]
        if many.any():
            rows.append((chunk % buckets, chunk, 1, int(many.sum()), np.sort(place[many]).astype("<u4").tobytes(), None, None))
        if starts.size:
            key, at = hb[starts], place[starts]
            # the hash as a share of all buckets: whole part and fraction, both in the hashes' order
            n = np.uint64(buckets)
            bucket = ((key >> SHIFT) * n + ((key & MASK) * n >> SHIFT) >> SHIFT).astype(np.int64)
            key = key * n >> np.uint64(64 - KEY_BITS)
            cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            for a, b in zip(cuts, cuts[1:]):
                rows.append((int(bucket[a]), chunk, 0, int(b - a), sorted_bytes(key[a:b]), place_bytes(at[a:b]), np.packbits(any_fixed[a:b]).tobytes()))
        columns = list(zip(*rows))
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names)

    def run(batches):
        chunk = TaskContext.get().partitionId() << 24  # the same in every attempt
        ids, keys, sizes, hashes, held = [], [], [], [], 0
        for batch in batches:
            for piece in slices(batch, "text"):
                h, n = word_hashes(texts(piece.column("text")))
                ids += piece.column("doc_id").to_pylist()
                keys += piece.column("key").to_pylist()
                sizes += n.tolist()
                hashes.append(h)
                held += h.size
                if held > CHUNK:
                    yield pack(ids, keys, sizes, hashes, chunk)
                    chunk += 1
                    ids, keys, sizes, hashes, held = [], [], [], [], 0
        if ids:
            yield pack(ids, keys, sizes, hashes, chunk)
    return docs.mapInArrow(tidied(run), "bucket int, chunk long, kind int, size int, data binary, more binary, fixed binary")


def match(packed: DataFrame) -> DataFrame:
    """(chunk, kind, data, more): the places of a chunk that are hits, and the chunks' documents as they are."""
    def one(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        mine = [k for k, kind in enumerate(rows["kind"]) if kind == 0]
        out = [(rows["chunk"][k], rows["kind"][k], rows["data"][k], rows["more"][k]) for k, kind in enumerate(rows["kind"]) if kind]
        if len(mine) > 1:
            key = [sorted_numbers(rows["data"][k], rows["size"][k]) for k in mine]
            place = np.concatenate([place_numbers(rows["more"][k], rows["size"][k]) for k in mine])
            fixed = np.concatenate([np.unpackbits(np.frombuffer(rows["fixed"][k], np.uint8), count=x.size).astype(bool) for k, x in zip(mine, key)])
            source = np.repeat(np.arange(len(mine)), [x.size for x in key])
            key = np.concatenate(key)
            order = np.argsort(key, kind="stable")
            starts, counts = groups(key[order])
            hit = (counts > 1) & np.logical_or.reduceat(fixed[order], starts)
            hits = np.sort(order[np.repeat(hit, counts)])
            cuts = np.searchsorted(source[hits], np.arange(len(mine) + 1))
            for k, a, b in zip(mine, cuts, cuts[1:]):
                if a < b:
                    out.append((rows["chunk"][k], 1, place[hits[a:b]].tobytes(), None))
        columns = list(zip(*out)) or [[], [], [], []]
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["chunk", "kind", "data", "more"])
    return packed.groupBy("bucket").applyInArrow(one, "chunk long, kind int, data binary, more binary")


def hits_by_document(matched: DataFrame) -> DataFrame:
    """(doc_id, key, hits): the word positions of each row's hits, packed."""
    def one(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        own = rows["kind"].index(2)
        (ids, keys), sizes = np.split(numbers(rows["data"][own], 8).view(np.int64), 2), np.frombuffer(rows["more"][own], "<i8")
        places = [np.frombuffer(d, "<u4") for d, kind in zip(rows["data"], rows["kind"]) if kind == 1]
        places = np.unique(np.concatenate(places)).astype(np.int64) if places else np.zeros(0, np.int64)
        ends = np.cumsum(sizes)
        doc = np.searchsorted(ends, places, "right")
        starts, counts = groups(doc)
        data = [(places[a:a + n] - (ends[doc[a]] - sizes[doc[a]])).astype("<u4").tobytes() for a, n in zip(starts, counts)]
        return pa.table([pa.array(ids[doc[starts]], pa.int64()), pa.array(keys[doc[starts]], pa.int64()), pa.array(data, pa.binary())], names=["doc_id", "key", "hits"])
    # a chunk's hits come from one task each and are as many as its words at most
    return matched.groupBy("chunk").applyInArrow(one, "doc_id long, key long, hits binary")


# -- 2. windows ------------------------------------------------------------------------------------------------------

def places_to_go(found: DataFrame, window: int) -> DataFrame:
    """(doc_id, key, at, gone): for rows (doc_id, key, text, hits), the starts of windows that are found earlier, one by one or
    packed; a row may have several."""
    block = (window + 1) // 2
    names = ["h1", "h2", "doc_id", "key", "at", "tied", "gone"]

    def pack(held):
        doc, key = (np.repeat(np.array([x[k] for x in held], np.int64), [x[2].size for x in held]) for k in (0, 1))
        at, h1, h2 = (np.concatenate([x[k] for x in held]) for k in (2, 3, 4))
        order = np.lexsort((key, at, doc, h2, h1))
        doc, key, at, h1, h2 = doc[order], key[order], at[order], h1[order], h2[order]
        first = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
        # equal to the earliest place here: the same document in another row
        lead = np.maximum.accumulate(np.where(first, np.arange(first.size), 0))
        later = (doc != doc[lead]) | (at != at[lead])
        again = np.concatenate([[False], (key[1:] == key[:-1]) & (at[1:] == at[:-1]) & (doc[1:] == doc[:-1])]) & ~first
        # rows of other texts in that place share its fate and go with it
        tied = np.flatnonzero(~first & ~later & ~again)
        many = np.bincount((np.cumsum(first) - 1)[tied], minlength=int(first.sum()))
        others = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32)), pa.array(key[tied]), mask=pa.array(many == 0))
        yield pa.RecordBatch.from_arrays([pa.array(h1[first].view(np.int64)), pa.array(h2[first].view(np.int32)), pa.array(doc[first]), pa.array(key[first]), pa.array(at[first].astype(np.int32)), others, pa.nulls(int(first.sum()), pa.binary())], names)
        later &= ~again
        order = np.lexsort((at[later], key[later], doc[later]))
        doc, key, at = doc[later][order], key[later][order], at[later][order]
        starts = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])) if doc.size else np.zeros(0, np.int64)
        n = starts.size
        if n:
            data = [at[a:b].astype("<u4").tobytes() for a, b in zip(starts, np.append(starts[1:], doc.size))]
            # rows that have their answer go through the same exchange under keys of their own
            yield pa.RecordBatch.from_arrays([pa.array(key[starts]), pa.nulls(n, pa.int32()), pa.array(doc[starts]), pa.array(key[starts]), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int64())), pa.array(data, pa.binary())], names)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for piece in slices(batch, "text"):
                whole, sizes = word_hashes(texts(piece.column("text")))
                ends = np.cumsum(sizes)
                for doc, key, a, b, hits in zip(piece.column("doc_id").to_pylist(), piece.column("key").to_pylist(), ends - sizes, ends, piece.column("hits").to_pylist()):
                    h = whole[a:b]
                    n = h.size - window + 1
                    if n <= 0:
                        continue
                    hit = np.zeros(h.size + 1, np.int64)
                    at = np.frombuffer(hits, "<u4").astype(np.int64)
                    at = at[at <= h.size - block]
                    # windows that hold the block at p start from p - (window - block) to p
                    np.add.at(hit, np.maximum(at - (window - block), 0), 1)
                    np.add.at(hit, at + 1, -1)
                    p = np.flatnonzero(np.cumsum(hit)[:n] > 0)
                    held.append((doc, key, p, rolling(h, window)[p], (rolling(h * np.uint64(0x9E3779B97F4A7C15) ^ (h >> np.uint64(32)), window)[p] >> np.uint64(32)).astype(np.uint32)))
                    size += p.size
                if size > CHUNK:
                    yield from pack(held)
                    held, size = [], 0
        if held:
            yield from pack(held)
    rows = found.mapInArrow(tidied(run), "h1 long, h2 int, doc_id long, key long, at int, tied array<long>, gone binary")
    place = F.struct("doc_id", "at")
    rows = rows.withColumn("first", F.min(place).over(W.partitionBy("h1", "h2")))
    rows = rows.where(F.col("gone").isNotNull() | (place != F.col("first")))
    keys = F.concat(F.array("key"), F.coalesce("tied", F.array().cast("array<long>")))
    return rows.select("doc_id", F.explode(keys).alias("key"), "at", "gone")


# -- the operator ----------------------------------------------------------------------------------------------------

def place_of(text: str) -> list[Column]:
    """The id that orders documents, and what tells rows of one id, or without one, from each other (never 0)."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.xxhash64(text).bitwiseOR(F.lit(1)).alias("key")]


def repeats(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, key, at, gone): per row that loses words, the starts of its windows found earlier, also packed."""
    spark = docs.sparkSession
    rows = docs.select(*place_of(text), F.col(text).alias("text"))
    buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # of rows equal in id and text, each has hits in all its repeated windows, so those of one do
    hits = written(hits_by_document(match(blocks(rows, window, buckets))).dropDuplicates(["doc_id", "key"]), "anchors")
    release(spark)
    # windows of an id that only one text has move without their text's key
    shared = hits.where(F.col("doc_id") != LAST).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    hits = lookup(hits, shared, ["doc_id"], ["key"]).withColumn("alone", F.col("n").isNull() & (F.col("doc_id") != LAST)).drop("n")
    found = rows.join(hits, ["doc_id", "key"]).withColumn("key", F.when(F.col("alone"), F.lit(0)).otherwise(F.col("key"))).drop("alone")
    gone = places_to_go(found, window)
    gone = gone.groupBy("doc_id", "key").agg(F.collect_list("at").alias("at"), F.collect_list("gone").alias("gone"))
    keys = hits.where("alone").select("doc_id", F.col("key").alias("own"))
    alone = gone.where("key = 0").join(keys, "doc_id").select("doc_id", F.col("own").alias("key"), "at", "gone")
    gone = gone.where("key != 0").unionByName(alone)
    out = written(gone, "repeats")
    release(spark)
    return out


def dedup(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents with their text as it is left, n_words and n_removed, and the removed spans (from, to) in words."""
    gone = repeats(docs, text, window)
    kind = "struct<text:string,n_words:bigint,n_removed:bigint,spans:array<struct<start:int,stop:int>>>"

    @F.arrow_udf(kind)
    def cut(column: pa.Array, at: pa.Array, packed: pa.Array) -> pa.Array:
        out = []
        for t, a, g in zip(texts(column), at.to_pylist(), packed.to_pylist()):
            words = words_of(t)
            if not a and not g:
                out.append((t, len(words), 0, []))
                continue
            starts = np.unique(np.concatenate([np.array(a or [], np.int64), *(np.frombuffer(x, "<u4").astype(np.int64) for x in g or [])]))
            starts = starts[starts <= len(words) - window]
            step = np.flatnonzero(np.diff(starts) > window) + 1
            spans = [(int(s[0]), int(s[-1]) + window) for s in np.split(starts, step) if s.size]
            keep = np.ones(len(words), bool)
            for x, y in spans:
                keep[x:y] = False
            left = t if keep.all() else b" ".join([words[k] for k in np.flatnonzero(keep)])
            out.append((left, len(words), int((~keep).sum()), spans))
        columns = list(zip(*out)) or [[], [], [], []]
        span = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
        spans = pa.array([[{"start": x, "stop": y} for x, y in s] for s in columns[3]], pa.list_(span))
        return pa.StructArray.from_arrays([pa.array(list(columns[0]), pa.binary()).cast(pa.string()), pa.array(list(columns[1]), pa.int64()), pa.array(list(columns[2]), pa.int64()), spans], ["text", "n_words", "n_removed", "spans"])

    joined = docs.select(whole_rows(docs), *place_of(text), F.col(text).alias("t")).join(gone, ["doc_id", "key"], "left")
    joined = joined.withColumn("cut", cut.asNondeterministic()("t", "at", "gone"))
    rest = [c for c in docs.columns if c not in ("n_words", "n_removed", "spans")]
    return joined.select(*[F.col("cut.text").alias(text) if c == text else F.col("row").getField(c).alias(c) for c in rest], "cut.n_words", "cut.n_removed", "cut.spans")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the hash of the kept words joined by one blank."""
    cut = dedup(docs.select("doc_id", "text"))
    kept = F.array_join(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), " ")
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))
