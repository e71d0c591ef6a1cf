"""7. Token ids in binary files: fixed-width bit packing with block offsets.

A file holds the documents of one range of ids in ascending order. Its ids are packed ``bits`` each, the fewest that
the vocabulary needs, in blocks of ``BLOCK`` ids that begin at whole bytes. A footer has each document's id and first
token, and each block's byte offset, so that any range of tokens is one seek and one vectorised unpacking:

    magic "TKB1" | block 0 | block 1 | ... | doc_id int64 x n (0 for null) | null flag uint8 x n | first token int64 x (n + 1)
    | block offset int64 x (blocks + 1) | footer start, n, blocks, tokens: int64 x 4 | bits, BLOCK: int32 x 2 | magic

All numbers are little-endian. Bits fill bytes from the lowest up.

Writers are Spark tasks over ranges of ids; a task names its file anew on each attempt and returns the name in a row, so
that only files of committed attempts are ever in the manifest. The folder can be any that pyarrow's file systems reach.

Cases: a null or empty text has the end id alone; rows of equal id stand together, in order of their texts; a null id
comes first and is null again on reading; an empty table gives an empty manifest. Other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from functools import lru_cache
from io import BytesIO

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F
from tokenizers import Tokenizer

from cohortlake.llm.common import slices, written
from cohortlake.session import fresh_path

TOKENIZER = "byte_bpe_50k.json"
BLOCK = 4096
MAGIC = b"TKB1"
END_ID = 0
#: So many units are remembered by a worker before it starts anew; a bound on memory only.
MEMORY = 500_000
#: Units that are encoded as one string.
LINE = 512
LINE_FEED = "\u010a"  # how byte-level vocabularies write it
#: A blank after what str.isspace() takes for white space.
BLANK_AFTER_SPACE = r"[\t-\r\x1c-\x1f\x{85}\p{Z}] "
#: A unit that begins with a blank and ends in no white space.
STANDS_BEFORE_BLANK = r"(?s)^ .*[^\t-\r\x1c-\x1f\x{85}\p{Z}]$"
#: The marks that close a sentence, with closing quotes and brackets.
SENTENCE_END = "[.!?\u3002\uff01\uff1f][\"')\\]\u00bb\u201d\u2019]*$"
MANIFEST = "shard int, file string, bits int, documents long, tokens long"


# -- packing ---------------------------------------------------------------------------------------------------------

def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if ids.size and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} needs more than {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, count: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.uint32)
    planes = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    return planes.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


class Writer:
    """Writes blocks as they fill; the footer comes last. Memory: one block and a few numbers a document."""

    def __init__(self, sink, bits: int):
        self.sink, self.bits, self.at = sink, bits, len(MAGIC)
        self.ids, self.nulls, self.starts, self.offsets, self.tokens = [], [], [0], [], 0
        self.buffer = np.zeros(0, np.uint32)
        sink.write(MAGIC)

    def block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.offsets.append(self.at)
        self.at += len(data)
        self.sink.write(data)

    def add(self, doc_ids: list[int | None], sizes: list[int], ids: np.ndarray) -> None:
        self.nulls += [x is None for x in doc_ids]
        self.ids += [x or 0 for x in doc_ids]
        self.starts += (self.tokens + np.cumsum(sizes)).tolist()
        self.tokens += ids.size
        self.buffer = np.concatenate([self.buffer, ids])
        whole = self.buffer.size // BLOCK * BLOCK
        for i in range(0, whole, BLOCK):
            self.block(self.buffer[i:i + BLOCK])
        self.buffer = self.buffer[whole:]

    def close(self) -> None:
        if self.buffer.size:
            self.block(self.buffer)
        footer = (self.at, len(self.ids), len(self.offsets), self.tokens)
        for values, kind in ((self.ids, "<i8"), (self.nulls, "u1"), (self.starts, "<i8"), ([*self.offsets, self.at], "<i8"), (footer, "<i8"), ((self.bits, BLOCK), "<i4")):
            self.sink.write(np.array(values, kind).tobytes())
        self.sink.write(MAGIC)


class Reader:
    """Random access to a file: any range of tokens, or the documents one by one."""

    TAIL = 4 * 8 + 2 * 4 + 4

    def __init__(self, source):
        self.source = source
        size = source.size() if hasattr(source, "size") else source.seek(0, 2)
        source.seek(size - self.TAIL)
        tail = source.read(self.TAIL)
        if tail[-4:] != MAGIC:
            raise ValueError("not a token file")
        begin, n, blocks, self.tokens = np.frombuffer(tail, "<i8", 4).tolist()
        self.bits, self.block = np.frombuffer(tail, "<i4", 2, 32).tolist()
        source.seek(begin)
        data = BytesIO(source.read(size - self.TAIL - begin))
        take = lambda k, kind: np.frombuffer(data.read(k * np.dtype(kind).itemsize), kind)
        ids, nulls = take(n, "<i8"), take(n, "u1")
        self.doc_ids = [None if z else x for x, z in zip(ids.tolist(), nulls.tolist())]
        self.starts, self.offsets = take(n + 1, "<i8"), take(blocks + 1, "<i8")

    def read(self, start: int, stop: int) -> np.ndarray:
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        self.source.seek(int(self.offsets[first]))
        data, parts = self.source.read(int(self.offsets[last + 1] - self.offsets[first])), []
        for b in range(first, last + 1):
            a = int(self.offsets[b] - self.offsets[first])
            count = min(self.block, self.tokens - b * self.block)
            parts.append(unpack(data[a:a + int(self.offsets[b + 1] - self.offsets[b])], count, self.bits))
        return np.concatenate(parts)[start - first * self.block:stop - first * self.block]

    def documents(self, at_once: int = 1 << 20):
        """(doc_id, start, ids) in order, read in runs of about so many tokens."""
        d = 0
        while d < len(self.doc_ids):
            e = max(d + 1, int(np.searchsorted(self.starts, self.starts[d] + at_once, "right")) - 1)
            base = int(self.starts[d])
            ids = self.read(base, int(self.starts[e]))
            for k in range(d, e):
                yield self.doc_ids[k], int(self.starts[k]), ids[int(self.starts[k]) - base:int(self.starts[k + 1]) - base]
            d = e


# -- encoding --------------------------------------------------------------------------------------------------------

class Encoder:
    """The ids of whole texts. A text is a row of units, each a word with the white space before it: a byte-level
    pre-tokenizer never joins what stands before a blank with it, so units can be encoded by themselves. The distinct units
    of a slice are found in Arrow, and those that are new are encoded, many in one string; numpy then puts all ids in place."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # a special token's string in a text is ordinary text
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        # in a byte-level vocabulary, each character of a token stands for one byte
        tokens = [self.tokenizer.id_to_token(i) or "" for i in range(self.vocabulary)]
        self.width = np.array([len(t) for t in tokens])
        self.feed = np.array([t.endswith(LINE_FEED) for t in tokens])
        self.forget()

    def ids_of(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the strings, and how many each has."""
        got = [x.ids for x in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]
        return np.array([i for ids in got for i in ids], np.uint32), np.array([len(ids) for ids in got], np.int64)

    def learn(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all units, how many each has, and after how many of them a sentence ends in it (0: none does)."""
        # the first unit of a text, or one that ends in white space, would run into its neighbour
        alone = ~np.asarray(pc.match_substring_regex(units, STANDS_BEFORE_BLANK))
        ids, sizes = self.ids_of(units.filter(pa.array(alone)).to_pylist())
        rest = units.filter(pa.array(~alone))
        lines = pa.ListArray.from_arrays(pa.array([*range(0, len(rest), LINE), len(rest)], pa.int32()), rest)
        more, _ = self.ids_of(pc.binary_join(lines, "").to_pylist())
        ends, want = np.cumsum(self.width[more]), np.cumsum(np.asarray(pc.binary_length(rest)), dtype=np.int64)
        upto = np.searchsorted(ends, want) + 1
        if want.size and not np.array_equal(ends[upto - 1], want):
            raise ValueError("a token crosses the blank between two words: this is no byte-level tokenizer")
        order = np.argsort(np.concatenate([np.flatnonzero(alone), np.flatnonzero(~alone)]))
        ids, sizes = np.concatenate([ids, more]), np.concatenate([sizes, np.diff(upto, prepend=0)])
        begin = (np.cumsum(sizes) - sizes)[order]
        sizes = sizes[order]
        ids = ids[np.arange(ids.size) + np.repeat(begin - (np.cumsum(sizes) - sizes), sizes)]
        # a sentence ends after a unit that closes with its mark, or else after the last line feed in a unit
        stops = np.where(np.asarray(pc.match_substring_regex(units, SENTENCE_END)), sizes, 0)
        feeds = np.flatnonzero(self.feed[ids])
        of = np.searchsorted(np.cumsum(sizes), feeds, "right")
        last = np.zeros_like(sizes)
        last[of] = feeds + 1 - (np.cumsum(sizes) - sizes)[of]  # places ascend, so a unit's last one stays
        stops = np.where(stops > 0, stops, last)
        return ids, sizes, stops

    @staticmethod
    def careful(text: str) -> list[str]:
        """The text cut before each blank that follows no white space."""
        out, at, last = [], 0, text.find(" ")
        while last >= 0:
            if last and not text[last - 1].isspace():
                out.append(text[at:last])
                at = last
            last = text.find(" ", last + 1)
        return out + [text[at:]] if text else []

    def units(self, column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The distinct units of all texts; the units of the texts as places among them, one text after the other; and how
        many each text has. Texts with a blank after white space, where a blank isn't always a cut, are cut one by one."""
        column = pc.fill_null(column, "")
        odd = np.asarray(pc.match_substring_regex(column, BLANK_AFTER_SPACE))
        split = pc.split_pattern(column.filter(pa.array(~odd)), " ")
        parts = split.flatten().dictionary_encode()
        counts = np.zeros(len(column), np.int64)
        counts[~odd] = np.asarray(pc.list_value_length(split))
        keys = 2 * np.asarray(parts.indices).astype(np.int64) + 1
        keys[np.cumsum(counts[~odd]) - counts[~odd]] -= 1  # the first part of a text has no blank before it
        there = np.zeros(2 * len(parts.dictionary), np.int64)
        there[keys] = 1
        some = np.flatnonzero(there)
        before = pa.array(["", " "]).take(pa.array(some & 1))
        distinct = pc.binary_join_element_wise(before, parts.dictionary.take(pa.array(some >> 1)), "")
        flat = (np.cumsum(there) - 1)[keys]
        if odd.any():
            cut = [self.careful(t) for t in column.filter(pa.array(odd)).to_pylist()]
            known = {u: len(distinct) + k for k, u in enumerate(dict.fromkeys(u for us in cut for u in us))}
            distinct = pa.concat_arrays([distinct, pa.array(list(known), pa.string())])
            counts[odd] = [len(us) for us in cut]
            mixed, which = np.zeros(int(counts.sum()), np.int64), np.repeat(odd, counts)
            mixed[which], mixed[~which] = [known[u] for us in cut for u in us], flat
            flat = mixed
        return distinct, flat, counts

    def forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.ids, self.sizes, self.stops = np.array([END_ID], np.uint32), np.ones(1, np.int64), np.ones(1, np.int64)
        self.at = np.zeros(1, np.int64)

    def places(self, distinct: pa.Array) -> np.ndarray:
        """The places of distinct units among the known ones, after new ones have been encoded."""
        found = pc.index_in(distinct, self.known)
        new = distinct.filter(pc.is_null(found))
        if len(new) + len(self.known) > MEMORY and len(self.known):
            self.forget()
            return self.places(distinct)
        place = np.asarray(pc.fill_null(found, 0)).astype(np.int64) + 1
        if len(new):
            place[np.asarray(pc.is_null(found))] = len(self.known) + 1 + np.arange(len(new))
            ids, sizes, stops = self.learn(new)
            self.known = pa.concat_arrays([self.known, new])
            self.ids, self.sizes, self.stops = np.append(self.ids, ids), np.append(self.sizes, sizes), np.append(self.stops, stops)
            self.at = np.cumsum(self.sizes) - self.sizes
        return place

    def coded(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The number of ids of each text with its end id, all ids, and after how many ids sentences or texts end."""
        distinct, units, counts = self.units(column)
        place = self.places(distinct)
        sizes, stops, at = self.sizes, self.stops, self.at
        # the unit at place 0 is the end of a text
        units = np.insert(place[units], np.cumsum(counts), 0)
        own = sizes[units]
        upto = np.cumsum(own)
        begin = upto - own
        ids = self.ids[np.arange(upto[-1] if upto.size else 0) + np.repeat(at[units] - begin, own)]
        texts, stops = upto[np.cumsum(counts + 1) - 1], stops[units]
        return np.diff(texts, prepend=0), ids, (begin + stops)[stops > 0]

    def encode(self, texts: list[str | None] | pa.Array) -> tuple[list[int], np.ndarray]:
        """The number of ids of each text with its end id, and all ids."""
        sizes, ids, _ = self.coded(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        return sizes.tolist(), ids


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


# -- files -----------------------------------------------------------------------------------------------------------

def write(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, text: str = "text") -> DataFrame:
    """Encodes the documents and writes them in ascending doc_id order; returns the manifest, one row per file, as a
    written table. Files of a lower shard have the lower ids."""
    spark = docs.sparkSession
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    folder = folder or fresh_path(spark, "tokens")

    def run(batches):
        enc, writer, sink, name = encoder(path), None, None, None
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                if writer is None:
                    store, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
                    store.create_dir(root, recursive=True)
                    name = f"{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex}.tkb"
                    sink = store.open_output_stream(f"{root}/{name}")
                    writer = Writer(sink, bits_for(enc.vocabulary))
                sizes, ids = enc.encode(part.column("text"))
                writer.add(part.column("doc_id").to_pylist(), sizes, ids)
        if writer is not None:
            writer.close()
            sink.close()
            row = [TaskContext.get().partitionId()], [name], [writer.bits], [len(writer.ids)], [writer.tokens]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64()))], ["shard", "file", "bits", "documents", "tokens"])

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(run, MANIFEST), "manifest").withColumn("folder", F.lit(folder))


def read(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Per document of the files: doc_id, start (tokens of all files and documents before it), n_tokens, ids_crc32,
    and the ids themselves if asked for. The running total is over one row per file."""
    before = F.coalesce(F.sum("tokens").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.withColumn("before", before)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                store, root = fs.FileSystem.from_uri(row["folder"] if "://" in row["folder"] else f"file://{row['folder']}")
                with store.open_input_file(f"{root}/{row['file']}") as source:
                    out = []
                    for doc_id, start, ids in Reader(source).documents():
                        out.append((doc_id, row["before"] + start, ids.size, zlib.crc32(ids.astype("<u4").tobytes()), *([ids.astype(np.int32)] * with_ids)))
                        if len(out) >= 4096:
                            yield rows(out, with_ids)
                            out = []
                    if out:
                        yield rows(out, with_ids)
    # a file is one task's work; a named number of partitions is one that adaptive execution leaves as it is
    return shards.repartition(max(1, manifest.count())).mapInArrow(run, schema)


def rows(out: list[tuple], with_ids: bool) -> pa.RecordBatch:
    columns = [pa.array(list(c), pa.int64()) for c in list(zip(*out))[:4]]
    if with_ids:
        columns.append(pa.array([x[4] for x in out], pa.list_(pa.int32())))
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][:len(columns)])
