"""13. Source divergence audit: how far the words of a source are from those of other sources, and which words do it.

Terms are counted where the documents are. The terms of a slice are cut from its bytes by numpy and packed by their length:
up to 8 bytes fill one unsigned 64-bit word, up to 16 two, most significant byte first; longer ones go into a bucket per
length and are sorted as byte strings. Words are sorted by radix, 16 bits at a time, behind the number of the document, so that
equal terms stand together, ordered by document, and documents of one group (language and source) follow each other;
lengths of runs then are the counts of terms and of the documents that have them.

A slice gives one row per group and term, and Spark adds them up, first in each task, then by term: no row carries
documents, and a hot source is only a number in the sums. Kept terms of a language are divided by hash into blocks of about
``BLOCK`` terms. A task compares all sources of the language on one block at a time, as a table of whole numbers; the sums per pair
of sources are added up by Spark. Nothing is collected to the driver.

Shares are whole numbers p = 1 + floor(10^9 (count + 2) / (N + 2 V)), computed as 38-digit decimals, and stay below 10^9 + 2, so that
squares of differences fit 64 bits. All arithmetic is exact.

Cases: null texts, languages and sources count as empty strings; a group without terms, or a language without kept terms,
has pairs of its own (of value 0 where V is 0); a language of one source has none; rows of equal id count one by one; equal
values are ordered by the item's bytes; a table without rows gives none. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from cohortlake.llm.common import slices, written

LEAST_DOCUMENTS = 10
TOP = 10
BLOCK = 2048
SLICE = 8 << 20
SCALE = 1_000_000_000
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
COUNTS = "lang string, source string, term string, n bigint, documents bigint"


# -- counting --------------------------------------------------------------------------------------------------------

def radix_order(words: list[np.ndarray]) -> np.ndarray:
    """A stable order by several arrays of unsigned integers, the least significant one first. Digits of 16 bits, which
    numpy sorts by counting; digits that are all equal are passed over."""
    order = None
    for word in words:
        for shift in range(0, 8 * word.itemsize, 16):
            digit = ((word >> word.dtype.type(shift)) & word.dtype.type(0xFFFF)).astype(np.uint16)
            if digit.size and (digit != digit[0]).any():
                step = np.argsort(digit if order is None else digit[order], kind="stable")
                order = step if order is None else order[step]
    return np.arange(words[0].size) if order is None else order


def packed(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at: int) -> np.ndarray:
    """Bytes ``at`` to ``at`` + 7 of each term as one number, zeros after its end."""
    view = np.ndarray((data.size - 7,), "<u8", data, 0, (1,))
    left = np.clip(sizes - at, 0, 8)
    word = view[np.where(left > 0, starts + at, 0)].byteswap()
    shift = (8 * (8 - np.maximum(left, 1))).astype(np.uint64)
    return np.where(left > 0, word >> shift << shift, np.uint64(0))


def counted(data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The terms of texts (lower-case bytes, with eight to spare, and where each text begins), per group: term, group, number of
    occurrences, and of documents. Texts of one group stand together."""
    inside = LETTER[data[:offsets[-1]]]
    edge = np.zeros(inside.size + 1, bool)
    edge[offsets] = True  # no term crosses a text's end
    before = np.concatenate([[False], inside])
    begin = np.flatnonzero(np.concatenate([inside, [False]]) & (~before | edge))
    end = np.flatnonzero(before & (~np.concatenate([inside, [False]]) | edge))
    sizes = end - begin
    document = np.searchsorted(offsets, begin, "right") - 1
    document = document.astype(np.uint32)
    bucket = np.where(sizes <= 16, (sizes > 8).astype(np.int64), sizes)
    results = []
    for size in np.unique(bucket).tolist():
        some = np.flatnonzero(bucket == size)
        s, n, d = begin[some], sizes[some], document[some]
        if size < 2:
            words = [packed(data, s, n, 8 * k) for k in range(size, -1, -1)]  # least significant first
            order = radix_order([d, *words])
            words = [w[order] for w in words]
            new = np.any([w[1:] != w[:-1] for w in words], 0)
        else:
            view = np.lib.stride_tricks.as_strided(data, (data.size - size + 1, size), (1, 1))
            strings = np.ascontiguousarray(view[s]).view(f"S{size}").ravel()
            order = np.argsort(strings, kind="stable")  # documents ascend already
            strings = strings[order]
            new = strings[1:] != strings[:-1]
        s, n, d = s[order], n[order], d[order]
        first = np.concatenate([[True], new | (group[d[1:]] != group[d[:-1]])])
        another = np.concatenate([[True], new | (d[1:] != d[:-1])])
        at = np.flatnonzero(first)
        results.append((s[at], n[at], group[d[at]], np.diff(np.append(at, d.size)), np.add.reduceat(another.astype(np.int64), at)))
    if not results:
        return pa.array([], pa.binary()), *[np.zeros(0, np.int64)] * 3
    s, n, g, occurrences, documents = (np.concatenate(x) for x in zip(*results))
    ends = np.cumsum(n)
    terms = data[np.arange(int(ends[-1])) + np.repeat(s - (ends - n), n)]
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(terms)]), g, occurrences, documents


def count(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per (lang, source, term) the occurrences and the documents; an empty term, without any, for each group."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                pairs = pa.StructArray.from_arrays([part.column("lang"), part.column("source")], ["lang", "source"]).to_pylist()
                names = list(dict.fromkeys((p["lang"], p["source"]) for p in pairs))
                number = {x: k for k, x in enumerate(names)}
                code = np.array([number[p["lang"], p["source"]] for p in pairs], np.int64)
                order = np.argsort(code, kind="stable")
                column = part.column("text").take(pa.array(order)).cast(pa.binary())
                offsets = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(column)).astype(np.int64))])
                data = np.zeros(int(offsets[-1]) + 8, np.uint8)
                data[:-8] = LOWER[np.frombuffer(b"".join(column.to_pylist()), np.uint8)]
                terms, g, n, d = counted(data, offsets, code[order])
                terms = pa.concat_arrays([terms, pa.array([b""] * len(names))]).cast(pa.string())
                g = pa.array(np.concatenate([g, np.arange(len(names))]))
                zero = np.zeros(len(names), np.int64)
                lang, source = (pa.array([x[k] for x in names], pa.string()).take(g) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([lang, source, terms, pa.array(np.append(n, zero)), pa.array(np.append(d, zero))], ["lang", "source", "term", "n", "documents"])

    named = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in (("lang", "lang"), ("source", "source"), (text, "text"))])
    return named.mapInArrow(run, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))


# -- comparing -------------------------------------------------------------------------------------------------------

def share(n: str, total: str, terms: str):
    return F.expr(f"cast(1 + (cast({SCALE} as decimal(10, 0)) * cast({n} + 2 as decimal(20, 0))) div (cast({total} as decimal(20, 0)) + 2 * cast({terms} as decimal(17, 0))) as bigint)")


def differences(key, rows: pa.Table, sources: pa.Table) -> pa.Table:
    """For one block of terms, the sum of f for each pair of sources. ``rows``: term, source, p; ``sources``: source and the p of a
    term that it lacks."""
    names = pc.sort_indices(sources.column("name"))
    name = sources.column("name").take(names).combine_chunks()
    none = np.asarray(sources.column("p_none").take(names)).astype(np.int64)
    terms = rows.column("term").combine_chunks().dictionary_encode()
    table = np.repeat(none[:, None], len(terms.dictionary), 1)
    table[np.asarray(pc.index_in(rows.column("source").combine_chunks(), name)), np.asarray(terms.indices)] = np.asarray(rows.column("p"))
    one, other, value = [], [], []
    for k in range(len(name) - 1):
        p, q = table[k], table[k + 1:]
        d, at = p - q, np.arange(k + 1, len(name))
        one.append(np.full(at.size, k))
        other.append(at)
        value.append((d * d // (p + q)).sum(1))
    one, other, value = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (one, other, value))
    lang = pa.array([key[0].as_py()] * (2 * one.size), pa.string())
    a, b = (name.take(pa.array(np.concatenate(x))) for x in ((one, other), (other, one)))
    return pa.table([lang, a, b, pa.array(np.append(value, value))], ["lang", "source", "item", "value"])


def audit(docs: DataFrame, text: str = "text", least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: per group each other source of its language (part ``pair``), and the terms that
    set it apart from its language (part ``term``, ranks up to ``top``)."""
    counts = written(count(docs, text), "counts")
    kept = counts.where("term != ''").groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("documents").alias("d")).where(F.col("d") >= least)
    kept = written(kept.select("lang", "term", "n_lang"), "kept")
    found = counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "n_lang")
    groups = counts.where("term = ''").select("lang", "source").join(found.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("n_all"))
    groups = groups.join(langs, "lang", "left").select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "v", "n_all")])
    groups = written(groups, "groups")

    rows = found.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", share("n", "total", "v").alias("p"), share("n_lang", "n_all", "v").alias("q"), F.ceil(F.col("v") / BLOCK).alias("blocks"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")))
    with_terms = groups.where("v > 0").withColumn("block", F.explode(F.sequence(F.lit(0), F.ceil(F.col("v") / BLOCK) - 1)))
    with_terms = with_terms.select("lang", "block", F.col("source").alias("name"), share("0", "total", "v").alias("p_none"))
    sums = rows.select("lang", "block", "source", "term", "p").groupBy("lang", "block").cogroup(with_terms.groupBy("lang", "block")).applyInArrow(
        differences, "lang string, source string, item string, value bigint")
    sums = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    # a language without kept terms has all its pairs with value 0
    bare = groups.where("v = 0").select("lang", "source")
    sums = sums.unionByName(bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source != item").withColumn("value", F.lit(0).cast("bigint")))

    value = F.expr("((p - q) * (p - q)) div (p + q)")
    apart = rows.where("p > q").select("lang", "source", F.col("term").alias("item"), value.alias("value"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    parts = [("pair", sums.withColumn("rank", F.row_number().over(order))), ("term", apart.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))]
    pair, term = (df.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank") for name, df in parts)
    return pair.unionByName(term)
