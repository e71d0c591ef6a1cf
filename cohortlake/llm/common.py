"""What several operators share: words, stable hashes, Arrow batches and intermediate tables."""

from __future__ import annotations

import ctypes
import gc
import time
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from cohortlake.session import written

__all__ = ["written", "words_of", "texts", "slices", "map_batches", "remainder", "mix64", "frame_of", "release", "short_batches", "tidied", "tidy", "whole_rows"]

#: The words of all operators: runs of bytes other than blank, tab, line feed, vertical tab, form feed and return.
#: bytes.split() without arguments splits at just these six, and bytes.lower() changes A-Z alone.
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: bytes | None, lower: bool = False) -> list[bytes]:
    if not text:
        return []
    return (text.lower() if lower else text).split()


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The UTF-8 bytes of a string column; None for null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def slices(batch: pa.RecordBatch, text: str, most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about so many bytes of text, at least one row each, so that memory follows
    the longest text and not the number of rows."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)).astype(np.int64)
    part = np.cumsum(sizes) // most_bytes
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str, text: str = "text") -> DataFrame:
    """``fn`` turns a part of a batch into columns by name; the rows go on in the given schema."""
    names = [x.split()[0] for x in _fields(schema)]

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                out = fn(part)
                yield pa.RecordBatch.from_arrays([out[n] if isinstance(out[n], pa.Array) else pa.array(out[n]) for n in names], names)
    return df.mapInArrow(tidied(run), schema)


def _fields(schema: str) -> list[str]:
    depth, parts = 0, [""]
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return [p.strip() for p in parts]


def remainder(doc_id: str | Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; an id that is null counts as empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(by))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of unsigned 64-bit integers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def short_batches(spark, rows: int = 2000, most_bytes: int = 4 << 20) -> None:
    """Documents are long rows: a session that hands over more of them at once than this, in rows or bytes, gets these limits. They
    are read when a plan is made, which can be after the call, so they stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", most_bytes)):
        now = spark.conf.get(key)
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def tidy() -> None:
    """Gives memory that a task has freed back to the system, as Spark uses the worker again for later tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no glibc
        pass


def tidied(fn: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The function of a task, with ``tidy`` at its end."""
    @wraps(fn)
    def run(batches):
        try:
            yield from fn(batches)
        finally:
            tidy()
    return run


def whole_rows(df: DataFrame, name: str = "row") -> Column:
    """All columns as one, so that an operator's own columns can have any names."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def frame_of(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def release(spark) -> None:
    """Shuffle files of frames that are out of reach go once the JVM has collected them, which takes two turns: one that
    finds what Python has let go, one for what that held."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)
