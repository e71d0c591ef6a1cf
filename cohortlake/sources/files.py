"""Delivered files: discovery, change detection, and reading as text."""

import hashlib
from collections.abc import Iterator
from functools import partial, reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# --- fixed values: texts that stand for a missing value in delivered CSV files
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
             "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
SUFFIXES = ("csv", "json")
RANGE = 64 << 20


def text_schema(columns) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def with_origin(df: DataFrame, columns) -> DataFrame:
    """Add file name and delivery order, taken right after the scan: block start, then row in the block."""
    return df.select(
        F.col("_metadata.file_name").alias("_file"),
        F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("r")).alias("_ord"),
        *columns)


def read_text_csv(spark: SparkSession, path, columns, origin: bool = True) -> DataFrame:
    """Every column as text; the usual missing-value tokens become null."""
    df = spark.read.schema(text_schema(columns)).option("header", True).option("multiLine", False).csv(path)
    df = with_origin(df, columns) if origin else df
    return df.withColumns({c: F.when(~F.col(c).isin(*NA_TOKENS), F.col(c)) for c in columns})


def read_text_json(spark: SparkSession, path, columns, origin: bool = True, array: bool = True) -> DataFrame:
    """Arrays of records (or one record per line); numbers become text, null stays null.

    An array file is read by one task; large deliveries should have one record per line.
    """
    df = (spark.read.schema(text_schema(columns)).option("multiLine", array)
          .option("primitivesAsString", True).json(path))
    return with_origin(df, columns) if origin else df


def discover(spark: SparkSession, folder: str, table: str | None = None, suffixes=SUFFIXES) -> DataFrame:
    """S3: delivered files ``table.suffix`` and ``table_*.suffix``, sorted by name. Contents are not read."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length", "modificationTime")
    return named(files.withColumn("FileName", F.element_at(F.split("path", "/"), -1)), table, suffixes)


def named(files: DataFrame, table: str | None = None, suffixes=SUFFIXES) -> DataFrame:
    """S3: the files whose names are those of a table's deliveries."""
    suffix = F.element_at(F.split("FileName", r"\."), -1)
    stem = F.regexp_replace("FileName", r"\.[^.]*$", "")
    files = files.where(suffix.isin(*suffixes)).withColumn("Stem", stem)
    if table:
        files = files.where((F.col("Stem") == table) | F.startswith(F.col("Stem"), F.lit(table + "_")))
    return files.orderBy("FileName")


def file_hashes(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """A fingerprint per file of its bytes alone, by one rule for all sizes: MD5 of the MD5s of its byte ranges, in order.

    Ranges are ``RANGE`` bytes long, are read by tasks of their own, a piece at a time, and give one short row each.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length")  # no contents
    ranges = files.select("path", F.explode(F.sequence(F.lit(0), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(RANGE))).alias("at"))
    # ranges are tiny rows for much work, so they are dealt over a fixed number of tasks
    hashed = ranges.repartition(4 * spark.sparkContext.defaultParallelism).mapInArrow(partial(hash_ranges, most=RANGE), "path string, at bigint, hash string")
    # a file has few ranges: a thousand for every 64 GB
    whole = F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "hash"))), lambda x: x["hash"]), ",").cast("binary"))
    return hashed.groupBy("path").agg(whole.alias("FileHash")).select(F.element_at(F.split("path", "/"), -1).alias("FileName"), "path", "FileHash")


def hash_ranges(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = []
        for path, at in zip(batch.column("path").to_pylist(), batch.column("at").to_pylist()):
            store, name = fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)
            digest, left = hashlib.md5(usedforsecurity=False), most
            with store.open_input_file(name) as source:
                source.seek(at)
                while left and (piece := source.read(min(left, 1 << 20))):
                    digest.update(piece)
                    left -= len(piece)
            hashes.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("at"), pa.array(hashes, pa.string())], ["path", "at", "hash"])


def changed_files(manifest: DataFrame, file_log: DataFrame, full: bool = False) -> DataFrame:
    """Files that are new or differ from what the log has seen."""
    if full:
        return manifest
    return manifest.join(file_log.select("FileName", "FileHash"), ["FileName", "FileHash"], "left_anti")


def union_batches(spark: SparkSession, paths, columns, pk: str) -> DataFrame:
    """All batch files of a table, one row per key: the first in the order of the paths, then of names and rows."""
    parts = [read_text_csv(spark, p, columns).withColumn("_batch", F.lit(i)) for i, p in enumerate([paths] if isinstance(paths, str) else paths)]
    rows = reduce(DataFrame.unionByName, parts)
    first = rows.groupBy(F.col(pk).alias("_pk")).agg(F.min_by(F.struct(*columns), F.struct("_batch", "_file", "_ord")).alias("_row"))
    return first.select("_row.*")


def export_csv(df: DataFrame, path: str) -> None:
    """A result as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)
