"""Continuous delivery: the same cleaning, run on files as they arrive.

The refresh itself is a batch job; this wraps its cleaning in a file stream so that new files are
picked up once each and cleaned rows land in a Parquet folder; rejected rows with their reasons, issues per check
and counts per file land beside it, in folders with the suffixes _rejected, _quality and _files.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlake.operators import cleaning as C
from cohortlake.operators.cleaning import TableSpec
from cohortlake.sources.files import NA_TOKENS, text_schema


def clean_new_files(spark: SparkSession, folder: str, spec: TableSpec, out: str, checkpoint: str,
                    parents: dict[str, DataFrame] | None = None, max_files: int = 1000):
    """Start an available-now query over the CSV files of a table; each file is cleaned once.

    De-duplication, medians and outliers are per file, so micro-batches give the same rows as one
    large batch. A batch overwrites its own output folder, so a repeated batch adds nothing.
    """
    stream = (spark.readStream.schema(text_schema(spec.columns)).option("header", True)
              .option("maxFilesPerTrigger", max_files).option("pathGlobFilter", f"{{{spec.name},{spec.name}_*}}.csv").csv(folder))
    rows = stream.select(
        F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        *[F.when(~F.col(c).isin(*NA_TOKENS), F.col(c)).alias(c) for c in spec.columns])

    def one_batch(batch: DataFrame, number: int) -> None:
        ordered = batch.withColumn("_ord", F.struct("_block", F.monotonically_increasing_id().alias("r"))).drop("_block")
        cleaned = C.clean(ordered, spec, parents)
        parts = {"": cleaned.good().drop("_ord"), "_rejected": cleaned.rejected().drop("_ord"), "_quality": C.quality_log(cleaned), "_files": C.file_counts(cleaned)}
        for suffix, rows in parts.items():
            rows.write.mode("overwrite").parquet(f"{out}{suffix}/batch={number}")

    return (rows.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
