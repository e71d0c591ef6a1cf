"""Idempotent upserts on Parquet tables, expressed as joins."""

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from cohortlake.sources.tables import drop_partition, read_partitioned


def upsert_type1(target: DataFrame, source: DataFrame, key: list[str], compare: list[str] | None = None) -> DataFrame:
    """Insert new keys, update rows whose compared columns differ (null-safe), keep the rest.

    Nothing is deleted. Both sides are unique on the key, so the join has no hot keys. The column
    _action tells what happened to each row.
    """
    values = [c for c in target.columns if c not in key]
    compare = values if compare is None else compare
    t = target.select(*key, F.struct(*values).alias("_t"))
    s = source.select(*key, F.struct(*[F.col(c).cast(target.schema[c].dataType).alias(c) for c in values]).alias("_s"))
    same = reduce(and_, [F.col(f"_t.{c}").eqNullSafe(F.col(f"_s.{c}")) for c in compare], F.lit(True))
    action = (F.when(F.col("_t").isNull(), "INSERT").when(F.col("_s").isNull(), "KEEP")
              .when(same, "KEEP").otherwise("UPDATE"))
    joined = t.join(s, key, "full_outer").withColumns({"_action": action, "_staged": F.col("_s").isNotNull()})
    take_source = F.col("_action") != "KEEP"
    return joined.select(*key, *[F.when(take_source, F.col(f"_s.{c}")).otherwise(F.col(f"_t.{c}")).alias(c) for c in values],
                         "_action", "_staged")


def upsert_log(target: DataFrame, source: DataFrame, key: list[str]) -> DataFrame:
    """As an upsert, but every delivered row replaces the old one."""
    kept = target.join(source.select(*key), key, "left_anti")
    return kept.unionByName(source.select(*target.columns))


def load_audit(merged: DataFrame, table: str, staged: DataFrame | None = None) -> DataFrame:
    """Staged, inserted, updated and orphaned rows of one load.

    ``staged`` is the delivered frame where a join before the upsert may have lost rows.
    """
    counts = merged.agg(
        F.count(F.when(F.col("_action") == "INSERT", 1)).alias("RowsInserted"),
        F.count(F.when(F.col("_action") == "UPDATE", 1)).alias("RowsUpdated"),
        F.count(F.when(F.col("_staged"), 1)).alias("_joined"))
    delivered = F.col("_joined") if staged is None else staged.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("RowsStaged", delivered).select(
        F.lit(table).alias("TableName"), "RowsStaged", "RowsInserted", "RowsUpdated",
        (F.col("RowsStaged") - F.col("_joined")).alias("RowsOrphaned"))


def _among(column: str, values: list) -> Column:
    return F.col(column).isin([v for v in values if v is not None]) | (F.col(column).isNull() if None in values else F.lit(False))


def merge_partitioned(spark: SparkSession, path: str, schema: str, source: DataFrame, key: list[str], partition: str,
                      compare: list[str] | None = None) -> dict[str, int]:
    """W4 + W21 on a table partitioned by a column of whole numbers: the upsert of ``source``, in the partitions it touches.

    Touched are those of the staged rows and those that hold old rows of their keys, so that a row whose partition changes
    leaves its old one. Only these are read whole, and written, once, by Spark's dynamic overwrite of partitions; the others
    keep their files. A partition that all its rows leave is removed last. Should a run end in between, its rows are there twice
    until the load is repeated, which counts them once. The numbers of rows are observed while they are written.
    """
    whole = read_partitioned(spark, path, schema)
    source = source.select(*[F.col(c).cast(whole.schema[c].dataType).alias(c) for c in whole.columns])
    old = whole.select(*key, partition).join(source.select(*key).withColumn("_staged", F.lit(1)), key, "left")
    sides = source.groupBy(partition).agg(F.count(F.lit(1)).alias("arrive")).unionByName(
        old.groupBy(partition).agg(F.count("_staged").alias("known"), F.count(F.lit(1)).alias("held")), allowMissingColumns=True)
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("arrive", "known", "held")]
    touched = sides.groupBy(partition).agg(*sums).where("arrive > 0 OR known > 0").collect()  # a row per partition
    if not touched:
        return dict.fromkeys(COUNTS, 0)
    left = [r[partition] for r in touched if not r["arrive"] and r["known"] == r["held"]]
    target = whole.where(_among(partition, [r[partition] for r in touched if r[partition] not in left]))
    if left:
        target = target.unionByName(whole.where(_among(partition, left)).join(target.select(*key), key, "left_anti"))
    changes = [*(compare or [c for c in whole.columns if c not in key])]
    seen = Observation()
    merged = upsert_type1(target, source, key, [*changes, *({partition} - set(changes))]).observe(
        seen, *[c.alias(n) for n, c in zip(COUNTS, (F.count(F.when(F.col("_staged"), 1)), F.count(F.when(F.col("_action") == "INSERT", 1)), F.count(F.when(F.col("_action") == "UPDATE", 1))))])
    rows = merged.drop("_action", "_staged").hint("rebalance", partition)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(partition).parquet(path)
    for value in left:
        drop_partition(spark, path, partition, value)
    return seen.get


COUNTS = ("RowsStaged", "RowsInserted", "RowsUpdated")


def audit_row(table: str, counts: dict[str, int], staged: DataFrame) -> DataFrame:
    """W5 for a load whose rows were counted while it was written; ``staged`` is the delivered frame."""
    given = staged.agg(F.count(F.lit(1)).alias("RowsStaged"))
    return given.select(F.lit(table).alias("TableName"), "RowsStaged", *[F.lit(counts[c]).alias(c) for c in COUNTS[1:]],
                        (F.col("RowsStaged") - counts["RowsStaged"]).alias("RowsOrphaned"))
