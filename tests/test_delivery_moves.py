"""The rows of a delivery are counted in groups of keys and dealt out over tasks of bounded size."""

from pyspark.sql import functions as F

from cohortlake.operators import cleaning as C
from cohortlake.session import written


def test_rows_are_dealt_out_over_tasks_of_bounded_size(spark, monkeypatch):
    """With more rows than Spark's own number of partitions holds, the rows of a delivery go to more tasks."""
    monkeypatch.setattr(C, "ROWS_PER_TASK", 10)
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = 10 * own * 4
    key = F.when(F.col("id") % 50 != 0, F.floor(F.col("id") / 2).cast("string"))
    rows = spark.range(n).select(F.floor(F.col("id") / 40).cast("string").alias("_file"), F.col("id").alias("_ord"), key.alias("ID"), F.lit(0).alias("_trims"))
    last = C.dedupe_keep_last(rows, "ID", ["_ord"], written)
    assert last.agg(F.count("*"), F.sum("_dups"), F.countDistinct("ID")).first()[:] == (n // 2 + 4, n // 2 - 4, n // 2)  # four rows have no key
    assert last.rdd.getNumPartitions() > 2 * own


def test_keys_are_counted_in_groups(spark):
    stored = []

    def keep(df, label):
        stored.append(df.columns)
        return written(df, label)
    rows = spark.range(300).select(F.lit("a").alias("_file"), F.col("id").alias("_ord"), F.col("id").cast("string").alias("ID"), F.lit(0).alias("_trims"))
    assert C.dedupe_keep_last(rows, "ID", ["_ord"], keep).count() == 300
    assert stored == [["_bucket", "_n"]]
