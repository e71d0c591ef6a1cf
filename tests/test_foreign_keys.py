"""Orphans among the keys of rows, by either way of joining them, without the help of skew handling."""

import pytest
from pyspark.sql import functions as F

from cohortlake.functions import skew
from cohortlake.operators import cleaning as C
from cohortlake.session import written

SPEC = C.TableSpec("lines", "LineID", ("LineID", "PartID"), foreign={"PartID": "parts"})


@pytest.fixture
def plain(spark):
    """Without adaptive handling of hot keys."""
    name = "spark.sql.adaptive.skewJoin.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, before)


@pytest.mark.parametrize("few,keep", [(100_000, written), (2, written), (100_000, None)], ids=["broadcast", "spread", "uncounted"])
@pytest.mark.parametrize("hot_is_orphan", [True, False])
def test_rows_with_an_orphan_key_are_rejected(spark, plain, monkeypatch, few, keep, hot_is_orphan):
    monkeypatch.setattr(C, "FEW", few)
    hot = 7 if hot_is_orphan else 2  # a third of all rows; parents are the even numbers
    key = F.when(F.col("id") % 3 == 0, hot).when(F.col("id") % 10 == 1, None).otherwise(F.col("id") % 100).cast("double")
    earlier = F.when(F.col("id") % 50 == 2, "missing_required")
    rows = spark.range(3000).select(F.col("id").cast("string").alias("LineID"), key.alias("PartID"), earlier.alias("Reason"))
    rows = rows.withColumn("_raw", F.struct("LineID", "PartID"))
    # a parent's key may come more than once, and be missing
    parents = spark.range(200).select(F.when(F.col("id") < 199, F.col("id") % 50 * 2).alias("key"))
    got = {int(r["LineID"]): r["Reason"] for r in C.check_foreign_keys(rows, SPEC, {"parts": parents}, keep).collect()}

    def want(k):
        part = hot if k % 3 == 0 else None if k % 10 == 1 else k % 100
        return "missing_required" if k % 50 == 2 else "orphan_key" if part is not None and part % 2 else None
    assert got == {k: want(k) for k in range(3000)}


def test_no_rows_and_no_parents(spark):
    rows = spark.createDataFrame([("1", 1.0, None), ("2", None, None)], "LineID string, PartID double, Reason string")
    rows = rows.withColumn("_raw", F.struct("LineID", "PartID"))
    none = spark.createDataFrame([], "key long")
    found = {r["LineID"]: r["Reason"] for r in C.check_foreign_keys(rows, SPEC, {"parts": none}, written).collect()}
    assert found == {"1": "orphan_key", "2": None}
    assert C.check_foreign_keys(rows.limit(0), SPEC, {"parts": none}, written).collect() == []


def plan_of(df):
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize("keep", [written, None], ids=["counted", "uncounted"])
def test_long_lists_of_keys_are_not_broadcast(spark, monkeypatch, keep):
    """Their files are small enough for Spark to try."""
    monkeypatch.setattr(C, "FEW", 2)
    stored = {}

    def kept(df, label):
        stored[label] = plan_of(df)
        return keep(df, label)
    rows = written(spark.range(2000).select(F.col("id").cast("string").alias("LineID"), F.col("id").cast("double").alias("PartID"), F.lit(None).cast("string").alias("Reason"),
                                            F.struct(F.col("id").cast("string").alias("LineID")).alias("_raw")), "rows")
    parents = written(spark.range(0, 2000, 2), "parents")
    checked = C.check_foreign_keys(rows, SPEC, {"parts": parents}, kept if keep else None)
    assert checked.where("Reason = 'orphan_key' AND PartID % 2 = 1").count() == checked.where("Reason IS NOT NULL").count() == 1000
    for plan in (*stored.values(), plan_of(checked)):
        broadcast = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
        assert not [line for line in broadcast if "_salt" in line or "LeftAnti" in line]


@pytest.mark.parametrize("places", [1 << 24, 128], ids=["few share a place", "all share places"])
@pytest.mark.parametrize("hot", [100_000, 50], ids=["no hot key", "hot key"])
def test_lookup_of_rare_keys(spark, plain, monkeypatch, places, hot):
    """Rows of any key, also none and both zeros, find what a plain join finds."""
    monkeypatch.setattr(skew, "PLACES", places)
    monkeypatch.setattr(skew, "HOT", hot)
    key = F.when(F.col("id") % 7 == 0, 3.0).when(F.col("id") % 7 == 1, None).when(F.col("id") % 7 == 2, F.expr("-0.0D")).otherwise(F.col("id").cast("double"))
    rows = spark.range(1000).select("id", key.alias("k"))
    counts = written(rows.groupBy("k").agg(F.count("*").alias("n")).where("k is not null and k % 3 = 0").withColumn("found", F.lit(True)), "counts")
    got = skew.lookup_rare(rows, counts, "k", ["id"], "n")
    want = rows.join(counts, "k", "left").select(*got.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.where("found").count() > 300
