"""What moves between tasks stays in proportion to the rows: lines meet their orders once, loads are counted where rows lie."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cohortlake.functions import skew
from cohortlake.operators import snapshot
from cohortlake.plans.driver_tables import University

SEATS = [(1, 0, 7), (1, 0, 7), (1, 0, 8), (2, 0, 7), (2, 1, 7), (3, 0, None), (3, 1, 8), (None, 1, 8), (4, None, 7)]


@pytest.mark.parametrize("hot", [100_000, 1], ids=["no hot teacher", "hot teachers"])
def test_teacher_load(spark, monkeypatch, hot):
    monkeypatch.setattr(skew, "HOT", hot)
    rows = spark.createDataFrame(SEATS, "StudentKey long, SemesterKey int, TeacherKey long")
    got = {r[:2]: float(r[2]) for r in snapshot.teacher_load_side(rows).collect()}
    # load: teacher 7 has three seats in semester 0 and one in 1, teacher 8 one and two
    assert got == {(1, 0): 2.3, (2, 0): 3.0, (2, 1): 1.0, (3, 1): 2.0, (None, 1): 2.0}


def test_a_table_almost_as_long_as_the_rows_is_not_copied(spark):
    rows = spark.range(2000).select(F.col("id").alias("StudentKey"), F.lit(0).alias("SemesterKey"), (F.col("id") % 1000).alias("TeacherKey"))
    side = snapshot.teacher_load_side(rows)
    assert side.count() == 2000
    plan = side._jdf.queryExecution().optimizedPlan().toString()
    # loads are counted per teacher only
    assert not [line for line in plan.splitlines() if "Aggregate [StudentKey" in line and "TeacherKey" in line.split("]")[0]]


def tables(spark, folder):
    day = datetime(1996, 3, 1)
    spark.createDataFrame([(1, 10, "F", 5.0, day, "1-URGENT"), (2, 11, "O", 6.0, day, "5-LOW")],
                          "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
                          ).write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(k, 3, s, n, 4.0, 9.0, 0.05, 0.02, "A", "F", day) for k, s, n in ((1, 7, 1), (1, 8, 2), (2, 7, 1), (2, 7, 1), (3, 7, 1), (None, 7, 1))],
                          "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
                          "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(f"{folder}/lineitem.parquet")


def test_reports_join_lines_with_orders_once(spark, tmp_path):
    tables(spark, tmp_path)
    plain, gold = (University(spark, str(tmp_path), g) for g in (False, True))
    for of in (lambda u: u.line_facts, lambda u: u.enrollments):
        assert sorted(map(tuple, of(gold).collect())) == sorted(map(tuple, of(plain).collect()))
        assert of(gold).count() == 4
        assert not any(str(tmp_path) in f for f in of(gold).inputFiles())
