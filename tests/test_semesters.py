"""Semesters follow the orders, also before the first and after the last of the test tables."""

from cohortlake.plans.driver_tables import YEAR0, University


def test_semesters_span_all_orders(spark, tmp_path):
    def keys(dates):
        folder = tmp_path / str(len(dates))
        spark.createDataFrame([(d,) for d in dates], "d string").selectExpr("to_date(d) AS o_orderdate").write.parquet(f"{folder}/orders.parquet")
        return [(r["SemesterKey"], r["SemesterLabel"][:4], r["StartDate"].month) for r in University(spark, str(folder)).semesters.orderBy("SemesterKey").collect()]
    assert keys(["1999-03-01", "2003-08-01"]) == [(k, str(YEAR0 + k // 2), 7 if k % 2 else 1) for k in range(2 * (1999 - YEAR0), 2 * (2003 - YEAR0) + 2)]
    assert keys([]) == []
