"""Checks that must hold after every load. Each is one row: Name, Passed, Found."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from cohortlake import settings as S
from cohortlake.functions.measures import count_where


def _row(df: DataFrame, name: str, passed, found) -> DataFrame:
    return df.select(F.lit(name).alias("Name"), passed.alias("Passed"), found.cast("long").alias("Found"))


def unique_key(df: DataFrame, name: str, pk: str) -> DataFrame:
    """V1: not empty and no key twice. Counting per key combines on the map side."""
    per_key = df.groupBy(pk).agg(F.count(F.lit(1)).alias("_n"))
    sums = per_key.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_rows"), F.count(F.lit(1)).alias("_keys"))
    return _row(sums, f"{name}: no duplicate keys", (F.col("_rows") == F.col("_keys")) & (F.col("_rows") > 0), F.col("_rows"))


def none_found(df: DataFrame, name: str) -> DataFrame:
    one = df.agg(F.count(F.lit(1)).alias("_n"))
    return _row(one, name, F.col("_n") == 0, F.col("_n"))


def has_parent(child: DataFrame, parent: DataFrame, on: list[str], name: str) -> DataFrame:
    """V2: every row has a match."""
    return none_found(child.select(*on).join(parent.select(*on), on, "left_anti"), name)


def scores_in_range(grades: DataFrame) -> DataFrame:
    """V3"""
    top = S.SCORE_MAX
    ok = (F.col("CurrentScore").between(0, top["current"]) & F.col("MidtermScore").between(0, top["midterm"])
          & F.col("FinalScore").between(0, top["final"]) & F.col("GradePoints").between(2, 5))
    return none_found(grades.where(~ok), "scores within valid range")


def grade_agrees(grades: DataFrame) -> DataFrame:
    """V4"""
    return none_found(grades.where((F.col("TotalScore") < S.PASS_MARK) != F.col("IsFailed")), "grade agrees with the pass mark")


def amounts_add_up(payments: DataFrame) -> DataFrame:
    """V5"""
    return none_found(payments.where(F.col("PaidAmount") + F.col("RemainingDebt") != F.col("TuitionAmount")),
                      "payments: paid + debt = tuition")


def snapshot_covers(snapshot: DataFrame, grades: DataFrame) -> DataFrame:
    """V6"""
    expected = grades.select("StudentKey", "SemesterKey").distinct().agg(F.count(F.lit(1))).scalar()
    one = snapshot.agg(F.count(F.lit(1)).alias("_n"))
    return _row(one, "snapshot covers every student-semester", F.col("_n") == expected, F.col("_n"))


def snapshot_complete(snapshot: DataFrame) -> DataFrame:
    """V7"""
    gap = (F.col("AttendanceRate").isNull() | F.col("SubmissionRate").isNull()
           | ~F.col("StudySemester").between(1, S.LAST_STUDY_SEMESTER))
    one = snapshot.agg(count_where(gap).alias("_n"))
    return _row(one, "snapshot has complete measures", F.col("_n") == 0, F.col("_n"))


def all_of(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def run_status(checks: DataFrame) -> DataFrame:
    """V8: FAILED if any check failed; the message lists them. A run has a dozen checks."""
    failed = F.array_sort(F.collect_list(F.when(~F.col("Passed"), F.col("Name"))))
    return checks.agg(failed.alias("_f"), F.count(F.lit(1)).alias("_n")).select(
        F.when(F.size("_f") > 0, "FAILED").otherwise("SUCCESS").alias("Status"),
        F.when(F.size("_f") > 0, F.array_join("_f", "; ")).otherwise(
            F.concat(F.col("_n").cast("string"), F.lit(" tests passed"))).alias("Message"))
