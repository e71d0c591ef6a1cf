"""Rule-based alerts for the latest semester."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlake import settings as S
from cohortlake.functions.measures import same_season
from cohortlake.operators.kpis import comparison_semester

LEVELS = ("critical", "warning", "attention", "positive")
COLUMNS = ["Level", "Metric", "EntityKey", "Entity", "Before", "After", "Value"]


def _alert(df: DataFrame, level, metric: str, key, entity, before, after, value) -> DataFrame:
    level = level if isinstance(level, Column) else F.lit(level)
    return df.select(level.alias("Level"), F.lit(metric).alias("Metric"), key.cast("long").alias("EntityKey"),
                     entity.alias("Entity"), before.cast("double").alias("Before"),
                     after.cast("double").alias("After"), value.cast("double").alias("Value"))


def risk_alert(kpi: DataFrame, limits: S.Thresholds = S.DEFAULTS) -> DataFrame:
    hit = kpi.where(F.col("high_risk_share") >= limits.high_risk_share)
    none = F.lit(None).cast("double")
    return _alert(hit, LEVELS[0], "risk", none, F.lit(None).cast("string"), none,
                  F.col("high_risk_share"), F.col("high_risk_students"))


def gpa_trend_alert(trend: DataFrame, latest, limits: S.Thresholds = S.DEFAULTS) -> DataFrame:
    """Three same-season semesters in a row in one direction, together at least 3 %.

    The faculty must have the latest semester and the comparison semester.
    """
    base = comparison_semester(trend, latest)
    w = Window.partitionBy("FacultyKey").orderBy("SemesterKey")
    season = trend.where(same_season("SemesterKey", latest)).withColumns({
        "_g0": F.lag("AvgGPA", 2).over(w), "_g1": F.lag("AvgGPA", 1).over(w)})
    compared = trend.where(F.col("SemesterKey") == base).select("FacultyKey")
    rows = season.where(F.col("SemesterKey") == latest).join(compared, "FacultyKey", "left_semi")
    g0, g1, g2 = F.col("_g0"), F.col("_g1"), F.col("AvgGPA")
    move = g2 / g0 - 1
    falling, rising = (g0 > g1) & (g1 > g2), (g0 < g1) & (g1 < g2)
    hit = rows.where((F.abs(move) >= limits.gpa_change) & (falling | rising))
    return _alert(hit, F.when(falling, LEVELS[1]).otherwise(LEVELS[3]), "gpa_trend",
                  F.col("FacultyKey"), F.col("FacultyName"), g0, g2, move)


def faculty_alerts(trend: DataFrame, latest, limits: S.Thresholds = S.DEFAULTS) -> DataFrame:
    """Attendance drop, GPA change and weak collection against the comparison semester."""
    base = comparison_semester(trend, latest)
    before = trend.where(F.col("SemesterKey") == base).select(
        "FacultyKey", F.col("AttendanceRate").alias("_att"), F.col("AvgGPA").alias("_gpa"))
    rows = trend.where(F.col("SemesterKey") == latest).join(before, "FacultyKey")
    key, name = F.col("FacultyKey"), F.col("FacultyName")
    drop = F.col("_att") - F.col("AttendanceRate")
    change = F.col("AvgGPA") / F.col("_gpa") - 1
    none = F.lit(None).cast("double")
    return reduce(DataFrame.unionByName, [
        _alert(rows.where(drop >= limits.attendance_drop), LEVELS[1], "attendance", key, name,
               F.col("_att"), F.col("AttendanceRate"), drop),
        _alert(rows.where(F.abs(change) >= limits.gpa_change),
               F.when(change > 0, LEVELS[3]).otherwise(LEVELS[1]), "gpa", key, name,
               F.col("_gpa"), F.col("AvgGPA"), change),
        _alert(rows.where(F.col("CollectionRate") < limits.collection_rate), LEVELS[1], "finance", key, name,
               none, F.col("CollectionRate"), F.col("CollectionRate"))])


def course_alerts(courses: DataFrame, limits: S.Thresholds = S.DEFAULTS) -> DataFrame:
    hot = courses.where((F.col("Enrollment") >= limits.min_enrollment) & (F.col("FailureRate") > limits.course_failure))
    return _alert(hot, LEVELS[2], "course", F.col("CourseKey"), F.col("CourseName"),
                  F.lit(None).cast("double"), F.col("FailureRate"), F.col("FailureRate"))


def alerts(kpi: DataFrame, trend: DataFrame, courses: DataFrame, latest,
           limits: S.Thresholds = S.DEFAULTS) -> DataFrame:
    """All rules, most severe first; within a level by rule, entity and failure rate."""
    everything = reduce(DataFrame.unionByName, [
        risk_alert(kpi, limits), gpa_trend_alert(trend, latest, limits),
        faculty_alerts(trend, latest, limits), course_alerts(courses, limits)])
    severity = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("Level"))
    rate = F.when(F.col("Metric") == "course", -F.col("Value"))
    return everything.withColumn("Severity", (severity - 1).cast("int")).orderBy(
        "Severity", rate.asc_nulls_first(), "EntityKey", "Metric")
