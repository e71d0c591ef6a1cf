"""Core indicators by any grain, trends, and course and teacher summaries."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlake import settings as S
from cohortlake.functions.measures import difficulty, mean, ratio, same_season, weighted_mean
from cohortlake.operators.exams import exam_rates
from cohortlake.operators.frames import EXAM_COLS

SCORE_SUMS = {"Points": "AvgGPA", "Total": "AvgScore", "Final": "Final", "Attendance": "Attendance"}


def aggregate(snapshot: DataFrame, payments: DataFrame, by: list[str]) -> DataFrame:
    """Indicators of the snapshot by any keys; collections join on the keys they share."""
    out = snapshot.groupBy(*by).agg(
        F.count(F.lit(1)).alias("Students"), weighted_mean("SemGPA", "Credits").alias("AvgGPA"),
        mean("AttendanceRate").alias("AttendanceRate"),
        ratio(F.sum("FailedCourses"), F.sum("CourseLoad")).alias("FailureRate"),
        mean("SubmissionRate").alias("SubmissionRate"), mean("IsAtRisk").alias("AtRiskShare"),
        mean("Retained").alias("Retention"))
    shared = [c for c in by if c in ("SemesterKey", "FacultyKey")]
    if not shared:
        return out
    paid = payments.groupBy(*shared).agg(*[F.sum(c).alias(c) for c in ("Tuition", "Paid", "Debt")])
    paid = paid.select(*shared, *[F.col(c).cast("double").alias(c) for c in ("Tuition", "Paid", "Debt")],
                       ratio("Paid", "Tuition").alias("CollectionRate"))
    return out.join(paid, shared, "left")


def semester_trend(snapshot, payments, semesters) -> DataFrame:
    """Indicators per semester, with its label."""
    labels = semesters.select("SemesterKey", "SemesterLabel")
    return aggregate(snapshot, payments, ["SemesterKey"]).join(labels, "SemesterKey")


def faculty_trend(snapshot, payments, semesters, faculties) -> DataFrame:
    """Indicators per semester and faculty, with labels."""
    return (aggregate(snapshot, payments, ["SemesterKey", "FacultyKey"])
            .join(semesters.select("SemesterKey", "SemesterLabel"), "SemesterKey")
            .join(faculties.select("FacultyKey", "FacultyName"), "FacultyKey"))


def season_split(trend: DataFrame, latest) -> DataFrame:
    """Only the semesters of one season, which are comparable year on year."""
    return trend.where(same_season("SemesterKey", latest)).orderBy("SemesterKey")


def season_trend_of(trend: DataFrame, faculty: Column, latest) -> DataFrame:
    """GPA of one faculty over the semesters of the latest season."""
    own = trend.where((F.col("FacultyKey") == faculty) & same_season("SemesterKey", latest))
    return own.select("FacultyKey", "SemesterKey", "SemesterLabel", "AvgGPA").orderBy("SemesterKey")


def course_summary(course_sem: DataFrame, courses: DataFrame, faculties: DataFrame,
                   semester=None, pooled: bool = False) -> DataFrame:
    """A10: one row per course and semester, or per course over all semesters (pooled)."""
    if semester is not None:
        course_sem = course_sem.where(F.col("SemesterKey") == semester)
    keys = ["CourseKey"] if pooled else ["CourseKey", "SemesterKey"]
    # the frame has one row per teacher already, so only the pooled form needs a distinct count
    teachers = F.count_distinct("TeacherKey") if pooled else F.count(F.lit(1))
    sums = course_sem.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in [*EXAM_COLS, *SCORE_SUMS]], teachers.alias("Teachers"))
    rated = exam_rates(sums).withColumns({c: ratio(c, "N") for c in SCORE_SUMS})
    named = rated.join(courses.select("CourseKey", "CourseName", "CurriculumSemester", "DepartmentName", "FacultyKey"),
                       "CourseKey").join(faculties.select("FacultyKey", "FacultyName"), "FacultyKey")
    return (named.withColumn("Difficulty", difficulty("FailureRate"))
            .withColumnsRenamed({"N": "Enrollment", "Points": "AvgGPA", "Total": "AvgScore"}))


def teacher_summary(course_sem: DataFrame, teachers: DataFrame, faculties: DataFrame, semester,
                    limits: S.Thresholds = S.DEFAULTS) -> DataFrame:
    """Load and results per teacher in one semester."""
    own = course_sem.where(F.col("SemesterKey") == semester).groupBy("TeacherKey").agg(
        F.sum("N").alias("Students"), F.count(F.lit(1)).alias("Courses"),
        ratio(F.sum("Points"), F.sum("N")).alias("AvgGPA"),
        (ratio(F.sum("Attendance"), F.sum("N")) / 100).alias("AttendanceRate"),
        ratio(F.sum("Failed"), F.sum("N")).alias("FailureRate"))
    names = teachers.select("TeacherKey", "TeacherName", "DepartmentKey", "DepartmentName", "FacultyKey")
    return (own.withColumn("Overloaded", F.col("Students") > limits.teacher_overload)
            .join(names, "TeacherKey").join(faculties.select("FacultyKey", "FacultyName"), "FacultyKey"))


def carry_last_retention(table: DataFrame, history: DataFrame, by: list[str], semester) -> DataFrame:
    """Where a semester's retention is not yet known, use the newest earlier semester that has any.

    ``history`` is the same aggregate over all semesters. A table without gaps stays as it is.
    """
    known = history.where((F.col("SemesterKey") < semester) & F.col("Retention").isNotNull())
    # one row per semester (and faculty): windows over all of them are small
    everything = Window.partitionBy()
    newest = known.withColumn("_newest", F.max("SemesterKey").over(everything))
    last = newest.where(F.col("SemesterKey") == F.col("_newest")).select(*by, F.col("Retention").alias("_last"))
    table = table.withColumn("_gap", F.max(F.col("Retention").isNull()).over(everything))
    table = table.join(last, by, "left") if by else table.withColumn("_last", last.agg(F.max("_last")).scalar())
    chosen = F.when(F.col("_gap"), F.col("_last")).otherwise(F.col("Retention"))
    return table.withColumn("Retention", chosen).drop("_last", "_gap")
