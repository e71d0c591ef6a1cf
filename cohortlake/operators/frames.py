"""Base frames of the metric layer: what every analysis starts from."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlake import settings as S
from cohortlake.functions.measures import count_where, tenth_band

MID_PASS = S.SCORE_MAX["midterm"] * S.CONTROL_PASS_SHARE
FIN_PASS = S.SCORE_MAX["final"] * S.CONTROL_PASS_SHARE
EXAM_COLS = ["N", "Failed", "CurrentSum", "MidtermSum", "FinalSum", "Admitted",
             "MidLow", "FinLow", "MidOkFailed", "N5", "N4", "N3"]


def exam_sums() -> list[Column]:
    """Twelve additive measures of exam results. All rates at all grains derive from them."""
    admitted, failed = F.col("IsAdmitted"), F.col("IsFailed")

    def total(c):
        return F.coalesce(F.sum(c), F.lit(0)).cast("double")

    return [
        F.count(F.lit(1)).alias("N"),
        count_where(failed).alias("Failed"),
        total("CurrentScore").alias("CurrentSum"),
        total("MidtermScore").alias("MidtermSum"),
        total(F.when(admitted, F.col("FinalScore"))).alias("FinalSum"),
        count_where(admitted).alias("Admitted"),
        count_where(F.col("MidtermScore") < MID_PASS).alias("MidLow"),
        count_where(admitted & (F.col("FinalScore") < FIN_PASS)).alias("FinLow"),
        count_where(failed & (F.col("MidtermScore") >= MID_PASS)).alias("MidOkFailed"),
        *[count_where(F.col("FinalGrade") == g).alias(f"N{g}") for g in ("5", "4", "3")],
    ]


def semesters_in_use(semesters: DataFrame, snapshot: DataFrame) -> DataFrame:
    """M1: the semesters the snapshot has rows for."""
    used = snapshot.select("SemesterKey").distinct()
    return semesters.join(used, "SemesterKey", "left_semi").orderBy("SemesterKey")


def with_department(dim: DataFrame, departments: DataFrame) -> DataFrame:
    """M2: teachers or courses with the name and faculty of their department."""
    return dim.join(departments.select("DepartmentKey", "DepartmentName", "FacultyKey"), "DepartmentKey")


def student_columns(students: DataFrame) -> DataFrame:
    """M3: the student columns that reports may use."""
    wanted = ("StudentKey", "FullName", "GroupName", "Gender", "DateOfBirth", "FacultyKey", "DepartmentKey",
              "EnrollmentYear", "StudyYear", "ScholarshipStatus", "TuitionStatus", "Status", "StatusDate")
    return students.select(*[c for c in wanted if c in students.columns])


def latest_semester(snapshot: DataFrame) -> Column:
    """M5: the newest semester of the snapshot, as a scalar subquery."""
    return snapshot.agg(F.max("SemesterKey")).scalar()


def with_retention(snapshot: DataFrame, latest=None) -> DataFrame:
    """M4: 1 if the student also has the next semester, 0 if not, null where that cannot be known yet.

    One window over a student's few semesters instead of a self-join.
    """
    following = F.lead("SemesterKey").over(Window.partitionBy("StudentKey").orderBy("SemesterKey"))
    latest = latest_semester(snapshot) if latest is None else latest
    known = (F.col("StudySemester") < S.LAST_STUDY_SEMESTER) & (F.col("SemesterKey") < latest)
    stayed = F.coalesce(following == F.col("SemesterKey") + 1, F.lit(False))
    return snapshot.withColumn("Retained", F.when(known, stayed.cast("int")))


def course_semester(grades: DataFrame) -> DataFrame:
    """M7: exam sums and score totals by semester, course and teacher."""
    extra = [F.sum(c).cast("double").alias(n) for c, n in (
        ("GradePoints", "Points"), ("TotalScore", "Total"), ("FinalScore", "Final"),
        ("AttendanceScore", "Attendance"))]
    return grades.groupBy("SemesterKey", "CourseKey", "TeacherKey").agg(*exam_sums(), *extra)


def exam_group(grades: DataFrame, students: DataFrame) -> DataFrame:
    """M8: exam sums by semester and the student's faculty and academic group.

    Sums are taken per student first, so the join to the students moves one row per
    student and semester and not one per grade.
    """
    per_student = grades.groupBy("SemesterKey", "StudentKey").agg(*exam_sums())
    return (per_student.join(students.select("StudentKey", "FacultyKey", "GroupName"), "StudentKey")
            .groupBy("SemesterKey", "FacultyKey", "GroupName")
            .agg(*[F.sum(c).alias(c) for c in EXAM_COLS]))


def exam_dist(grades: DataFrame, students: DataFrame) -> DataFrame:
    """M9: joint counts of midterm and final results in tenths of their maximum (-1: not admitted)."""
    binned = grades.select(
        "SemesterKey", "StudentKey",
        tenth_band("MidtermScore", S.SCORE_MAX["midterm"]).alias("MidBin"),
        F.when(~F.col("IsAdmitted"), -1).otherwise(tenth_band("FinalScore", S.SCORE_MAX["final"]))
        .cast("int").alias("FinBin"))
    per_student = binned.groupBy("SemesterKey", "StudentKey", "MidBin", "FinBin").agg(F.count(F.lit(1)).alias("N"))
    return (per_student.join(students.select("StudentKey", "FacultyKey"), "StudentKey")
            .groupBy("SemesterKey", "FacultyKey", "MidBin", "FinBin").agg(F.sum("N").alias("N")))


def payments_by_faculty(payments: DataFrame, students: DataFrame) -> DataFrame:
    """Invoices and amounts by semester and faculty. Amounts stay decimal, so later sums are exact."""
    per_student = payments.groupBy("SemesterKey", "StudentKey").agg(
        F.count(F.lit(1)).alias("Invoices"), count_where(F.col("RemainingDebt") > 0).alias("WithDebt"),
        F.sum("TuitionAmount").alias("Tuition"), F.sum("PaidAmount").alias("Paid"),
        F.sum("RemainingDebt").alias("Debt"))
    return (per_student.join(students.select("StudentKey", "FacultyKey"), "StudentKey")
            .groupBy("SemesterKey", "FacultyKey")
            .agg(F.sum("Invoices").alias("Invoices"), F.sum("WithDebt").alias("WithDebt"),
                 *[F.sum(c).alias(c) for c in ("Tuition", "Paid", "Debt")]))


def payments_by_month(payments: DataFrame, date_dim: DataFrame) -> DataFrame:
    """Paid and invoiced amounts by calendar month."""
    daily = payments.groupBy("DateKey").agg(F.sum("PaidAmount").alias("Paid"), F.sum("TuitionAmount").alias("Tuition"))
    return (daily.join(date_dim.select("DateKey", "Year", "Month"), "DateKey").groupBy("Year", "Month")
            .agg(F.sum("Paid").cast("double").alias("Paid"), F.sum("Tuition").cast("double").alias("Tuition"))
            .orderBy("Year", "Month"))


def student_debt(payments: DataFrame) -> DataFrame:
    """Total debt and tuition per student."""
    return payments.groupBy("StudentKey").agg(
        F.sum("RemainingDebt").cast("double").alias("TotalDebt"),
        F.sum("TuitionAmount").cast("double").alias("TotalTuition"))


def data_version(run_log: DataFrame, risk: DataFrame) -> DataFrame:
    """Changes whenever a load or a scoring has finished."""
    run = run_log.where(F.col("Status") == "SUCCESS").agg(F.max("RunID")).scalar()
    at = F.date_format(F.max("ScoredAt"), "yyyy-MM-dd HH:mm:ss")
    return risk.agg(at.alias("_at")).select(
        F.concat_ws("-", F.coalesce(run.cast("string"), F.lit("None")),
                    F.coalesce(F.col("_at"), F.lit("None"))).alias("Version"))


def label_of(semesters: DataFrame, key) -> Column:
    """The label of one semester, as a scalar subquery."""
    return semesters.where(F.col("SemesterKey") == key).agg(F.max("SemesterLabel")).scalar()
