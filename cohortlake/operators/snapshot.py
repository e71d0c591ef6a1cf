"""The student-semester snapshot: one row per student and semester, rebuilt from the facts."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlake import settings as S
from cohortlake.functions.measures import count_where, flag, mean, ratio
from cohortlake.functions.skew import lookup_counts

KEY = ["StudentKey", "SemesterKey"]


def grade_measures() -> list[Column]:
    return [F.count(F.lit(1)).cast("int").alias("CourseLoad"), F.sum("Credits").cast("int").alias("Credits"),
            F.sum(F.col("GradePoints") * F.col("Credits")).cast("double").alias("QualityPoints"),
            count_where(F.col("IsFailed")).cast("int").alias("FailedCourses")]


def attendance_measures() -> list[Column]:
    return [mean(flag(F.col("IsPresent"))).cast("decimal(5,4)").alias("AttendanceRate")]


def assignment_measures() -> list[Column]:
    return [mean("Score").cast("decimal(5,1)").alias("AvgAssignmentScore"),
            mean(flag(F.col("IsSubmitted"))).cast("decimal(5,4)").alias("SubmissionRate")]


def grade_base(grades: DataFrame) -> DataFrame:
    """Course count, credits, quality points and failed courses."""
    return grades.groupBy(*KEY).agg(*grade_measures())


def attendance_side(attendance: DataFrame) -> DataFrame:
    """Share of checks the student was present at."""
    return attendance.groupBy(*KEY).agg(*attendance_measures())


def assignment_side(assignments: DataFrame) -> DataFrame:
    """Mean score and share handed in."""
    return assignments.groupBy(*KEY).agg(*assignment_measures())


def payment_side(payments: DataFrame) -> DataFrame:
    """Open debt as a share of tuition; null where nothing was invoiced."""
    return payments.groupBy(*KEY).agg(
        ratio(F.sum("RemainingDebt"), F.sum("TuitionAmount")).cast("decimal(5,4)").alias("DebtRatio"))


def warning_side(warnings: DataFrame) -> DataFrame:
    """Warnings dated in the semester."""
    return warnings.groupBy(*KEY).agg(F.count(F.lit(1)).alias("Warnings"))


def teacher_load_side(enrollments: DataFrame) -> DataFrame:
    """How many enrolments a student's teachers have, on average.

    Every enrolment counts, so loads are counted in each task before they move, and enrolments move once to meet them. The
    join spreads a teacher of very many students over many tasks.
    """
    taught = ["TeacherKey", "SemesterKey"]
    seats = enrollments.select(*KEY, "TeacherKey").na.drop(subset=taught)
    load = seats.groupBy(*taught).agg(F.count(F.lit(1)).alias("_load"))
    both = lookup_counts(seats, load, taught, ["StudentKey"], "_load")
    return both.groupBy(*KEY).agg(ratio(F.sum("_load"), F.count(F.lit(1))).cast("decimal(8,1)").alias("AvgTeacherLoad"))


def running(c: str) -> Column:
    """Sum of the student's semesters so far."""
    so_far = (Window.partitionBy("StudentKey").orderBy("SemesterKey")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return F.sum(c).over(so_far)


def previous(c: Column) -> Column:
    """The value in the student's previous semester."""
    return F.lag(c).over(Window.partitionBy("StudentKey").orderBy("SemesterKey"))


def study_semester(first_year: int) -> Column:
    """Which of the student's semesters this is, counted from enrolment."""
    return F.col("SemesterKey") - 2 * (F.col("EnrollmentYear") - first_year) + 1


def student_semester(base: DataFrame, sides: list[DataFrame], students: DataFrame,
                     first_year: int = S.FIRST_ACADEMIC_YEAR, at_risk_gpa: float = S.AT_RISK_GPA,
                     at_risk_failed: int = S.AT_RISK_FAILED) -> DataFrame:
    """W13-W19 from the grade base and the side aggregates.

    All frames are one row per student and semester, so windows run over a handful of rows.
    """
    for side in sides:
        base = base.join(side, KEY, "left")
    base = base.join(students.select("StudentKey", "FacultyKey", "DepartmentKey", "EnrollmentYear"), "StudentKey")
    gpa = ratio("QualityPoints", "Credits")
    base = base.withColumns({"Warnings": F.coalesce("Warnings", F.lit(0)), "_gpa": gpa})
    everything = Window.partitionBy("StudentKey")
    return base.select(
        *KEY, "FacultyKey", "DepartmentKey", study_semester(first_year).cast("int").alias("StudySemester"),
        "CourseLoad", "Credits", F.col("_gpa").cast("decimal(4,2)").alias("SemGPA"),
        ratio(running("QualityPoints"), running("Credits")).cast("decimal(4,2)").alias("CumGPA"),
        previous(F.col("_gpa")).cast("decimal(4,2)").alias("PrevGPA"),
        "AttendanceRate", "FailedCourses", running("FailedCourses").cast("int").alias("CumFailedCourses"),
        "AvgAssignmentScore", "SubmissionRate", running("Warnings").cast("int").alias("WarningsCum"),
        F.coalesce("DebtRatio", F.lit(0).cast("decimal(5,4)")).alias("DebtRatio"), "AvgTeacherLoad",
        flag((F.col("_gpa") < at_risk_gpa) | (F.col("FailedCourses") >= at_risk_failed)).alias("IsAtRisk"),
        flag(F.col("SemesterKey") == F.max("SemesterKey").over(everything)).alias("IsLastSemester"))
