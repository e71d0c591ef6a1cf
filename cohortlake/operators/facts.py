"""Fact tables from staged rows. Calendar lookups are small; joins on enrolments are large on both sides."""

from pyspark.sql import DataFrame, functions as F

from cohortlake import settings as S
from cohortlake.functions.measures import grade_of


def full_name(last="LastName", first="FirstName"):
    """W20"""
    return F.concat_ws(" ", F.col(last), F.col(first))


def fact_enrollments(stg: DataFrame, semesters: DataFrame) -> DataFrame:
    """The semester key of every enrolment."""
    found = semesters.select("SemesterKey", "AcademicYear", F.col("SemesterName").alias("Semester"))
    return stg.join(found, ["AcademicYear", "Semester"]).select(
        "EnrollmentID", F.col("StudentID").alias("StudentKey"), F.col("CourseID").alias("CourseKey"),
        F.col("TeacherID").alias("TeacherKey"), "SemesterKey")


def fact_grades(stg: DataFrame, enrollments: DataFrame, courses: DataFrame) -> DataFrame:
    """Total, grade, points and failure follow from the scores; semester and teacher from the enrolment."""
    enrolled = enrollments.select(F.col("StudentKey").alias("StudentID"), F.col("CourseKey").alias("CourseID"),
                                  "TeacherKey", "SemesterKey")
    credits = courses.select(F.col("CourseKey").alias("CourseID"), "Credits")
    rows = stg.join(enrolled, ["StudentID", "CourseID"]).join(credits, "CourseID")
    rows = rows.withColumn("TotalScore", F.col("CurrentScore") + F.col("MidtermScore") + F.col("FinalScore"))
    return rows.select(
        "GradeID", F.col("StudentID").alias("StudentKey"), F.col("CourseID").alias("CourseKey"), "TeacherKey", "SemesterKey",
        "CurrentScore", "MidtermScore", "FinalScore", "AttendanceScore", F.col("TotalScore").cast("decimal(5,1)").alias("TotalScore"),
        (F.col("ExamAdmitted") == S.YES_NO[0]).alias("IsAdmitted"), grade_of("TotalScore", 1).alias("FinalGrade"),
        grade_of("TotalScore", 2).cast("decimal(3,1)").alias("GradePoints"), "Credits",
        (F.col("TotalScore") < S.PASS_MARK).alias("IsFailed"), "IsMidtermImputed")


def _dated(stg: DataFrame, date_dim: DataFrame, date: str) -> DataFrame:
    """Add date key and semester; rows outside all semesters fall out."""
    days = date_dim.where(F.col("SemesterKey").isNotNull()).select(F.col("Date").alias(date), "DateKey", "SemesterKey")
    return stg.join(days, date)


def fact_attendance(stg: DataFrame, date_dim: DataFrame) -> DataFrame:
    """W9"""
    return _dated(stg, date_dim, "Date").select(
        "AttendanceID", F.col("StudentID").alias("StudentKey"), F.col("CourseID").alias("CourseKey"), "DateKey", "SemesterKey",
        "Status", (F.col("Status") == S.ATTENDANCE[0]).alias("IsPresent"))


def fact_payments(stg: DataFrame, date_dim: DataFrame) -> DataFrame:
    """W10"""
    return _dated(stg, date_dim, "PaymentDate").select(
        "PaymentID", F.col("StudentID").alias("StudentKey"), "DateKey", "SemesterKey",
        *[F.col(c).cast("decimal(14,2)").alias(c) for c in ("TuitionAmount", "PaidAmount", "RemainingDebt")], "PaymentStatus")


def fact_assignments(stg: DataFrame, enrollments: DataFrame, date_dim: DataFrame) -> DataFrame:
    """The semester comes from the enrolment; a submission date may be missing."""
    enrolled = enrollments.select(F.col("StudentKey").alias("StudentID"), F.col("CourseKey").alias("CourseID"), "SemesterKey")
    due = date_dim.select(F.col("Date").alias("DueDate"), F.col("DateKey").alias("DueDateKey"))
    handed = date_dim.select(F.col("Date").alias("SubmissionDate"), F.col("DateKey").alias("SubmissionDateKey"))
    rows = stg.join(enrolled, ["StudentID", "CourseID"]).join(due, "DueDate").join(handed, "SubmissionDate", "left")
    return rows.select(
        "AssignmentID", F.col("StudentID").alias("StudentKey"), F.col("CourseID").alias("CourseKey"), "SemesterKey",
        "DueDateKey", "SubmissionDateKey", "Score", "SubmissionStatus",
        (F.col("SubmissionStatus") != S.SUBMISSION[2]).alias("IsSubmitted"),
        (F.col("SubmissionStatus") == S.SUBMISSION[1]).alias("IsLate"))


def fact_warnings(stg: DataFrame, date_dim: DataFrame) -> DataFrame:
    """W12"""
    return _dated(stg, date_dim, "WarningDate").select(
        "WarningID", F.col("StudentID").alias("StudentKey"), "DateKey", "SemesterKey", "WarningType", "Severity")
