"""Headline figures, the scored-student table and debt bands."""

from pyspark.sql import DataFrame, functions as F

from cohortlake import settings as S
from cohortlake.functions.measures import count_where, is_high_risk, mean, ratio

COMPARED = {"avg_gpa": "AvgGPA", "attendance": "AttendanceRate", "failure_rate": "FailureRate",
            "collection_rate": "CollectionRate"}


def comparison_semester(trend: DataFrame, latest):
    """The same semester a year before, or the previous semester where that is missing."""
    year_ago = trend.where(F.col("SemesterKey") == latest - 2).agg(F.count(F.lit(1)) > 0).scalar()
    return F.when(year_ago, latest - 2).otherwise(latest - 1)


def graduation_rate(students: DataFrame) -> DataFrame:
    """Share of graduates in the cohorts that have at least one."""
    per_cohort = students.groupBy("EnrollmentYear").agg(
        count_where(F.col("Status") == S.STUDENT_STATUS[2]).alias("_done"), F.count(F.lit(1)).alias("_all"))
    return per_cohort.where(F.col("_done") > 0).agg(ratio(F.sum("_done"), F.sum("_all")).alias("graduation_rate"))


def kpis(trend: DataFrame, semesters: DataFrame, students: DataFrame, risk: DataFrame,
         payments: DataFrame, latest) -> DataFrame:
    """One row of headline values beside those of the comparison semester."""
    key = F.col("SemesterKey")
    has_year_ago = F.max(F.when(key == latest - 2, True)).isNotNull()

    def then(c):
        year_ago, before = F.max(F.when(key == latest - 2, F.col(c))), F.max(F.when(key == latest - 1, F.col(c)))
        return F.when(has_year_ago, year_ago).otherwise(before)

    def now(c):
        return F.max(F.when(key == latest, F.col(c)))

    picked = []
    for name, c in COMPARED.items():
        picked += [now(c).alias(name), then(c).alias(f"{name}_prev")]
    known = F.when(F.col("Retention").isNotNull(), F.struct(key, F.col("Retention").alias("r")))
    one = trend.agg(
        now("SemesterLabel").alias("semester"), then("SemesterLabel").alias("compared_with"),
        now("Students").alias("students_in_semester"), *picked,
        # one row per semester: a short list, newest first
        F.sort_array(F.collect_list(known), asc=False).alias("_kept"))
    scored = risk.agg(F.struct(
        count_where(is_high_risk()).alias("high"), F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum("IsFlagged"), F.lit(0)).alias("flagged"))).scalar()
    active = students.agg(count_where(F.col("Status") == S.STUDENT_STATUS[0])).scalar()
    return one.select(
        "semester", "compared_with", active.alias("total_students"), "students_in_semester",
        *[c for name in COMPARED for c in (name, f"{name}_prev")],
        F.try_element_at("_kept", F.lit(1)).getField("r").alias("retention"),
        F.try_element_at("_kept", F.lit(2)).getField("r").alias("retention_prev"),
        graduation_rate(students).scalar().alias("graduation_rate"),
        scored.getField("high").alias("high_risk_students"),
        ratio(scored.getField("high"), scored.getField("n")).alias("high_risk_share"),
        scored.getField("flagged").alias("flagged_students"),
        payments.agg(F.sum("Debt").cast("double")).scalar().alias("outstanding_debt"))


CURRENT = ["StudySemester", "SemGPA", "CumGPA", "AttendanceRate", "FailedCourses", "CumFailedCourses",
           "SubmissionRate", "AvgAssignmentScore", "WarningsCum", "DebtRatio"]


def risk_table(risk: DataFrame, snapshot: DataFrame, students: DataFrame, faculties: DataFrame,
               departments: DataFrame, latest) -> DataFrame:
    """Scored students with names and their indicators of the latest semester, riskiest first."""
    current = snapshot.where(F.col("SemesterKey") == latest).select("StudentKey", *CURRENT)
    names = students.select("StudentKey", "FullName", "GroupName", "StudyYear", "TuitionStatus")
    return (risk.join(current, "StudentKey", "left").join(names, "StudentKey")
            .join(faculties.select("FacultyKey", "FacultyName"), "FacultyKey")
            .join(departments.select("DepartmentKey", "DepartmentName"), "DepartmentKey")
            .orderBy(F.desc("RiskProbability"), F.asc("StudentKey")))


def risk_vs_debt(snapshot: DataFrame, students: DataFrame, latest) -> DataFrame:
    """Outcomes by debt band, in band order; bands without students are left out."""
    debt = F.col("DebtRatio")
    band = (F.when(F.col("TuitionStatus") == S.TUITION_STATUS[0], 0).when(debt == 0, 1)
            .when(debt <= 0.3, 2).when(debt <= 0.6, 3).otherwise(4))
    names = F.array(*[F.lit(b) for b in S.DEBT_BANDS])
    rows = snapshot.where(F.col("SemesterKey") == latest).join(students.select("StudentKey", "TuitionStatus"), "StudentKey")
    return (rows.groupBy(band.alias("BandNo")).agg(
        F.count(F.lit(1)).alias("Students"), mean("SemGPA").alias("AvgGPA"),
        mean("AttendanceRate").alias("AttendanceRate"), mean("IsAtRisk").alias("AtRiskShare"))
        .withColumn("DebtBand", F.element_at(names, F.col("BandNo") + 1)).orderBy("BandNo"))
