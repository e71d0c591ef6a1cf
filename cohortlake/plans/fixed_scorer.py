"""A fixed linear scorer. It lets every operator around a model be checked against SQL; the fitted
models of operators.training are drop-in replacements."""

from pyspark.sql import DataFrame, functions as F

from cohortlake.functions.measures import clip

# --- fixed values: weights of the linear risk score, in order of evaluation
INTERCEPT = 1.1
RISK_WEIGHTS = (
    ("SemGPA", -0.1), ("CumGPA", -0.05), ("PrevGPA", -0.02), ("GPATrend", -0.03), ("AttendanceRate", -0.3),
    ("FailedCourses", 0.06), ("CumFailedCourses", 0.005), ("AvgAssignmentScore", -0.002),
    ("SubmissionRate", -0.05), ("WarningsCum", 0.01), ("DebtRatio", 0.08), ("StudySemester", 0.004),
    ("Credits", -0.001), ("AvgTeacherLoad", 0.0004))
THRESHOLD = 0.45


def linear_scorer(rows: DataFrame) -> DataFrame:
    risk = F.lit(INTERCEPT)
    for name, weight in RISK_WEIGHTS:
        risk = risk + F.col(name) * weight
    risk = clip(risk, 0.0, 1.0)
    return rows.select(
        "*", risk.alias("_risk"), (F.col("SemGPA") * 0.6 + F.col("CumGPA") * 0.4).alias("_gpa"),
        (F.col("FailedCourses") * 0.15).alias("_fail"), (risk * 0.1).alias("_dropout"))
