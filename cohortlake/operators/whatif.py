"""What-if re-scoring: change the levers of some students and ask the models again."""

from pyspark.sql import Column, DataFrame, functions as F

from cohortlake import settings as S
from cohortlake.functions.measures import clip, count_where, is_high_risk, mean, risk_level
from cohortlake.functions.selection import top_share
from cohortlake.operators.risk import Scorer, predict

HIGHER_IS_BETTER = {"predicted_gpa": True, "at_risk_students": False, "high_risk_students": False,
                    "failure_rate": False, "retention": True, "graduation_probability": True}
LEVER_NAMES = ("attendance", "submission", "assignment_score", "teacher_load_pct")


def population(rows: DataFrame, scorer: Scorer) -> DataFrame:
    """Students to score with their present risk and level."""
    now = predict(rows, scorer).drop("PredictedNextGPA", "PredictedFailRate", "DropoutProbability")
    return now.withColumnRenamed("RiskProbability", "BaseRisk").withColumn("BaseLevel", risk_level("BaseRisk"))


def target_mask(pop: DataFrame, target: str, share: float = 0.3, faculty: int | None = None) -> DataFrame:
    """Add the flag Targeted: all, high risk, or the top share by risk (ties by smallest key)."""
    if target == "high_risk":
        pop = pop.withColumn("Targeted", is_high_risk("BaseLevel"))
    elif target == "top_risk":
        pop = top_share(pop, "BaseRisk", "StudentKey", share, "Targeted")
    else:
        pop = pop.withColumn("Targeted", F.lit(True))
    if faculty is not None:
        pop = pop.withColumn("Targeted", F.col("Targeted") & (F.col("FacultyKey") == faculty))
    return pop


def apply_levers(pop: DataFrame, effects: dict[str, dict[str, Column | float]], attendance: float = 0.0,
                 submission: float = 0.0, assignment_score: float = 0.0, teacher_load_pct: float = 0.0) -> DataFrame:
    """Shift the levers of targeted rows, then carry the change to GPA and failed courses."""
    hit = F.col("Targeted")

    def changed(value: Column, old: str) -> Column:
        return F.when(hit, value).otherwise(F.col(old))

    def effect(outcome: str) -> Column:
        terms = [(F.col(c) - F.col(f"_o_{c}")) * effects[outcome][c] for c in S.LEVERS]
        return terms[0] + terms[1] + terms[2] + terms[3]

    out = pop.withColumns({f"_o_{c}": F.col(c) for c in S.LEVERS})
    out = out.withColumn("_sub", clip(F.col("SubmissionRate") + submission, 0.0, 1.0))
    # work not handed in counts as 0, so the mean score grows with the share handed in
    growth = F.coalesce(F.try_divide(F.col("_sub"), F.col("SubmissionRate")), F.lit(1.0))
    out = out.withColumns({
        "AttendanceRate": changed(clip(F.col("AttendanceRate") + attendance, 0.0, 1.0), "AttendanceRate"),
        "AvgAssignmentScore": changed(
            clip(F.col("AvgAssignmentScore") * growth + assignment_score, 0.0, 100.0), "AvgAssignmentScore"),
        "SubmissionRate": changed(F.col("_sub"), "SubmissionRate"),
        "AvgTeacherLoad": changed(F.col("AvgTeacherLoad") * (1 + teacher_load_pct), "AvgTeacherLoad")})
    out = out.withColumns({
        "_gpa": clip(F.col("SemGPA") + effect("SemGPA"), 2.0, 5.0),
        "_failed": clip(F.col("FailedCourses") + effect("FailRate") * F.col("CourseLoad"), 0.0, F.col("CourseLoad"))})
    out = out.withColumns({
        "CumGPA": clip(F.col("CumGPA") + F.try_divide(F.col("_gpa") - F.col("SemGPA"), F.col("StudySemester")), 2.0, 5.0),
        "CumFailedCourses": clip(F.col("CumFailedCourses") + F.col("_failed") - F.col("FailedCourses"), 0.0)})
    out = out.withColumns({"SemGPA": F.col("_gpa"), "FailedCourses": F.col("_failed"),
                           "GPATrend": F.col("_gpa") - F.col("PrevGPA")})
    return out.select(*pop.columns)


def outcomes(rows: DataFrame, scorer: Scorer, threshold, by=()) -> DataFrame:
    """Six outcome figures, one aggregation."""
    scored = predict(rows, scorer).withColumn("_level", risk_level("RiskProbability"))
    left = clip(S.LAST_STUDY_SEMESTER - F.col("StudySemester"), 0)
    stays = 1 - F.col("DropoutProbability")
    return scored.groupBy(*by).agg(
        mean("PredictedNextGPA").alias("predicted_gpa"),
        count_where(F.col("RiskProbability") >= threshold).cast("double").alias("at_risk_students"),
        count_where(is_high_risk("_level")).cast("double").alias("high_risk_students"),
        mean("PredictedFailRate").alias("failure_rate"), (1 - mean("DropoutProbability")).alias("retention"),
        mean(F.pow(stays, left)).alias("graduation_probability"))


def compare_scenario(pop: DataFrame, scorer: Scorer, effects, threshold, target: str = "all", share: float = 0.3,
                     faculty: int | None = None, **levers: float) -> DataFrame:
    """Six rows with baseline, scenario, change and whether it improves; plus the students affected.

    Both populations are tagged and scored in one pass.
    """
    marked = target_mask(pop, target, share, faculty)
    after = apply_levers(marked, effects, **levers)
    both = marked.withColumn("_after", F.lit(False)).unionByName(after.withColumn("_after", F.lit(True)))
    sizes = marked.agg(F.struct(F.count(F.lit(1)).alias("n"), count_where(F.col("Targeted")).alias("hit"))).scalar()
    keys = list(HIGHER_IS_BETTER)
    long = outcomes(both, scorer, threshold, ["_after"]).unpivot(["_after"], keys, "Key", "_v")
    table = long.groupBy("Key").agg(F.max(F.when(~F.col("_after"), F.col("_v"))).alias("Baseline"),
                                    F.max(F.when(F.col("_after"), F.col("_v"))).alias("Scenario"))
    change = F.col("Scenario") - F.col("Baseline")
    up = F.col("Key").isin(*[k for k, better in HIGHER_IS_BETTER.items() if better])
    return table.select("Key", "Baseline", "Scenario", change.alias("Change"),
                        F.when(up, change > 0).otherwise(change < 0).alias("Improves"),
                        sizes.getField("n").alias("Students"), sizes.getField("hit").alias("Affected"))


def run_scenario(pop: DataFrame, scorer: Scorer, effects, threshold, name: str, faculty: int | None = None) -> DataFrame:
    """One of the named scenarios."""
    return compare_scenario(pop, scorer, effects, threshold, faculty=faculty, **S.SCENARIOS[name])


def all_scenarios(pop: DataFrame, scorer: Scorer, effects, threshold) -> DataFrame:
    """Every named scenario, one block of rows each."""
    parts = [run_scenario(pop, scorer, effects, threshold, n).withColumn("Name", F.lit(n)) for n in S.SCENARIOS]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def scenario_catalog(spark) -> DataFrame:
    """The parameters of the named scenarios."""
    rows = [(n, s["target"], s.get("share"), *[float(s.get(k, 0.0)) for k in LEVER_NAMES]) for n, s in S.SCENARIOS.items()]
    return spark.createDataFrame(
        rows, "Name string, target string, share double, " + ", ".join(f"{k} double" for k in LEVER_NAMES))


def negligible_effect(table: DataFrame) -> DataFrame:
    """Whether the change is within the model's error."""
    def change(key):
        return F.max(F.when(F.col("Key") == key, F.abs("Change")))
    return table.agg(((change("predicted_gpa") < 0.015)
                      & (change("at_risk_students") < 0.005 * F.max("Students"))).alias("Negligible"))
