"""The weighted health score and what it is computed from."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlake import settings as S
from cohortlake.functions.measures import clip, count_where, is_high_risk, mean, ratio
from cohortlake.operators import performance as P

COMPONENTS = list(S.HEALTH_WEIGHTS)


def health_detail(values: DataFrame, entity: list[str], limits: S.Thresholds = S.DEFAULTS) -> DataFrame:
    """One row per entity and component that has a value; weights are rescaled to those present."""
    spark = values.sparkSession
    scale = spark.createDataFrame(
        [(k, w, *[float(x) for x in limits.health_scales[k]]) for k, w in limits.health_weights.items()],
        "Key string, _w double, Worst double, Best double")
    long = values.select(*entity, *[F.col(c).cast("double") for c in COMPONENTS]).unpivot(
        entity, COMPONENTS, "Key", "Value").where(F.col("Value").isNotNull())
    scored = long.join(F.broadcast(scale), "Key")       # seven rows
    sub = clip((F.col("Value") - F.col("Worst")) / (F.col("Best") - F.col("Worst")), 0.0, 1.0) * 100
    # seven components at most per entity; tenths of thousandths add up exactly
    total = F.sum(F.col("_w").cast("decimal(6,4)")).over(Window.partitionBy(*entity))
    return scored.withColumns({
        "Weight": F.bround(F.col("_w") / total.cast("double"), 4), "_sub": sub,
    }).select(*entity, "Key", "Value", "Worst", "Best", F.bround("_sub", 1).alias("SubScore"), "Weight",
              F.bround(F.col("_sub") * F.col("Weight"), 1).alias("Points"))


def health_total(detail: DataFrame, entity: list[str]) -> DataFrame:
    """The score, the sum of the rounded points."""
    total = F.sum(F.col("Points").cast("decimal(10,1)")).cast("double")
    return detail.groupBy(*entity).agg(total.alias("HealthScore"))


def course_health(courses: DataFrame, by: list[str], limits: S.Thresholds = S.DEFAULTS) -> DataFrame:
    """Share of courses with enough results whose failure rate is too high."""
    big = courses.where(F.col("Enrollment") >= limits.min_enrollment)
    return big.groupBy(*by).agg(
        ratio(count_where(F.col("FailureRate") > limits.course_failure), F.count(F.lit(1))).alias("course_health"))


def _inputs(row: DataFrame, entity: list[str], faculty_load: Column, course_share: Column) -> DataFrame:
    return row.select(
        *entity, F.col("AvgGPA").alias("academic"), F.col("SubmissionRate").alias("engagement"),
        F.col("AttendanceRate").alias("attendance"), F.col("Retention").alias("retention"),
        F.col("CollectionRate").alias("financial"), faculty_load.alias("faculty_load"),
        course_share.alias("course_health"))


def university_inputs(trend: DataFrame, teachers: DataFrame, courses: DataFrame, semester,
                      limits: S.Thresholds = S.DEFAULTS) -> DataFrame:
    """The seven component values of the whole university in one semester."""
    row = P.carry_last_retention(trend.where(F.col("SemesterKey") == semester), trend, [], semester)
    overloaded = teachers.agg(mean(F.col("Overloaded").cast("int"))).scalar()
    return _inputs(row, ["SemesterKey"], overloaded, course_health(courses, [], limits).scalar())


def university_health(trend, teachers, courses, semester, limits: S.Thresholds = S.DEFAULTS) -> DataFrame:
    """The detail rows of the university's score."""
    return health_detail(university_inputs(trend, teachers, courses, semester, limits), ["SemesterKey"], limits)


def risk_by_faculty(risk: DataFrame) -> DataFrame:
    high = F.when(is_high_risk(), 1).otherwise(0)
    return risk.groupBy("FacultyKey").agg(
        F.count(F.lit(1)).alias("ScoredStudents"), F.sum(high).alias("HighRiskStudents"),
        mean(high).alias("HighRiskShare"), mean(F.col("RiskProbability").cast("decimal(9,6)")).alias("AvgRiskProbability"))


def faculty_summary(trend: DataFrame, courses: DataFrame, risk: DataFrame, semester,
                    limits: S.Thresholds = S.DEFAULTS) -> DataFrame:
    """Faculties compared in one semester, with predicted risk, health score and rank.

    Teacher load is left out: teachers of general courses serve every faculty.
    """
    row = P.carry_last_retention(trend.where(F.col("SemesterKey") == semester), trend, ["FacultyKey"], semester)
    row = (row.join(risk_by_faculty(risk), "FacultyKey", "left")
           .join(course_health(courses, ["FacultyKey"], limits), "FacultyKey", "left"))
    values = _inputs(row, ["FacultyKey"], F.lit(None).cast("double"), F.col("course_health"))
    scores = health_total(health_detail(values, ["FacultyKey"], limits), ["FacultyKey"])
    ranked = row.drop("course_health").join(scores, "FacultyKey")
    # one row per faculty is left here, so the global rank is a small sort
    return ranked.withColumn("Rank", F.rank().over(Window.orderBy(F.desc("HealthScore")))).orderBy("Rank")


def extreme_row(df: DataFrame, measure: str, key: str, largest: bool = True) -> DataFrame:
    """The row with the largest or smallest measure; ties go to the smallest key."""
    order = F.desc(measure) if largest else F.asc(measure)
    return df.orderBy(order, F.asc(key)).limit(1)
