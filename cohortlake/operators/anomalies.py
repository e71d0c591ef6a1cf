"""Unusual changes: faculties against their own past, courses against their history, teacher load."""

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from cohortlake import settings as S
from cohortlake.functions.selection import robust_z

METRICS = ["AttendanceRate", "AvgGPA", "FailureRate", "CollectionRate"]
COLUMNS = ["Kind", "Metric", "EntityKey", "Entity", "SemesterKey", "Before", "After", "Change", "Z", "Hint"]


def peer_median(df: DataFrame, value: str, within: list[str], key: str, out: str) -> DataFrame:
    """Median of the other rows of the group, for every row, without pairing rows.

    After sorting a group, leaving one row out moves the middle by at most one place, so three
    values around the middle answer for all rows. The group is the faculties of one semester.
    """
    group = Window.partitionBy(*within)
    ranked = df.withColumns({
        "_r": F.row_number().over(group.orderBy(value, key)), "_n": F.count(F.lit(1)).over(group)})
    others = F.col("_n") - 1
    low, high = F.floor((others + 1) / 2), F.floor((others + 2) / 2)

    def at(place):
        return F.max(F.when(F.col("_r") == place, F.col(value))).over(group)

    ranked = ranked.withColumns({"_at0": at(low), "_at1": at(low + 1), "_at2": at(low + 2)})

    def without_self(place, here, after):
        # places from the row's own place on move up by one when it is left out
        return F.when(place < F.col("_r"), here).otherwise(after)

    first = without_self(low, F.col("_at0"), F.col("_at1"))
    second = F.when(low == high, first).otherwise(without_self(high, F.col("_at1"), F.col("_at2")))
    return ranked.withColumn(out, F.when(others > 0, (first + second) / 2)).drop("_r", "_n", "_at0", "_at1", "_at2")


def faculty_deltas(trend: DataFrame) -> DataFrame:
    """Every metric's change from the faculty's previous semester, one row per change."""
    long = trend.select("FacultyKey", "FacultyName", "SemesterKey", *METRICS).unpivot(
        ["FacultyKey", "FacultyName", "SemesterKey"], METRICS, "Metric", "After")
    before = F.lag("After").over(Window.partitionBy("FacultyKey", "Metric").orderBy("SemesterKey"))
    return long.withColumn("Before", before).withColumn("Change", F.col("After") - F.col("Before")).where(
        F.col("Change").isNotNull())


def faculty_anomalies(trend: DataFrame, limits: S.Thresholds = S.DEFAULTS) -> DataFrame:
    """Changes far outside the usual spread of that metric's changes."""
    scored = robust_z(faculty_deltas(trend), "Change", ["Metric"])
    sized = scored.withColumn("_size", F.abs("Change"))
    peers = peer_median(sized, "_size", ["Metric", "SemesterKey"], "FacultyKey", "_peers")
    hint = (F.when(F.col("Metric") == "CollectionRate", "payment")
            .when(F.col("_peers") < F.col("_size") / 3, "isolated").otherwise("shared"))
    hits = peers.withColumn("Hint", hint).where(F.abs("Z") >= limits.anomaly_z)
    return hits.select(F.lit("faculty").alias("Kind"), "Metric", F.col("FacultyKey").cast("long").alias("EntityKey"),
                       F.col("FacultyName").alias("Entity"), "SemesterKey", "Before", "After", "Change",
                       F.bround("Z", 1).alias("Z"), "Hint")


def course_anomalies(courses: DataFrame, limits: S.Thresholds = S.DEFAULTS) -> DataFrame:
    """A failure rate far above the course's own history (binomial z)."""
    by_course = Window.partitionBy("CourseKey").orderBy("SemesterKey")
    prior = by_course.rowsBetween(Window.unboundedPreceding, -1)
    rows = courses.where(F.col("Enrollment") >= limits.min_enrollment).withColumns({
        "_f": F.sum("Failed").over(prior), "_n": F.sum("Enrollment").over(prior),
        "_fin": F.lag("FinalPct").over(by_course), "_mid": F.lag("MidtermPct").over(by_course),
    }).where(F.col("_n").isNotNull())
    rows = rows.withColumn("_p0", F.col("_f") / F.col("_n"))
    p0, rise = F.col("_p0"), F.col("FailureRate") - F.col("_p0")
    spread = F.sqrt(F.greatest(p0 * (1 - p0), F.lit(1e-4)) / F.col("Enrollment"))
    rows = rows.withColumns({"_z": rise / spread, "Change": rise})
    hits = rows.where((F.col("_z") >= limits.anomaly_z + 1) & (F.col("Change") >= limits.course_rise))
    final_fell = (F.col("FinalPct") - F.col("_fin")) * 100 < (F.col("MidtermPct") - F.col("_mid")) * 100 - 8
    return hits.select(F.lit("course").alias("Kind"), F.lit("FailureRate").alias("Metric"),
                       F.col("CourseKey").cast("long").alias("EntityKey"), F.col("CourseName").alias("Entity"),
                       "SemesterKey", p0.alias("Before"), F.col("FailureRate").alias("After"), "Change",
                       F.bround("_z", 1).alias("Z"), F.when(final_fell, "final_exam").otherwise("whole_course").alias("Hint"))


def teacher_load_anomalies(teachers: DataFrame, semester, limits: S.Thresholds = S.DEFAULTS) -> DataFrame:
    """Teachers with far more students than their colleagues; Change is the multiple of the median."""
    scored = robust_z(teachers, "Students", keep=("median",))
    hits = scored.where(F.col("Z") >= limits.anomaly_z)
    return hits.select(F.lit("teacher").alias("Kind"), F.lit("Students").alias("Metric"),
                       F.col("TeacherKey").cast("long").alias("EntityKey"), F.col("TeacherName").alias("Entity"),
                       semester.cast("int").alias("SemesterKey"), F.col("median").alias("Before"),
                       F.col("Students").cast("double").alias("After"),
                       (F.col("Students") / F.col("median")).alias("Change"),
                       F.bround("Z", 1).alias("Z"), F.lit("workload").alias("Hint"))


def anomalies(trend: DataFrame, course_history: DataFrame, teachers: DataFrame, semester,
              limits: S.Thresholds = S.DEFAULTS) -> DataFrame:
    """All kinds, newest semester first, then by z."""
    return reduce(DataFrame.unionByName, [
        faculty_anomalies(trend, limits), course_anomalies(course_history, limits),
        teacher_load_anomalies(teachers, semester, limits),
    ]).orderBy(F.desc("SemesterKey"), F.desc("Z"), "Kind", "Metric", "EntityKey")
