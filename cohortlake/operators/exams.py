"""Exam analysis: rates, breakdowns, distributions and year-on-year changes."""

from pyspark.sql import Column, DataFrame, functions as F

from cohortlake import settings as S
from cohortlake.functions.measures import ratio, same_season
from cohortlake.operators.frames import EXAM_COLS

KEYS = {"faculty": ["FacultyKey"], "group": ["FacultyKey", "GroupName"], "university": [],
        "semester": ["SemesterKey"], "course": ["CourseKey"], "teacher": ["TeacherKey"]}
HEADLINES = ["N", "CurrentPct", "MidtermPct", "FinalPct", "ExamGap", "MidtermPassRate", "FinalPassRate",
             "NotAdmitted", "NotAdmittedRate", "FailureRate", "LostAfterMidterm", "ExcellentRate"]


def exam_rates(sums: DataFrame) -> DataFrame:
    """A1: averages and rates from the additive sums. Final measures count admitted students only."""
    top = S.SCORE_MAX
    return sums.withColumns({
        "Current": ratio("CurrentSum", "N"), "Midterm": ratio("MidtermSum", "N"),
        "FinalAdmitted": ratio("FinalSum", "Admitted"), "NotAdmitted": F.col("N") - F.col("Admitted"),
        "MidtermPassRate": 1 - ratio("MidLow", "N"), "FinalPassRate": 1 - ratio("FinLow", "Admitted"),
        "FailureRate": ratio("Failed", "N"), "LostAfterMidterm": ratio("MidOkFailed", "N"),
        "ExcellentRate": ratio("N5", "N"),
    }).withColumns({
        "CurrentPct": F.col("Current") / top["current"], "MidtermPct": F.col("Midterm") / top["midterm"],
        "FinalPct": F.col("FinalAdmitted") / top["final"], "NotAdmittedRate": ratio("NotAdmitted", "N"),
    }).withColumn("ExamGap", F.col("FinalPct") - F.col("MidtermPct"))


def exam_by(source: DataFrame, by: str, semester=None) -> DataFrame:
    """A2: rates by faculty, group, university, semester, course or teacher.

    ``source`` is the exam-group frame, or the course-semester frame for course and teacher.
    """
    if semester is not None and by != "semester":
        source = source.where(F.col("SemesterKey") == semester)
    sums = source.groupBy(*KEYS[by]).agg(*[F.sum(c).alias(c) for c in EXAM_COLS])
    if by == "university":
        sums = sums.where(F.col("N").isNotNull())
    return exam_rates(sums)


def exam_by_grains(source: DataFrame, grains: list[str], semester=None) -> DataFrame:
    """A2 for several grains in one pass over the source, told apart by the column Grain."""
    if semester is not None:
        source = source.where(F.col("SemesterKey") == semester)
    keys = list(dict.fromkeys(k for g in grains for k in KEYS[g]))
    sets = [[F.col(k) for k in KEYS[g]] for g in grains]
    sums = source.groupingSets(sets, *[F.col(k) for k in keys]).agg(
        F.grouping_id(*keys).alias("_g"), *[F.sum(c).alias(c) for c in EXAM_COLS])
    label = F.lit(None).cast("string")
    for g in grains:
        mask = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in KEYS[g])
        label = F.when(F.col("_g") == mask, g).otherwise(label)
    return exam_rates(sums.withColumn("Grain", label).drop("_g"))


def exam_overview(source: DataFrame, semester) -> DataFrame:
    """A3: headline figures of a semester beside those of the same semester a year before (null if none).

    Both semesters come from one aggregation.
    """
    both = source.where((F.col("SemesterKey") == semester) | (F.col("SemesterKey") == semester - 2))
    now = F.col("SemesterKey") == semester
    sums = both.groupBy(now.alias("_now")).agg(*[F.sum(c).alias(c) for c in EXAM_COLS])
    rates = exam_rates(sums)
    one = rates.agg(*[F.max(F.when(F.col("_now"), F.col(c))).alias(c) for c in HEADLINES],
                    *[F.max(F.when(~F.col("_now"), F.col(c))).alias(f"Prev{c}") for c in HEADLINES],
                    *[F.max(F.when(F.col("_now"), F.col(c))).alias(f"Grade{g}")
                      for g, c in (("5", "N5"), ("4", "N4"), ("3", "N3"), ("2", "Failed"))])
    return one.where(F.col("N").isNotNull())


def band_labels() -> list[str]:
    return [f"{i * 10}-{i * 10 + 9 if i < 9 else 100}%" for i in range(10)]


def exam_histogram(dist: DataFrame, semester, faculty=None) -> DataFrame:
    """A4: share of results per tenth, ten rows also where a band is empty."""
    picked = _picked(dist, semester, faculty)
    # every row counts once for the midterm and, when admitted, once for the final
    marks = picked.select("N", F.explode(F.array(
        F.struct(F.lit("m").alias("_control"), F.col("MidBin").alias("BandNo")),
        F.struct(F.lit("f").alias("_control"), F.col("FinBin").alias("BandNo")))).alias("_x"))
    counts = marks.select("N", "_x.*").where(F.col("BandNo") >= 0).groupBy("BandNo").agg(
        F.sum(F.when(F.col("_control") == "m", F.col("N"))).alias("_m"),
        F.sum(F.when(F.col("_control") == "f", F.col("N"))).alias("_f"))
    totals = counts.agg(F.struct(F.sum("_m").alias("m"), F.sum("_f").alias("f"))).scalar()
    labels = F.array(*[F.lit(x) for x in band_labels()])
    spine = dist.sparkSession.range(10).select(F.col("id").cast("int").alias("BandNo"))
    full = spine.join(counts, "BandNo", "left")
    return full.select(
        "BandNo", F.element_at(labels, F.col("BandNo") + 1).alias("Band"),
        ratio(F.coalesce("_m", F.lit(0)), totals.getField("m")).alias("Midterm"),
        F.coalesce(ratio(F.coalesce("_f", F.lit(0)), totals.getField("f")), F.lit(0.0)).alias("Final")
    ).orderBy("BandNo")


def _picked(dist: DataFrame, semester, faculty) -> DataFrame:
    picked = dist.where(F.col("SemesterKey") == semester)
    return picked if faculty is None else picked.where(F.col("FacultyKey") == faculty)


def _level(bin_no: str) -> Column:
    b = F.col(bin_no)
    return (F.when(b < 0, S.NOT_ADMITTED).when(b < 6, S.MIDTERM_LEVELS[2])
            .when(b < 8, S.MIDTERM_LEVELS[1]).otherwise(S.MIDTERM_LEVELS[0]))


FLOW_COLUMNS = {S.MIDTERM_LEVELS[0]: "High", S.MIDTERM_LEVELS[1]: "Middle",
                S.MIDTERM_LEVELS[2]: "Low", S.NOT_ADMITTED: "NotAdmitted"}


def exam_flow(dist: DataFrame, semester, faculty=None) -> DataFrame:
    """A5: how midterm levels moved to final levels: 3 x 4 counts and row shares, zero-filled."""
    levels = _picked(dist, semester, faculty).select(
        _level("MidBin").alias("MidtermLevel"), _level("FinBin").alias("_fin"), "N")
    wide = levels.groupBy("MidtermLevel").pivot("_fin", list(FLOW_COLUMNS)).agg(F.sum("N"))
    spine = dist.sparkSession.createDataFrame(
        [(i, level) for i, level in enumerate(S.MIDTERM_LEVELS)], "Row int, MidtermLevel string")
    flow = spine.join(wide, "MidtermLevel", "left").select(
        "Row", "MidtermLevel",
        *[F.coalesce(F.col(f"`{label}`"), F.lit(0)).cast("long").alias(name) for label, name in FLOW_COLUMNS.items()])
    names = list(FLOW_COLUMNS.values())
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    return flow.withColumns({f"{n}Share": ratio(n, total) for n in names}).orderBy("Row")


def low_midterm_outcome(flow: DataFrame) -> DataFrame:
    """Share of results with a midterm below 60 % that were then not passed or not admitted."""
    return flow.where(F.col("MidtermLevel") == S.MIDTERM_LEVELS[2]).select(
        (F.col("LowShare") + F.col("NotAdmittedShare")).alias("LowMidtermNotPassed"))


def exam_change(source: DataFrame, by: str = "faculty") -> DataFrame:
    """Every entity's rates in each semester against two semesters before, in percentage points."""
    keys = KEYS[by]
    sums = source.groupBy("SemesterKey", *keys).agg(*[F.sum(c).alias(c) for c in EXAM_COLS])
    measures = ["MidtermPct", "FinalPct", "NotAdmittedRate", "FailureRate"]
    rates = exam_rates(sums).select("SemesterKey", *keys, *measures)
    before = rates.select((F.col("SemesterKey") + 2).alias("SemesterKey"), *keys,
                          *[F.col(m).alias(f"_p_{m}") for m in measures])
    return rates.join(before, ["SemesterKey", *keys], "left").select(
        "SemesterKey", *keys, *measures,
        *[((F.col(m) - F.col(f"_p_{m}")) * 100).alias(f"{m}Change") for m in measures])


def faculty_exam_trend(source: DataFrame, faculty, latest) -> DataFrame:
    """One faculty's exam rates over the semesters of the same season."""
    own = source.where((F.col("FacultyKey") == faculty) & same_season("SemesterKey", latest))
    return exam_by(own, "semester").orderBy("SemesterKey")


def grade_shares(source: DataFrame, semester=None) -> DataFrame:
    """Share of the grades 5, 4, 3 and 2."""
    one = exam_by(source, "university", semester)
    shares = one.select(*[ratio(c, "N").alias(g) for g, c in (("5", "N5"), ("4", "N4"), ("3", "N3"), ("2", "Failed"))])
    return shares.unpivot([], ["5", "4", "3", "2"], "Grade", "Share")
