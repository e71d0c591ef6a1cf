"""Risk data set, scoring and explanation. A scorer is any frame-to-frame function that adds the
four raw model outputs; a fitted bundle and a fixed expression are both scorers."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlake import settings as S
from cohortlake.functions.measures import clip, flag, ratio, risk_level
from cohortlake.functions.selection import exact_median

Scorer = Callable[[DataFrame], DataFrame]
RAW = ["_risk", "_gpa", "_fail", "_dropout"]
OUTPUTS = ["RiskProbability", "PredictedNextGPA", "PredictedFailRate", "DropoutProbability"]


def risk_snapshot(snapshot: DataFrame, students: DataFrame) -> DataFrame:
    """L1: the snapshot with the student's status, all measures as doubles."""
    rows = snapshot.join(students.select("StudentKey", "Status"), "StudentKey")
    keys = ("StudentKey", "SemesterKey", "FacultyKey", "DepartmentKey", "Status")
    return rows.select(*[F.col(c) if c in keys else F.col(c).cast("double").alias(c) for c in rows.columns])


def add_features(rows: DataFrame) -> DataFrame:
    """L2: a first semester has no history, so its own GPA stands in for the previous one."""
    rows = rows.withColumn("PrevGPA", F.coalesce("PrevGPA", "SemGPA"))
    return rows.withColumn("GPATrend", F.col("SemGPA") - F.col("PrevGPA"))


def build_dataset(rows: DataFrame, latest=None) -> DataFrame:
    """L3: every student-semester with its outcome in the next semester.

    Target is null where the outcome is unknown. IsLabelled marks training rows (never the latest
    semester, whose only known outcomes are drop-outs) and ToScore the active students' latest rows.
    The next semester is found by one window over a student's few semesters.
    """
    ahead = Window.partitionBy("StudentKey").orderBy("SemesterKey")
    follows = F.lead("SemesterKey").over(ahead) == F.col("SemesterKey") + 1
    nxt = {n: F.when(follows, F.lead(c).over(ahead)) for n, c in (
        ("NextAtRisk", "IsAtRisk"), ("NextGPA", "SemGPA"), ("NextFailed", "FailedCourses"), ("NextLoad", "CourseLoad"))}
    rows = rows.withColumns(nxt)
    has_next = F.col("NextAtRisk").isNotNull()
    dropped = ~has_next & (F.col("IsLastSemester") == 1) & (F.col("Status") == S.STUDENT_STATUS[1])
    if latest is None:
        latest = rows.agg(F.max("SemesterKey")).scalar()
    return rows.withColumns({
        "Dropout": flag(dropped), "Target": F.when(dropped, 1).otherwise(F.col("NextAtRisk")).cast("int"),
        "NextFailRate": ratio("NextFailed", "NextLoad"),
        "IsLabelled": (has_next | dropped) & (F.col("SemesterKey") < latest),
        "ToScore": (F.col("SemesterKey") == latest) & (F.col("Status") == S.STUDENT_STATUS[0])})


def labelled(dataset: DataFrame) -> DataFrame:
    return dataset.where("IsLabelled")


def to_score(dataset: DataFrame) -> DataFrame:
    return dataset.where("ToScore")


def temporal_split(rows: DataFrame) -> DataFrame:
    """L4: newest labelled semester = test, the one before = validation, older = train."""
    last = rows.agg(F.max("SemesterKey")).scalar()
    age = last - F.col("SemesterKey")
    return rows.withColumn("Split", F.when(age == 0, "test").when(age == 1, "validation").otherwise("train"))


def baseline_profile(rows: DataFrame) -> DataFrame:
    """Median of every feature over the rows that were not at risk. All features go together."""
    each = [F.struct(F.lit(c).alias("_feature"), F.col(c).cast("double").alias("_x")) for c in S.FEATURES]
    medians = exact_median(rows.where(F.col("Target") == 0).select(F.inline(F.array(*each))), "_x", ["_feature"])
    return medians.agg(*[F.max(F.when(F.col("_feature") == c, F.col("median"))).alias(c) for c in S.FEATURES])


def predict(rows: DataFrame, scorer: Scorer) -> DataFrame:
    """The four outputs, kept inside their valid ranges."""
    scored = scorer(rows)
    return scored.withColumns({
        "RiskProbability": clip("_risk", 0.01, 0.99), "PredictedNextGPA": clip("_gpa", 2.0, 5.0),
        "PredictedFailRate": clip("_fail", 0.0, 1.0), "DropoutProbability": F.col("_dropout")}).drop(*RAW)


def explain(rows: DataFrame, scorer: Scorer, baseline: dict[str, float]) -> DataFrame:
    """The share (0-100) of each factor group in a student's predicted risk.

    A group's features are set to the baseline and the model is asked again; the fall of the risk is
    the group's contribution. All variants are scored side by side on the same row, so nothing is
    shuffled and no row is copied.
    """
    kept = rows.columns
    base = scorer(rows.select("*", F.struct(*S.FEATURES).alias("_own")))
    change: tuple = ()
    step = F.col("_risk").alias("_base")
    for group, features in [*S.FACTOR_GROUPS.items(), (None, ())]:
        # restore the previous group's features and replace those of the next one
        columns = [F.lit(baseline[c]).alias(c) if c in features
                   else F.col("_own").getField(c).alias(c) if c in change else F.col(c)
                   for c in base.columns if c not in RAW]
        base = base.select(*columns, step)
        if group:
            base = scorer(base)
            step = F.greatest(F.col("_base") - F.col("_risk"), F.lit(0.0)).alias(f"_c_{group}")
            change = features
    names = list(S.FACTOR_GROUPS)
    total = sum((F.col(f"_c_{g}") for g in names[1:]), F.col(f"_c_{names[0]}"))
    share = {g: F.coalesce(F.bround(F.try_divide(F.col(f"_c_{g}"), F.col("_total")) * 100, 1), F.lit(0.0)) for g in names}
    return base.select("*", total.alias("_total")).select(*kept, *[share[g].alias(g) for g in names])


def main_factors(top: int = 4) -> Column:
    """Text of the largest shares of at least 1, largest first."""
    parts = F.array(*[F.struct((-F.col(g)).alias("s"), F.lit(i).alias("i"), F.lit(label).alias("name"))
                      for i, (g, label) in enumerate(S.FACTOR_LABELS.items())])
    best = F.slice(F.array_sort(F.filter(parts, lambda x: x.getField("s") <= -1)), 1, top)
    words = F.transform(best, lambda x: F.concat(
        x.getField("name"), F.lit(" "), F.bround(-x.getField("s"), 0).cast("int").cast("string"), F.lit("%")))
    return F.when(F.size(best) > 0, F.array_join(words, " · ")).otherwise(S.NO_FACTOR)


def score_students(rows: DataFrame, scorer: Scorer, baseline: dict[str, float], threshold,
                   model_name: str, scored_at: Column) -> DataFrame:
    """The table of scored students."""
    scored = predict(explain(rows, scorer, baseline), scorer)
    scored = scored.withColumns({o: F.bround(o, 4) for o in OUTPUTS})
    return scored.select(
        "StudentKey", "SemesterKey", "FacultyKey", "DepartmentKey", *OUTPUTS,
        risk_level("RiskProbability").alias("RiskLevel"),
        flag(F.col("RiskProbability") >= threshold).alias("IsFlagged"), *S.FACTOR_GROUPS,
        main_factors().alias("MainFactors"), F.lit(model_name).alias("ModelName"), scored_at.alias("ScoredAt"))


def within_student(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Each value minus the student's own mean, for students with at least two semesters."""
    own = Window.partitionBy("StudentKey")
    rows = rows.withColumn("FailRate", ratio("FailedCourses", "CourseLoad")).withColumn("_n", F.count(F.lit(1)).over(own))
    return rows.where(F.col("_n") >= 2).select(
        "StudentKey", "SemesterKey", *[(F.col(c) - F.avg(c).over(own)).alias(c) for c in columns])


def lever_effects(rows: DataFrame) -> DataFrame:
    """Within-student association of the four levers with GPA and the share of failed courses.

    One pass sums the products of all columns; the 4 x 4 normal equations are then one tiny row
    per outcome, solved by elimination in column expressions.
    """
    targets = ["SemGPA", "FailRate"]
    demeaned = within_student(rows, [*S.LEVERS, *targets])
    names = list(S.LEVERS)
    complete = demeaned.na.drop(subset=[*names, *targets])
    pairs = {f"x{i}{j}": (names[i], names[j]) for i in range(4) for j in range(i, 4)}
    pairs |= {f"y{t}{i}": (names[i], targets[t]) for t in range(2) for i in range(4)}
    sums = complete.agg(*[F.sum(F.col(a) * F.col(b)).alias(k) for k, (a, b) in pairs.items()])
    long = sums.select(F.inline(F.array(*[
        F.struct(F.lit(targets[t]).alias("Outcome"), *[F.col(k) for k in pairs if k[0] == "x"],
                 *[F.col(f"y{t}{i}").alias(f"b{i}") for i in range(4)]) for t in range(2)])))
    # forward elimination on the symmetric matrix, then back substitution
    for k in range(4):
        step = {}
        for i in range(k + 1, 4):
            factor = F.try_divide(F.col(f"x{k}{i}"), F.col(f"x{k}{k}"))
            step |= {f"x{i}{j}": F.col(f"x{i}{j}") - factor * F.col(f"x{k}{j}") for j in range(i, 4)}
            step[f"b{i}"] = F.col(f"b{i}") - factor * F.col(f"b{k}")
        if step:
            long = long.withColumns(step)
    for i in (3, 2, 1, 0):
        known = sum((F.col(f"x{i}{j}") * F.col(names[j]) for j in range(i + 1, 4)), F.lit(0.0))
        long = long.withColumn(names[i], F.try_divide(F.col(f"b{i}") - known, F.col(f"x{i}{i}")))
    return long.select("Outcome", *[F.bround(n, 6).alias(n) for n in names])
