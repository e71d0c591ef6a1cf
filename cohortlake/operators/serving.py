"""Data behind pages and question-answering tools: rankings, searches, scoped views, composed reports."""

import uuid

from pyspark.sql import DataFrame, Window, functions as F

from cohortlake import settings as S
from cohortlake.functions.measures import count_where, is_high_risk, mean, ratio, same_season
from cohortlake.functions.selection import attach, exact_median, ordered_top, top_per_group
from cohortlake.functions.text import contains

PROFILE_SHOWN = ["SemesterLabel", "SemGPA", "CumGPA", "AttendanceRate", "FailedCourses", "SubmissionRate",
                 "AvgAssignmentScore", "DebtRatio", "WarningsCum"]
# fixed values: what each role may see
ROLES = {"management": {"faculty": "all", "students": True}, "dean": {"faculty": "own", "students": True},
         "teacher": {"faculty": "all", "students": False}}


def risk_level_counts(risk: DataFrame) -> DataFrame:
    """Students per level in fixed order, also levels without students."""
    levels = [label for _, label in S.RISK_LEVELS]
    spine = risk.sparkSession.createDataFrame(list(enumerate(levels)), "LevelNo int, RiskLevel string")
    counts = risk.groupBy("RiskLevel").agg(F.count(F.lit(1)).alias("Students"))
    return spine.join(counts, "RiskLevel", "left").na.fill(0, ["Students"]).orderBy("LevelNo")


def top_k(df: DataFrame, measure: str, key: str, k: int, floor_on: str, floor: int) -> DataFrame:
    """The k rows with the largest measure among those of sufficient size."""
    return ordered_top(df.where(F.col(floor_on) >= floor), k, F.desc(measure), F.asc(key))


def top_k_per_group(df: DataFrame, by: str, measure: str, key: str, k: int, floor_on: str, floor: int) -> DataFrame:
    """D2 for every group at once."""
    return top_per_group(df.where(F.col(floor_on) >= floor), [by], k, F.desc(measure), F.asc(key))


def bottom_k_gap(courses: DataFrame, k: int = 8, floor: int = S.DEFAULTS.min_enrollment) -> DataFrame:
    """D3: courses whose final result is furthest below the midterm."""
    return ordered_top(courses.where(F.col("N") >= floor), k, F.asc("ExamGap"), F.asc("CourseKey")).withColumn(
        "Gap", -F.col("ExamGap"))


def risk_search(table: DataFrame, levels=None, faculties=None, text: str | None = None, limit: int | None = None) -> DataFrame:
    """By level and faculty, or by text (part of name or group, or the exact id), which replaces them. All rows that
    match, riskiest first, or the first ``limit`` of them."""
    text = (text or "").strip()
    if text:
        hit = (contains(F.col("FullName"), text) | contains(F.col("GroupName"), text)
               | (F.col("StudentKey").cast("string") == text.lower()))
    else:
        hit = F.lit(True)
        if levels:
            hit = hit & F.col("RiskLevel").isin(*levels)
        if faculties:
            hit = hit & F.col("FacultyName").isin(*faculties)
    order = [F.desc("RiskProbability"), F.asc("StudentKey")]
    found = table.where(hit)
    return found.orderBy(*order) if limit is None else ordered_top(found, limit, *order)


def untouched_only(table: DataFrame, log: DataFrame) -> DataFrame:
    """Students without any record in the staff log."""
    return table.join(log.select("StudentKey").distinct(), "StudentKey", "left_anti")


def high_share_by_faculty(table: DataFrame) -> DataFrame:
    """Share of high and critical risk per faculty."""
    share = mean(F.when(is_high_risk(), 1).otherwise(0)).alias("HighShare")
    return table.groupBy("FacultyKey", "FacultyName").agg(share).orderBy(F.desc("HighShare"), "FacultyKey")


def finance_summary(payments: DataFrame, faculties: DataFrame, semester) -> DataFrame:
    """Amounts of one semester, per faculty and in total (FacultyKey null)."""
    own = payments.where(F.col("SemesterKey") == semester).join(faculties.select("FacultyKey", "FacultyName"), "FacultyKey")
    sums = own.rollup(F.struct("FacultyKey", "FacultyName").alias("_f")).agg(
        *[F.sum(c).alias(c) for c in ("Tuition", "Paid", "Debt")])
    return sums.select("_f.FacultyKey", "_f.FacultyName", *[F.col(c).cast("double").alias(c) for c in ("Tuition", "Paid", "Debt")],
                       ratio("Paid", "Tuition").alias("CollectionRate")).orderBy(F.desc("Debt"))


def teacher_load_stats(teachers: DataFrame) -> DataFrame:
    """Teachers, median load, overloaded, and the correlation of load and GPA."""
    stats = teachers.agg(F.count(F.lit(1)).alias("Teachers"), count_where(F.col("Overloaded")).alias("Overloaded"),
                         F.corr("Students", "AvgGPA").alias("LoadGPACorrelation"))
    return attach(stats, exact_median(teachers, "Students", name="MedianLoad"))


def model_trust(comparison: DataFrame) -> DataFrame:
    """Of ten flagged students how many were at risk, of ten at risk how many were found."""
    best = comparison.where((F.col("IsBest") == 1) & (F.col("Split") == "test") & (F.col("Rule") == "recall target"))
    return best.select("Model", "Threshold", F.bround(F.col("Precision") * 10, 0).cast("int").alias("RightOf10"),
                       F.bround(F.col("Recall") * 10, 0).cast("int").alias("FoundOf10"))


def intervention_history(log: DataFrame, student) -> DataFrame:
    """One student's records, newest first."""
    return log.where(F.col("StudentKey") == student).orderBy(F.desc("CreatedAt"), F.desc("InterventionID"))


def latest_intervention(log: DataFrame) -> DataFrame:
    """Per student the newest status and the number of records, combined before the shuffle."""
    return log.groupBy("StudentKey").agg(
        F.max_by("Status", F.struct("CreatedAt", "InterventionID")).alias("Status"),
        F.count(F.lit(1)).alias("Records"))


def find_entity(dim: DataFrame, key: str, name: str, text: str) -> DataFrame:
    """The first row (by key) whose name contains the text."""
    return dim.where(contains(F.col(name), text)).orderBy(key).limit(1)


def require_entity(dim: DataFrame, key: str, name: str, text: str) -> int:
    """The key of that row, or an error that lists the valid names."""
    found = find_entity(dim, key, name, text).first()
    if found is None:
        names = ", ".join(r[0] for r in dim.select(name).orderBy(key).limit(100).collect())
        raise ValueError(f"no match for '{text}'; known: {names}")
    return found[key]


def scope_rows(df: DataFrame, role: str, own_faculty: int | None = None, faculty: int | None = None,
               student_level: bool = False) -> DataFrame:
    """Restrict a frame to what the role may see, before anything is computed from it."""
    rights = ROLES[role]
    if student_level and not rights["students"]:
        raise PermissionError("this role sees aggregated figures only")
    if rights["faculty"] == "own":
        if faculty is not None and faculty != own_faculty:
            raise PermissionError("this role sees its own faculty only")
        faculty = own_faculty
    return df if faculty is None else df.where(F.col("FacultyKey") == faculty)


def factor_shares(risk: DataFrame) -> DataFrame:
    """Mean share of each factor over the high-risk students, largest first."""
    high = risk.where(is_high_risk())
    means = high.agg(*[mean(F.col(g).cast("decimal(6,1)")).alias(g) for g in S.FACTOR_GROUPS])
    return means.unpivot([], list(S.FACTOR_GROUPS), "Factor", "MeanShare").orderBy(F.desc("MeanShare"), "Factor")


def example_case(risk: DataFrame, floor: float = 0.8) -> DataFrame:
    """Among the surest cases the one that GPA explains least."""
    return risk.where(F.col("RiskProbability") >= floor).orderBy("F_GPA", "StudentKey").limit(1)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of every table; IsFact also counts the snapshot, as its name begins like a fact."""
    parts = [df.agg(F.count(F.lit(1)).alias("Rows")).select(F.lit(n).alias("TableName"), "Rows") for n, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("IsFact", F.col("TableName").startswith("Fact"))


def student_profile(student, students, faculties, departments, snapshot, semesters, grades, courses, teachers,
                    warnings, risk) -> dict[str, DataFrame]:
    """The five frames about one student. The key filter reaches every scan."""
    def own(df):
        return df.where(F.col("StudentKey") == student)

    info = (own(students).join(faculties.select("FacultyKey", "FacultyName"), "FacultyKey")
            .join(departments.select("DepartmentKey", "DepartmentName"), "DepartmentKey"))
    labels = semesters.select("SemesterKey", "SemesterLabel")
    admitted = F.when(F.col("IsAdmitted"), S.YES_NO[0]).otherwise(S.YES_NO[1])
    marks = (own(grades).join(courses.select("CourseKey", "CourseName"), "CourseKey")
             .join(teachers.select("TeacherKey", "TeacherName"), "TeacherKey").join(labels, "SemesterKey")
             .select("SemesterLabel", "CourseName", "TeacherName", "CurrentScore", "MidtermScore", "FinalScore",
                     "TotalScore", "FinalGrade", "AttendanceScore", admitted.alias("Admitted"), "SemesterKey")
             .orderBy("SemesterKey", "CourseName"))
    return {"info": info, "history": own(snapshot).join(labels, "SemesterKey").orderBy("SemesterKey"), "grades": marks,
            "warnings": own(warnings).select("WarningDate", "WarningType", "Severity").orderBy("WarningDate"),
            "risk": own(risk)}


def latest_grades(grades: DataFrame) -> DataFrame:
    """Of one student's grades those of the newest semester."""
    newest = F.max("SemesterKey").over(Window.partitionBy())      # one student's rows
    return grades.withColumn("_m", newest).where(F.col("SemesterKey") == F.col("_m")).drop("_m", "SemesterKey")


def top_risk(table: DataFrame, limit: int = 20) -> DataFrame:
    """The ``limit`` riskiest students."""
    return ordered_top(table, limit, F.desc("RiskProbability"), F.asc("StudentKey"))


def find_students(students: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """The first ``limit`` students, by key, whose name contains the text."""
    return students.where(contains(F.col("FullName"), text)).orderBy("StudentKey").limit(limit).select(
        "StudentKey", "FullName", "FacultyKey", "StudyYear", "Status")


def risk_by_study_year(table: DataFrame) -> DataFrame:
    """Students and share of high risk per study year."""
    return table.groupBy("StudyYear").agg(
        F.count(F.lit(1)).alias("Students"), mean(F.when(is_high_risk(), 1).otherwise(0)).alias("HighRiskShare"))


def faculty_report(faculty, trend, pooled_courses, table, limits: S.Thresholds = S.DEFAULTS) -> dict[str, DataFrame]:
    """One faculty's trend, hardest courses, risk by study year and mean factor shares."""
    def own(df):
        return df.where(F.col("FacultyKey") == faculty)

    return {"trend": own(trend).orderBy("SemesterKey"),
            "hardest_courses": top_k(own(pooled_courses), "FailureRate", "CourseKey", 8, "Enrollment", limits.min_enrollment),
            "risk_by_study_year": risk_by_study_year(own(table)), "factor_shares": factor_shares(own(table))}


def course_history(courses: DataFrame, semesters: DataFrame, text: str) -> DataFrame:
    """A course's semesters, found by part of its name."""
    return (courses.where(contains(F.col("CourseName"), text)).join(semesters.select("SemesterKey", "SemesterLabel"), "SemesterKey")
            .orderBy("CourseName", "SemesterKey"))


def hardest_courses(courses: DataFrame, k: int = 10, limits: S.Thresholds = S.DEFAULTS) -> DataFrame:
    """The k courses with the highest failure rate among those of sufficient size."""
    return top_k(courses, "FailureRate", "CourseKey", k, "Enrollment", limits.min_enrollment)


def exam_report(rates: DataFrame, by: str, key: str, limit: int = 15, limits: S.Thresholds = S.DEFAULTS) -> DataFrame:
    """Exam rates of the ``limit`` sufficiently large entities with the highest failure rate."""
    floor = limits.min_group if by == "group" else limits.min_enrollment
    return top_k(rates, "FailureRate", key, limit, "N", floor)


def prediction_report(risk: DataFrame, comparison: DataFrame) -> dict[str, DataFrame]:
    """Level distribution, flagged count, mean factor shares and the best model's row."""
    return {"levels": risk_level_counts(risk),
            "flagged": risk.agg(F.count(F.lit(1)).alias("Scored"), F.coalesce(F.sum("IsFlagged"), F.lit(0)).alias("Flagged")),
            "factor_shares": factor_shares(risk),
            "model": comparison.where((F.col("IsBest") == 1) & (F.col("Split") == "test") & (F.col("Rule") == "recall target"))}


def reads_beyond(found: DataFrame, views: set[str]) -> str | None:
    """What the analysed plan reads outside the given views, subqueries included; None if there is nothing.

    In an analysed plan a view is a node of its own around what it reads, whatever name the query used for it: below
    one of the given views all is allowed, and elsewhere only rows that the query itself spells out."""
    todo = [found._jdf.queryExecution().analyzed()]
    while todo:
        node = todo.pop()
        kind = node.nodeName()
        if kind == "View":
            name = node.desc().identifier().table()
            if name not in views:
                return name
            continue
        below = [seq.apply(i) for seq in (node.children(), node.innerChildren(), node.subqueries()) for i in range(seq.size()) if hasattr(seq.apply(i), "subqueries")]
        if node.children().isEmpty() and kind not in ("OneRowRelation", "LocalRelation", "CTERelationRef"):
            return kind
        todo += below
    return None


def capped_query(spark, tables: dict[str, DataFrame], sql: str, cap: int | None = None) -> DataFrame:
    """One SELECT over published tables. With a ``cap``, at most so many rows; the column truncated says whether there
    are more. The result is lazy.

    Only the given tables can be read: the analysed query is checked, so that paths, other views, catalog tables and functions
    that give rows raise, also under a name that the query defines. Tables are bound under names of this call alone, so no view of the
    session is replaced.
    """
    body = sql.strip().rstrip(";").strip()
    if "--" in body or "/*" in body:
        raise ValueError("comments are not allowed")
    views = {name: f"published_{uuid.uuid4().hex}" for name in tables}
    for name, view in views.items():
        tables[name].createOrReplaceTempView(view)
    bound = ", ".join(f"`{name}` AS (SELECT * FROM {view})" for name, view in views.items())
    try:
        found = spark.sql(f"WITH {bound} SELECT * FROM (\n{body}\n)")
    except Exception as exc:
        raise ValueError(f"only one SELECT over the published tables is allowed: {exc}") from exc
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)
    other = reads_beyond(found, set(views.values()))
    if other:
        raise ValueError(f"{other} is not a published table")
    if cap is None:
        return found.withColumn("truncated", F.lit(False))
    # the window is over the rows of the cap and one more
    some = found.limit(cap + 1).withColumn("truncated", F.count(F.lit(1)).over(Window.partitionBy()) > cap)
    return some.limit(cap)


def round_records(df: DataFrame, digits: int = 3) -> DataFrame:
    """Floating-point columns rounded half-even for output."""
    return df.select(*[F.bround(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


# ----------------------------------------------------------- raw profile
def profile_totals(grades: DataFrame) -> DataFrame:
    """Overall means and shares of the delivered grades."""
    admitted = F.col("IsAdmitted")
    return grades.agg(
        mean("GradePoints").alias("AvgGPA"), mean("TotalScore").alias("AvgTotal"), mean("AttendanceScore").alias("Attendance"),
        mean(F.col("IsFailed").cast("int")).alias("FailureRate"), mean((~admitted).cast("int")).alias("NotAdmitted"),
        mean("CurrentScore").alias("Current"), mean("MidtermScore").alias("Midterm"),
        mean(F.when(admitted, F.least(F.greatest(F.col("FinalScore"), F.lit(0.0)), F.lit(50.0)))).alias("FinalAdmitted"))


def profile_pivot(grades: DataFrame, students: DataFrame, faculties: list) -> DataFrame:
    """Three measures by year (rows) and faculty (columns); sums per student come before the join."""
    year = F.floor(F.col("SemesterKey") / 2).alias("Year")
    per_student = grades.groupBy(year, "StudentKey").agg(
        F.sum("GradePoints").alias("p"), F.sum("AttendanceScore").alias("a"),
        F.sum(F.col("IsFailed").cast("int")).alias("f"), F.count(F.lit(1)).alias("n"))
    return (per_student.join(students.select("StudentKey", "FacultyKey"), "StudentKey").groupBy("Year")
            .pivot("FacultyKey", faculties).agg(
                F.round(ratio(F.sum("p"), F.sum("n")), 3).alias("gpa"), F.round(ratio(F.sum("a"), F.sum("n")), 3).alias("att"),
                F.round(ratio(F.sum("f"), F.sum("n")), 3).alias("fail")))


def profile_teacher_load(enrollments: DataFrame) -> DataFrame:
    """Five-number summary of students per teacher and semester; equal loads are counted first."""
    loads = enrollments.groupBy("SemesterKey", "TeacherKey").agg(F.count(F.lit(1)).alias("_load"))
    counts = loads.groupBy("_load").agg(F.count(F.lit(1)).alias("_c"))
    at = {"Q1": 0.25, "Median": 0.5, "Q3": 0.75}
    return counts.agg(F.sum("_c").alias("Count"), ratio(F.sum(F.col("_load") * F.col("_c")), F.sum("_c")).alias("Mean"),
                      F.min("_load").alias("Min"), *[F.percentile("_load", q, F.col("_c")).alias(n) for n, q in at.items()],
                      F.max("_load").alias("Max"))


def profile_cohorts(students: DataFrame) -> DataFrame:
    """Students by enrolment year (rows) and status (columns)."""
    counts = students.groupBy("EnrollmentYear").pivot("Status", list(S.STUDENT_STATUS)).agg(F.count(F.lit(1)))
    return counts.na.fill(0)
