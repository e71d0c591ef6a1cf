"""Registered queries: base frames and exam analysis."""

from pyspark.sql import functions as F

from cohortlake.operators import dimensions, exams, frames
from cohortlake.plans.oracle_base import EXAM_COLS, LATEST, RATE_COLS, RATES, RESUM, query
from cohortlake.plans.registry import register

RATE_LIST = ", ".join(EXAM_COLS + RATE_COLS)


@register("semesters_in_use", query(
    "SELECT SemesterKey, SemesterName, SemesterLabel, StartDate, EndDate FROM semesters "
    "WHERE SemesterKey IN (SELECT SemesterKey FROM lines)", "semesters", "lines"))
def _(u):
    return frames.semesters_in_use(u.semesters, u.order_heads)


@register("teachers_with_department", query("SELECT * FROM teachers", "teachers"))
def _(u):
    return u.teachers_full


@register("courses_with_department", query("SELECT * FROM courses", "courses"))
def _(u):
    return u.courses_full


@register("student_columns", query("SELECT * FROM students", "students"))
def _(u):
    return frames.student_columns(u.students)


@register("retention", query("SELECT StudentKey, SemesterKey, Retained FROM snap", "snap"))
def _(u):
    return u.snap_retained.select("StudentKey", "SemesterKey", "Retained")


@register("latest_semester", query("SELECT max(SemesterKey) AS Latest FROM lines", "lines"))
def _(u):
    return u.snap.agg(F.max("SemesterKey").alias("Latest"))


@register("exam_sums", query(f"SELECT {RESUM} FROM course_sem", "course_sem"))
def _(u):
    return u.scored_lines.agg(*frames.exam_sums())


@register("course_semester", query("SELECT * FROM course_sem", "course_sem"))
def _(u):
    return u.course_sem


@register("exam_group", query("SELECT * FROM exam_group", "exam_group"))
def _(u):
    return u.exam_group


DIST = """SELECT g.SemesterKey, FacultyKey, CASE WHEN MidtermScore >= 30 THEN 9 ELSE floor(MidtermScore * 10 / 30) END::INT AS MidBin,
  CASE WHEN IsAdmitted = 0 THEN -1 WHEN FinalScore >= 50 THEN 9 ELSE floor(FinalScore * 10 / 50) END::INT AS FinBin, count(*) AS N
FROM grades g JOIN students s ON s.StudentKey = g.StudentKey GROUP BY ALL"""


@register("exam_dist", query(DIST, "grades", "students"))
def _(u):
    return u.exam_dist


@register("payments_by_faculty", query(
    "SELECT SemesterKey, FacultyKey, Invoices, WithDebt, Tuition::DOUBLE AS Tuition, Paid::DOUBLE AS Paid, Debt::DOUBLE AS Debt FROM pay_fac",
    "pay_fac"))
def _(u):
    return u.payments_faculty.withColumns({c: F.col(c).cast("double") for c in ("Tuition", "Paid", "Debt")})


@register("payments_by_month", query(
    "SELECT year(PaymentDate) AS Year, month(PaymentDate) AS Month, sum(PaidAmount)::DOUBLE AS Paid, "
    "sum(TuitionAmount)::DOUBLE AS Tuition FROM payments GROUP BY ALL", "payments"))
def _(u):
    days = dimensions.date_dim(u.semesters, "1995-01-01", "2001-12-31")
    return frames.payments_by_month(u.payments, days)


@register("student_debt", query(
    "SELECT StudentKey, sum(RemainingDebt)::DOUBLE AS TotalDebt, sum(TuitionAmount)::DOUBLE AS TotalTuition "
    "FROM payments GROUP BY ALL", "payments"))
def _(u):
    return frames.student_debt(u.payments)


@register("label_of", query(
    f"SELECT SemesterLabel FROM semesters WHERE SemesterKey = {LATEST}", "semesters", "lines"))
def _(u):
    return u.faculties.limit(1).select(frames.label_of(u.semesters, u.latest).alias("SemesterLabel"))


@register("exam_rates", query(f"SELECT SemesterKey, FacultyKey, GroupName, {RATE_LIST.split(', Current,')[0]}, {RATES} "
                              "FROM exam_group", "exam_group"))
def _(u):
    return exams.exam_rates(u.exam_group)


def _by_sql(keys, source, where="", join="", names=""):
    group = f"GROUP BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return (f"SELECT {', '.join('x.' + k.strip() for k in keys.split(',')) + ', ' if keys else ''}"
            f"{', '.join('x.' + c for c in EXAM_COLS)}, {RATES}{names} "
            f"FROM (SELECT {lead}{RESUM} FROM {source} {where} {group}) x {join}")


NOW = f"WHERE SemesterKey = {LATEST}"


@register("exam_by_faculty", query(_by_sql(
    "FacultyKey", "exam_group", NOW, "JOIN faculties f ON f.FacultyKey = x.FacultyKey", ", FacultyName"),
    "exam_group", "faculties"))
def _(u):
    return exams.exam_by(u.exam_group, "faculty", u.latest).join(u.faculties, "FacultyKey")


@register("exam_by_group", query(_by_sql(
    "FacultyKey, GroupName", "exam_group", NOW, "JOIN faculties f ON f.FacultyKey = x.FacultyKey", ", FacultyName"),
    "exam_group", "faculties"))
def _(u):
    return exams.exam_by(u.exam_group, "group", u.latest).join(u.faculties, "FacultyKey")


@register("exam_by_university", query(_by_sql("", "exam_group", NOW), "exam_group"))
def _(u):
    return exams.exam_by(u.exam_group, "university", u.latest)


@register("exam_by_semester", query(_by_sql(
    "SemesterKey", "exam_group", "", "JOIN semesters s ON s.SemesterKey = x.SemesterKey", ", SemesterLabel"),
    "exam_group", "semesters"))
def _(u):
    return exams.exam_by(u.exam_group, "semester").join(
        u.semesters.select("SemesterKey", "SemesterLabel"), "SemesterKey")


@register("exam_by_course", query(_by_sql(
    "CourseKey", "course_sem", NOW, "JOIN courses c ON c.CourseKey = x.CourseKey JOIN faculties f ON f.FacultyKey = c.FacultyKey",
    ", CourseName, CurriculumSemester, c.FacultyKey, FacultyName"), "course_sem", "courses", "faculties"))
def _(u):
    names = u.courses_full.select("CourseKey", "CourseName", "CurriculumSemester", "FacultyKey").join(u.faculties, "FacultyKey")
    return exams.exam_by(u.course_sem, "course", u.latest).join(names, "CourseKey")


@register("exam_by_teacher", query(_by_sql(
    "TeacherKey", "course_sem", NOW, "JOIN teachers t ON t.TeacherKey = x.TeacherKey", ", TeacherName, DepartmentName"),
    "course_sem", "teachers"))
def _(u):
    names = u.teachers_full.select("TeacherKey", "TeacherName", "DepartmentName")
    return exams.exam_by(u.course_sem, "teacher", u.latest).join(names, "TeacherKey")


@register("exam_by_grains", query(
    f"""SELECT Grain, FacultyKey, GroupName, SemesterKey, {', '.join(EXAM_COLS)}, {RATES} FROM (
  SELECT 'faculty' AS Grain, FacultyKey, NULL AS GroupName, NULL AS SemesterKey, {RESUM} FROM exam_group GROUP BY FacultyKey
  UNION ALL SELECT 'group', FacultyKey, GroupName, NULL, {RESUM} FROM exam_group GROUP BY FacultyKey, GroupName
  UNION ALL SELECT 'university', NULL, NULL, NULL, {RESUM} FROM exam_group
  UNION ALL SELECT 'semester', NULL, NULL, SemesterKey, {RESUM} FROM exam_group GROUP BY SemesterKey)""", "exam_group"))
def _(u):
    return exams.exam_by_grains(u.exam_group, ["faculty", "group", "university", "semester"])


def _overview_sql():
    cur = ", ".join(f"max(CASE WHEN s = 1 THEN {c} END) AS {c}, max(CASE WHEN s = 0 THEN {c} END) AS Prev{c}"
                    for c in exams.HEADLINES)
    grades = ", ".join(f"max(CASE WHEN s = 1 THEN {c} END) AS Grade{g}" for g, c in
                       (("5", "N5"), ("4", "N4"), ("3", "N3"), ("2", "Failed")))
    return query(f"""SELECT {cur}, {grades} FROM (SELECT s, {', '.join(EXAM_COLS)}, {RATES} FROM (
  SELECT CASE WHEN SemesterKey = {LATEST} THEN 1 ELSE 0 END AS s, {RESUM} FROM exam_group
  WHERE SemesterKey IN ({LATEST}, {LATEST} - 2) GROUP BY 1))""", "exam_group")


@register("exam_overview", _overview_sql())
def _(u):
    return exams.exam_overview(u.exam_group, u.latest)


DIST_CTE = {"dist": DIST}


@register("exam_histogram", query(f"""
SELECT b AS BandNo, (b * 10) || '-' || CASE WHEN b < 9 THEN b * 10 + 9 ELSE 100 END || '%' AS Band,
  coalesce((SELECT sum(N) FROM dist WHERE SemesterKey = {LATEST} AND MidBin = b), 0)::DOUBLE
    / (SELECT sum(N) FROM dist WHERE SemesterKey = {LATEST}) AS Midterm,
  coalesce((SELECT sum(N) FROM dist WHERE SemesterKey = {LATEST} AND FinBin = b), 0)::DOUBLE
    / (SELECT sum(N) FROM dist WHERE SemesterKey = {LATEST} AND FinBin >= 0) AS Final
FROM range(10) t(b)""", "grades", "students", extra=DIST_CTE))
def _(u):
    return exams.exam_histogram(u.exam_dist, u.latest)


def _flow_parts(select, where):
    lvl = ("CASE WHEN {b} < 0 THEN 'Qo''yilmagan' WHEN {b} < 6 THEN '60% dan past' WHEN {b} < 8 THEN '60-79%' "
           "ELSE '80% va yuqori' END")
    counts = ", ".join(f"coalesce(sum(CASE WHEN f = '{k}' THEN N END), 0)::BIGINT AS {n}" for k, n in
                       (("80% va yuqori", "High"), ("60-79%", "Middle"), ("60% dan past", "Low"), ("Qo''yilmagan", "NotAdmitted")))
    shares = ", ".join(f"{n}::DOUBLE / nullif(High + Middle + Low + NotAdmitted, 0) AS {n}Share"
                       for n in ("High", "Middle", "Low", "NotAdmitted"))
    flow = f"""SELECT *, {shares} FROM (SELECT Row, l AS MidtermLevel, {counts}
  FROM (VALUES (0, '80% va yuqori'), (1, '60-79%'), (2, '60% dan past')) v(Row, l)
  LEFT JOIN (SELECT {lvl.format(b='MidBin')} AS m, {lvl.format(b='FinBin')} AS f, N FROM dist WHERE {where}) d ON d.m = v.l GROUP BY ALL)"""
    return query(select, "grades", "students", extra={**DIST_CTE, "flow": flow})


@register("exam_flow", _flow_parts("SELECT * FROM flow", f"SemesterKey = {LATEST} AND FacultyKey = 2"))
def _(u):
    return exams.exam_flow(u.exam_dist, u.latest, faculty=2)


@register("low_midterm_outcome", _flow_parts(
    "SELECT LowShare + NotAdmittedShare AS LowMidtermNotPassed FROM flow WHERE Row = 2", f"SemesterKey = {LATEST}"))
def _(u):
    return exams.low_midterm_outcome(exams.exam_flow(u.exam_dist, u.latest))


CHANGES = ["MidtermPct", "FinalPct", "NotAdmittedRate", "FailureRate"]


@register("exam_change", query(
    f"SELECT a.SemesterKey, a.FacultyKey, {', '.join('a.' + c for c in CHANGES)}, "
    f"{', '.join(f'(a.{c} - b.{c}) * 100 AS {c}Change' for c in CHANGES)} FROM r a "
    "LEFT JOIN r b ON b.SemesterKey + 2 = a.SemesterKey AND b.FacultyKey = a.FacultyKey", "exam_group",
    extra={"r": _by_sql("SemesterKey, FacultyKey", "exam_group")}))
def _(u):
    return exams.exam_change(u.exam_group)


@register("faculty_exam_trend", query(_by_sql(
    "SemesterKey", "exam_group", f"WHERE FacultyKey = 1 AND SemesterKey % 2 = {LATEST} % 2"), "exam_group"))
def _(u):
    return exams.faculty_exam_trend(u.exam_group, 1, u.latest)


@register("grade_shares", query(
    "SELECT '5' AS Grade, sum(N5)::DOUBLE / sum(N) AS Share FROM exam_group UNION ALL "
    "SELECT '4', sum(N4)::DOUBLE / sum(N) FROM exam_group UNION ALL SELECT '3', sum(N3)::DOUBLE / sum(N) FROM exam_group "
    "UNION ALL SELECT '2', sum(Failed)::DOUBLE / sum(N) FROM exam_group", "exam_group"))
def _(u):
    return exams.grade_shares(u.exam_group)
