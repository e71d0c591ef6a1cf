"""Registered queries: indicators, health, headline figures, alerts and anomalies."""

from pyspark.sql import functions as F

from cohortlake.functions.selection import robust_z
from cohortlake.operators import alerts as AL, anomalies as AN, health as H, kpis as K, performance as P, snapshot
from cohortlake.plans.driver_tables import LIMITS
from cohortlake.plans.oracle_base import AGG, LATEST, MONEY, query
from cohortlake.plans.registry import register


def rounded(df, digits: int = 6):
    """Doubles rounded for comparison; whole numbers and text as they are."""
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


# ------------------------------------------------------------------- snapshot
SNAP_COLS = ("StudentKey SemesterKey FacultyKey DepartmentKey StudySemester CourseLoad Credits SemGPA CumGPA PrevGPA AttendanceRate "
             "FailedCourses CumFailedCourses AvgAssignmentScore SubmissionRate WarningsCum DebtRatio AvgTeacherLoad IsAtRisk "
             "IsLastSemester").split()
DECIMALS = {"SemGPA", "CumGPA", "PrevGPA", "AttendanceRate", "AvgAssignmentScore", "SubmissionRate", "DebtRatio", "AvgTeacherLoad"}


def _plain(names):
    return ", ".join(f"{c}::DOUBLE AS {c}" if c in DECIMALS else c for c in names)


def _doubles(df):
    return df.select(*[F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c) for c, t in df.dtypes])


@register("student_semester", query(f"SELECT {_plain(SNAP_COLS)} FROM snap", "snap"))
def _(u):
    return _doubles(u.snap)


@register("snapshot_base", query("SELECT StudentKey, SemesterKey, CourseLoad, Credits, QualityPoints, FailedCourses FROM snap0", "snap0"))
def _(u):
    return snapshot.grade_base(u.scored_lines)


@register("snapshot_attendance", query(
    "SELECT StudentKey, SemesterKey, CAST(att AS DECIMAL(5,4))::DOUBLE AS AttendanceRate FROM snap0", "snap0"))
def _(u):
    return _doubles(snapshot.attendance_side(u.attendance))


@register("snapshot_assignments", query(
    "SELECT StudentKey, SemesterKey, CAST(asg AS DECIMAL(5,1))::DOUBLE AS AvgAssignmentScore, "
    "CAST(sub AS DECIMAL(5,4))::DOUBLE AS SubmissionRate FROM snap0", "snap0"))
def _(u):
    return _doubles(snapshot.assignment_side(u.assignments))


@register("snapshot_payments", query(
    "SELECT StudentKey, SemesterKey, CAST(sum(RemainingDebt)::DOUBLE / sum(TuitionAmount)::DOUBLE AS DECIMAL(5,4))::DOUBLE AS DebtRatio "
    "FROM payments GROUP BY 1, 2", "payments"))
def _(u):
    return _doubles(snapshot.payment_side(u.payments))


@register("snapshot_warnings", query(
    "SELECT StudentKey, SemesterKey, count(*) AS Warnings FROM warnings GROUP BY 1, 2", "warnings"))
def _(u):
    return snapshot.warning_side(u.warnings)


@register("snapshot_teacher_load", query(
    "SELECT StudentKey, SemesterKey, CAST(load AS DECIMAL(8,1))::DOUBLE AS AvgTeacherLoad FROM loads", "loads"))
def _(u):
    return _doubles(snapshot.teacher_load_side(u.enrollments))


for _name, _cols in {"snapshot_running": ["CumGPA", "CumFailedCourses", "WarningsCum"], "snapshot_lag": ["PrevGPA"],
                     "snapshot_flags": ["IsAtRisk", "IsLastSemester"], "study_semester": ["StudySemester"]}.items():
    _picked = ["StudentKey", "SemesterKey", *_cols]

    @register(_name, query(f"SELECT {_plain(_picked)} FROM snap", "snap"))
    def _(u, picked=_picked):
        return _doubles(u.snap.select(*picked))


# ----------------------------------------------------------------- indicators
@register("aggregate_faculty", query(f"SELECT a.*, {MONEY} FROM "
                                     f"(SELECT FacultyKey, {AGG} FROM snap GROUP BY 1) a LEFT JOIN (SELECT FacultyKey, sum(Tuition) AS Tuition, "
                                     "sum(Paid) AS Paid, sum(Debt) AS Debt FROM pay_fac GROUP BY 1) p ON p.FacultyKey = a.FacultyKey",
                                     "snap", "pay_fac"))
def _(u):
    return P.aggregate(u.snap_retained, u.payments_faculty, ["FacultyKey"])


@register("semester_trend", query("SELECT * FROM trend", "trend"))
def _(u):
    return u.trend


@register("faculty_trend", query("SELECT * FROM ftrend", "ftrend"))
def _(u):
    return u.faculty_trend


@register("season_split", query(f"SELECT * FROM trend WHERE SemesterKey % 2 = {LATEST} % 2", "trend", "lines"))
def _(u):
    return P.season_split(u.trend, u.latest)


@register("course_summary", query("SELECT * FROM chist", "chist"))
def _(u):
    return u.course_history


@register("course_summary_latest", query(f"SELECT * FROM chist WHERE SemesterKey = {LATEST}", "chist", "lines"))
def _(u):
    return u.course_summary(u.latest)


@register("course_summary_pooled", query("SELECT * FROM cpool", "cpool"))
def _(u):
    return u.course_pooled


@register("teacher_summary", query("SELECT * FROM tsum", "tsum"))
def _(u):
    return u.teacher_summary(u.latest)


# ---------------------------------------------------------------------- health
SCALES = {"academic": (0.25, 3.0, 4.5), "engagement": (0.10, 0.60, 0.98), "attendance": (0.15, 0.60, 0.95),
          "retention": (0.15, 0.80, 0.99), "faculty_load": (0.10, 0.40, 0.0), "financial": (0.15, 0.60, 1.0),
          "course_health": (0.10, 0.30, 0.0)}
SCALE_VALUES = ", ".join(f"('{k}', {w}, {a}::DOUBLE, {b}::DOUBLE)" for k, (w, a, b) in SCALES.items())
UNI_ROW = f"""SELECT SemesterKey, AvgGPA AS academic, SubmissionRate AS engagement, AttendanceRate AS attendance,
  CASE WHEN Retention IS NULL THEN (SELECT Retention FROM trend WHERE Retention IS NOT NULL AND SemesterKey < {LATEST} ORDER BY SemesterKey DESC LIMIT 1)
    ELSE Retention END AS retention, CollectionRate AS financial,
  (SELECT sum(Overloaded::INT)::DOUBLE / count(*) FROM tsum) AS faculty_load,
  (SELECT sum((FailureRate > 0.25)::INT)::DOUBLE / count(*) FROM chist WHERE SemesterKey = {LATEST} AND Enrollment >= 30) AS course_health
FROM trend WHERE SemesterKey = {LATEST}"""
FAC_ROW = f"""SELECT FacultyKey, AvgGPA AS academic, SubmissionRate AS engagement, AttendanceRate AS attendance,
  (SELECT b.Retention FROM ftrend b WHERE b.FacultyKey = a.FacultyKey AND b.Retention IS NOT NULL AND b.SemesterKey =
    (SELECT max(SemesterKey) FROM ftrend WHERE Retention IS NOT NULL AND SemesterKey < {LATEST})) AS retention,
  CollectionRate AS financial, NULL::DOUBLE AS faculty_load,
  (SELECT sum((FailureRate > 0.25)::INT)::DOUBLE / nullif(count(*), 0) FROM chist c
    WHERE c.SemesterKey = {LATEST} AND Enrollment >= 30 AND c.FacultyKey = a.FacultyKey) AS course_health
FROM ftrend a WHERE SemesterKey = {LATEST}"""


def _detail(entity):
    return f"""SELECT {entity}, Key, Value, Worst, Best, round_even(sub, 1) AS SubScore, Weight, round_even(sub * Weight, 1) AS Points FROM (
  SELECT *, least(greatest((Value - Worst) / (Best - Worst), 0), 1) * 100 AS sub,
    round_even(w::DOUBLE / (sum(w) OVER (PARTITION BY {entity}))::DOUBLE, 4) AS Weight
  FROM (UNPIVOT row ON {', '.join(SCALES)} INTO NAME k VALUE Value) r JOIN (VALUES {SCALE_VALUES}) s(Key, w, Worst, Best) ON s.Key = r.k)"""


@register("health_inputs", query(UNI_ROW, "trend", "tsum", "chist", "lines"), gold=True)
def _(u):
    return H.university_inputs(u.trend, u.teacher_summary(u.latest), u.course_summary(u.latest), u.latest, LIMITS)


@register("university_health", query("SELECT * FROM detail", "trend", "tsum", "chist", "lines",
                                     extra={"row": UNI_ROW, "detail": _detail("SemesterKey")}), gold=True)
def _(u):
    return H.university_health(u.trend, u.teacher_summary(u.latest), u.course_summary(u.latest), u.latest, LIMITS)


@register("health_score", query(
    "SELECT SemesterKey, round(sum(Points), 1) AS HealthScore FROM detail GROUP BY 1", "trend", "tsum", "chist", "lines",
    extra={"row": UNI_ROW, "detail": _detail("SemesterKey")}), gold=True)
def _(u):
    detail = H.university_health(u.trend, u.teacher_summary(u.latest), u.course_summary(u.latest), u.latest, LIMITS)
    return H.health_total(detail, ["SemesterKey"])


@register("carry_last_retention", query(
    f"SELECT FacultyKey, retention AS Retention FROM ({FAC_ROW})", "ftrend", "chist", "lines"), gold=True)
def _(u):
    row = u.faculty_trend.where(F.col("SemesterKey") == u.latest)
    return P.carry_last_retention(row, u.faculty_trend, ["FacultyKey"], u.latest).select("FacultyKey", "Retention")


FAC_SUMMARY = f"""SELECT t.* EXCLUDE (Retention), r.retention AS Retention, ScoredStudents, HighRiskStudents, HighRiskShare, AvgRiskProbability,
  HealthScore, rank() OVER (ORDER BY HealthScore DESC) AS Rank
FROM ftrend t JOIN row r ON r.FacultyKey = t.FacultyKey
LEFT JOIN (SELECT FacultyKey, count(*) AS ScoredStudents, sum((RiskLevel IN ('Yuqori', 'Kritik'))::INT) AS HighRiskStudents,
  sum((RiskLevel IN ('Yuqori', 'Kritik'))::INT)::DOUBLE / count(*) AS HighRiskShare,
  sum(RiskProbability::DECIMAL(9,6))::DOUBLE / count(*) AS AvgRiskProbability FROM risk GROUP BY 1) k ON k.FacultyKey = t.FacultyKey
JOIN (SELECT FacultyKey, round(sum(Points), 1) AS HealthScore FROM detail GROUP BY 1) h ON h.FacultyKey = t.FacultyKey
WHERE t.SemesterKey = {LATEST}"""
FAC_EXTRA = {"row": FAC_ROW, "detail": _detail("FacultyKey"), "fsum": FAC_SUMMARY}


def faculty_summary(u):
    return H.faculty_summary(u.faculty_trend, u.course_summary(u.latest), u.risk, u.latest, LIMITS)


@register("faculty_summary", query("SELECT * FROM fsum", "ftrend", "chist", "risk", "lines", extra=FAC_EXTRA), gold=True)
def _(u):
    return faculty_summary(u)


@register("extreme_faculty", query(
    "SELECT * FROM fsum ORDER BY HighRiskShare DESC, FacultyKey LIMIT 1", "ftrend", "chist", "risk", "lines", extra=FAC_EXTRA), gold=True)
def _(u):
    return H.extreme_row(faculty_summary(u), "HighRiskShare", "FacultyKey")


@register("weakest_component", query(
    "SELECT * FROM detail ORDER BY SubScore, Key LIMIT 1", "trend", "tsum", "chist", "lines",
    extra={"row": UNI_ROW, "detail": _detail("SemesterKey")}), gold=True)
def _(u):
    detail = H.university_health(u.trend, u.teacher_summary(u.latest), u.course_summary(u.latest), u.latest, LIMITS)
    return H.extreme_row(detail, "SubScore", "Key", largest=False)


@register("season_trend_of_weakest", query(
    f"SELECT FacultyKey, SemesterKey, SemesterLabel, AvgGPA FROM ftrend WHERE SemesterKey % 2 = {LATEST} % 2 AND FacultyKey = "
    "(SELECT FacultyKey FROM fsum ORDER BY HighRiskShare DESC, FacultyKey LIMIT 1)", "ftrend", "chist", "risk", "lines", extra=FAC_EXTRA), gold=True)
def _(u):
    worst = H.extreme_row(H.risk_by_faculty(u.risk), "HighRiskShare", "FacultyKey").select("FacultyKey").scalar()
    return P.season_trend_of(u.faculty_trend, worst, u.latest)


# ------------------------------------------------------------ headline figures
def _kpi_sql():
    base = f"(CASE WHEN EXISTS (SELECT 1 FROM trend WHERE SemesterKey = {LATEST} - 2) THEN {LATEST} - 2 ELSE {LATEST} - 1 END)"
    both = ", ".join(f"c.{c} AS {n}, p.{c} AS {n}_prev" for n, c in K.COMPARED.items())
    kept = "(SELECT Retention FROM trend WHERE Retention IS NOT NULL ORDER BY SemesterKey DESC LIMIT 1 OFFSET {})"
    high = "(SELECT sum((RiskLevel IN ('Yuqori', 'Kritik'))::INT) FROM risk)"
    return query(f"""SELECT c.SemesterLabel AS semester, p.SemesterLabel AS compared_with,
  (SELECT count(*) FROM students WHERE Status = 'Faol') AS total_students, c.Students AS students_in_semester, {both},
  {kept.format(0)} AS retention, {kept.format(1)} AS retention_prev,
  (SELECT sum((Status = 'Bitirgan')::INT)::DOUBLE / count(*) FROM students WHERE EnrollmentYear IN
    (SELECT EnrollmentYear FROM students WHERE Status = 'Bitirgan')) AS graduation_rate,
  {high} AS high_risk_students, {high}::DOUBLE / (SELECT count(*) FROM risk) AS high_risk_share,
  (SELECT sum(IsFlagged) FROM risk) AS flagged_students, (SELECT sum(Debt)::DOUBLE FROM pay_fac) AS outstanding_debt
FROM trend c JOIN trend p ON c.SemesterKey = {LATEST} AND p.SemesterKey = {base}""", "trend", "risk", "students", "lines")


def kpi_row(u):
    return K.kpis(u.trend, u.semesters, u.students, u.risk, u.payments_faculty, u.latest)


@register("kpis", _kpi_sql(), gold=True)
def _(u):
    return kpi_row(u)


@register("graduation_rate", query(
    "SELECT sum((Status = 'Bitirgan')::INT)::DOUBLE / count(*) AS graduation_rate FROM students WHERE EnrollmentYear IN "
    "(SELECT EnrollmentYear FROM students WHERE Status = 'Bitirgan')", "students"))
def _(u):
    return K.graduation_rate(u.students)


def risk_rows(u):
    return K.risk_table(u.risk, u.snap, u.students, u.faculties, u.departments, u.latest)


RISK_TABLE = f"""SELECT r.* , {_plain(K.CURRENT)}, FullName, GroupName, StudyYear, TuitionStatus, FacultyName, DepartmentName
FROM risk r LEFT JOIN (SELECT StudentKey AS sk, {', '.join(K.CURRENT)} FROM snap WHERE SemesterKey = {LATEST}) c ON c.sk = r.StudentKey
JOIN (SELECT StudentKey AS sk2, FullName, GroupName, StudyYear, TuitionStatus FROM students) s ON sk2 = r.StudentKey
JOIN (SELECT FacultyKey AS fk, FacultyName FROM faculties) f ON fk = r.FacultyKey
JOIN (SELECT DepartmentKey AS dk, DepartmentName FROM departments) d ON dk = r.DepartmentKey"""
RISK_NEEDS = ("risk", "snap", "students", "faculties", "departments", "lines")


@register("risk_table", query(RISK_TABLE, *RISK_NEEDS), gold=True)
def _(u):
    return _doubles(risk_rows(u))


@register("risk_vs_debt", query(f"""
SELECT b AS BandNo, CASE b WHEN 0 THEN 'Grant (to''lov yo''q)' WHEN 1 THEN 'Qarzi yo''q' WHEN 2 THEN 'Qarz 1-30%'
  WHEN 3 THEN 'Qarz 31-60%' ELSE 'Qarz 60% dan yuqori' END AS DebtBand, count(*) AS Students, sum(SemGPA)::DOUBLE / count(*) AS AvgGPA,
  sum(AttendanceRate)::DOUBLE / count(*) AS AttendanceRate, sum(IsAtRisk)::DOUBLE / count(*) AS AtRiskShare
FROM (SELECT s.*, CASE WHEN TuitionStatus = 'Grant' THEN 0 WHEN DebtRatio = 0 THEN 1 WHEN DebtRatio <= 0.3 THEN 2
  WHEN DebtRatio <= 0.6 THEN 3 ELSE 4 END AS b FROM snap s JOIN students t ON t.StudentKey = s.StudentKey WHERE SemesterKey = {LATEST})
GROUP BY 1, 2""", "snap", "students", "lines"))
def _(u):
    return K.risk_vs_debt(u.snap, u.students, u.latest)


# --------------------------------------------------------------------- alerts


def _alert_sql():
    base = f"(CASE WHEN EXISTS (SELECT 1 FROM ftrend WHERE SemesterKey = {LATEST} - 2) THEN {LATEST} - 2 ELSE {LATEST} - 1 END)"
    cur = f"FROM ftrend c JOIN ftrend p ON p.FacultyKey = c.FacultyKey AND c.SemesterKey = {LATEST} AND p.SemesterKey = {base}"
    return query(f"""
SELECT 'critical' AS Level, 'risk' AS Metric, NULL::BIGINT AS EntityKey, NULL::VARCHAR AS Entity, NULL::DOUBLE AS Before, round(h::DOUBLE / n, 6) AS After,
  h::DOUBLE AS Value, 0 AS Severity FROM (SELECT count(*) AS n, sum((RiskLevel IN ('Yuqori', 'Kritik'))::INT) AS h FROM risk) WHERE h::DOUBLE / n >= 0.08
UNION ALL SELECT CASE WHEN g0 > g1 THEN 'warning' ELSE 'positive' END, 'gpa_trend', FacultyKey, FacultyName, round(g0, 6), round(g2, 6), round(g2 / g0 - 1, 6),
  CASE WHEN g0 > g1 THEN 1 ELSE 3 END FROM (
    SELECT c.FacultyKey, c.FacultyName, c.AvgGPA AS g2, b.AvgGPA AS g1, a.AvgGPA AS g0 {cur}
    JOIN (SELECT *, row_number() OVER (PARTITION BY FacultyKey ORDER BY SemesterKey DESC) AS q FROM ftrend WHERE SemesterKey % 2 = {LATEST} % 2) b
      ON b.FacultyKey = c.FacultyKey AND b.q = 2
    JOIN (SELECT *, row_number() OVER (PARTITION BY FacultyKey ORDER BY SemesterKey DESC) AS q FROM ftrend WHERE SemesterKey % 2 = {LATEST} % 2) a
      ON a.FacultyKey = c.FacultyKey AND a.q = 3) WHERE abs(g2 / g0 - 1) >= 0.03 AND ((g0 > g1 AND g1 > g2) OR (g0 < g1 AND g1 < g2))
UNION ALL SELECT 'warning', 'attendance', c.FacultyKey, c.FacultyName, round(p.AttendanceRate, 6), round(c.AttendanceRate, 6),
  round(p.AttendanceRate - c.AttendanceRate, 6), 1 {cur} WHERE p.AttendanceRate - c.AttendanceRate >= 0.02
UNION ALL SELECT CASE WHEN c.AvgGPA > p.AvgGPA THEN 'positive' ELSE 'warning' END, 'gpa', c.FacultyKey, c.FacultyName, round(p.AvgGPA, 6),
  round(c.AvgGPA, 6), round(c.AvgGPA / p.AvgGPA - 1, 6), CASE WHEN c.AvgGPA > p.AvgGPA THEN 3 ELSE 1 END {cur} WHERE abs(c.AvgGPA / p.AvgGPA - 1) >= 0.03
UNION ALL SELECT 'warning', 'finance', c.FacultyKey, c.FacultyName, NULL, round(c.CollectionRate, 6), round(c.CollectionRate, 6), 1 {cur} WHERE c.CollectionRate < 0.85
UNION ALL SELECT 'attention', 'course', CourseKey, CourseName, NULL, round(FailureRate, 6), round(FailureRate, 6), 2 FROM chist
WHERE SemesterKey = {LATEST} AND Enrollment >= 30 AND FailureRate > 0.25""", "risk", "ftrend", "chist", "lines")


def alert_rows(u):
    return AL.alerts(kpi_row(u), u.faculty_trend, u.course_summary(u.latest), u.latest, LIMITS)


@register("alerts", _alert_sql(), gold=True)
def _(u):
    return rounded(alert_rows(u))


# ------------------------------------------------------------------- anomalies
@register("robust_z", query("""
SELECT StudentKey, SemesterKey, round(coalesce((TotalDebt - m) / (1.4826::DOUBLE * nullif(mad, 0)), 0), 6) AS Z FROM (
  SELECT *, (SELECT median(abs(TotalDebt - m)) FROM d, (SELECT median(TotalDebt) AS m FROM d)) AS mad
  FROM d, (SELECT median(TotalDebt) AS m FROM d))""", "payments",
    extra={"d": "SELECT StudentKey, SemesterKey, sum(RemainingDebt)::DOUBLE AS TotalDebt FROM payments GROUP BY 1, 2"}))
def _(u):
    debt = u.payments.groupBy("StudentKey", "SemesterKey").agg(F.sum("RemainingDebt").cast("double").alias("TotalDebt"))
    return rounded(robust_z(debt, "TotalDebt").select("StudentKey", "SemesterKey", "Z"))


DELTAS = """SELECT * FROM (SELECT FacultyKey, FacultyName, SemesterKey, Metric, After, lag(After) OVER (PARTITION BY FacultyKey, Metric ORDER BY SemesterKey) AS Before,
  After - lag(After) OVER (PARTITION BY FacultyKey, Metric ORDER BY SemesterKey) AS Change
FROM (UNPIVOT (SELECT FacultyKey, FacultyName, SemesterKey, AttendanceRate, AvgGPA, FailureRate, CollectionRate FROM ftrend)
  ON AttendanceRate, AvgGPA, FailureRate, CollectionRate INTO NAME Metric VALUE After)) WHERE Change IS NOT NULL"""
DELTA_Z = """SELECT d.*, coalesce((Change - m) / (1.4826::DOUBLE * nullif(mad, 0)), 0) AS zz FROM delta d
JOIN (SELECT Metric, median(Change) AS m FROM delta GROUP BY 1) a ON a.Metric = d.Metric
JOIN (SELECT x.Metric, median(abs(Change - m)) AS mad FROM delta x JOIN (SELECT Metric, median(Change) AS m FROM delta GROUP BY 1) y ON y.Metric = x.Metric GROUP BY 1) b
  ON b.Metric = d.Metric"""


def _fac_anomaly(z):
    return f"""SELECT 'faculty' AS Kind, Metric, FacultyKey::BIGINT AS EntityKey, FacultyName AS Entity, SemesterKey, round(Before, 6) AS Before, round(After, 6) AS After,
  round(Change, 6) AS Change, round_even(zz, 1) AS Z, CASE WHEN Metric = 'CollectionRate' THEN 'payment' WHEN
    (SELECT median(abs(o.Change)) FROM dz o WHERE o.Metric = d.Metric AND o.SemesterKey = d.SemesterKey AND o.FacultyKey <> d.FacultyKey) < abs(Change) / 3
    THEN 'isolated' ELSE 'shared' END AS Hint FROM dz d WHERE abs(zz) >= {z}"""


COURSE_ANOMALY = """SELECT 'course' AS Kind, 'FailureRate' AS Metric, CourseKey::BIGINT AS EntityKey, CourseName AS Entity, SemesterKey, round(p0, 6) AS Before,
  round(FailureRate, 6) AS After, round(FailureRate - p0, 6) AS Change, round_even(zz, 1) AS Z,
  CASE WHEN (FinalPct - pf) * 100 < (MidtermPct - pm) * 100 - 8 THEN 'final_exam' ELSE 'whole_course' END AS Hint
FROM (SELECT *, (FailureRate - p0) / sqrt(greatest(p0 * (1 - p0), 0.0001::DOUBLE) / Enrollment) AS zz FROM (
  SELECT *, sum(Failed) OVER w::DOUBLE / sum(Enrollment) OVER w AS p0, lag(FinalPct) OVER o AS pf, lag(MidtermPct) OVER o AS pm
  FROM chist WHERE Enrollment >= 30 WINDOW o AS (PARTITION BY CourseKey ORDER BY SemesterKey),
    w AS (PARTITION BY CourseKey ORDER BY SemesterKey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE p0 IS NOT NULL)
WHERE zz >= {z} AND FailureRate - p0 >= {rise}"""
TEACHER_ANOMALY = """SELECT 'teacher' AS Kind, 'Students' AS Metric, TeacherKey::BIGINT AS EntityKey, TeacherName AS Entity, {sem} AS SemesterKey, m AS Before,
  Students::DOUBLE AS After, round(Students::DOUBLE / m, 6) AS Change, round_even(zz, 1) AS Z, 'workload' AS Hint
FROM (SELECT *, coalesce((Students - m) / (1.4826::DOUBLE * nullif((SELECT median(abs(Students - m)) FROM tsum, (SELECT median(Students) AS m FROM tsum)), 0)), 0) AS zz
  FROM tsum, (SELECT median(Students) AS m FROM tsum)) WHERE zz >= {z}"""
STRICT = LIMITS.__class__(min_enrollment=30, min_group=20, teacher_overload=60, anomaly_z=1.5, course_rise=0.02)


@register("faculty_anomalies", query(_fac_anomaly(1.5), "ftrend", extra={"delta": DELTAS, "dz": DELTA_Z}))
def _(u):
    return rounded(AN.faculty_anomalies(u.faculty_trend, STRICT))


@register("course_anomalies", query(COURSE_ANOMALY.format(z=2.5, rise=0.02), "chist"))
def _(u):
    return rounded(AN.course_anomalies(u.course_history, STRICT))


@register("teacher_load_anomalies", query(TEACHER_ANOMALY.format(z=1.5, sem=LATEST), "tsum", "lines"))
def _(u):
    return rounded(AN.teacher_load_anomalies(u.teacher_summary(u.latest), F.lit(u.latest), STRICT))


@register("anomalies", query(
    f"SELECT * FROM ({_fac_anomaly(3.0)}) UNION ALL ({COURSE_ANOMALY.format(z=4.0, rise=0.07)}) UNION ALL "
    f"({TEACHER_ANOMALY.format(z=3.0, sem=LATEST)})", "ftrend", "chist", "tsum", "lines", extra={"delta": DELTAS, "dz": DELTA_Z}), gold=True)
def _(u):
    return rounded(AN.anomalies(u.faculty_trend, u.course_history, u.teacher_summary(u.latest), F.lit(u.latest), LIMITS))
