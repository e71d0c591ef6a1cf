"""The driver-table reading of plans.driver_tables, written as independent ANSI SQL."""

SEM = "((year(o_orderdate)-1995)*2 + CASE WHEN month(o_orderdate) > 6 THEN 1 ELSE 0 END)"

CTE = {
    "faculties": (), "departments": (), "students": (), "teachers": (), "courses": ("departments",),
    "semesters": (), "lines": (), "grades": ("lines",), "payments": (), "warnings": (),
    "seats": ("lines",), "loads": ("seats",), "snap0": ("grades", "payments", "warnings", "loads", "students"),
    "snap": ("snap0",), "exam_group": ("grades", "students"), "course_sem": ("grades",),
    "pay_fac": ("payments", "students"), "interventions": (),
}

SQL = {
    "faculties": "SELECT r_regionkey AS FacultyKey, r_name AS FacultyName FROM region",
    "departments": "SELECT n_nationkey AS DepartmentKey, n_name AS DepartmentName, n_regionkey AS FacultyKey FROM nation",
    "students": """
SELECT c_custkey AS StudentKey, c_name AS FullName, c_mktsegment AS GroupName, n_regionkey AS FacultyKey,
  c_nationkey AS DepartmentKey, 1995 + c_custkey % 4 AS EnrollmentYear, 1 + c_custkey % 4 AS StudyYear,
  CASE WHEN c_custkey % 5 = 0 THEN 'Grant' ELSE 'Kontrakt' END AS TuitionStatus,
  CASE WHEN c_custkey % 10 = 0 THEN 'Chetlashtirilgan' WHEN c_custkey % 10 <= 2 THEN 'Bitirgan' ELSE 'Faol' END AS Status
FROM customer JOIN nation ON n_nationkey = c_nationkey""",
    "teachers": """
SELECT s_suppkey AS TeacherKey, s_name AS TeacherName, s_nationkey AS DepartmentKey,
  n_name AS DepartmentName, n_regionkey AS FacultyKey FROM supplier JOIN nation ON n_nationkey = s_nationkey""",
    "courses": """
SELECT CourseKey, CourseName, c.DepartmentKey, 1 + CourseKey % 8 AS CurriculumSemester, DepartmentName, d.FacultyKey
FROM (SELECT DISTINCT p_brand AS CourseName, CAST(substr(p_brand, 7) AS INT) AS CourseKey,
  CAST(substr(p_brand, 7) AS INT) % 25 AS DepartmentKey FROM part) c JOIN departments d ON d.DepartmentKey = c.DepartmentKey""",
    "semesters": """
SELECT k AS SemesterKey, CASE WHEN k % 2 = 0 THEN 'Kuz' ELSE 'Bahor' END AS SemesterName,
  (1995 + k // 2) || ' ' || CASE WHEN k % 2 = 0 THEN 'Kuz' ELSE 'Bahor' END AS SemesterLabel,
  make_date(1995 + k // 2, CASE WHEN k % 2 = 0 THEN 1 ELSE 7 END, 1) AS StartDate,
  CASE WHEN k % 2 = 0 THEN make_date(1995 + k // 2, 6, 30) ELSE make_date(1995 + k // 2, 12, 31) END AS EndDate
FROM range(14) t(k)""",
    "lines": f"""
SELECT l.*, o_custkey AS StudentKey, {SEM} AS SemesterKey, CAST(o_orderdate AS DATE) AS Date
FROM lineitem l JOIN orders ON o_orderkey = l_orderkey""",
    "grades": """
SELECT *, CASE WHEN TotalScore >= 90 THEN '5' WHEN TotalScore >= 70 THEN '4' WHEN TotalScore >= 60 THEN '3' ELSE '2' END AS FinalGrade,
  CASE WHEN TotalScore >= 90 THEN 5 WHEN TotalScore >= 70 THEN 4 WHEN TotalScore >= 60 THEN 3 ELSE 2 END AS GradePoints,
  CASE WHEN TotalScore < 60 THEN 1 ELSE 0 END AS IsFailed
FROM (SELECT *, CurrentScore + MidtermScore + FinalScore AS TotalScore FROM (
  SELECT StudentKey, l_suppkey AS TeacherKey, SemesterKey, l_partkey, Date,
    12 + round(l_tax * 100) AS CurrentScore, 16 + round(l_discount * 100) AS MidtermScore,
    CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 0 ELSE least(50, 5 + l_quantity) END AS FinalScore,
    CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 0 ELSE 1 END AS IsAdmitted,
    60::DOUBLE + l_linenumber * 5 AS AttendanceScore, 1 + l_linenumber % 6 AS Credits,
    CASE WHEN l_linenumber = 7 THEN 'Kelmadi' WHEN l_linenumber = 6 AND l_returnflag = 'R' THEN 'Sababli' ELSE 'Keldi' END AS AttStatus,
    CASE WHEN l_linestatus = 'O' AND l_linenumber <= 2 THEN 0 ELSE 1 END AS IsSubmitted,
    CASE WHEN l_linestatus = 'O' AND l_linenumber <= 2 THEN 0 ELSE l_quantity * 2 END AS Score,
    CAST(substr(p_brand, 7) AS INT) AS CourseKey
  FROM lines JOIN part ON p_partkey = l_partkey))""",
    "payments": f"""
SELECT *, TuitionAmount - PaidAmount AS RemainingDebt FROM (
  SELECT o_orderkey AS PaymentID, o_custkey AS StudentKey, {SEM} AS SemesterKey, CAST(o_orderdate AS DATE) AS PaymentDate,
    CAST(o_totalprice AS DECIMAL(14,2)) AS TuitionAmount,
    CAST(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(14,2))
      WHEN o_orderstatus = 'P' THEN CAST((CAST(CAST(o_totalprice AS DECIMAL(14,2)) * 100 AS BIGINT) + 1) // 2 AS DECIMAL(14,0)) / 100
      ELSE 0 END AS DECIMAL(14,2)) AS PaidAmount
  FROM orders)""",
    "warnings": f"""
SELECT o_orderkey AS WarningID, o_custkey AS StudentKey, {SEM} AS SemesterKey, CAST(o_orderdate AS DATE) AS WarningDate,
  CASE o_orderkey % 4 WHEN 0 THEN 'Past o''zlashtirish' WHEN 1 THEN 'Davomat pastligi' WHEN 2 THEN 'Akademik qarzdorlik'
    ELSE 'To''lov qarzdorligi' END AS WarningType,
  CASE WHEN o_totalprice > 250000 THEN 'Yuqori' ELSE 'O''rta' END AS Severity
FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'""",
    "seats": "SELECT StudentKey, SemesterKey, l_suppkey AS TeacherKey, count(*) AS c FROM lines GROUP BY ALL",
    "loads": """
SELECT s.StudentKey, s.SemesterKey, sum(ld * c)::DOUBLE / sum(c) AS load FROM seats s
JOIN (SELECT TeacherKey, SemesterKey, sum(c) AS ld FROM seats GROUP BY ALL) t
  ON t.TeacherKey = s.TeacherKey AND t.SemesterKey = s.SemesterKey GROUP BY ALL""",
    "snap0": """
SELECT g.*, a.d, coalesce(w.Warnings, 0) AS Warnings, l.load, st.FacultyKey, st.DepartmentKey, st.EnrollmentYear
FROM (SELECT StudentKey, SemesterKey, count(*) AS CourseLoad, sum(Credits) AS Credits,
    sum(GradePoints * Credits)::DOUBLE AS QualityPoints, sum(IsFailed) AS FailedCourses,
    sum(CASE WHEN AttStatus = 'Keldi' THEN 1 ELSE 0 END)::DOUBLE / count(*) AS att, sum(Score)::DOUBLE / count(*) AS asg,
    sum(IsSubmitted)::DOUBLE / count(*) AS sub FROM grades GROUP BY ALL) g
LEFT JOIN (SELECT StudentKey, SemesterKey, sum(RemainingDebt)::DOUBLE / sum(TuitionAmount)::DOUBLE AS d FROM payments GROUP BY ALL) a
  ON a.StudentKey = g.StudentKey AND a.SemesterKey = g.SemesterKey
LEFT JOIN (SELECT StudentKey, SemesterKey, count(*) AS Warnings FROM warnings GROUP BY ALL) w
  ON w.StudentKey = g.StudentKey AND w.SemesterKey = g.SemesterKey
LEFT JOIN loads l ON l.StudentKey = g.StudentKey AND l.SemesterKey = g.SemesterKey
JOIN students st ON st.StudentKey = g.StudentKey""",
    "snap": """
SELECT StudentKey, SemesterKey, FacultyKey, DepartmentKey, SemesterKey - 2 * (EnrollmentYear - 1995) + 1 AS StudySemester,
  CourseLoad, Credits, CAST(QualityPoints / Credits AS DECIMAL(4,2)) AS SemGPA,
  CAST(sum(QualityPoints) OVER w / sum(Credits) OVER w AS DECIMAL(4,2)) AS CumGPA,
  CAST(lag(QualityPoints / Credits) OVER (PARTITION BY StudentKey ORDER BY SemesterKey) AS DECIMAL(4,2)) AS PrevGPA,
  CAST(att AS DECIMAL(5,4)) AS AttendanceRate, FailedCourses, sum(FailedCourses) OVER w AS CumFailedCourses,
  CAST(asg AS DECIMAL(5,1)) AS AvgAssignmentScore, CAST(sub AS DECIMAL(5,4)) AS SubmissionRate,
  sum(Warnings) OVER w AS WarningsCum, CAST(coalesce(d, 0) AS DECIMAL(5,4)) AS DebtRatio,
  CAST(load AS DECIMAL(8,1)) AS AvgTeacherLoad,
  CASE WHEN QualityPoints / Credits < 3.0 OR FailedCourses >= 2 THEN 1 ELSE 0 END AS IsAtRisk,
  CASE WHEN SemesterKey = max(SemesterKey) OVER (PARTITION BY StudentKey) THEN 1 ELSE 0 END AS IsLastSemester,
  CASE WHEN SemesterKey - 2 * (EnrollmentYear - 1995) + 1 < 8 AND SemesterKey < (SELECT max(SemesterKey) FROM snap0) THEN
    CASE WHEN lead(SemesterKey) OVER (PARTITION BY StudentKey ORDER BY SemesterKey) = SemesterKey + 1 THEN 1 ELSE 0 END END AS Retained
FROM snap0 WINDOW w AS (PARTITION BY StudentKey ORDER BY SemesterKey ROWS UNBOUNDED PRECEDING)""",
    "exam_group": "SELECT g.SemesterKey, FacultyKey, GroupName, {sums} FROM grades g JOIN students s ON s.StudentKey = g.StudentKey GROUP BY ALL",
    "course_sem": """
SELECT SemesterKey, CourseKey, TeacherKey, {sums}, sum(GradePoints)::DOUBLE AS Points, sum(TotalScore)::DOUBLE AS Total,
  sum(FinalScore)::DOUBLE AS Final, sum(AttendanceScore)::DOUBLE AS Attendance FROM grades GROUP BY ALL""",
    "pay_fac": """
SELECT p.SemesterKey, FacultyKey, count(*) AS Invoices, sum(CASE WHEN RemainingDebt > 0 THEN 1 ELSE 0 END) AS WithDebt,
  sum(TuitionAmount) AS Tuition, sum(PaidAmount) AS Paid, sum(RemainingDebt) AS Debt
FROM payments p JOIN students s ON s.StudentKey = p.StudentKey GROUP BY ALL""",
    "interventions": """
SELECT event_id AS InterventionID, user_id AS StudentKey, event_type AS Status, date_trunc('second', ts) AS CreatedAt FROM events""",
}

MONEY = "Tuition::DOUBLE AS Tuition, Paid::DOUBLE AS Paid, Debt::DOUBLE AS Debt, Paid::DOUBLE / Tuition::DOUBLE AS CollectionRate"
AGG = """count(*) AS Students, sum(SemGPA * Credits)::DOUBLE / sum(Credits) AS AvgGPA,
  sum(AttendanceRate)::DOUBLE / nullif(count(AttendanceRate), 0) AS AttendanceRate, sum(FailedCourses)::DOUBLE / sum(CourseLoad) AS FailureRate,
  sum(SubmissionRate)::DOUBLE / nullif(count(SubmissionRate), 0) AS SubmissionRate, sum(IsAtRisk)::DOUBLE / count(*) AS AtRiskShare,
  sum(Retained)::DOUBLE / nullif(count(Retained), 0) AS Retention"""
FEATURES = ("SemGPA PrevGPA CumGPA GPATrend AttendanceRate FailedCourses CumFailedCourses AvgAssignmentScore SubmissionRate "
            "WarningsCum DebtRatio StudySemester Credits AvgTeacherLoad").split()
GROUPS = {"F_GPA": FEATURES[:4], "F_Attendance": ["AttendanceRate"], "F_Failed": ["FailedCourses", "CumFailedCourses"],
          "F_Assignments": ["AvgAssignmentScore", "SubmissionRate"], "F_Debt": ["DebtRatio"],
          "F_History": ["WarningsCum", "StudySemester", "Credits"], "F_TeacherLoad": ["AvgTeacherLoad"]}
WEIGHTS = [("SemGPA", "-0.1"), ("CumGPA", "-0.05"), ("PrevGPA", "-0.02"), ("GPATrend", "-0.03"), ("AttendanceRate", "-0.3"),
           ("FailedCourses", "0.06"), ("CumFailedCourses", "0.005"), ("AvgAssignmentScore", "-0.002"), ("SubmissionRate", "-0.05"),
           ("WarningsCum", "0.01"), ("DebtRatio", "0.08"), ("StudySemester", "0.004"), ("Credits", "-0.001"), ("AvgTeacherLoad", "0.0004")]


def risk_sql(value=lambda f: f) -> str:
    """The linear risk score over the given feature expressions."""
    out = "1.1::DOUBLE"
    for name, weight in WEIGHTS:
        out = f"({out} + {value(name)} * ({weight})::DOUBLE)"
    return f"least(greatest({out}, 0.0::DOUBLE), 1.0::DOUBLE)"


def level_sql(p: str) -> str:
    return f"CASE WHEN {p} < 0.25 THEN 'Past' WHEN {p} < 0.5 THEN 'O''rta' WHEN {p} < 0.75 THEN 'Yuqori' ELSE 'Kritik' END"


def _dbl(names):
    return ", ".join(f"{c}::DOUBLE AS {c}" for c in names)


CTE |= {"trend": ("snap", "pay_fac", "semesters"), "ftrend": ("snap", "pay_fac", "semesters", "faculties"),
        "chist": ("course_sem", "courses", "faculties"), "cpool": ("course_sem", "courses", "faculties"),
        "tsum": ("course_sem", "teachers", "faculties", "lines"), "feat": ("snap", "students"), "dataset": ("feat",),
        "base": ("dataset",), "risk": ("dataset", "base")}
_OTHERS = ["CourseLoad", "SemGPA", "CumGPA", "AttendanceRate", "FailedCourses", "CumFailedCourses", "AvgAssignmentScore",
           "SubmissionRate", "WarningsCum", "DebtRatio", "StudySemester", "Credits", "AvgTeacherLoad", "IsAtRisk", "IsLastSemester"]
_SHARES = ", ".join(
    "greatest(b - {}, 0.0::DOUBLE) AS c_{}".format(
        risk_sql(lambda f, cols=cols: f"m_{f}" if f in cols else f), g) for g, cols in GROUPS.items())
_TOTAL = "(" * 6 + "c_F_GPA" + "".join(f" + c_{g})" for g in list(GROUPS)[1:])
_LABELS = {"F_GPA": "GPA", "F_Attendance": "Davomat", "F_Failed": "Yiqilgan fanlar", "F_Assignments": "Topshiriqlar",
           "F_Debt": "Moliyaviy qarz", "F_History": "Akademik tarix", "F_TeacherLoad": "O''qituvchi yuklamasi"}
_FACTOR_LIST = "[" + ", ".join(f"{{'s': -{g}, 'i': {i}, 'n': '{n}'}}" for i, (g, n) in enumerate(_LABELS.items())) + "]"
SQL |= {
    "trend": f"""SELECT a.*, {MONEY}, SemesterLabel
FROM (SELECT SemesterKey, {AGG} FROM snap GROUP BY 1) a
LEFT JOIN (SELECT SemesterKey, sum(Tuition) AS Tuition, sum(Paid) AS Paid, sum(Debt) AS Debt FROM pay_fac GROUP BY 1) p
  ON p.SemesterKey = a.SemesterKey JOIN semesters s ON s.SemesterKey = a.SemesterKey""",
    "ftrend": f"""SELECT a.*, {MONEY}, SemesterLabel, FacultyName
FROM (SELECT SemesterKey, FacultyKey, {AGG} FROM snap GROUP BY 1, 2) a
LEFT JOIN pay_fac p ON p.SemesterKey = a.SemesterKey AND p.FacultyKey = a.FacultyKey
JOIN semesters s ON s.SemesterKey = a.SemesterKey JOIN faculties f ON f.FacultyKey = a.FacultyKey""",
    "feat": f"""SELECT *, SemGPA - PrevGPA AS GPATrend FROM (SELECT s.StudentKey, s.SemesterKey, s.FacultyKey, s.DepartmentKey, Status,
  {', '.join(f's.{c}::DOUBLE AS {c}' for c in _OTHERS)}, coalesce(s.PrevGPA::DOUBLE, s.SemGPA::DOUBLE) AS PrevGPA
FROM snap s JOIN students t ON t.StudentKey = s.StudentKey)""",
    "dataset": """SELECT *, NextFailed / NextLoad AS NextFailRate,
  CASE WHEN NextAtRisk IS NULL AND IsLastSemester = 1 AND Status = 'Chetlashtirilgan' THEN 1 ELSE 0 END AS Dropout,
  CASE WHEN NextAtRisk IS NULL AND IsLastSemester = 1 AND Status = 'Chetlashtirilgan' THEN 1 ELSE NextAtRisk END::INT AS Target,
  (NextAtRisk IS NOT NULL OR (IsLastSemester = 1 AND Status = 'Chetlashtirilgan')) AND SemesterKey < (SELECT max(SemesterKey) FROM feat) AS IsLabelled,
  SemesterKey = (SELECT max(SemesterKey) FROM feat) AND Status = 'Faol' AS ToScore
FROM (SELECT a.*, b.IsAtRisk AS NextAtRisk, b.SemGPA AS NextGPA, b.FailedCourses AS NextFailed, b.CourseLoad AS NextLoad
  FROM feat a LEFT JOIN feat b ON b.StudentKey = a.StudentKey AND b.SemesterKey = a.SemesterKey + 1)""",
    "base": "SELECT " + ", ".join(f"median({f}) AS m_{f}" for f in FEATURES) + " FROM dataset WHERE IsLabelled AND Target = 0",
    "risk": f"""SELECT StudentKey, SemesterKey, FacultyKey, DepartmentKey, RiskProbability, PredictedNextGPA, PredictedFailRate, DropoutProbability,
  {level_sql('RiskProbability')} AS RiskLevel, CASE WHEN RiskProbability >= 0.45 THEN 1 ELSE 0 END AS IsFlagged, {', '.join(GROUPS)},
  coalesce(nullif(array_to_string(list_transform(list_slice(list_sort(list_filter({_FACTOR_LIST}, lambda x: x.s <= -1)), 1, 4),
    lambda x: x.n || ' ' || round_even(-x.s, 0)::INT || '%'), ' · '), ''), 'Sezilarli omil yo''q') AS MainFactors,
  'linear' AS ModelName, TIMESTAMP '2002-01-01 00:00:00' AS ScoredAt
FROM (SELECT StudentKey, SemesterKey, FacultyKey, DepartmentKey, round_even(least(greatest(b, 0.01), 0.99), 4) AS RiskProbability,
  round_even(least(greatest(SemGPA * 0.6::DOUBLE + CumGPA * 0.4::DOUBLE, 2), 5), 4) AS PredictedNextGPA,
  round_even(least(greatest(FailedCourses * 0.15::DOUBLE, 0), 1), 4) AS PredictedFailRate, round_even(b * 0.1::DOUBLE, 4) AS DropoutProbability,
  {', '.join(f"coalesce(round_even(c_{g} / nullif({_TOTAL}, 0) * 100, 1), 0) AS {g}" for g in GROUPS)}
  FROM (SELECT *, {_SHARES} FROM (SELECT *, {risk_sql()} AS b FROM dataset, base WHERE ToScore)))""",
}

EXAM_SUMS = """count(*) AS N, sum(IsFailed) AS Failed, sum(CurrentScore)::DOUBLE AS CurrentSum, sum(MidtermScore)::DOUBLE AS MidtermSum,
  sum(CASE WHEN IsAdmitted = 1 THEN FinalScore ELSE 0 END)::DOUBLE AS FinalSum, sum(IsAdmitted) AS Admitted,
  sum(CASE WHEN MidtermScore < 18 THEN 1 ELSE 0 END) AS MidLow,
  sum(CASE WHEN IsAdmitted = 1 AND FinalScore < 30 THEN 1 ELSE 0 END) AS FinLow,
  sum(CASE WHEN MidtermScore >= 18 AND IsFailed = 1 THEN 1 ELSE 0 END) AS MidOkFailed,
  sum(CASE WHEN FinalGrade = '5' THEN 1 ELSE 0 END) AS N5, sum(CASE WHEN FinalGrade = '4' THEN 1 ELSE 0 END) AS N4,
  sum(CASE WHEN FinalGrade = '3' THEN 1 ELSE 0 END) AS N3"""
EXAM_COLS = "N Failed CurrentSum MidtermSum FinalSum Admitted MidLow FinLow MidOkFailed N5 N4 N3".split()
RESUM = ", ".join(f"sum({c}) AS {c}" for c in EXAM_COLS)
RATES = """CurrentSum / N AS Current, MidtermSum / N AS Midterm, FinalSum / nullif(Admitted, 0) AS FinalAdmitted,
  N - Admitted AS NotAdmitted, CurrentSum / N / 20 AS CurrentPct, MidtermSum / N / 30 AS MidtermPct,
  FinalSum / nullif(Admitted, 0) / 50 AS FinalPct, FinalSum / nullif(Admitted, 0) / 50 - MidtermSum / N / 30 AS ExamGap,
  1 - MidLow::DOUBLE / N AS MidtermPassRate, 1 - FinLow::DOUBLE / nullif(Admitted, 0) AS FinalPassRate,
  (N - Admitted)::DOUBLE / N AS NotAdmittedRate, Failed::DOUBLE / N AS FailureRate,
  MidOkFailed::DOUBLE / N AS LostAfterMidterm, N5::DOUBLE / N AS ExcellentRate"""
RATE_COLS = ("Current Midterm FinalAdmitted NotAdmitted CurrentPct MidtermPct FinalPct ExamGap MidtermPassRate FinalPassRate "
             "NotAdmittedRate FailureRate LostAfterMidterm ExcellentRate").split()


DIFFICULTY = ("CASE WHEN Failed::DOUBLE / N <= 0.1 THEN 'Yengil' WHEN Failed::DOUBLE / N <= 0.2 THEN 'O''rtacha' "
              "WHEN Failed::DOUBLE / N <= 0.3 THEN 'Qiyin' ELSE 'Juda qiyin' END")


def _course(keys, teachers):
    other = [c for c in EXAM_COLS if c != "N"]
    return f"""SELECT {', '.join('x.' + k for k in keys)}, N AS Enrollment, {', '.join(other)}, {RATES}, Points / N AS AvgGPA, Total / N AS AvgScore,
  Final / N AS Final, Attendance / N AS Attendance, Teachers, CourseName, CurriculumSemester, DepartmentName, c.FacultyKey, FacultyName,
  {DIFFICULTY} AS Difficulty
FROM (SELECT {', '.join(keys)}, {RESUM}, sum(Points) AS Points, sum(Total) AS Total, sum(Final) AS Final, sum(Attendance) AS Attendance,
  {teachers} AS Teachers FROM course_sem GROUP BY {', '.join(keys)}) x
JOIN courses c ON c.CourseKey = x.CourseKey JOIN faculties f ON f.FacultyKey = c.FacultyKey"""


SQL |= {
    "chist": _course(["CourseKey", "SemesterKey"], "count(*)"),
    "cpool": _course(["CourseKey"], "count(DISTINCT TeacherKey)"),
    "tsum": """SELECT x.*, x.Students > 60 AS Overloaded, TeacherName, DepartmentKey, DepartmentName, t.FacultyKey, FacultyName FROM (
  SELECT TeacherKey, sum(N) AS Students, count(DISTINCT CourseKey) AS Courses, sum(Points) / sum(N) AS AvgGPA,
    sum(Attendance) / sum(N) / 100 AS AttendanceRate, sum(Failed)::DOUBLE / sum(N) AS FailureRate
  FROM course_sem WHERE SemesterKey = {now} GROUP BY 1) x
JOIN teachers t ON t.TeacherKey = x.TeacherKey JOIN faculties f ON f.FacultyKey = t.FacultyKey""",
}
LATEST = "(SELECT max(SemesterKey) FROM lines)"


def query(body: str, *needs: str, extra: dict[str, str] | None = None,
          now: str = LATEST) -> str:
    """The body after the common table expressions it needs, each after those it builds on."""
    order: list[str] = []

    def add(name):
        for base in CTE[name]:
            add(base)
        if name not in order:
            order.append(name)

    for name in needs:
        add(name)
    parts = [f"{n} AS ({SQL[n].replace('{sums}', EXAM_SUMS).replace('{now}', now)})" for n in order]
    parts += [f"{n} AS ({b})" for n, b in (extra or {}).items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body.strip()
