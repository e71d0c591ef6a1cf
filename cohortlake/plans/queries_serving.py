"""Registered queries: data behind pages and tools, and the file and table sources."""

from pyspark.sql import functions as F

from cohortlake import settings as S
from cohortlake.functions.selection import exact_median, pick_ranks
from cohortlake.operators import exams, frames, serving as D, whatif as X
from cohortlake.plans import queries_metrics as M, queries_risk as Q
from cohortlake.plans.driver_tables import LIMITS
from cohortlake.plans.oracle_base import AGG, EXAM_COLS, GROUPS, LATEST, MONEY, RATES, RESUM, query
from cohortlake.plans.registry import ORACLES, register
from cohortlake.session import fresh_path
from cohortlake.sources import files as SF, tables as ST

HIGH = "RiskLevel IN ('Yuqori', 'Kritik')"


@register("risk_level_counts", query("""SELECT LevelNo, l AS RiskLevel, count(r.StudentKey) AS Students FROM (VALUES (0, 'Past'), (1, 'O''rta'), (2, 'Yuqori'), (3, 'Kritik')) v(LevelNo, l)
LEFT JOIN risk r ON r.RiskLevel = v.l GROUP BY 1, 2""", "risk"), gold=True)
def _(u):
    return D.risk_level_counts(u.risk)


@register("hardest_pooled_courses", query("SELECT * FROM cpool WHERE Enrollment >= 30 ORDER BY FailureRate DESC, CourseKey LIMIT 7", "cpool"), gold=True)
def _(u):
    return D.top_k(u.course_pooled, "FailureRate", "CourseKey", 7, "Enrollment", LIMITS.min_enrollment)


@register("hardest_groups_per_faculty", query(
    f"""SELECT * FROM (SELECT FacultyKey, GroupName, N, FailureRate, row_number() OVER (PARTITION BY FacultyKey ORDER BY FailureRate DESC, GroupName) AS Place
  FROM (SELECT *, {RATES} FROM (SELECT FacultyKey, GroupName, {RESUM} FROM exam_group WHERE SemesterKey = {LATEST} GROUP BY 1, 2)) WHERE N >= 20) WHERE Place <= 3""",
    "exam_group", "lines"), gold=True)
def _(u):
    rates = exams.exam_by(u.exam_group, "group", u.latest).select("FacultyKey", "GroupName", "N", "FailureRate")
    return D.top_k_per_group(rates, "FacultyKey", "FailureRate", "GroupName", 3, "N", LIMITS.min_group)


@register("widest_final_gap", query(
    f"SELECT CourseKey, N, ExamGap, -ExamGap AS Gap FROM (SELECT CourseKey, N, {RATES} FROM (SELECT CourseKey, {RESUM} FROM course_sem WHERE SemesterKey = {LATEST} GROUP BY 1)) "
    "WHERE N >= 30 ORDER BY ExamGap, CourseKey LIMIT 8", "course_sem", "lines"), gold=True)
def _(u):
    rates = exams.exam_by(u.course_sem, "course", u.latest).select("CourseKey", "N", "ExamGap")
    return D.bottom_k_gap(rates)


TABLE = {"tab": M.RISK_TABLE}
SHORT = "StudentKey, FullName, GroupName, FacultyName, RiskProbability, RiskLevel"


def short(df):
    return df.select(*SHORT.split(", "))


@register("risk_search_levels", query(f"SELECT {SHORT} FROM tab WHERE {HIGH} AND FacultyName IN ('ASIA', 'EUROPE') ORDER BY RiskProbability DESC, StudentKey LIMIT 500",
                                      *M.RISK_NEEDS, extra=TABLE), gold=True)
def _(u):
    return short(D.risk_search(M.risk_rows(u), S.HIGH_RISK, ["ASIA", "EUROPE"]))


@register("risk_search_text", query(f"SELECT {SHORT} FROM tab WHERE contains(lower(FullName), 'build') OR contains(lower(GroupName), 'build') OR StudentKey::VARCHAR = 'build' "
                                    "ORDER BY RiskProbability DESC, StudentKey LIMIT 500", *M.RISK_NEEDS, extra=TABLE), gold=True)
def _(u):
    return short(D.risk_search(M.risk_rows(u), text=" BUILD "))


@register("untouched_students", query(f"SELECT {SHORT} FROM tab WHERE StudentKey NOT IN (SELECT StudentKey FROM interventions)", *M.RISK_NEEDS, "interventions", extra=TABLE), gold=True)
def _(u):
    return short(D.untouched_only(M.risk_rows(u), u.interventions))


@register("high_share_by_faculty", query(f"SELECT FacultyKey, FacultyName, sum(({HIGH})::INT)::DOUBLE / count(*) AS HighShare FROM tab GROUP BY 1, 2", *M.RISK_NEEDS, extra=TABLE), gold=True)
def _(u):
    return D.high_share_by_faculty(M.risk_rows(u))


@register("finance_summary", query(f"""SELECT FacultyKey, FacultyName, {MONEY} FROM (
  SELECT p.FacultyKey, FacultyName, sum(Tuition) AS Tuition, sum(Paid) AS Paid, sum(Debt) AS Debt FROM pay_fac p JOIN faculties f ON f.FacultyKey = p.FacultyKey
  WHERE SemesterKey = {LATEST} GROUP BY 1, 2 UNION ALL SELECT NULL, NULL, sum(Tuition), sum(Paid), sum(Debt) FROM pay_fac WHERE SemesterKey = {LATEST})""",
                                   "pay_fac", "faculties", "lines"), gold=True)
def _(u):
    return D.finance_summary(u.payments_faculty, u.faculties, u.latest)


@register("teacher_load_stats", query("""SELECT count(*) AS Teachers, sum(Overloaded::INT) AS Overloaded, median(Students) AS MedianLoad,
  round(corr(Students, AvgGPA), 9) AS LoadGPACorrelation FROM tsum""", "tsum"), gold=True)
def _(u):
    return D.teacher_load_stats(u.teacher_summary(u.latest)).withColumn("LoadGPACorrelation", F.round("LoadGPACorrelation", 9))


@register("intervention_history", query("SELECT * FROM interventions WHERE StudentKey = 7", "interventions"))
def _(u):
    return D.intervention_history(u.interventions, 7)


@register("latest_intervention", query("""SELECT StudentKey, Status, Records FROM (SELECT *, row_number() OVER (PARTITION BY StudentKey ORDER BY CreatedAt DESC, InterventionID DESC) AS r,
  count(*) OVER (PARTITION BY StudentKey) AS Records FROM interventions) WHERE r = 1""", "interventions"))
def _(u):
    return D.latest_intervention(u.interventions)


@register("find_entity", query("SELECT * FROM departments WHERE contains(lower(DepartmentName), 'nation_1') ORDER BY DepartmentKey LIMIT 1", "departments"))
def _(u):
    return D.find_entity(u.departments, "DepartmentKey", "DepartmentName", "Nation_1")


@register("scope_rows", query(f"SELECT SemesterKey, {AGG} FROM snap WHERE FacultyKey = 3 GROUP BY 1", "snap"), gold=True)
def _(u):
    from cohortlake.operators.performance import aggregate
    own = D.scope_rows(u.snap_retained, "dean", own_faculty=3, student_level=True)
    return aggregate(own, u.payments_faculty, ["SemesterKey"]).drop("Tuition", "Paid", "Debt", "CollectionRate")


SHARES = f"SELECT Factor, MeanShare FROM (UNPIVOT (SELECT {', '.join(f'sum({g}::DECIMAL(6,1))::DOUBLE / count(*) AS {g}' for g in GROUPS)} FROM risk WHERE {HIGH}) ON {', '.join(GROUPS)} INTO NAME Factor VALUE MeanShare)"


@register("factor_shares", query(SHARES, "risk"), gold=True)
def _(u):
    return D.factor_shares(u.risk)


@register("example_case", query("SELECT StudentKey, RiskProbability, F_GPA FROM risk WHERE RiskProbability >= 0.5 ORDER BY F_GPA, StudentKey LIMIT 1", "risk"), gold=True)
def _(u):
    return D.example_case(u.risk, 0.5).select("StudentKey", "RiskProbability", "F_GPA")


@register("row_counts", query("""SELECT 'DimStudent' AS TableName, count(*) AS Rows, false AS IsFact FROM students UNION ALL SELECT 'FactGrades', count(*), true FROM grades
UNION ALL SELECT 'FactPayments', count(*), true FROM payments UNION ALL SELECT 'FactStudentSemester', count(*), true FROM snap""", "students", "grades", "payments", "snap"), gold=True)
def _(u):
    return D.row_counts({"DimStudent": u.students, "FactGrades": u.scored_lines, "FactPayments": u.payments, "FactStudentSemester": u.snap})


WARNED = 15


def profile(u, student=17):
    return D.student_profile(student, u.students, u.faculties, u.departments, u.snap, u.semesters, u.grades, u.courses, u.teachers, u.warnings, u.risk)


GRADES_OF = """SELECT SemesterLabel, CourseName, TeacherName, CurrentScore, MidtermScore, FinalScore, TotalScore, FinalGrade, AttendanceScore,
  CASE WHEN IsAdmitted = 1 THEN 'Ha' ELSE 'Yo''q' END AS Admitted, g.SemesterKey FROM grades g JOIN courses c ON c.CourseKey = g.CourseKey JOIN teachers t ON t.TeacherKey = g.TeacherKey
JOIN semesters s ON s.SemesterKey = g.SemesterKey WHERE StudentKey = 17"""
GRADE_NEEDS = ("grades", "courses", "teachers", "semesters")


@register("profile_info", query("SELECT s.*, FacultyName, DepartmentName FROM students s JOIN faculties f ON f.FacultyKey = s.FacultyKey JOIN departments d ON d.DepartmentKey = s.DepartmentKey "
                                "WHERE StudentKey = 17", "students", "faculties", "departments"), gold=True)
def _(u):
    return profile(u)["info"]


@register("profile_history", query(f"SELECT {M._plain(M.SNAP_COLS)}, SemesterLabel FROM snap JOIN (SELECT SemesterKey AS k, SemesterLabel FROM semesters) ON k = SemesterKey WHERE StudentKey = 17",
                                   "snap", "semesters"), gold=True)
def _(u):
    return M._doubles(profile(u)["history"])


@register("profile_grades", query(GRADES_OF, *GRADE_NEEDS), gold=True)
def _(u):
    return profile(u)["grades"]


@register("profile_latest_grades", query("SELECT * EXCLUDE (SemesterKey) FROM g17 WHERE SemesterKey = (SELECT max(SemesterKey) FROM g17)", *GRADE_NEEDS, extra={"g17": GRADES_OF}), gold=True)
def _(u):
    return D.latest_grades(profile(u)["grades"])


@register("profile_warnings", query(f"SELECT WarningDate, WarningType, Severity FROM warnings WHERE StudentKey = {WARNED}", "warnings"), gold=True)
def _(u):
    return profile(u, WARNED)["warnings"]


@register("overview_trend", query("SELECT SemesterLabel, Students, round_even(AvgGPA, 3) AS AvgGPA, round_even(AttendanceRate, 3) AS AttendanceRate, round_even(FailureRate, 3) AS FailureRate FROM trend", "trend"), gold=True)
def _(u):
    return D.round_records(u.trend.select("SemesterLabel", "Students", "AvgGPA", "AttendanceRate", "FailureRate"))


def report(u):
    return D.faculty_report(2, u.faculty_trend, u.course_pooled, M.risk_rows(u), LIMITS)


@register("faculty_report_trend", query("SELECT * FROM ftrend WHERE FacultyKey = 2", "ftrend"), gold=True)
def _(u):
    return report(u)["trend"]


@register("faculty_report_courses", query("SELECT * FROM cpool WHERE FacultyKey = 2 AND Enrollment >= 30 ORDER BY FailureRate DESC, CourseKey LIMIT 8", "cpool"), gold=True)
def _(u):
    return report(u)["hardest_courses"]


@register("faculty_report_study_years", query(f"SELECT StudyYear, count(*) AS Students, sum(({HIGH})::INT)::DOUBLE / count(*) AS HighRiskShare FROM tab WHERE FacultyKey = 2 GROUP BY 1",
                                              *M.RISK_NEEDS, extra=TABLE), gold=True)
def _(u):
    return report(u)["risk_by_study_year"]


@register("top_risk_students", query(f"SELECT {SHORT} FROM tab ORDER BY RiskProbability DESC, StudentKey LIMIT 20", *M.RISK_NEEDS, extra=TABLE), gold=True)
def _(u):
    return short(D.top_risk(M.risk_rows(u)))


@register("find_students", query("SELECT StudentKey, FullName, FacultyKey, StudyYear, Status FROM students WHERE contains(lower(FullName), '0012') ORDER BY StudentKey LIMIT 200", "students"))
def _(u):
    return D.find_students(u.students, "0012", 200)


@register("course_report_history", query("SELECT c.*, SemesterLabel FROM chist c JOIN (SELECT SemesterKey AS k, SemesterLabel FROM semesters) ON k = SemesterKey WHERE contains(lower(CourseName), 'brand#2')",
                                         "chist", "semesters"), gold=True)
def _(u):
    return D.course_history(u.course_history, u.semesters, "BRAND#2")


@register("course_report_hardest", query(f"SELECT * FROM chist WHERE SemesterKey = {LATEST} AND Enrollment >= 30 ORDER BY FailureRate DESC, CourseKey LIMIT 10", "chist", "lines"), gold=True)
def _(u):
    return D.hardest_courses(u.course_summary(u.latest), 10, LIMITS)


@register("exam_report_teachers", query(f"SELECT * FROM (SELECT TeacherKey, {', '.join(EXAM_COLS)}, {RATES} FROM (SELECT TeacherKey, {RESUM} FROM course_sem GROUP BY 1)) WHERE N >= 30 "
                                        "ORDER BY FailureRate DESC, TeacherKey LIMIT 60", "course_sem"), gold=True)
def _(u):
    return D.exam_report(exams.exam_by(u.course_sem, "teacher"), "teacher", "TeacherKey", 60, LIMITS)


@register("prediction_report_flagged", query("SELECT count(*) AS Scored, sum(IsFlagged) AS Flagged FROM risk", "risk"), gold=True)
def _(u):
    return D.prediction_report(u.risk, Q.E.compare_models(Q.scored_models(u)))["flagged"]


@register("capped_query", query("SELECT * FROM (SELECT FacultyKey, count(*) AS Students FROM students GROUP BY 1), (SELECT false AS truncated)", "students"))
def _(u):
    return D.capped_query(u.spark, {"published_students": u.students}, "SELECT FacultyKey, count(*) AS Students FROM published_students GROUP BY FacultyKey", 200)


@register("round_records", query("SELECT StudentKey, round_even(TotalDebt, 1) AS TotalDebt FROM (SELECT StudentKey, sum(RemainingDebt)::DOUBLE AS TotalDebt FROM payments GROUP BY 1)", "payments"))
def _(u):
    return D.round_records(frames.student_debt(u.payments).select("StudentKey", "TotalDebt"), 1)


@register("data_version", query("SELECT max(user_id)::VARCHAR || '-2002-01-01 00:00:00' AS Version FROM (SELECT user_id, arg_max(event_type, ts) AS e FROM events GROUP BY 1) WHERE e = 'purchase'"), gold=True)
def _(u):
    from cohortlake.operators.cleaning import run_log
    from cohortlake.plans.queries_load import run_events
    return frames.data_version(run_log(run_events(u)), u.risk)


# ------------------------------------------------------------- parts of reports
@register("faculty_report_factors", query(SHARES.replace("FROM risk", "FROM (SELECT * FROM risk WHERE FacultyKey = 2)"), "risk"), gold=True)
def _(u):
    return report(u)["factor_shares"]


@register("profile_risk", query("SELECT * EXCLUDE (ScoredAt) FROM risk WHERE StudentKey = 17", "risk"), gold=True)
def _(u):
    return profile(u)["risk"].drop("ScoredAt")


@register("prediction_report_levels", ORACLES["risk_level_counts"], gold=True)
def _(u):
    return D.prediction_report(u.risk, Q.E.compare_models(Q.scored_models(u)))["levels"]


@register("prediction_report_factors", ORACLES["factor_shares"], gold=True)
def _(u):
    return D.prediction_report(u.risk, Q.E.compare_models(Q.scored_models(u)))["factor_shares"]


@register("prediction_report_model", f"SELECT * FROM ({ORACLES['compare_models']}) WHERE IsBest = 1 AND Split = 'test' AND Rule = 'recall target'", gold=True)
def _(u):
    return D.prediction_report(u.risk, Q.E.compare_models(Q.scored_models(u)))["model"].withColumn("ROC_AUC", F.round("ROC_AUC", 9))


@register("all_scenarios", " UNION ALL ".join(f"SELECT '{n}' AS Name, * FROM ({ORACLES['scenario_' + n]})" for n in S.SCENARIOS), gold=True)
def _(u):
    return Q._rounded(X.all_scenarios(Q.population(u), Q.linear_scorer, Q.EFFECTS, Q.THRESHOLD))


# ------------------------------------------------------------------ raw profile
@register("profile_totals", query("""SELECT sum(GradePoints)::DOUBLE / count(*) AS AvgGPA, sum(TotalScore)::DOUBLE / count(*) AS AvgTotal, sum(AttendanceScore)::DOUBLE / count(*) AS Attendance,
  sum(IsFailed)::DOUBLE / count(*) AS FailureRate, sum(1 - IsAdmitted)::DOUBLE / count(*) AS NotAdmitted, sum(CurrentScore)::DOUBLE / count(*) AS Current,
  sum(MidtermScore)::DOUBLE / count(*) AS Midterm, sum(CASE WHEN IsAdmitted = 1 THEN FinalScore END)::DOUBLE / sum(IsAdmitted) AS FinalAdmitted FROM grades""", "grades"))
def _(u):
    return D.profile_totals(u.scored_lines)


def _pivot_sql():
    cells = []
    for k in range(5):
        w = f"CASE WHEN FacultyKey = {k} THEN "
        cells += [f'round(sum({w}GradePoints END)::DOUBLE / sum({w}1 END), 3) AS "{k}_gpa"', f'round(sum({w}AttendanceScore END)::DOUBLE / sum({w}1 END), 3) AS "{k}_att"',
                  f'round(sum({w}IsFailed END)::DOUBLE / sum({w}1 END), 3) AS "{k}_fail"']
    return query(f"SELECT SemesterKey // 2 AS Year, {', '.join(cells)} FROM grades g JOIN students s ON s.StudentKey = g.StudentKey GROUP BY 1", "grades", "students")


@register("profile_pivot", _pivot_sql())
def _(u):
    return D.profile_pivot(u.scored_lines, u.students, [r[0] for r in u.faculties.select("FacultyKey").orderBy("FacultyKey").collect()])


@register("profile_teacher_load", query("""SELECT count(*) AS Count, sum(c)::DOUBLE / count(*) AS Mean, min(c) AS Min, quantile_cont(c, 0.25) AS Q1, median(c) AS Median,
  quantile_cont(c, 0.75) AS Q3, max(c) AS Max FROM (SELECT SemesterKey, l_suppkey, count(*) AS c FROM lines GROUP BY 1, 2)""", "lines"))
def _(u):
    return D.profile_teacher_load(u.enrollments)


@register("profile_cohorts", query("""SELECT EnrollmentYear, sum((Status = 'Faol')::INT) AS Faol, sum((Status = 'Chetlashtirilgan')::INT) AS Chetlashtirilgan,
  sum((Status = 'Bitirgan')::INT) AS Bitirgan FROM students GROUP BY 1""", "students"))
def _(u):
    return D.profile_cohorts(u.students)


@register("exact_median", query("SELECT l_returnflag, round(median(l_extendedprice), 6) AS median FROM lineitem GROUP BY 1"))
def _(u):
    return exact_median(u.table("lineitem"), "l_extendedprice", ["l_returnflag"]).withColumn("median", F.round("median", 6))


@register("order_statistic", query("SELECT n, (SELECT o_totalprice FROM (SELECT o_totalprice, row_number() OVER (ORDER BY o_totalprice) AS r FROM orders) WHERE r = n - n // 10) AS cut FROM (SELECT count(*) AS n FROM orders)"))
def _(u):
    return pick_ranks(u.table("orders"), "o_totalprice", lambda n: {"cut": n - F.floor(n / 10)})


# --------------------------------------------------------------------- sources

@register("read_text_csv", query("SELECT c_custkey::VARCHAR AS c_custkey, c_name, CASE WHEN c_custkey % 10 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer"))
def _(u):
    path = fresh_path(u.spark, "csv")
    rows = u.table("customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 10 == 0, "N/A").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    SF.export_csv(rows, path)
    return SF.read_text_csv(u.spark, path, rows.columns, origin=False)


@register("read_text_json", query("SELECT s_suppkey::VARCHAR AS s_suppkey, s_name, CASE WHEN s_suppkey % 4 <> 0 THEN s_nationkey::VARCHAR END AS s_nationkey FROM supplier"))
def _(u):
    path = fresh_path(u.spark, "json")
    u.table("supplier").select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 4 != 0, F.col("s_nationkey")).alias("s_nationkey")).write.json(path)
    return SF.read_text_json(u.spark, path, ["s_suppkey", "s_name", "s_nationkey"], origin=False, array=False)


@register("discover_files")
def _(u):
    return SF.discover(u.spark, u.folder, suffixes=("parquet",)).select("FileName", "length")


@register("changed_files")
def _(u):
    manifest = SF.file_hashes(u.spark, u.folder, "*.parquet")
    seen = manifest.where(F.col("FileName") != "orders.parquet").unionByName(
        manifest.where(F.col("FileName") == "orders.parquet").withColumn("FileHash", F.lit("old")))
    return SF.changed_files(manifest, seen).select("FileName", "FileHash")


NAMED = """(SELECT page_id, ['grades', 'grades_', 'gradesheet_', 'payments_'][page_id % 4 + 1] || CASE WHEN page_id % 4 > 0 THEN page_id::VARCHAR ELSE '' END
  || ['.csv', '.json', '.txt'][page_id % 3 + 1] AS FileName FROM pages)"""


@register("file_name_rule", query(rf"SELECT page_id, FileName FROM {NAMED} WHERE regexp_matches(FileName, '^grades(_.*)?[.](csv|json)$')"))
def _(u):
    stems = F.array(*[F.lit(x) for x in ("grades", "grades_", "gradesheet_", "payments_")])
    ends = F.array(*[F.lit(x) for x in (".csv", ".json", ".txt")])
    number = F.when(F.col("page_id") % 4 > 0, F.col("page_id").cast("string")).otherwise("")
    name = F.concat(stems[(F.col("page_id") % 4).cast("int")], number, ends[(F.col("page_id") % 3).cast("int")])
    return SF.named(u.table("pages").select("page_id", name.alias("FileName")), "grades").select("page_id", "FileName")


@register("changed_manifest", query("""SELECT url || '#' || page_id AS FileName, md5(html) AS FileHash FROM pages WHERE page_id % 5 = 0 OR page_id % 7 = 0"""))
def _(u):
    """Pages as files: the log has an older content for every fifth and has never seen every seventh."""
    manifest = u.table("pages").select("page_id", F.concat("url", F.lit("#"), F.col("page_id").cast("string")).alias("FileName"), F.md5(F.col("html").cast("binary")).alias("FileHash"))
    seen = manifest.where("page_id % 7 != 0").withColumn("FileHash", F.when(F.col("page_id") % 5 == 0, "older").otherwise(F.col("FileHash")))
    return SF.changed_files(manifest.drop("page_id"), seen)


@register("union_batches", query("SELECT o_orderkey::VARCHAR AS k, o_custkey::VARCHAR AS customer, o_orderstatus AS status FROM orders"))
def _(u):
    path = fresh_path(u.spark, "batches")
    rows = u.table("orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("status"))
    SF.export_csv(rows, f"{path}/first")
    SF.export_csv(rows.where("k % 3 = 0").withColumn("status", F.lit("later")), f"{path}/second")      # a second batch repeats some keys
    return SF.union_batches(u.spark, [f"{path}/first", f"{path}/second"], ["k", "customer", "status"], "k")


@register("write_stage", query("SELECT c_name, c_custkey FROM customer"))
def _(u):
    path = fresh_path(u.spark, "stage")
    ST.write_stage(u.table("customer"), path, ["c_name", "c_custkey"])
    return u.spark.read.parquet(path)


@register("replace_table", query("SELECT * EXCLUDE (o_totalprice), round(o_totalprice * 2, 2) AS o_totalprice, 2 AS version FROM orders"))
def _(u):
    """All rows are written, and then written again with other prices."""
    path, orders = fresh_path(u.spark, "table"), u.table("orders")
    ST.replace_table(orders, path)
    version = ST.replace_table(ST.read_table(u.spark, path).withColumn("o_totalprice", F.round(F.col("o_totalprice") * 2, 2)), path)
    return ST.read_table(u.spark, path).withColumn("version", F.lit(version))


def snapshot_export(u):
    path = fresh_path(u.spark, "export")
    ST.export_snapshot({"students": u.students, "debt": frames.student_debt(u.payments)}, path, "1", {"latest": u.latest}, "2002-01-01 00:00")
    return path


@register("export_snapshot", query("SELECT 'students' AS Frame, count(*) AS Rows FROM students UNION ALL SELECT 'debt', count(DISTINCT StudentKey) FROM payments", "students", "payments"))
def _(u):
    manifest = u.spark.read.schema(ST.MANIFEST).json(f"{snapshot_export(u)}/manifest")
    return manifest.select(F.explode("rows").alias("Frame", "Rows"))


@register("load_snapshot", query(f"SELECT s.StudentKey, FullName, TotalDebt, {LATEST} AS latest FROM students s JOIN (SELECT StudentKey, sum(RemainingDebt)::DOUBLE AS TotalDebt FROM payments GROUP BY 1) p "
                                 "ON p.StudentKey = s.StudentKey", "students", "payments", "lines"))
def _(u):
    loaded, scalars = ST.load_snapshot(u.spark, snapshot_export(u))
    return loaded["students"].join(loaded["debt"], "StudentKey").select("StudentKey", "FullName", "TotalDebt", F.lit(scalars["latest"]).alias("latest"))


@register("for_entity", query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 17"))
def _(u):
    return ST.for_entity(u.table("orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", 17)


@register("backup_restore_log", query("SELECT InterventionID, StudentKey, Status FROM interventions", "interventions"))
def _(u):
    backup, table = fresh_path(u.spark, "backup"), fresh_path(u.spark, "log")
    ST.backup_log(u.interventions, backup)
    ST.restore_log(u.spark, backup, table)
    return ST.read_table(u.spark, table).select("InterventionID", "StudentKey", "Status")


@register("export_csv", query("SELECT n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation"))
def _(u):
    path = fresh_path(u.spark, "download")
    SF.export_csv(u.table("nation").select("n_name", "n_regionkey"), path)
    return u.spark.read.option("header", True).csv(path)


@register("table_or_empty", query("SELECT c_custkey, CAST(NULL AS VARCHAR) AS Model FROM customer"))
def _(u):
    missing = ST.table_or_empty(u.spark, fresh_path(u.spark, "missing"), "c_custkey long, Model string")
    return u.table("customer").select("c_custkey").join(missing, "c_custkey", "left")
