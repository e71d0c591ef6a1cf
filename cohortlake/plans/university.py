"""The whole refresh: delivered files to warehouse, snapshot, checks and logs. Running it again on the
same files changes nothing."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlake import settings as S
from cohortlake.operators import assertions as V, cleaning as C, dimensions as D, facts as FT, snapshot as N, upsert as U
from cohortlake.operators.cleaning import TableSpec
from cohortlake.session import written
from cohortlake.sources import files as SF, tables as ST

TOP, HUNDRED = S.SCORE_MAX, (0, 100)

# --- fixed values: what each delivered table must look like, parents first
SPECS = (
    TableSpec("faculties", "FacultyID", ("FacultyID", "FacultyName", "Dean", "EstablishedYear"),
              ints=("FacultyID", "EstablishedYear"), required=("FacultyID", "FacultyName")),
    TableSpec("departments", "DepartmentID", ("DepartmentID", "DepartmentName", "FacultyID"),
              ints=("DepartmentID", "FacultyID"), required=("DepartmentID", "DepartmentName", "FacultyID"),
              foreign={"FacultyID": "faculties"}),
    TableSpec("teachers", "TeacherID",
              ("TeacherID", "TeacherName", "DepartmentID", "ExperienceYears", "AcademicDegree", "EmploymentType"),
              cats={"AcademicDegree": S.DEGREES, "EmploymentType": S.EMPLOYMENT},
              ints=("TeacherID", "DepartmentID", "ExperienceYears"), required=("TeacherID", "TeacherName", "DepartmentID"),
              foreign={"DepartmentID": "departments"}),
    TableSpec("courses", "CourseID", ("CourseID", "CourseName", "DepartmentID", "Credits", "Semester", "CourseType"),
              cats={"CourseType": S.COURSE_TYPE}, ints=("CourseID", "DepartmentID", "Credits", "Semester"),
              required=("CourseID", "CourseName", "DepartmentID", "Credits", "Semester"),
              ranges={"Semester": (1, 8), "Credits": (1, 12)}, foreign={"DepartmentID": "departments"}),
    TableSpec("students", "StudentID",
              ("StudentID", "FirstName", "LastName", "GroupName", "Gender", "DateOfBirth", "FacultyID", "DepartmentID",
               "EnrollmentYear", "StudyYear", "ScholarshipStatus", "TuitionStatus", "Status", "StatusDate"),
              names=("FirstName", "LastName"),
              cats={"Gender": S.GENDER, "ScholarshipStatus": S.SCHOLARSHIP, "TuitionStatus": S.TUITION_STATUS,
                    "Status": S.STUDENT_STATUS},
              ints=("StudentID", "FacultyID", "DepartmentID", "EnrollmentYear", "StudyYear"),
              dates=("DateOfBirth", "StatusDate"), defaults={"Gender": S.GENDER_UNKNOWN},
              required=("StudentID", "FirstName", "LastName", "GroupName", "FacultyID", "DepartmentID",
                        "EnrollmentYear", "StudyYear", "Status"),
              ranges={"StudyYear": (1, 4)}, foreign={"FacultyID": "faculties", "DepartmentID": "departments"}),
    TableSpec("enrollments", "EnrollmentID",
              ("EnrollmentID", "StudentID", "CourseID", "TeacherID", "Semester", "AcademicYear"),
              cats={"Semester": S.SEASONS}, ints=("EnrollmentID", "StudentID", "CourseID", "TeacherID"),
              required=("EnrollmentID", "StudentID", "CourseID", "TeacherID", "Semester", "AcademicYear"),
              foreign={"StudentID": "students", "CourseID": "courses", "TeacherID": "teachers"}),
    TableSpec("grades", "GradeID",
              ("GradeID", "StudentID", "CourseID", "CurrentScore", "MidtermScore", "FinalScore", "AttendanceScore",
               "ExamAdmitted", "FinalGrade", "GPA"),
              cats={"FinalGrade": tuple(g[1] for g in S.GRADE_SCALE), "ExamAdmitted": S.YES_NO},
              ints=("GradeID", "StudentID", "CourseID"),
              floats=("CurrentScore", "MidtermScore", "FinalScore", "AttendanceScore", "GPA"),
              impute={"MidtermScore": "CourseID"},
              required=("GradeID", "StudentID", "CourseID", "CurrentScore", "MidtermScore", "FinalScore",
                        "AttendanceScore", "ExamAdmitted", "FinalGrade", "GPA"),
              outliers=("MidtermScore", "FinalScore"),
              ranges={"CurrentScore": (0, TOP["current"]), "MidtermScore": (0, TOP["midterm"]),
                      "FinalScore": (0, TOP["final"]), "AttendanceScore": HUNDRED, "GPA": (2, 5)},
              foreign={"StudentID": "students", "CourseID": "courses"}),
    TableSpec("attendance", "AttendanceID", ("AttendanceID", "StudentID", "CourseID", "Date", "Status"),
              cats={"Status": S.ATTENDANCE}, ints=("AttendanceID", "StudentID", "CourseID"), dates=("Date",),
              required=("AttendanceID", "StudentID", "CourseID", "Date", "Status"), date_ranges={"Date": S.FACT_DATES},
              foreign={"StudentID": "students", "CourseID": "courses"}),
    TableSpec("payments", "PaymentID",
              ("PaymentID", "StudentID", "TuitionAmount", "PaidAmount", "RemainingDebt", "PaymentDate", "PaymentStatus"),
              cats={"PaymentStatus": S.PAYMENT_STATUS}, ints=("PaymentID", "StudentID"),
              floats=("TuitionAmount", "PaidAmount", "RemainingDebt"), dates=("PaymentDate",),
              required=("PaymentID", "StudentID", "TuitionAmount", "PaidAmount", "PaymentDate"), outliers=("PaidAmount",),
              ranges={"TuitionAmount": (1, 1e9), "PaidAmount": (0, 1e9)}, date_ranges={"PaymentDate": S.FACT_DATES},
              foreign={"StudentID": "students"}, payment_rules=True),
    TableSpec("assignments", "AssignmentID",
              ("AssignmentID", "StudentID", "CourseID", "SubmissionDate", "Score", "SubmissionStatus", "DueDate"),
              cats={"SubmissionStatus": S.SUBMISSION}, ints=("AssignmentID", "StudentID", "CourseID"), floats=("Score",),
              dates=("SubmissionDate", "DueDate"),
              required=("AssignmentID", "StudentID", "CourseID", "Score", "SubmissionStatus", "DueDate"),
              outliers=("Score",), ranges={"Score": HUNDRED}, date_ranges={"DueDate": S.FACT_DATES},
              foreign={"StudentID": "students", "CourseID": "courses"}),
    TableSpec("academic_warnings", "WarningID", ("WarningID", "StudentID", "WarningType", "WarningDate", "Severity"),
              cats={"WarningType": S.WARNING_TYPES, "Severity": S.SEVERITY}, ints=("WarningID", "StudentID"),
              dates=("WarningDate",), required=("WarningID", "StudentID", "WarningType", "WarningDate", "Severity"),
              date_ranges={"WarningDate": S.FACT_DATES}, foreign={"StudentID": "students"}),
)

# warehouse tables: name -> (schema, key, columns compared to detect a change)
TABLES = {
    "DimFaculty": ("FacultyKey long, FacultyName string, Dean string, EstablishedYear long", "FacultyKey", None),
    "DimDepartment": ("DepartmentKey long, DepartmentName string, FacultyKey long", "DepartmentKey", None),
    "DimTeacher": ("TeacherKey long, TeacherName string, DepartmentKey long, ExperienceYears long, AcademicDegree string, "
                   "EmploymentType string", "TeacherKey", None),
    "DimCourse": ("CourseKey long, CourseName string, DepartmentKey long, Credits long, CurriculumSemester long, "
                  "CourseType string", "CourseKey", None),
    "DimStudent": ("StudentKey long, FirstName string, LastName string, FullName string, GroupName string, Gender string, "
                   "DateOfBirth date, FacultyKey long, DepartmentKey long, EnrollmentYear long, StudyYear long, "
                   "ScholarshipStatus string, TuitionStatus string, Status string, StatusDate date", "StudentKey", None),
    "FactEnrollments": ("EnrollmentID long, StudentKey long, CourseKey long, TeacherKey long, SemesterKey int", "EnrollmentID", None),
    "FactGrades": ("GradeID long, StudentKey long, CourseKey long, TeacherKey long, SemesterKey int, CurrentScore decimal(5,1), "
                   "MidtermScore decimal(5,1), FinalScore decimal(5,1), AttendanceScore decimal(5,1), TotalScore decimal(5,1), "
                   "IsAdmitted boolean, FinalGrade string, GradePoints decimal(3,1), Credits long, IsFailed boolean, "
                   "IsMidtermImputed boolean", "GradeID",
                   ["StudentKey", "CourseKey", "TeacherKey", "SemesterKey", "CurrentScore", "MidtermScore", "FinalScore",
                    "AttendanceScore", "IsAdmitted", "FinalGrade", "GradePoints", "Credits", "IsMidtermImputed"]),
    "FactAttendance": ("AttendanceID long, StudentKey long, CourseKey long, DateKey int, SemesterKey int, Status string, "
                       "IsPresent boolean", "AttendanceID", ["StudentKey", "CourseKey", "DateKey", "Status"]),
    "FactPayments": ("PaymentID long, StudentKey long, DateKey int, SemesterKey int, TuitionAmount decimal(14,2), "
                     "PaidAmount decimal(14,2), RemainingDebt decimal(14,2), PaymentStatus string", "PaymentID",
                     ["StudentKey", "DateKey", "TuitionAmount", "PaidAmount", "RemainingDebt", "PaymentStatus"]),
    "FactAssignments": ("AssignmentID long, StudentKey long, CourseKey long, SemesterKey int, DueDateKey int, "
                        "SubmissionDateKey int, Score decimal(5,1), SubmissionStatus string, IsSubmitted boolean, IsLate boolean",
                        "AssignmentID", ["StudentKey", "CourseKey", "SemesterKey", "DueDateKey", "SubmissionDateKey", "Score",
                                         "SubmissionStatus"]),
    "FactWarnings": ("WarningID long, StudentKey long, DateKey int, SemesterKey int, WarningType string, Severity string",
                     "WarningID", ["StudentKey", "DateKey", "WarningType", "Severity"]),
}
CONTROL = {
    "FileLog": "FileName string, TableName string, FileHash string, RowsRead long, RowsLoaded long, RowsRejected long, RunID int",
    "DataQualityLog": "FileName string, TableName string, CheckName string, Action string, IssueCount long, RunID int",
    "RejectedRecords": "RunID int, FileName string, TableName string, Reason string, RawRecord string",
    "LoadAudit": "RunID int, TableName string, RowsStaged long, RowsInserted long, RowsUpdated long, RowsOrphaned long",
    "RunEvents": "RunID int, At timestamp, Status string, Message string, FilesProcessed long, RowsRead long, RowsLoaded long, RowsRejected long",
}
PARENT_TABLE = {"faculties": "DimFaculty", "departments": "DimDepartment", "teachers": "DimTeacher",
                "courses": "DimCourse", "students": "DimStudent"}


def _rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(c).alias(names.get(c, c)) for c in df.columns])


KEYS = {"FacultyID": "FacultyKey", "DepartmentID": "DepartmentKey", "TeacherID": "TeacherKey", "CourseID": "CourseKey",
        "StudentID": "StudentKey", "Semester": "CurriculumSemester"}


class Refresh:
    """One run over a delivery folder into a warehouse folder."""

    def __init__(self, spark: SparkSession, delivered: str, warehouse: str):
        self.spark, self.delivered, self.root = spark, delivered.rstrip("/"), warehouse.rstrip("/")
        events = self.table("RunEvents").agg(F.max("RunID")).first()[0]
        self.run_id = (events or 0) + 1

    def table(self, name: str) -> DataFrame:
        schema = TABLES[name][0] if name in TABLES else CONTROL[name]
        if name in TABLES and name.startswith("Fact"):
            return ST.read_partitioned(self.spark, f"{self.root}/{name}", schema)
        return ST.table_or_empty(self.spark, f"{self.root}/{name}", schema)

    def append(self, name: str, rows: DataFrame) -> None:
        ST.replace_table(self.table(name).unionByName(rows.select(*self.table(name).columns)), f"{self.root}/{name}")

    def event(self, status: str, message: str, totals=None, run_id: int | None = None) -> None:
        row = self.spark.range(1).select(
            F.lit(run_id or self.run_id).alias("RunID"), F.current_timestamp().alias("At"), F.lit(status).alias("Status"),
            F.lit(message).alias("Message"), *[F.lit(totals[c] if totals else None).cast("long").alias(c) for c in (
                "FilesProcessed", "RowsRead", "RowsLoaded", "RowsRejected")])
        self.append("RunEvents", row)

    # ------------------------------------------------------------------ staging
    def read(self, spec: TableSpec, names: list[str]) -> DataFrame | None:
        parts = []
        for suffix, reader in (("csv", SF.read_text_csv), ("json", SF.read_text_json)):
            paths = [f"{self.delivered}/{n}" for n in names if n.endswith("." + suffix)]
            if paths:
                parts.append(reader(self.spark, paths, spec.columns))
        return reduce(DataFrame.unionByName, parts) if parts else None

    def stage(self, full: bool) -> tuple[dict[str, DataFrame], list[tuple[TableSpec, C.Cleaned, DataFrame]]]:
        """Clean all new or changed files; returns staged frames, and what is logged once they are in the warehouse."""
        hashes = SF.changed_files(SF.file_hashes(self.spark, self.delivered), self.table("FileLog"), full)
        todo = written(hashes.select("FileName", "FileHash"), "todo")
        staged, cleanings = {}, []
        for spec in SPECS:
            found = SF.discover(self.spark, self.delivered, spec.name).join(todo, "FileName", "left_semi")
            raw = self.read(spec, [r[0] for r in found.select("FileName").collect()])
            if raw is not None:
                parents = {p: self.parent_keys(p, staged) for p in set(spec.foreign.values())}
                cleaned = C.clean(raw, spec, parents, keep=written)
                cleaned.rows = written(cleaned.rows, f"{spec.name}-checked")
                staged[spec.name] = written(C.merge_parts(cleaned.good(), spec.pk), f"stg-{spec.name}")
                cleanings.append((spec, cleaned, todo))
        return staged, cleanings

    def parent_keys(self, parent: str, staged: dict[str, DataFrame]) -> DataFrame:
        """Keys in the warehouse and keys staged in this run."""
        name = PARENT_TABLE[parent]
        keys = self.table(name).select(F.col(TABLES[name][1]).alias("k"))
        pk = next(s.pk for s in SPECS if s.name == parent)
        return keys.unionByName(staged[parent].select(F.col(pk).alias("k"))) if parent in staged else keys

    def log_files(self, spec: TableSpec, cleaned: C.Cleaned, todo: DataFrame) -> DataFrame:
        run = F.lit(self.run_id).alias("RunID")
        counts = written(C.file_counts(cleaned).join(todo, "FileName").select("*", run), "file-counts")
        log = self.table("FileLog")
        ST.replace_table(U.upsert_log(log, counts, ["FileName"]), f"{self.root}/FileLog")
        quality = C.quality_log(cleaned).select("*", run)
        old = self.table("DataQualityLog").join(counts.select("FileName"), "FileName", "left_anti")
        ST.replace_table(old.unionByName(quality.select(*old.columns)), f"{self.root}/DataQualityLog")
        sample = C.reject_sample(cleaned.rejected()).select("*", run, F.lit(spec.name).alias("TableName"))
        self.append("RejectedRecords", sample)
        return counts

    # ---------------------------------------------------------------- warehouse
    def load(self, name: str, source: DataFrame, delivered: DataFrame) -> None:
        """Facts are merged in the semesters they touch; the small dimensions are written as a whole."""
        schema, key, compare = TABLES[name]
        if name.startswith("Fact"):
            counts = U.merge_partitioned(self.spark, f"{self.root}/{name}", schema, source, [key], "SemesterKey", compare)
            self.append("LoadAudit", U.audit_row(name, counts, delivered).withColumn("RunID", F.lit(self.run_id)))
            return
        merged = U.upsert_type1(self.table(name), source, [key], compare)
        merged = written(merged, f"merge-{name}")
        ST.replace_table(merged.drop("_action", "_staged"), f"{self.root}/{name}")
        self.append("LoadAudit", U.load_audit(merged, name, delivered).withColumn("RunID", F.lit(self.run_id)))

    def load_dimensions(self, staged: dict[str, DataFrame]) -> None:
        for parent, name in PARENT_TABLE.items():
            if parent in staged:
                rows = staged[parent]
                if parent == "students":
                    rows = rows.withColumn("FullName", FT.full_name())
                self.load(name, _rename(rows, KEYS), rows)

    def load_facts(self, staged: dict[str, DataFrame]) -> None:
        semesters = D.semester_dim(self.spark)
        days = D.date_dim(semesters)
        builders = {
            "enrollments": ("FactEnrollments", lambda r: FT.fact_enrollments(r, semesters)),
            "grades": ("FactGrades", lambda r: FT.fact_grades(r, self.table("FactEnrollments"), self.table("DimCourse"))),
            "attendance": ("FactAttendance", lambda r: FT.fact_attendance(r, days)),
            "payments": ("FactPayments", lambda r: FT.fact_payments(r, days)),
            "assignments": ("FactAssignments", lambda r: FT.fact_assignments(r, self.table("FactEnrollments"), days)),
            "academic_warnings": ("FactWarnings", lambda r: FT.fact_warnings(r, days)),
        }
        for table, (name, build) in builders.items():
            if table in staged:
                self.load(name, build(staged[table]), staged[table])

    def build_snapshot(self) -> DataFrame:
        sides = [N.attendance_side(self.table("FactAttendance")), N.assignment_side(self.table("FactAssignments")),
                 N.payment_side(self.table("FactPayments")), N.warning_side(self.table("FactWarnings")),
                 N.teacher_load_side(self.table("FactEnrollments"))]
        snap = N.student_semester(N.grade_base(self.table("FactGrades")), sides, self.table("DimStudent"))
        ST.replace_table(snap, f"{self.root}/FactStudentSemester")
        return ST.read_table(self.spark, f"{self.root}/FactStudentSemester")

    def check(self, snap: DataFrame) -> DataFrame:
        facts = [V.unique_key(self.table(n), n, TABLES[n][1]) for n in TABLES if n.startswith("Fact")]
        grades = self.table("FactGrades")
        return V.all_of(*facts, V.has_parent(grades, self.table("FactEnrollments"), ["StudentKey", "CourseKey"],
                                             "every grade has an enrollment"), V.scores_in_range(grades),
                        V.grade_agrees(grades), V.amounts_add_up(self.table("FactPayments")), V.snapshot_covers(snap, grades),
                        V.snapshot_complete(snap))

    def close_interrupted(self) -> None:
        """Runs that were still running when their process ended are failed ones."""
        last = self.table("RunEvents").groupBy("RunID").agg(F.max_by("Status", "At").alias("Status"))
        for row in last.where("Status = 'RUNNING'").orderBy("RunID").collect():
            self.event("FAILED", "interrupted", run_id=row["RunID"])

    def run(self, full: bool = False) -> dict:
        """Files count as seen only when their rows are in the warehouse: a run that fails before leaves them to the next."""
        self.close_interrupted()
        self.event("RUNNING", "")
        try:
            return self.refresh(full)
        except Exception as exc:
            self.event("FAILED", f"{type(exc).__name__}: {exc}")
            raise

    def refresh(self, full: bool) -> dict:
        staged, cleanings = self.stage(full)
        self.load_dimensions(staged)
        self.load_facts(staged)
        logged = [self.log_files(*cleaning) for cleaning in cleanings]
        counts = reduce(DataFrame.unionByName, logged) if logged else None
        totals = C.totals(counts).first().asDict() if counts is not None else dict.fromkeys(
            ("FilesProcessed", "RowsRead", "RowsLoaded", "RowsRejected"), 0)
        result = V.run_status(self.check(self.build_snapshot())).first()
        self.event(result["Status"], result["Message"], totals)
        return {"run_id": self.run_id, "status": result["Status"], "message": result["Message"], **totals}
