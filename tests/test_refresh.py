"""A small university with planted dirt, loaded twice."""

import json
import os

import pytest
from pyspark.sql import functions as F

from cohortlake import settings as S
from cohortlake.operators import cleaning as C
from cohortlake.operators.quality import data_quality
from cohortlake.sources import tables as ST
from cohortlake.plans.university import SPECS, Refresh
from cohortlake.sources import files as SF
from cohortlake.streaming.incremental import clean_new_files

SPEC = {s.name: s for s in SPECS}


def write_csv(path, header, rows):
    path.write_text("\n".join([",".join(header), *[",".join("" if v is None else str(v) for v in r) for r in rows]]) + "\n",
                    encoding="utf-8")


@pytest.fixture(scope="module")
def delivered(tmp_path_factory):
    folder = tmp_path_factory.mktemp("delivered")
    (folder / "faculties.json").write_text(json.dumps(
        [{"FacultyID": i, "FacultyName": f"F{i}", "Dean": None if i == 2 else "D", "EstablishedYear": 1990} for i in (1, 2)]))
    (folder / "departments.json").write_text(json.dumps(
        [{"DepartmentID": i, "DepartmentName": f"K{i}", "FacultyID": i} for i in (1, 2)]))
    write_csv(folder / "teachers.csv", SPEC["teachers"].columns, [
        (1, "T1", 1, 5, "phd", S.EMPLOYMENT[0]), (2, "T2", 2, 7, "Magistr", S.EMPLOYMENT[1]), (3, "T3", 9, 1, "PhD", S.EMPLOYMENT[0])])
    write_csv(folder / "courses.csv", SPEC["courses"].columns, [
        (c, f"C{c}", 1 + c % 2, 3 + c % 2, 1 + (c - 1) // 2, S.COURSE_TYPE[0]) for c in (1, 2, 3, 4)])
    students = []
    for i in range(1, 13):
        students.append((i, " ali " if i == 1 else f"Ism{i}", f"Fam{i}", f"G-{i % 2}", None if i == 2 else S.GENDER[i % 2],
                         "05.03.2004" if i == 3 else "2004-03-05", 1 + i % 2, 1 + i % 2, 2022, 1, S.SCHOLARSHIP[0],
                         S.TUITION_STATUS[1], S.STUDENT_STATUS[0], ""))
    write_csv(folder / "students.csv", SPEC["students"].columns, students)
    enr, grd, att, asg, n = [], [], [], [], 0
    for i in range(1, 13):
        for c in (1, 2, 3, 4):
            n += 1
            enr.append((n, i, c, 1 + c % 2, S.SEASONS[(c - 1) // 2], "2022-2023"))
            grd.append((n, i, c, 10 + i % 8, None if n == 5 else 18 + i % 5, 150 if n == 9 else 30 + i, 90, "Ha", "4", 4))
            day = f"2022-10-{c:02d}" if c <= 2 else f"2023-03-{c:02d}"
            att.append((n, i, c, day, ["Keldi", "KELMADI", " keldi "][n % 3]))
            asg.append((n, i, c, day, 1000 if n == 20 else 70 + i, S.SUBMISSION[0], day))
    grd.append((1, 1, 1, 12, 20, 40, 91, "Ha", "4", 4))                # a later copy of grade 1 wins
    att += [(101, 999, 1, "2022-10-05", "Keldi"), (102, 1, 1, "2099-12-31", "Keldi"), (103, 1, 1, "yesterday", "Keldi")]
    write_csv(folder / "enrollments_1.csv", SPEC["enrollments"].columns, enr)
    write_csv(folder / "grades_1.csv", SPEC["grades"].columns, grd)
    write_csv(folder / "attendance_1.csv", SPEC["attendance"].columns, att)
    write_csv(folder / "payments_1.csv", SPEC["payments"].columns, [
        (i, i, "8 000 000" if i == 1 else 8000000, -5 if i == 4 else 4000000 if i % 2 else 8000000, "", "2022-10-10", "") for i in range(1, 13)])
    write_csv(folder / "assignments_1.csv", SPEC["assignments"].columns, asg)
    write_csv(folder / "academic_warnings_1.csv", SPEC["academic_warnings"].columns, [
        (1, 1, S.WARNING_TYPES[0], "2022-11-01", S.SEVERITY[0]), (2, 1, S.WARNING_TYPES[1], "2023-04-01", S.SEVERITY[1])])
    return folder


@pytest.fixture(scope="module")
def loaded(spark, delivered, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("warehouse"))
    first = Refresh(spark, str(delivered), root).run()
    return root, first


def test_first_load(spark, loaded):
    root, first = loaded
    assert first["status"] == "SUCCESS", first["message"]
    assert first["FilesProcessed"] == 11 and first["message"] == "12 tests passed"
    job = Refresh(spark, "", root)
    quality = {(r["TableName"], r["CheckName"]): r["IssueCount"] for r in job.table("DataQualityLog").collect()}
    assert quality[("students", "whitespace_trimmed")] == 1 and quality[("students", "format_standardised")] == 1
    assert quality[("students", "missing_filled")] == 1 and quality[("students", "type_corrected")] == 1
    assert quality[("teachers", "orphan_key")] == 1 and quality[("teachers", "format_standardised")] == 1
    assert quality[("grades", "duplicate")] == 1 and quality[("grades", "missing_imputed")] == 1
    assert quality[("grades", "out_of_range")] == 1 and quality[("grades", "outlier_FinalScore")] >= 1
    assert quality[("attendance", "orphan_key")] == 1 and quality[("attendance", "out_of_range")] == 1
    assert quality[("attendance", "invalid_date")] == 1
    assert quality[("payments", "type_corrected")] == 1 and quality[("payments", "out_of_range")] == 1
    assert quality[("assignments", "out_of_range")] == 1
    student = job.table("DimStudent").where("StudentKey = 1").first()
    assert (student["FirstName"], student["FullName"]) == ("Ali", "Fam1 Ali")
    grade = job.table("FactGrades").where("GradeID = 1").first()
    assert (float(grade["TotalScore"]), grade["FinalGrade"], grade["SemesterKey"]) == (72.0, "4", 0)
    imputed = job.table("FactGrades").where("IsMidtermImputed").first()
    assert imputed["GradeID"] == 5 and 18 <= imputed["MidtermScore"] <= 22


def test_snapshot(spark, loaded):
    rows = {(r["StudentKey"], r["SemesterKey"]): r for r in Refresh(spark, "", loaded[0]).table("FactGrades").sparkSession.read.parquet(
        f"{loaded[0]}/FactStudentSemester").collect()}
    assert len(rows) == 24
    one = rows[(1, 1)]
    assert one["StudySemester"] == 2 and one["WarningsCum"] == 2 and one["IsLastSemester"] == 1
    assert rows[(1, 0)]["WarningsCum"] == 1 and rows[(1, 0)]["PrevGPA"] is None and one["PrevGPA"] == rows[(1, 0)]["SemGPA"]
    assert float(rows[(1, 0)]["DebtRatio"]) == 0.5 and float(rows[(1, 1)]["DebtRatio"]) == 0.0
    assert float(rows[(1, 0)]["AvgTeacherLoad"]) == 12.0


def test_second_load_changes_nothing(spark, delivered, loaded):
    root, _ = loaded
    again = Refresh(spark, str(delivered), root).run()
    assert again["status"] == "SUCCESS" and again["FilesProcessed"] == 0
    full = Refresh(spark, str(delivered), root).run(full=True)
    assert full["status"] == "SUCCESS" and full["FilesProcessed"] == 11
    audit = Refresh(spark, "", root).table("LoadAudit").where(F.col("RunID") == full["run_id"])
    sums = audit.agg(F.sum("RowsInserted"), F.sum("RowsUpdated"), F.count(F.lit(1))).first()
    assert (sums[0], sums[1], sums[2]) == (0, 0, 11)


def test_failed_run_leaves_its_files_to_the_next(spark, delivered, loaded, tmp_path, monkeypatch):
    root = str(tmp_path / "warehouse")

    def broken(self, staged):
        raise RuntimeError("no space")
    with monkeypatch.context() as m:
        m.setattr(Refresh, "load_facts", broken)
        with pytest.raises(RuntimeError):
            Refresh(spark, str(delivered), root).run()
    stopped = Refresh(spark, str(delivered), root)
    assert [tuple(r) for r in stopped.table("RunEvents").where("Status = 'FAILED'").select("RunID", "Message").collect()] == [(1, "RuntimeError: no space")]
    stopped.event("RUNNING", "")                                         # a run whose process was killed
    result = Refresh(spark, str(delivered), root).run()
    assert (result["run_id"], result["status"], result["FilesProcessed"]) == (3, "SUCCESS", 11)
    closed = Refresh(spark, "", root).table("RunEvents").where("RunID = 2 AND Status = 'FAILED'")
    assert closed.first()["Message"] == "interrupted"
    for name in ("DimStudent", "FactGrades", "FactAttendance", "FactStudentSemester"):
        mine, clean = (Refresh(spark, "", r).table(name) if name != "FactStudentSemester" else ST.read_table(spark, f"{r}/{name}") for r in (root, loaded[0]))
        assert sorted(map(repr, mine.collect())) == sorted(map(repr, clean.select(*mine.columns).collect()))


def test_quality_report(spark, loaded):
    job = Refresh(spark, "", loaded[0])
    row = data_quality(job.table("FileLog"), job.table("DataQualityLog")).first()
    assert 0 < row["score"] < 1 and row["duplicates"] == 1 and row["orphans"] == 2 and row["missing"] == 2


def test_rejected_rows_keep_their_raw_text(spark, loaded):
    rows = Refresh(spark, "", loaded[0]).table("RejectedRecords").where("TableName = 'attendance'").collect()
    raw = {r["Reason"]: json.loads(r["RawRecord"]) for r in rows}
    assert raw["invalid_date"]["Date"] == "yesterday" and raw["orphan_key"]["StudentID"] == "999"


def test_first_reason_wins(spark):
    spec = C.TableSpec("t", "ID", ("ID", "Status", "Score"), cats={"Status": ("A",)}, ints=("ID",), floats=("Score",),
                       required=("ID", "Score"), ranges={"Score": (0, 10)})
    df = spark.createDataFrame([("1", "z", "x", 1), ("2", "a", "x", 2), ("3", "A", None, 3), ("4", "A", "11", 4), ("5", "A", "10", 5)],
                               "ID string, Status string, Score string, o int").select(
        F.lit("f").alias("_file"), F.struct("o").alias("_ord"), "ID", "Status", "Score")
    rows = {int(r["ID"]): r["Reason"] for r in C.clean(df, spec).rows.collect()}
    assert rows == {1: "invalid_category", 2: "invalid_number", 3: "missing_required", 4: "out_of_range", 5: None}


def test_missing_tokens_and_json_nulls(spark, tmp_path):
    write_csv(tmp_path / "x.csv", ["a", "b"], [("NA", "1"), ("ok", "NULL")])
    rows = SF.read_text_csv(spark, str(tmp_path / "x.csv"), ["a", "b"]).select("a", "b").collect()
    assert [(r["a"], r["b"]) for r in rows] == [(None, "1"), ("ok", None)]
    (tmp_path / "y.json").write_text('[{"a": 1, "b": null}, {"a": "t"}]')
    rows = SF.read_text_json(spark, str(tmp_path / "y.json"), ["a", "b"]).select("a", "b").collect()
    assert [(r["a"], r["b"]) for r in rows] == [("1", None), ("t", None)]


def test_changed_file_is_found(spark, tmp_path):
    write_csv(tmp_path / "grades_1.csv", ["a"], [(1,)])
    write_csv(tmp_path / "grades_2.csv", ["a"], [(2,)])
    log = spark.createDataFrame(
        SF.file_hashes(spark, str(tmp_path)).collect())
    write_csv(tmp_path / "grades_2.csv", ["a"], [(3,)])
    changed = SF.changed_files(SF.file_hashes(spark, str(tmp_path)), log).collect()
    assert [r["FileName"] for r in changed] == ["grades_2.csv"]
    assert [r["FileName"] for r in SF.discover(spark, str(tmp_path), "grades").collect()] == ["grades_1.csv", "grades_2.csv"]


def test_fingerprints_are_of_the_bytes_at_every_size(spark, tmp_path, monkeypatch):
    """Files of many ranges and of one: a changed byte is found though length and time are as they were; a touched file is the same."""
    monkeypatch.setattr(SF, "RANGE", 1000)
    sizes = {"grades_1.csv": 1, "grades_2.csv": 1000, "grades_3.csv": 1001, "grades_4.csv": 250_000}
    for name, n in sizes.items():
        (tmp_path / name).write_bytes(bytes(k * 7 % 251 for k in range(n)))
        os.utime(tmp_path / name, (1_000_000, 1_000_000))
    before = {r["FileName"]: r["FileHash"] for r in SF.file_hashes(spark, str(tmp_path)).collect()}
    assert set(before) == set(sizes) and len(set(before.values())) == len(sizes)
    data = bytearray((tmp_path / "grades_4.csv").read_bytes())
    data[123_456] ^= 1
    (tmp_path / "grades_4.csv").write_bytes(data)
    os.utime(tmp_path / "grades_4.csv", (1_000_000, 1_000_000))
    os.utime(tmp_path / "grades_3.csv", (2_000_000, 2_000_000))
    after = {r["FileName"]: r["FileHash"] for r in SF.file_hashes(spark, str(tmp_path)).collect()}
    assert [n for n in sizes if before[n] != after[n]] == ["grades_4.csv"]
    data[:1000], data[1000:2000] = data[1000:2000], data[:1000]             # ranges count in their order
    (tmp_path / "grades_4.csv").write_bytes(data)
    assert {r["FileName"]: r["FileHash"] for r in SF.file_hashes(spark, str(tmp_path)).collect()}["grades_4.csv"] != after["grades_4.csv"]


def test_streamed_files_are_cleaned_once(spark, delivered, tmp_path):
    spec = C.TableSpec("attendance", "AttendanceID", SPEC["attendance"].columns, cats=SPEC["attendance"].cats,
                       ints=SPEC["attendance"].ints, dates=("Date",), required=("AttendanceID", "Date"),
                       date_ranges={"Date": S.FACT_DATES})
    for _ in range(2):
        query = clean_new_files(spark, str(delivered), spec, str(tmp_path / "out"), str(tmp_path / "cp"))
        query.awaitTermination(120)
        assert query.exception() is None
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert rows.count() == 49 and rows.select("Status").distinct().count() == 2
