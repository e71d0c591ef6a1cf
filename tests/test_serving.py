"""Role scoping, the capped query, versioned tables and the staff log."""

import pytest
from pyspark.sql import functions as F

from cohortlake.operators import serving as D
from cohortlake.sources import tables as ST


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(i, f"Name{i}", i % 3) for i in range(10)], "StudentKey int, FullName string, FacultyKey int")


@pytest.mark.parametrize("sql", [
    "DELETE FROM people", "UPDATE people SET FullName = 'x'", "SELECT 1; DROP TABLE people", "CREATE TABLE copy AS SELECT * FROM people",
    "INSERT INTO people SELECT * FROM people", "SELECT 1 -- comment", "SELECT 1 /* comment */", "TRUNCATE TABLE people",
    "DROP VIEW people", "SET spark.sql.ansi.enabled = false", "SELECT * FROM unknown_table", ""])
def test_only_one_select_is_accepted(spark, people, sql):
    with pytest.raises(ValueError):
        D.capped_query(spark, {"people": people}, sql)


@pytest.mark.parametrize("sql", [
    "SELECT * FROM parquet.`/root/testdata/sf0.001/orders.parquet`", "SELECT * FROM staff_notes", "SELECT * FROM default.people", "SELECT * FROM range(3)",
    "SELECT (SELECT max(note) FROM staff_notes) FROM people", "SELECT * FROM people WHERE StudentKey IN (SELECT k FROM staff_notes)",
    "WITH staff_notes AS (SELECT * FROM staff_notes) SELECT * FROM staff_notes", "SELECT * FROM people WHERE 1 = (WITH staff_notes AS (SELECT max(k) AS m FROM staff_notes) SELECT m FROM staff_notes)",
    "WITH a AS (WITH staff_notes AS (SELECT * FROM staff_notes) SELECT * FROM staff_notes) SELECT * FROM a", "SELECT * FROM other_people", "SELECT * FROM global_temp.notes",
    "WITH people AS (SELECT * FROM staff_notes) SELECT * FROM people", "SELECT * FROM people p, LATERAL (SELECT * FROM staff_notes s WHERE s.k = p.StudentKey)",
    "WITH x AS (SELECT * FROM staff_notes) SELECT * FROM x", "SELECT * FROM people JOIN staff_notes ON StudentKey = k"])
def test_only_published_tables_are_read(spark, people, sql):
    spark.createDataFrame([(1, "secret")], "k int, note string").createOrReplaceTempView("staff_notes")
    spark.table("staff_notes").createOrReplaceGlobalTempView("notes")
    people.createOrReplaceTempView("other_people")                       # what is published, but under a name that isn't
    with pytest.raises(ValueError):
        D.capped_query(spark, {"people": people}, sql)
    assert spark.table("staff_notes").count() == 1


def test_select_is_capped(spark, people):
    rows = D.capped_query(spark, {"people": people}, "  with x as (select 1 as a) select * from x ;", cap=4)
    assert [tuple(r) for r in rows.collect()] == [(1, False)]
    rows = D.capped_query(spark, {"people": people}, "SELECT * FROM people", cap=4).collect()
    assert len(rows) == 4 and all(r["truncated"] for r in rows)
    rows = D.capped_query(spark, {"people": people}, "SELECT * FROM (VALUES (1), (2)) AS v(k) WHERE k IN (SELECT FacultyKey FROM people) AND EXISTS (WITH people AS (SELECT * FROM people) SELECT 1 FROM people)")
    assert rows.count() > 0
    rows = D.capped_query(spark, {"people": people}, "WITH people AS (SELECT * FROM people WHERE FacultyKey = 1) SELECT * FROM people")
    assert rows.count() == 3 and not rows.where("truncated").count()


def test_reports_have_as_many_rows_as_asked_for(spark):
    many = spark.range(700).selectExpr("cast(id as int) as StudentKey", "concat('Name', id) as FullName", "1 as FacultyKey", "1 as StudyYear", "'x' as Status",
                                       "rand(1) as RiskProbability", "'F' as FacultyName", "'high' as RiskLevel", "'G' as GroupName")
    assert D.top_risk(many, 120).count() == 120 and D.find_students(many, "name", 300).count() == 300
    assert D.risk_search(many).count() == 700 and D.risk_search(many, limit=5).count() == 5


def test_last_good_run_is_found_behind_many_failures(spark):
    from cohortlake.operators.quality import last_good_run
    runs = spark.range(1, 40).selectExpr("cast(id as int) as RunID", "if(id = 3, 'SUCCESS', 'FAILED') as Status")
    assert [r["RunID"] for r in last_good_run(runs).collect()] == [3]


def test_roles(people):
    assert D.scope_rows(people, "management").count() == 10
    assert D.scope_rows(people, "management", faculty=1).count() == 3
    assert D.scope_rows(people, "dean", own_faculty=0).count() == 4
    with pytest.raises(PermissionError):
        D.scope_rows(people, "dean", own_faculty=0, faculty=1)
    with pytest.raises(PermissionError):
        D.scope_rows(people, "teacher", student_level=True)


def test_entity_lookup(people):
    assert D.require_entity(people, "StudentKey", "FullName", "name7") == 7
    with pytest.raises(ValueError, match="Name0"):
        D.require_entity(people, "StudentKey", "FullName", "nobody")


def test_versions_and_log_restore(spark, people, tmp_path):
    table, backup = str(tmp_path / "t"), str(tmp_path / "b")
    assert ST.restore_log(spark, backup, table) == 0
    assert ST.table_or_empty(spark, table, people.schema).count() == 0
    assert ST.backup_log(people.limit(0), backup) == 0
    assert ST.backup_log(people, backup) == 10 and ST.restore_log(spark, backup, table) == 10
    assert ST.restore_log(spark, backup, table) == 0            # never into a table with rows
    ST.replace_table(ST.read_table(spark, table).where(F.col("StudentKey") < 3), table)   # reads the version it replaces
    assert ST.read_table(spark, table).count() == 3 and ST.versions(spark, table) == [1, 2]


def test_unfinished_version_is_invisible(spark, people, tmp_path):
    table = str(tmp_path / "t")
    ST.replace_table(people, table)
    (tmp_path / "t" / "v=2").mkdir()
    assert ST.read_table(spark, table).count() == 10
