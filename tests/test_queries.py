"""Registered queries against their SQL on the smallest tables. A spread by default, all with ALL_QUERIES=1."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
SPREAD = """student_semester exam_by_faculty exam_by_grains exam_flow retention course_summary_pooled university_health faculty_summary kpis
alerts anomalies risk_vs_debt quality_log good_rows merge_parts upsert_type1 fact_grades date_dim load_assertions build_dataset
threshold_for_recall compare_models score_students lever_effects target_mask_top_risk scenario_tutoring_30 finance_summary
latest_intervention profile_pivot replace_table load_snapshot""".split()
NAMES = sorted(entry.oracle_sql()) if os.environ.get("ALL_QUERIES") else SPREAD


def comparable(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        v = float(v) if hasattr(v, "as_tuple") else v
        return v + 0.0 if isinstance(v, float) else v

    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in Path(FOLDER).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    return con


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, db, name):
    df = entry.queries()[name](spark, FOLDER)
    got = comparable(df.columns, df.collect())
    rel = db.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert got == comparable(rel.columns, rel.fetchall())
