"""Rows of a delivery move once, and only those that lack a value meet its median."""

import pytest
from pyspark.sql import functions as F

from cohortlake.operators import cleaning as C
from cohortlake.session import written

SPEC = C.TableSpec("lines", "ID", ("ID", "Part", "Score"), ints=("ID", "Part"), floats=("Score",), impute={"Score": "Part"},
                   required=("ID", "Score"), ranges={"Score": (0, 40)})
ROWS = [("a", 1, "1", "7", "10"), ("a", 2, " 1", "7", "20"), ("a", 3, "2", "7", None), ("a", 4, None, "7", "31"), ("a", 5, None, "7", "31"),
        ("a", 6, "3", "8", None), ("b", 7, "1", "7", "4"), ("b", 8, "1", None, None), ("b", 9, "1 ", "9", "1e999"), (None, 10, "1", "7", "5"), (None, 11, "1", "7", "5")]
TEXT = "_file string, _ord int, ID string, Part string, Score string"


def cleaned(spark, keep=None):
    return C.clean(spark.createDataFrame(ROWS, TEXT), SPEC, keep=keep)


@pytest.mark.parametrize("hot", [100_000, 1], ids=["one move", "hot keys"])
@pytest.mark.parametrize("keep", [written, None], ids=["stored", "plan"])
def test_last_row_of_a_key_and_medians(spark, monkeypatch, hot, keep):
    monkeypatch.setattr(C, "HOT", hot)
    got = {r["_ord"]: (r["Score"], r["_dups"], r["_trims"], r["IsImputed"], r["Reason"]) for r in cleaned(spark, keep).rows.collect()}
    assert got == {2: (20.0, 1, 1, False, None), 3: (31.0, 0, 0, True, None), 4: (31.0, 0, 0, False, "missing_required"), 5: (31.0, 0, 0, False, "missing_required"),
                   6: (None, 0, 0, True, "missing_required"), 9: (float("inf"), 2, 1, False, "out_of_range"), 10: (5.0, 0, 0, False, None), 11: (5.0, 0, 0, False, None)}


def test_whole_numbers_are_read_as_before(spark):
    texts = ["12", " 1 2", "+5", "1.0", "1.5", "1e3", "1e999", "123456789012345", "1234567890123456789", "x", "", None, "\x015"]
    from cohortlake.functions import text as X
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["w"] for r in rows.select("i", X.whole(F.col("t")).alias("w")).orderBy("i").collect()]
    assert got == [12.0, 12.0, 5.0, 1.0, None, 1000.0, None, 123456789012345.0, 1234567890123456789.0, None, None, None, None]


def test_rows_are_stored_once(spark):
    kept = []

    def keep(df, label):
        kept.append(label)
        return written(df, label)
    cleaned(spark, keep).rows.count()
    assert kept == ["hot-keys", "lines"]


def test_only_rows_that_lack_a_value_move_to_their_median(spark):
    """The rows with a value are read past the join: it has no more rows than lack one."""
    rows = spark.range(5000).select(
        F.lit("a").alias("_file"), F.col("id").alias("_ord"), F.col("id").cast("string").alias("ID"), F.lit("7").alias("Part"),
        F.when(F.col("id") % 1000 != 1, (F.col("id") % 10).cast("string")).alias("Score"))
    stored = written(C.fill_defaults(C.retype(C.standardise(C.delivered_once(rows, SPEC), SPEC), SPEC), SPEC), "rows")
    plan = C.impute_group_median(stored, SPEC)
    assert plan._jdf.queryExecution().optimizedPlan().toString().lstrip().startswith("Union")
    assert plan.where("IsImputed").agg(F.count("*"), F.min("Score"), F.max("Score")).first()[:] == (5, 5.0, 5.0)
