"""Upserts into partitioned tables."""

import re

import pytest

from cohortlake.operators import upsert as U
from cohortlake.sources import tables as ST

SCHEMA = "k long, part int, v string"


def merge(spark, path, rows):
    return U.merge_partitioned(spark, path, SCHEMA, spark.createDataFrame(rows, SCHEMA), ["k"], "part")


def files(path):
    return {p.name: sorted((f.name, f.stat().st_mtime_ns) for f in p.glob("*.parquet")) for p in path.glob("part=*")}


def rows(spark, path):
    return sorted(map(tuple, ST.read_partitioned(spark, str(path), SCHEMA).collect()), key=repr)


def test_only_touched_partitions_are_written(spark, tmp_path):
    path = tmp_path / "t"
    assert merge(spark, str(path), []) == {"RowsStaged": 0, "RowsInserted": 0, "RowsUpdated": 0}
    first = [(k, k % 4, f"a{k}") for k in range(40)] + [(100, None, "n"), (200, 9, "alone")]
    assert merge(spark, str(path), first) == {"RowsStaged": 42, "RowsInserted": 42, "RowsUpdated": 0}
    before = files(path)
    # one row changed, one as it was, one new, one that moves from 2 to 1; partitions 0 and null and 9 are not touched
    counts = merge(spark, str(path), [(1, 1, "b"), (5, 1, "a5"), (300, 1, "new"), (2, 1, "a2")])
    assert counts == {"RowsStaged": 4, "RowsInserted": 1, "RowsUpdated": 2}
    after = files(path)
    assert {p for p in after if after[p] != before[p]} == {"part=1", "part=2"}
    want = {k: (k, p, v) for k, p, v in first} | {1: (1, 1, "b"), 300: (300, 1, "new"), 2: (2, 1, "a2")}
    assert rows(spark, path) == sorted(want.values(), key=repr)
    # all rows leave partition 9, and the one without a partition gets one
    merge(spark, str(path), [(200, 0, "moved"), (100, 3, "n")])
    assert "part=9" not in files(path) and "part=__HIVE_DEFAULT_PARTITION__" not in files(path)
    want |= {200: (200, 0, "moved"), 100: (100, 3, "n")}
    assert rows(spark, path) == sorted(want.values(), key=repr)


def test_a_run_that_ends_early_is_repeated(spark, tmp_path, monkeypatch):
    path = tmp_path / "t"
    merge(spark, str(path), [(1, 1, "a"), (2, 2, "b")])
    with monkeypatch.context() as m:
        m.setattr(U, "drop_partition", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            merge(spark, str(path), [(2, 1, "c"), (3, 3, "d")])
    assert len(rows(spark, path)) == 4                                   # key 2 is there twice
    merge(spark, str(path), [(2, 1, "c"), (3, 3, "d")])
    assert rows(spark, path) == [(1, 1, "a"), (2, 1, "c"), (3, 3, "d")]


def test_the_scan_is_pruned_to_touched_partitions(spark, tmp_path, capsys):
    path = tmp_path / "t"
    merge(spark, str(path), [(k, k % 3, "a") for k in range(30)])
    ST.read_partitioned(spark, str(path), SCHEMA).where(U._among("part", [1, None])).explain("formatted")
    assert re.search(r"PartitionFilters: \[.*part#", capsys.readouterr().out)
