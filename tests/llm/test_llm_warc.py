"""Revisit resolution: small cases, slices, and the query against its SQL."""

import datetime as dt

import duckdb
import pytest

from cohortlake.llm import warc
from cohortlake.llm.queries import ORACLES, QUERIES
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "record_id long, url string, date timestamp, kind string, etag string, last_modified string, headers map<string,string>, body string, status string, target string"


def at(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=n)


def row(i, url, t, kind="response", etag=None, lm=None, headers=None, body=None):
    return (i, url, None if t is None else at(t), kind, etag, lm, headers, body, "mine", "mine")


def test_op6_is_the_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{FOLDER}/pages.parquet'")
    df, rel = QUERIES["op6_revisits"](spark, FOLDER), con.sql(ORACLES["op6_revisits"])
    order = sorted(df.columns)
    assert sorted(rel.columns) == order
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(tuple, df.select(*order).collect()), key=key) == sorted(rel.select(*order).fetchall(), key=key)


@pytest.mark.parametrize("url, want", [("HTTPS://www.A.org:443/b/?utm_source=x#f", "a.org/b"), ("http://user@a.org/B?z=1&a=2", "a.org/B?a=2&z=1"), ("a.org", "a.org"), ("http://a.org/?ref=q&k", "a.org?k"), ("", ""), (None, None)])
def test_canonical(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(warc.canonical(F.col("u"))).first()[0] == want


@pytest.mark.parametrize("slices", [1, 3, 64])
def test_op6_cases(spark, slices):
    h = {"ETag": "old", "Content-Type": "text/html", "Server": "s"}
    rows = [row(1, "http://a/x", 10, etag="t1", headers=h, body="one"), row(2, "https://www.a/x/", 20, "revisit", 'W/t1', headers={"Etag": "new", "Content-Type": "no", "Date": "d"}),
            row(3, "http://a/x", 30, etag="t2", body="two"), row(4, "http://a/x", 40, "revisit", "t1"), row(5, "http://a/x", 40, "revisit", "t2"), row(5, "http://a/x", 40, "revisit", "t2"),
            row(6, "http://b/", 5, "revisit", "t"), row(7, "http://b/", 5, None, lm="m", body="b"), row(8, "http://b/", 5, "revisit", "t", "m"), row(9, "http://b/", 6, "revisit", "t"),
            row(10, None, 7, "revisit", "t"), row(11, "http://b/", None, "revisit", "t"), row(12, None, 1, body="n"), row(13, "http://c/", None, body="x"), row(14, "http://c/", 9, "revisit")]
    got = warc.resolve(spark.createDataFrame(rows, SCHEMA), slices).collect()
    assert sorted((r["record_id"], r["status"], r["target_id"], r["body"]) for r in got) == [
        (2, "resolved", 1, "one"), (4, "mismatch", 3, None), (5, "resolved", 3, "two"), (5, "resolved", 3, "two"), (6, "orphan", None, None),
        (8, "resolved", 7, "b"), (9, "unverified", 7, None), (10, "orphan", None, None), (11, "orphan", None, None), (14, "orphan", None, None)]
    assert {r["record_id"]: r for r in got}[2]["headers"] == {"etag": "new", "content-type": "text/html", "server": "s", "date": "d"}
    assert warc.resolve(spark.createDataFrame([], SCHEMA), slices).collect() == []


@pytest.mark.parametrize("slices", [1, 7])
def test_op6_hot_url(spark, slices):
    rows = [row(k, "http://hot/" if k % 3 else f"http://u{k}/", (k * 37) % 500, "response" if k % 5 == 0 else "revisit", "e") for k in range(400)]
    got = {r["record_id"]: r["target_id"] for r in warc.resolve(spark.createDataFrame(rows, SCHEMA).repartition(4), slices).collect()}
    full = [(r[1], r[2], r[0]) for r in rows if r[3] == "response"]
    for r in rows:
        if r[3] == "revisit":
            before = [(t, i) for u, t, i in full if u == r[1] and (t, i) < (r[2], r[0])]
            assert got[r[0]] == (max(before)[1] if before else None)
