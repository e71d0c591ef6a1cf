"""Order statistics, medians and running totals against brute force, over one range and over many."""

import random
import statistics

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from cohortlake.functions import selection as SEL
from cohortlake.functions.skew import last_per_key, lookup
from cohortlake.operators.anomalies import peer_median
from cohortlake.operators.evaluation import roc_auc, threshold_for_recall


@pytest.fixture(params=[True, False], ids=["one-range", "all-ranges"])
def ranges(request, spark):
    """Small data meets in one range; without coalescing it is spread over all of them."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, str(request.param).lower())
    yield
    spark.conf.set(name, before)


def numbers(n, seed, values=None):
    rnd = random.Random(seed)
    return [rnd.choice(values) if values else rnd.lognormvariate(0, 2) for _ in range(n)]


@pytest.mark.parametrize("n,values", [(1, None), (2, None), (501, None), (1200, None), (900, [1.0, 2.0, 2.5]), (800, [7.0])])
def test_exact_median(spark, ranges, n, values):
    data = numbers(n, n, values)
    df = spark.createDataFrame([(x,) for x in data], "x double")
    assert SEL.exact_median(df, "x").first()["median"] == pytest.approx(statistics.median(data), abs=1e-12)


def test_median_per_group_with_a_hot_group(spark, ranges):
    rows = [("hot", x) for x in numbers(900, 1)] + [("a", x) for x in numbers(30, 2)] + [("b", None), ("b", 4.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: r["median"] for r in SEL.exact_median(df, "x", ["g"]).collect()}
    for g in ("hot", "a", "b"):
        assert got[g] == pytest.approx(statistics.median(x for k, x in rows if k == g and x is not None))


def test_selection_of_a_million_values_and_of_one_hot_value(spark, ranges):
    wide = spark.range(1_000_000).select(F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("g"),
                                         (F.pmod(F.col("id") * 7919, F.lit(1_000_000)) / 8).alias("x"))
    got = {r["g"]: r for r in SEL.median_and_mad(wide, "x", ["g"]).collect()}
    for g, first in (("even", 0), ("odd", 1)):  # 500 000 values in steps of a quarter
        assert got[g]["median"] == pytest.approx((first + 499_999) / 8)
        assert got[g]["mad"] == pytest.approx(249_999.5 / 8, abs=1)
    hot = spark.range(300_000).select(F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id").cast("double")).alias("x"))
    data = [5.0 if k % 3 == 0 else float(k) for k in range(300_000)]
    assert SEL.exact_median(hot, "x").first()["median"] == statistics.median(data)


def test_selection_without_rows_and_ranks_outside(spark, ranges):
    none = spark.createDataFrame([], "g string, x double")
    assert SEL.exact_median(none, "x").first()["median"] is None and SEL.exact_median(none, "x", ["g"]).collect() == []
    two = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    row = SEL.pick_ranks(two, "x", lambda n: {"a": n, "b": n + 1}).first()
    assert (row["n"], row["a"], row["b"]) == (2, 2.0, None)


def test_totals_below_scores_of_one_narrow_place(spark, ranges):
    """Scores that agree in their first ten digits spread over all tasks like any others."""
    close = spark.range(200_000).select((F.lit(0.5) + F.col("id") * F.lit(1e-15)).alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("c"))
    got = SEL.totals_below(close, "s", ["c"])
    assert got.agg(F.max("below_c") + F.max_by("c", "s")).first()[0] == 200_000
    counts = sorted((r["s"], r["c"], r["below_c"]) for r in got.collect())
    total = 0
    for _, c, below in counts:
        assert below == total
        total += c


@pytest.mark.parametrize("share", [0.0, 0.1, 0.3, 0.5, 1.0])
@pytest.mark.parametrize("values", [None, [0.01, 0.5, 0.99]])
def test_top_share_matches_sorting(spark, ranges, share, values):
    data = list(enumerate(numbers(700, 3, values)))
    df = spark.createDataFrame(data, "k long, v double")
    got = {r["k"] for r in SEL.top_share(df, "v", "k", share, "t").collect() if r["t"]}
    want = sorted(data, key=lambda kv: (-kv[1], kv[0]))[:round(len(data) * share)]
    assert got == {k for k, _ in want}


def test_robust_z_cases(spark, ranges):
    flat = spark.createDataFrame([(5.0,)] * 6, "x double")
    assert [r["Z"] for r in SEL.robust_z(flat, "x").collect()] == [0.0] * 6
    jump = spark.createDataFrame([(x,) for x in (1.0, 1.1, 0.9, 1.0, 1.05, 0.95, 9.0)], "x double")
    z = {r["x"]: r["Z"] for r in SEL.robust_z(jump, "x").collect()}
    assert z[9.0] > 3 and all(abs(v) < 3 for x, v in z.items() if x != 9.0)


@pytest.mark.parametrize("values", [None, [0.0, 0.25, 0.5, 1.0]])
def test_auc_and_threshold(spark, ranges, values):
    rnd = random.Random(5)
    data = [(rnd.choice(values) if values else rnd.random(), int(rnd.random() < 0.4)) for _ in range(600)]
    df = spark.createDataFrame(data, "Score double, Target int")
    pos, neg = [s for s, y in data if y], [s for s, y in data if not y]
    wins = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg))
    assert roc_auc(df).first()["ROC_AUC"] == pytest.approx(wins, abs=1e-12)
    ml = BinaryClassificationEvaluator(rawPredictionCol="Score", labelCol="Target", numBins=0)
    assert ml.evaluate(df.withColumn("Target", F.col("Target").cast("double"))) == pytest.approx(wins, abs=1e-9)
    cut = threshold_for_recall(df, 0.8).first()["Threshold"]
    assert sum(p >= cut for p in pos) / len(pos) >= 0.8
    higher = [s for s in pos if s > cut]
    assert len(higher) / len(pos) < 0.8 or cut == 0.99


def test_threshold_without_positives(spark):
    df = spark.createDataFrame([(0.3, 0), (0.6, 0)], "Score double, Target int")
    assert threshold_for_recall(df).first()["Threshold"] == 0.5


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8])
def test_peer_median_leaves_one_out(spark, n):
    data = [(1, i, float(x)) for i, x in enumerate(random.Random(n).choices(range(5), k=n))]
    df = spark.createDataFrame(data, "s int, k int, v double")
    for r in peer_median(df, "v", ["s"], "k", "m").collect():
        others = [v for _, k, v in data if k != r["k"]]
        assert r["m"] == (statistics.median(others) if others else None)


def test_last_per_key_and_lookup(spark):
    rows = [("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), (None, 1, "p"), (None, 2, "q")]
    df = spark.createDataFrame(rows, "k string, o int, v string")
    kept = {(r["k"], r["v"], r["n"]) for r in last_per_key(df, ["k"], ["o"], [F.count(F.lit(1)).alias("n")]).collect()}
    assert kept == {("a", "z", 3), (None, "p", 1), (None, "q", 1)}
    table = spark.createDataFrame([("a", 10)], "k string, w int")
    joined = lookup(df, table, ["k"], ["o"])
    assert sorted((r["v"], r["w"]) for r in joined.collect()) == [("p", None), ("q", None), ("x", 10), ("y", 10), ("z", 10)]
