"""Exact order statistics, medians and running totals that never gather a whole column in one task.

Equal values are counted before any shuffle. The counted values are sorted over ranges, which Spark cuts by a sample, and
stored with the number of their range: the cuts decide on balance alone. Totals per group and range are the only small state;
they tell which range holds a wanted rank, or what lies below a range, and only within a range are values put in order. So
a value or a group that holds a third of all rows costs no more than any other, and any number of distinct values will do.
"""

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlake import settings as S
from cohortlake.functions.skew import lookup
from cohortlake.session import written


def attach(df: DataFrame, stats: DataFrame, by=(), columns=None) -> DataFrame:
    """Add the columns of a per-group (or one-row) frame to every row."""
    by = list(by)
    columns = columns or [c for c in stats.columns if c not in by]
    if by:
        return df.join(stats.select(*by, *columns), by)
    one = stats.select(F.struct(*columns).alias("_s")).scalar()
    return (df.withColumn("_s", one)
            .select(*df.columns, *[F.col("_s").getField(c).alias(c) for c in columns]))


def counted(df: DataFrame, value: str, by=(), weight: str | None = None) -> DataFrame:
    """``by``, _v, _c: how often every value that isn't null occurs; ``weight`` names a column of counts."""
    many = F.sum(weight) if weight else F.count(F.lit(1))
    return df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(many.alias("_c"))


def ranged(df: DataFrame, order: str, sums: list[str], by=()) -> tuple[DataFrame, DataFrame]:
    """The rows, unique on ``by`` and ``order``, with their range of that order; and per group and range the sums in it,
    those before it (_before_<c>) and those of the whole group (_all_<c>)."""
    placed = df.repartitionByRange(*by, order).withColumn("_range", F.spark_partition_id())
    placed = written(placed, "ranges")
    group = Window.partitionBy(*by)
    lower = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(*by, "_range").agg(*[F.sum(c).alias(c) for c in sums])
    return placed, sizes.withColumns({f"_before_{c}": F.coalesce(F.sum(c).over(lower), F.lit(0)) for c in sums}
                                     | {f"_all_{c}": F.sum(c).over(group) for c in sums})


def picked(placed: DataFrame, sizes: DataFrame, ranks: Callable[[Column], dict[str, Column]], by=()) -> DataFrame:
    """The values at the wanted ranks; of the stored rows only ranges that hold one are read into a window."""
    by = list(by)
    before, n = F.col("_before__c"), F.col("_all__c")
    wanted = ranks(n)
    held = reduce(or_, [(rank > before) & (rank <= before + F.col("_c")) for rank in wanted.values()])
    near = placed.join(sizes.where(held).select(*by, "_range", before, n), [*by, "_range"])
    upto = before + F.sum("_c").over(Window.partitionBy(*by, "_range").orderBy("_v"))
    near = near.withColumn("_upto", upto)
    picks = [F.max(F.when((F.col("_upto") >= rank) & (F.col("_upto") - F.col("_c") < rank), F.col("_v"))).alias(name)
             for name, rank in wanted.items()]
    return near.groupBy(*by).agg(F.max(n).alias("n"), *picks)


def pick_ranks(df: DataFrame, value: str, ranks: Callable[[Column], dict[str, Column]], by=(), weight: str | None = None) -> DataFrame:
    """Values at given ascending ranks (1 = smallest) of a column, per group.

    ``ranks`` maps the row count to the wanted ranks. Null values are ignored. The result has one row per group: ``by``,
    ``n`` and the picks; a rank outside of 1 to n gives null.
    """
    return picked(*ranged(counted(df, value, by, weight), "_v", ["_c"], by), ranks, by)


def middle(n: Column) -> dict[str, Column]:
    return {"_a": F.floor((n + 1) / 2), "_b": F.floor((n + 2) / 2)}


def mean_of_middle(ranks: DataFrame, by, name: str) -> DataFrame:
    return ranks.select(*by, ((F.col("_a") + F.col("_b")) / 2).cast("double").alias(name))


def exact_median(df: DataFrame, value: str, by=(), name: str = "median", weight: str | None = None) -> DataFrame:
    """Exact median of a column with any number of distinct values."""
    return mean_of_middle(pick_ranks(df, value, middle, by, weight), by, name)


def spread(df: DataFrame, value: str, by=()) -> tuple[DataFrame, DataFrame]:
    """The counted values (_v, _c) with their group's median and median absolute deviation; and these two per group."""
    by = list(by)
    placed, sizes = ranged(counted(df, value, by), "_v", ["_c"], by)
    mid = written(mean_of_middle(picked(placed, sizes, middle, by), by, "median"), "medians")

    def with_group(values, stats):
        return lookup(values, stats, by, ["_v"], "inner") if by else attach(values, stats)

    values = with_group(placed.drop("_range"), mid)
    mad = exact_median(values.withColumn("_gap", F.abs(F.col("_v") - F.col("median"))), "_gap", by, "mad", "_c")
    both = attach(mid, mad, by)
    return with_group(placed.drop("_range"), both), both


def median_and_mad(df: DataFrame, value: str, by=()) -> DataFrame:
    """``by``, median and median absolute deviation."""
    return spread(df, value, by)[1]


def robust_z(df: DataFrame, value: str, by=(), out: str = "Z", keep: tuple[str, ...] = ()) -> DataFrame:
    """(x - median) / (1.4826 MAD); 0 when the MAD is 0. ``keep``: median or mad, if wanted as well."""
    z = F.when(F.col("mad") > 0, (F.col(value) - F.col("median")) / (S.MAD_SCALE * F.col("mad"))).otherwise(0.0)
    scored = attach(df, median_and_mad(df, value, by), by).withColumn(out, z)
    return scored.drop(*[c for c in ("median", "mad") if c not in keep])


def top_share(df: DataFrame, value: str, key: str, share: float, out: str) -> DataFrame:
    """Flag the round(n * share) rows with the largest value; ties go to the smallest key.

    A limit of that size would end in one task. Instead the value at the cut is selected, and among
    the rows that tie with it the key at the cut. Only these few numbers come to the driver.
    """
    slim = written(df.select(value, key), "top-share")
    # the k-th largest is the (n - k + 1)-th smallest
    found = pick_ranks(slim, value, lambda n: {
        "cut": n - F.bround(n * share).cast("long") + 1}).withColumn("k", F.bround(F.col("n") * share).cast("long")).first()
    if found is None or not found["k"]:
        return df.withColumn(out, F.lit(False))
    cut, wanted = F.lit(found["cut"]), found["k"]
    sizes = slim.agg(F.count(F.when(F.col(value) > cut, 1)).alias("above"),
                     F.count(F.when(F.col(value) == cut, 1)).alias("ties")).first()
    inside, rest = F.col(value) > cut, wanted - sizes["above"]
    if rest == sizes["ties"]:
        inside = F.col(value) >= cut
    elif rest > 0:
        last = pick_ranks(slim.where(F.col(value) == cut), key, lambda n: {"last": F.lit(rest)}).first()["last"]
        inside = inside | ((F.col(value) == cut) & (F.col(key) <= F.lit(last)))
    return df.withColumn(out, F.coalesce(inside, F.lit(False)))


def totals_below(df: DataFrame, score: str, sums: list[str], by=()) -> DataFrame:
    """Add below_<c>: the total of c over all rows of the group with a smaller score. Scores are unique per group."""
    by = list(by)
    placed, sizes = ranged(df, score, sums, by)
    lower = Window.partitionBy(*by, "_range").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(sizes.select(*by, "_range", *[f"_before_{c}" for c in sums]), [*by, "_range"])
    below = [(F.col(f"_before_{c}") + F.coalesce(F.sum(c).over(lower), F.lit(0))).alias(f"below_{c}") for c in sums]
    return out.select(*df.columns, *below)


def ordered_top(df: DataFrame, k: int, *order) -> DataFrame:
    """Largest rows of a report; Spark keeps k rows per task and merges them."""
    return df.orderBy(*order).limit(k)


def top_per_group(df: DataFrame, by, k: int, *order, rank: str = "Place") -> DataFrame:
    """First k rows of every group; Spark cuts each group to k rows before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
