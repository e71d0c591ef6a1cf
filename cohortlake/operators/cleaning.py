"""Rule-driven cleaning: text rows in, typed rows with a first rejection reason out.

Rules are column expressions; the only shuffles are the de-duplication, the group medians and the
foreign-key joins. Rows are never dropped on the way: rejected ones carry their reason and raw text.
"""

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import cached_property, reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlake import settings as S
from cohortlake.functions.measures import flag
from cohortlake.functions.selection import counted, exact_median, spread, top_per_group
from cohortlake.functions.skew import SALTS, last_per_key, lookup, lookup_rare
from cohortlake.functions import text as X

#: Orphan keys that are broadcast; of these numbers, a megabyte or two.
FEW = 100_000
#: Rows of one key that are too many for one task.
HOT = 100_000
#: Groups of keys that are counted together to find such keys.
BUCKETS = 1 << 16
#: Rows that one task puts in order in memory, where there are more than Spark's number of shuffle partitions makes smaller.
ROWS_PER_TASK = 400_000
COUNTERS = {"_trims": "whitespace_trimmed", "_dups": "duplicate", "_recased": "format_standardised",
            "_retyped": "type_corrected", "_filled": "missing_filled", "_imputed": "missing_imputed"}


@dataclass(frozen=True)
class TableSpec:
    """What a delivered table must look like. Rules apply in the order of the fields."""

    name: str
    pk: str
    columns: tuple[str, ...]
    names: tuple[str, ...] = ()
    cats: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    ints: tuple[str, ...] = ()
    floats: tuple[str, ...] = ()
    dates: tuple[str, ...] = ()
    defaults: Mapping[str, str] = field(default_factory=dict)
    impute: Mapping[str, str] = field(default_factory=dict)
    required: tuple[str, ...] = ()
    outliers: tuple[str, ...] = ()
    ranges: Mapping[str, tuple[float, float]] = field(default_factory=dict)
    date_ranges: Mapping[str, tuple[str, str]] = field(default_factory=dict)
    foreign: Mapping[str, str] = field(default_factory=dict)
    payment_rules: bool = False


def any_of(tests: list[Column]) -> Column:
    return reduce(or_, [F.coalesce(t, F.lit(False)) for t in tests], F.lit(False))


def first_reason(rules: list[tuple[Column, str]], earlier: Column | None = None) -> Column:
    """The first rule that fires, after any reason the row already has."""
    steps = [F.when(test, why) for test, why in rules]
    return F.coalesce(*([earlier] if earlier is not None else []), *steps, F.lit(None).cast("string"))


def trim_all(df: DataFrame, columns) -> DataFrame:
    """Strip every column, empty becomes null; _trims marks rows that changed; raw text is kept.

    Here and below, what is costly to work out is a column of its own before it is used twice, or Spark would work it out again.
    """
    bare = df.select("*", *[X.stripped(F.col(c)).alias(f"_s_{c}") for c in columns])
    changed = any_of([F.col(c) != F.col(f"_s_{c}") for c in columns])
    rest = [c for c in df.columns if c not in columns]
    return bare.select(*rest, *[F.nullif(F.col(f"_s_{c}"), F.lit("")).alias(c) for c in columns],
                       F.struct(*columns).alias("_raw"), flag(changed).alias("_trims"))


def hot_keys(df: DataFrame, key: list[str], present: Column, keep) -> tuple[DataFrame | None, int | None]:
    """Keys of more than HOT rows (None: there are none), and the number of all rows where ``keep`` stores counts.

    Stored counts are of BUCKETS groups of keys, so that next to nothing moves; only keys of groups of more than HOT rows are counted themselves.
    """
    def exact(rows):
        return rows.where(present).groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT).select(*key)

    if not keep:
        return exact(df), None
    bucket = F.when(present, F.pmod(F.xxhash64(*key), F.lit(BUCKETS)))
    sizes = keep(df.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n")), "hot-keys")
    full = sizes.where(F.col("_bucket").isNotNull() & (F.col("_n") > HOT)).select("_bucket")
    rows, some = sizes.agg(F.sum("_n"), F.max(F.when(F.col("_bucket").isNotNull(), F.col("_n")))).first()
    if (some or 0) <= HOT:
        return None, rows
    hot = keep(exact(df.withColumn("_bucket", bucket).join(F.broadcast(full), "_bucket", "left_semi").drop("_bucket")), "hot-keys")
    return (None if hot.isEmpty() else hot), rows


def moved(df: DataFrame, columns: list[str], rows: int | None) -> DataFrame:
    """Rows dealt out by columns: over Spark's own number of partitions, or more where these would hold over ROWS_PER_TASK rows."""
    tasks = (rows or 0) // ROWS_PER_TASK + 1
    own = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, *columns) if tasks > own else df.repartition(*columns)


def dedupe_keep_last(df: DataFrame, pk: str, order: list[str], keep=None) -> DataFrame:
    """Within a file the last row of every key; rows without a key all stay. Copies are counted.

    Rows move once, by their key, with only the columns that later steps read. Keys are counted first, by themselves: one of more
    than HOT rows (few by nature, so they are broadcast) would fill a task, and its rows are compared before they move.
    ``keep`` may store these counts; where there are no such keys, nothing is looked up.
    """
    key, present = ["_file", pk], F.col(pk).isNotNull() & F.col("_file").isNotNull()
    hot, rows = hot_keys(df, key, present, keep)
    cheap = df if hot is None else df.join(F.broadcast(hot), key, "left_anti")
    # rows without a key lie anywhere
    place = [pk, "_file", "_apart"]
    cheap = moved(cheap.withColumn("_apart", F.when(~present, F.xxhash64(*order))), place, rows)
    own = Window.partitionBy(*place).orderBy(*[F.desc(o) for o in order])
    copies_of = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = cheap.withColumns({
        "_at": F.row_number().over(own), "_all_trims": F.sum("_trims").over(copies_of),
        "_dups": F.when(present, F.count(F.lit(1)).over(copies_of) - 1).otherwise(0).cast("int")}).where(~present | (F.col("_at") == 1))
    trims = F.when(present, F.col("_all_trims")).otherwise(F.col("_trims")).cast(df.schema["_trims"].dataType)
    last = last.withColumn("_trims", trims).drop("_at", "_all_trims", "_apart")
    if hot is None:
        return last
    copies = [F.sum("_trims").alias("_all_trims"), (F.count(F.lit(1)) - 1).cast("int").alias("_dups")]
    many = last_per_key(df.join(F.broadcast(hot), key, "left_semi"), key, order, copies)
    return last.unionByName(many.withColumn("_trims", F.col("_all_trims").cast(df.schema["_trims"].dataType)).drop("_all_trims"))


def delivered_once(df: DataFrame, spec: TableSpec, keep=None) -> DataFrame:
    """C1 + C2. The rows move as delivered, and are stripped again where they arrive: that costs less than moving both texts."""
    columns = list(spec.columns)
    rows = dedupe_keep_last(trim_all(df, columns), spec.pk, ["_ord"], keep).drop(*columns)
    bare = rows.select("*", *[X.stripped(F.col("_raw").getField(c)).alias(c) for c in columns])
    return bare.select(*rows.columns, *[F.nullif(F.col(c), F.lit("")).alias(c) for c in columns])


def standardise(df: DataFrame, spec: TableSpec) -> DataFrame:
    """C3 + C4: names in proper case, categories in the vocabulary's spelling."""
    done = {f"_p_{c}": X.proper_case(F.col(c)) for c in spec.names} | {f"_p_{c}": X.canonical(F.col(c), words) for c, words in spec.cats.items()}
    changed = any_of([F.col(f"_p_{c}") != F.col(c) for c in (*spec.names, *spec.cats)])
    unknown = [(F.col(c).isNotNull() & F.col(f"_p_{c}").isNull(), "invalid_category") for c in spec.cats]
    new = {c: F.col(f"_p_{c}") for c in (*spec.names, *spec.cats)}
    return df.withColumns(done).withColumns({"_recased": flag(changed), "Reason": first_reason(unknown), **new}).drop(*done)


def retype(df: DataFrame, spec: TableSpec) -> DataFrame:
    """C5 + C6: numbers written with blanks, dates in two notations."""
    numeric = [*spec.ints, *spec.floats]
    read = {f"_n_{c}": X.number(F.col(c)) for c in numeric} | {f"_i_{c}": X.iso_date(F.col(c)) for c in spec.dates}
    read |= {f"_l_{c}": X.local_date(F.col(c)) for c in spec.dates}
    values = {c: X.without_fraction(F.col(f"_n_{c}")) if c in spec.ints else F.col(f"_n_{c}") for c in numeric}
    values |= {c: F.coalesce(f"_i_{c}", f"_l_{c}") for c in spec.dates}
    changed = any_of([X.compact(F.col(c)) != F.col(c) for c in numeric]
                     + [F.col(f"_i_{c}").isNull() & F.col(f"_l_{c}").isNotNull() for c in spec.dates])
    rules = [(F.col(c).isNotNull() & values[c].isNull(), "invalid_number") for c in numeric]
    rules += [(F.col(c).isNotNull() & values[c].isNull(), "invalid_date") for c in spec.dates]
    return df.withColumns(read).withColumns({
        "_retyped": flag(changed), "Reason": first_reason(rules, F.col("Reason")), **values}).drop(*read)


def fill_defaults(df: DataFrame, spec: TableSpec) -> DataFrame:
    """A default for missing values of rows not rejected so far."""
    def missing(c):
        return F.col(c).isNull() & F.col("Reason").isNull()

    filled = {c: F.when(missing(c), v).otherwise(F.col(c)) for c, v in spec.defaults.items()}
    count = sum((flag(missing(c)) for c in spec.defaults), F.lit(0))
    return df.withColumns({"_filled": count, **filled})


def impute_group_median(df: DataFrame, spec: TableSpec) -> DataFrame:
    """The median of the file's group, over all its rows, rounded half-even.

    Only groups that lack a value are looked at beyond the count of their values, and only rows that lack one move to meet their
    median; a group of many such rows is spread over SALTS tasks, and its median is copied to those of them that have rows.
    """
    df = df.withColumn("_imputed", F.lit(0))
    for c, by in spec.impute.items():
        mark, group = f"Is{c.replace('Score', '')}Imputed", ["_file", by]
        missing = F.col(c).isNull() & F.col("Reason").isNull()
        lacking = df.where(missing).withColumn("_salt", F.pmod(F.xxhash64(spec.pk, "_raw"), F.lit(SALTS)).cast("int"))
        places = lacking.select(*group, "_salt").distinct()
        values = counted(df, c, group).join(places.select(*group).distinct(), group, "left_semi")
        medians = exact_median(values, "_v", group, "_median", "_c")
        filled = lacking.join(places.join(medians, group), [*group, "_salt"], "left").withColumns(
            {c: F.bround("_median", 0), mark: F.lit(True), "_imputed": F.col("_imputed") + 1})
        rest = df.where(~missing).withColumn(mark, F.lit(False))
        df = rest.unionByName(filled.select(*rest.columns))
    return df


def require(df: DataFrame, spec: TableSpec) -> DataFrame:
    """A missing required value."""
    return df.withColumn("Reason", first_reason(
        [(F.col(c).isNull(), "missing_required") for c in spec.required], F.col("Reason")))


def flag_outliers(df: DataFrame, spec: TableSpec, k: float = S.OUTLIER_K) -> DataFrame:
    """Per file the number of values far from the median, among rows not rejected so far. All columns go together."""
    if not spec.outliers:
        return None
    each = [F.struct(F.lit(c).alias("_column"), F.col(c).cast("double").alias("_x")) for c in spec.outliers]
    listed = df.where(F.col("Reason").isNull()).select("_file", F.inline(F.array(*each)))
    values, _ = spread(listed, "_x", ["_file", "_column"])
    far = F.abs(F.col("_v") - F.col("median")) / (S.MAD_SCALE * F.col("mad")) > k
    found = values.where(F.col("mad") > 0).where(far).groupBy("_file", "_column").agg(F.sum("_c").alias("IssueCount"))
    return found.select(F.col("_file").alias("FileName"), F.concat(F.lit("outlier_"), "_column").alias("CheckName"),
                        F.lit("FLAGGED").alias("Action"), "IssueCount")


def check_ranges(df: DataFrame, spec: TableSpec) -> DataFrame:
    """C11 + C12: inclusive limits for numbers and dates; missing values pass."""
    rules = [(~F.col(c).between(lo, hi), "out_of_range") for c, (lo, hi) in spec.ranges.items()]
    rules += [(~F.col(c).between(F.lit(lo).cast("date"), F.lit(hi).cast("date")), "out_of_range")
              for c, (lo, hi) in spec.date_ranges.items()]
    return df.withColumn("Reason", first_reason(rules, F.col("Reason")))


def check_foreign_keys(df: DataFrame, spec: TableSpec, parents: Mapping[str, DataFrame], keep=None, values: DataFrame | None = None) -> DataFrame:
    """The value must exist among the parent's keys (a one-column frame); missing values pass.

    Orphans are found among the distinct values, counted together with the parent's keys, so rows meet these alone and not the
    parent's keys. Either list may be long and its file small enough for Spark to broadcast it, so neither is left to its size check.
    With ``keep`` orphans are stored and counted. Up to FEW are broadcast, so that no row is shuffled; of more, only rows whose value
    may be among them move (``lookup_rare``). Uncounted ones are joined in a way that spreads every key over many tasks. ``values``
    has the same rows before gaps were filled, which is less work to read.
    """
    for c, parent in spec.foreign.items():
        source = df if values is None or c in spec.impute else values
        keys = parents[parent]
        keys = keys.select(F.col(keys.columns[0]).cast("double").alias(c), F.lit(0).alias("_one"), F.lit(True).alias("_known"))
        both = source.select(c, F.lit(1).alias("_one"), F.lit(False).alias("_known")).unionByName(keys).where(F.col(c).isNotNull())
        orphans = (both.groupBy(c).agg(F.sum("_one").alias("_rows"), F.bool_or("_known").alias("_known"))
                   .where(~F.col("_known")).select(c, "_rows", F.lit(True).alias("_orphan")))
        orphans = keep(orphans, "orphans") if keep else orphans
        if not keep:
            df = lookup(df, orphans.drop("_rows").hint("merge"), [c], [spec.pk, "_raw"])
        elif orphans.limit(FEW + 1).count() <= FEW:
            df = df.join(F.broadcast(orphans.drop("_rows")), c, "left")
        else:
            df = lookup_rare(df, orphans, c, [spec.pk, "_raw"], "_rows").drop("_rows")
        df = df.withColumn("Reason", first_reason([(F.col("_orphan"), "orphan_key")], F.col("Reason"))).drop("_orphan")
    return df


def derive_payment(df: DataFrame) -> DataFrame:
    """C14: open debt and payment status follow from the amounts; overpayment is rejected."""
    tuition, paid = F.col("TuitionAmount"), F.col("PaidAmount")
    debt = F.when((tuition - paid).isNotNull(), F.greatest(tuition - paid, F.lit(0.0)))
    status = F.when(debt == 0, S.PAYMENT_STATUS[0]).when(paid > 0, S.PAYMENT_STATUS[1]).otherwise(S.PAYMENT_STATUS[2])
    return df.withColumns({"RemainingDebt": debt, "PaymentStatus": status,
                           "Reason": first_reason([(paid > tuition, "out_of_range")], F.col("Reason"))})


@dataclass
class Cleaned:
    """All rows of a delivery with their reasons, and the rows that the outlier check looks at."""

    rows: DataFrame
    spec: TableSpec
    checked: DataFrame

    @cached_property
    def outliers(self) -> DataFrame | None:
        """C10, worked out when a log asks for it."""
        return flag_outliers(self.checked, self.spec)

    def good(self) -> DataFrame:
        """Accepted rows, whole numbers as integers."""
        names = [*self.spec.columns, *[f"Is{c.replace('Score', '')}Imputed" for c in self.spec.impute]]
        extra = [c for c in ("RemainingDebt", "PaymentStatus") if self.spec.payment_rules and c not in names]
        cast = {c: F.col(c).cast("long") for c in self.spec.ints}
        return self.rows.where(F.col("Reason").isNull()).select(
            "_file", "_ord", *[cast.get(c, F.col(c)).alias(c) for c in [*names, *extra]])

    def rejected(self) -> DataFrame:
        """Rejected rows as they were delivered, with the reason."""
        return self.rows.where(F.col("Reason").isNotNull()).select("_file", "_ord", "Reason", "_raw.*")


def clean(df: DataFrame, spec: TableSpec, parents: Mapping[str, DataFrame] | None = None, keep=None) -> Cleaned:
    """C1-C16 in order. ``df`` has the text columns, _file and _ord (delivery order).

    ``keep`` may store rows (for example ``session.written``) once a key's last row is known and its texts are read. All that
    follows is worked out from these: the medians, the outlier check and the foreign keys read their own columns alone.
    """
    once = fill_defaults(retype(standardise(delivered_once(df, spec, keep), spec), spec), spec)
    once = keep(once, spec.name) if keep else once
    checked = require(impute_group_median(once, spec), spec)
    rows = check_foreign_keys(check_ranges(checked, spec), spec, parents or {}, keep, once)
    if spec.payment_rules:
        rows = derive_payment(rows)
    return Cleaned(rows, spec, checked)


def merge_parts(good: DataFrame, pk: str) -> DataFrame:
    """C17: of all files of a table the last file's row of every key."""
    return last_per_key(good, [pk], ["_file", "_ord"], keep_null_keys=False).drop("_file", "_ord")


def quality_log(cleaned: Cleaned) -> DataFrame:
    """Issues per file and check. Every row lists what happened to it; one aggregation counts."""
    issues = [F.struct(F.lit(check).alias("CheckName"), F.lit("FIXED").alias("Action"), F.col(c).cast("long").alias("n"))
              for c, check in COUNTERS.items()]
    issues.append(F.struct(F.col("Reason").alias("CheckName"), F.lit("REJECTED").alias("Action"),
                           flag(F.col("Reason").isNotNull()).cast("long").alias("n")))
    listed = cleaned.rows.select(F.col("_file").alias("FileName"), F.inline(F.filter(F.array(*issues), lambda x: x.getField("n") > 0)))
    log = listed.groupBy("FileName", "CheckName", "Action").agg(F.sum("n").alias("IssueCount"))
    if cleaned.outliers is not None:
        log = log.unionByName(cleaned.outliers)
    return log.withColumn("TableName", F.lit(cleaned.spec.name))


def reject_sample(rejected: DataFrame, n: int = S.REJECT_SAMPLE) -> DataFrame:
    """The first n rejected rows per file and reason, the raw row as JSON without nulls."""
    raw = [c for c in rejected.columns if c not in ("_file", "_ord", "Reason")]
    picked = top_per_group(rejected, ["_file", "Reason"], n, F.asc("_ord"))
    return picked.select(F.col("_file").alias("FileName"), "Reason", "Place", F.to_json(F.struct(*raw)).alias("RawRecord"))


def file_counts(cleaned: Cleaned) -> DataFrame:
    """C20: rows read, loaded and rejected per file."""
    return cleaned.rows.groupBy(F.col("_file").alias("FileName")).agg(
        (F.count(F.lit(1)) + F.sum("_dups")).alias("RowsRead"),
        F.count(F.when(F.col("Reason").isNull(), 1)).alias("RowsLoaded"), F.count("Reason").alias("RowsRejected"),
    ).withColumn("TableName", F.lit(cleaned.spec.name))


def totals(counts: DataFrame) -> DataFrame:
    """Files and rows of a run."""
    return counts.agg(F.count(F.lit(1)).alias("FilesProcessed"), *[
        F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("RowsRead", "RowsLoaded", "RowsRejected")])


def run_log(events: DataFrame) -> DataFrame:
    """The present state of every run from its start and finish records."""
    return events.groupBy("RunID").agg(F.min("At").alias("StartedAt"), F.max(F.when(F.col("Status") != "RUNNING", F.col("At"))).alias("FinishedAt"),
                                       F.max_by("Status", F.struct("At", F.col("Status") != "RUNNING")).alias("Status"),
                                       F.max("Message").alias("Message"))
