"""Registered queries: cleaning, warehouse load, checks and data quality."""

from pyspark.sql import functions as F

from cohortlake import settings as S
from cohortlake.functions import text as X
from cohortlake.operators import assertions as V, cleaning as C, dimensions as D, facts as FT, quality as Q, upsert as U
from cohortlake.plans.driver_tables import DELIVERY, season_of
from cohortlake.plans.oracle_base import query
from cohortlake.plans.registry import register
from cohortlake.session import fresh_path, written
from cohortlake.sources.tables import read_partitioned

# ------------------------------------------------------------------- cleaning
COLS = ["RecordID", "CourseID", "Score", "Amount", "Status", "Date", "Name", "Gender"]
ORDER = "l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
RAW = """SELECT *, CASE l_returnflag WHEN 'A' THEN 'Keldi' WHEN 'N' THEN 'Kelmadi' ELSE 'Sababli' END AS st0 FROM lineitem"""
TEXT = f"""SELECT 'lineitem_' || l_linenumber AS f, {ORDER},
  CASE WHEN l_partkey % 199 <> 0 THEN CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) END AS RecordID,
  CASE WHEN l_partkey % 211 = 0 THEN 'n/a' WHEN l_orderkey % 97 = 0 THEN CAST(l_partkey + 9000000 AS VARCHAR) ELSE CAST(l_partkey AS VARCHAR) END AS CourseID,
  CASE WHEN l_orderkey % 59 = 0 THEN '1000' WHEN l_orderkey % 53 <> 0 THEN CAST(CAST(16 + round(l_discount * 100) AS INT) AS VARCHAR) END AS Score,
  CASE WHEN l_partkey % 41 = 0 THEN CAST(floor(l_extendedprice)::BIGINT // 1000 AS VARCHAR) || ' ' || lpad(CAST(floor(l_extendedprice)::BIGINT % 1000 AS VARCHAR), 3, '0')
    ELSE CAST(floor(l_extendedprice)::BIGINT AS VARCHAR) END AS Amount,
  CASE WHEN l_suppkey % 11 = 0 THEN upper(st0) WHEN l_suppkey % 13 = 0 THEN lower(st0) WHEN l_suppkey % 17 = 0 THEN '  ' || st0 || chr(9)
    WHEN l_suppkey % 19 = 0 THEN 'xx' ELSE st0 END AS Status,
  CASE WHEN l_suppkey % 23 = 0 THEN strftime(l_shipdate, '%-d.%-m.%Y') WHEN l_suppkey % 29 = 0 THEN 'not-a-date' WHEN l_suppkey % 31 = 0 THEN '2099-12-31'
    ELSE strftime(l_shipdate, '%Y-%m-%d') END AS Date,
  CASE WHEN l_suppkey % 3 = 0 THEN 'ali' ELSE 'Vali' END AS Name,
  CASE WHEN l_orderkey % 61 = 0 THEN NULL WHEN l_orderkey % 2 = 0 THEN 'Erkak' ELSE 'ayol' END AS Gender FROM raw0"""
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
TRIMMED = ("SELECT f, " + ORDER + ", " + ", ".join(f"nullif({STRIP.format(c)}, '') AS {c}" for c in COLS) + ", CASE WHEN "
           + " OR ".join(f"coalesce({c} <> {STRIP.format(c)}, false)" for c in COLS) + " THEN 1 ELSE 0 END AS trim1 FROM text0")
PART = f"PARTITION BY f, RecordID, CASE WHEN RecordID IS NULL THEN row({ORDER}) END"
DEDUPED = f"""SELECT * FROM (SELECT *, row_number() OVER ({PART} ORDER BY {', '.join(c + ' DESC' for c in ORDER.split(', '))}) AS rn,
  sum(trim1) OVER ({PART}) AS trims, CASE WHEN RecordID IS NULL THEN 0 ELSE count(*) OVER ({PART}) - 1 END AS dups FROM t) WHERE rn = 1"""
CANON = "CASE lower({0}) WHEN {1} END"
ST = "CASE lower(Status) WHEN 'keldi' THEN 'Keldi' WHEN 'kelmadi' THEN 'Kelmadi' WHEN 'sababli' THEN 'Sababli' END"
GE = "CASE lower(Gender) WHEN 'erkak' THEN 'Erkak' WHEN 'ayol' THEN 'Ayol' END"
PN = "CASE WHEN Name = lower(Name) AND Name <> upper(Name) THEN upper(Name[1]) || Name[2:] ELSE Name END"
ISO = "try_strptime(Date, '%Y-%m-%d')::DATE"
LOC = "try_strptime(Date, '%d.%m.%Y')::DATE"


def _num(c):
    return f"TRY_CAST(replace({c}, ' ', '') AS DOUBLE)"


TYPED = f"""SELECT f, {ORDER}, trims, dups, {', '.join(f'{_num(c)} AS {c}' for c in COLS[:4])}, {ST} AS Status, coalesce({ISO}, {LOC}) AS Date,
  {PN} AS Name, {GE} AS g0,
  CASE WHEN coalesce({PN} <> Name, false) OR coalesce({ST} <> Status, false) OR coalesce({GE} <> Gender, false) THEN 1 ELSE 0 END AS recased,
  CASE WHEN {' OR '.join(f"coalesce(replace({c}, ' ', '') <> {c}, false)" for c in COLS[:4])} OR ({ISO} IS NULL AND {LOC} IS NOT NULL) THEN 1 ELSE 0 END AS retyped,
  CASE WHEN (Status IS NOT NULL AND {ST} IS NULL) OR (Gender IS NOT NULL AND {GE} IS NULL) THEN 'invalid_category'
    WHEN {' OR '.join(f'({c} IS NOT NULL AND {_num(c)} IS NULL)' for c in COLS[:4])} THEN 'invalid_number'
    WHEN Date IS NOT NULL AND coalesce({ISO}, {LOC}) IS NULL THEN 'invalid_date' END AS r1 FROM d"""
FILLED = """SELECT y.* EXCLUDE (Score), CASE WHEN g0 IS NULL AND r1 IS NULL THEN 'Ko''rsatilmagan' ELSE g0 END AS Gender,
  CASE WHEN g0 IS NULL AND r1 IS NULL THEN 1 ELSE 0 END AS filled, Score IS NULL AND r1 IS NULL AS IsImputed,
  CASE WHEN Score IS NULL AND r1 IS NULL THEN round_even(med, 0) ELSE Score END AS Score
FROM y LEFT JOIN (SELECT f AS f2, CourseID AS c2, median(Score) AS med FROM y GROUP BY 1, 2) m ON f2 = f AND c2 = CourseID"""
CHECKED = """SELECT *, coalesce(r1, CASE WHEN RecordID IS NULL OR CourseID IS NULL OR Score IS NULL OR Status IS NULL OR Date IS NULL THEN 'missing_required' END) AS r2 FROM i"""
FINAL = """SELECT *, coalesce(r2, CASE WHEN Score NOT BETWEEN 0 AND 30 OR Amount NOT BETWEEN 0 AND 100000 OR Date NOT BETWEEN DATE '1995-01-01' AND DATE '2001-12-31'
  THEN 'out_of_range' WHEN CourseID NOT IN (SELECT p_partkey FROM part) THEN 'orphan_key' END) AS Reason FROM q"""
STAGES = {"raw0": RAW, "text0": TEXT, "t": TRIMMED, "d": DEDUPED, "y": TYPED, "i": FILLED, "q": CHECKED, "z": FINAL}


def staged(upto: str) -> dict[str, str]:
    names = list(STAGES)
    return {n: STAGES[n] for n in names[:names.index(upto) + 1]}


def clean(u):
    return C.clean(u.deliveries, DELIVERY, {"part": u.table("part").select("p_partkey")}, keep=written)


def typed(u):
    return C.retype(C.standardise(C.delivered_once(u.deliveries, DELIVERY, written), DELIVERY), DELIVERY)


def filled(u):
    """Stored, as the steps that follow read it more than once."""
    return written(C.fill_defaults(typed(u), DELIVERY), "filled")


@register("trim_all", query("SELECT f AS FileName, Status, trim1 AS Trimmed, count(*) AS N FROM t GROUP BY ALL", extra=staged("t")))
def _(u):
    return C.trim_all(u.deliveries, COLS).groupBy(F.col("_file").alias("FileName"), "Status", F.col("_trims").alias("Trimmed")).agg(
        F.count(F.lit(1)).alias("N"))


@register("dedupe_keep_last", query("SELECT f AS FileName, RecordID, CourseID, Amount, Status, Date, dups AS Copies FROM d", extra=staged("d")))
def _(u):
    rows = C.dedupe_keep_last(C.trim_all(u.deliveries, COLS), "RecordID", ["_ord"], written)
    return rows.select(F.col("_file").alias("FileName"), "RecordID", "CourseID", "Amount", "Status", "Date", F.col("_dups").alias("Copies"))


@register("proper_case", query(
    "SELECT lower(c_name) AS Delivered, upper(lower(c_name)[1]) || lower(c_name)[2:] AS Name, c_mktsegment AS Kept FROM customer"))
def _(u):
    low = F.lower("c_name")
    return u.table("customer").select(low.alias("Delivered"), X.proper_case(low).alias("Name"), X.proper_case(F.col("c_mktsegment")).alias("Kept"))


@register("canonicalise", query("SELECT Status AS Delivered, " + ST + " AS Canonical, count(*) AS N FROM d GROUP BY ALL", extra=staged("d")))
def _(u):
    rows = C.dedupe_keep_last(C.trim_all(u.deliveries, COLS), "RecordID", ["_ord"], written)
    return rows.groupBy(F.col("Status").alias("Delivered"), X.canonical(F.col("Status"), S.ATTENDANCE).alias("Canonical")).agg(
        F.count(F.lit(1)).alias("N"))


@register("to_number", query("SELECT f AS FileName, RecordID, CourseID, Score, Amount, r1 AS Reason FROM y", extra=staged("y")))
def _(u):
    return typed(u).select(F.col("_file").alias("FileName"), "RecordID", "CourseID", "Score", "Amount", "Reason")


@register("to_date", query("SELECT f AS FileName, Date, retyped AS Retyped, r1 AS Reason, count(*) AS N FROM y GROUP BY ALL", extra=staged("y")))
def _(u):
    return typed(u).groupBy(F.col("_file").alias("FileName"), "Date", F.col("_retyped").alias("Retyped"), "Reason").agg(
        F.count(F.lit(1)).alias("N"))


@register("fill_default", query("SELECT f AS FileName, Gender, filled AS Filled, count(*) AS N FROM i GROUP BY ALL", extra=staged("i")))
def _(u):
    return C.fill_defaults(typed(u), DELIVERY).groupBy(F.col("_file").alias("FileName"), "Gender", F.col("_filled").alias("Filled")).agg(
        F.count(F.lit(1)).alias("N"))


@register("impute_group_median", query(
    "SELECT f AS FileName, CourseID, Score, count(*) AS N FROM i WHERE IsImputed GROUP BY ALL", extra=staged("i")))
def _(u):
    rows = C.impute_group_median(filled(u), DELIVERY)
    return rows.where("IsImputed").groupBy(F.col("_file").alias("FileName"), "CourseID", "Score").agg(F.count(F.lit(1)).alias("N"))


@register("require", query("SELECT f AS FileName, r2 AS Reason, count(*) AS N FROM q GROUP BY ALL", extra=staged("q")))
def _(u):
    rows = C.require(C.impute_group_median(filled(u), DELIVERY), DELIVERY)
    return rows.groupBy(F.col("_file").alias("FileName"), "Reason").agg(F.count(F.lit(1)).alias("N"))


def _outlier_sql():
    part = """SELECT FileName, 'outlier_{c}' AS CheckName, 'FLAGGED' AS Action, count(*) AS IssueCount FROM (
  SELECT a.f AS FileName, {c}, m, mad FROM (SELECT f, {c} FROM q WHERE r2 IS NULL) a JOIN (
    SELECT x.f, m, median(abs({c} - m)) AS mad FROM (SELECT f, {c} FROM q WHERE r2 IS NULL) x
    JOIN (SELECT f, median({c}) AS m FROM q WHERE r2 IS NULL GROUP BY 1) y2 ON y2.f = x.f GROUP BY 1, 2) s ON s.f = a.f)
WHERE mad > 0 AND abs({c} - m) / (1.4826::DOUBLE * mad) > 6 GROUP BY 1"""
    return part.format(c="Score") + " UNION ALL " + part.format(c="Amount")


@register("flag_outliers", query(_outlier_sql(), extra=staged("q")))
def _(u):
    rows = C.require(C.impute_group_median(filled(u), DELIVERY), DELIVERY)
    return C.flag_outliers(rows, DELIVERY)


@register("split_rejected", query("SELECT f AS FileName, RecordID, Reason FROM (SELECT z.f, t2.RecordID, z.Reason FROM z JOIN d t2 ON t2.f = z.f AND "
                                  "row(" + ", ".join("z." + c.strip() for c in ORDER.split(",")) + ") = row(" + ", ".join("t2." + c.strip() for c in ORDER.split(","))
                                  + ") AND t2.RecordID IS NOT DISTINCT FROM CAST(z.RecordID::BIGINT AS VARCHAR) WHERE Reason IS NOT NULL)", extra=staged("z")))
def _(u):
    return clean(u).rejected().select(F.col("_file").alias("FileName"), "RecordID", "Reason")


@register("first_reason", query("SELECT f AS FileName, Reason, count(*) AS N FROM z GROUP BY ALL", extra=staged("z")))
def _(u):
    return clean(u).rows.groupBy(F.col("_file").alias("FileName"), "Reason").agg(F.count(F.lit(1)).alias("N"))


@register("check_ranges", query("SELECT CASE WHEN Score NOT BETWEEN 0 AND 30 THEN 1 ELSE 0 END AS BadScore, CASE WHEN Date NOT BETWEEN DATE '1995-01-01' AND "
                                "DATE '2001-12-31' THEN 1 ELSE 0 END AS BadDate, count(*) AS N FROM z WHERE Reason = 'out_of_range' GROUP BY ALL", extra=staged("z")))
def _(u):
    rows = clean(u).rows.where(F.col("Reason") == "out_of_range")
    bad_score = F.when(~F.col("Score").between(0, 30), 1).otherwise(0)
    bad_date = F.when(~F.col("Date").between("1995-01-01", "2001-12-31"), 1).otherwise(0)
    return rows.groupBy(bad_score.alias("BadScore"), bad_date.alias("BadDate")).agg(F.count(F.lit(1)).alias("N"))


@register("foreign_key", query("SELECT f AS FileName, CourseID::BIGINT AS CourseID, count(*) AS N FROM z WHERE Reason = 'orphan_key' GROUP BY ALL", extra=staged("z")))
def _(u):
    rows = clean(u).rows.where(F.col("Reason") == "orphan_key")
    return rows.groupBy(F.col("_file").alias("FileName"), F.col("CourseID").cast("long").alias("CourseID")).agg(F.count(F.lit(1)).alias("N"))


@register("good_rows", query("SELECT f AS FileName, RecordID::BIGINT AS RecordID, CourseID::BIGINT AS CourseID, Score, Amount, Status, Date, Name, Gender, "
                             "IsImputed FROM z WHERE Reason IS NULL", extra=staged("z")))
def _(u):
    return clean(u).good().select(F.col("_file").alias("FileName"), *COLS, F.col("IsImputed"))


PAY = """SELECT *, CASE WHEN (o_orderkey % 71) = 0 THEN o_totalprice + 1 WHEN o_orderstatus = 'F' THEN o_totalprice WHEN o_orderstatus = 'P'
  THEN round(o_totalprice / 2, 2) ELSE 0 END AS paid FROM orders"""


@register("derive_payment", query("""SELECT PaymentStatus, Reason, count(*) AS N FROM (SELECT CASE WHEN greatest(o_totalprice - paid, 0) = 0 THEN 'To''liq to''langan'
  WHEN paid > 0 THEN 'Qisman to''langan' ELSE 'To''lanmagan' END AS PaymentStatus, CASE WHEN paid > o_totalprice THEN 'out_of_range' END AS Reason FROM p) GROUP BY ALL""",
                                  extra={"p": PAY}))
def _(u):
    price = F.col("o_totalprice")
    paid = (F.when(F.col("o_orderkey") % 71 == 0, price + 1).when(F.col("o_orderstatus") == "F", price)
            .when(F.col("o_orderstatus") == "P", F.round(price / 2, 2)).otherwise(0.0))
    rows = u.table("orders").select(price.alias("TuitionAmount"), paid.alias("PaidAmount"), F.lit(None).cast("string").alias("Reason"))
    return C.derive_payment(rows).groupBy("PaymentStatus", "Reason").agg(F.count(F.lit(1)).alias("N"))


@register("merge_parts", query("""SELECT Part, FileName, Amount FROM (SELECT CAST(CourseID AS BIGINT) AS Part, f AS FileName, Amount,
  row_number() OVER (PARTITION BY CourseID ORDER BY f DESC, """ + ", ".join(c + " DESC" for c in ORDER.split(", ")) + """, RecordID DESC) AS r
  FROM z WHERE Reason IS NULL) WHERE r = 1""", extra=staged("z")))
def _(u):
    good = clean(u).good().withColumn("FileName", F.col("_file")).withColumn("_ord", F.struct("_ord", "RecordID"))
    return C.merge_parts(good, "CourseID").select(F.col("CourseID").alias("Part"), "FileName", "Amount")


FIXES = {"whitespace_trimmed": "trims", "duplicate": "dups", "format_standardised": "recased", "type_corrected": "retyped",
         "missing_filled": "filled", "missing_imputed": "IsImputed::INT"}
QLOG = " UNION ALL ".join(
    [f"SELECT f AS FileName, '{k}' AS CheckName, 'FIXED' AS Action, sum({c}) AS IssueCount, 'deliveries' AS TableName FROM z GROUP BY 1 HAVING sum({c}) > 0"
     for k, c in FIXES.items()]
    + ["SELECT f, Reason, 'REJECTED', count(*), 'deliveries' FROM z WHERE Reason IS NOT NULL GROUP BY 1, 2",
       f"SELECT *, 'deliveries' AS TableName FROM ({_outlier_sql()})"])
FILES = """SELECT f AS FileName, count(*) + sum(dups) AS RowsRead, sum((Reason IS NULL)::INT) AS RowsLoaded, sum((Reason IS NOT NULL)::INT) AS RowsRejected,
  'deliveries' AS TableName FROM z GROUP BY 1"""


@register("quality_log", query(QLOG, extra=staged("z")))
def _(u):
    return C.quality_log(clean(u))


@register("reject_sample", query("""SELECT FileName, Reason, Place FROM (SELECT f AS FileName, Reason, row_number() OVER (PARTITION BY f, Reason ORDER BY RecordID) AS Place
  FROM z WHERE Reason IS NOT NULL) WHERE Place <= 300""", extra=staged("z")))
def _(u):
    return C.reject_sample(clean(u).rejected()).select("FileName", "Reason", "Place")


@register("file_log", query(FILES, extra=staged("z")))
def _(u):
    return C.file_counts(clean(u))


@register("run_totals", query("SELECT count(*) AS FilesProcessed, sum(RowsRead) AS RowsRead, sum(RowsLoaded) AS RowsLoaded, sum(RowsRejected) AS RowsRejected "
                              f"FROM ({FILES})", extra=staged("z")))
def _(u):
    return C.totals(C.file_counts(clean(u)))


# the event log read as run records: an event opens a run, a purchase ends it well, an error ends it badly
RUNS = """SELECT user_id AS RunID, ts AS happened, CASE event_type WHEN 'purchase' THEN 'SUCCESS' WHEN 'error' THEN 'FAILED' ELSE 'RUNNING' END AS Status FROM events"""


def run_events(u):
    status = F.when(F.col("event_type") == "purchase", "SUCCESS").when(F.col("event_type") == "error", "FAILED").otherwise("RUNNING")
    return u.table("events").select(F.col("user_id").alias("RunID"), F.col("ts").alias("At"), status.alias("Status"), F.lit(None).cast("string").alias("Message"))


@register("run_log", query("SELECT RunID, min(happened) AS StartedAt, max(CASE WHEN Status <> 'RUNNING' THEN happened END) AS FinishedAt, arg_max(Status, happened) AS Status "
                           "FROM r GROUP BY 1", extra={"r": RUNS}))
def _(u):
    return C.run_log(run_events(u)).drop("Message")


@register("data_quality", query(f"""SELECT 1 - sum(CASE WHEN Action <> 'FLAGGED' THEN IssueCount END)::DOUBLE / (SELECT sum(RowsRead) FROM fl) AS score,
  (SELECT sum(RowsRead) FROM fl) AS total_rows, sum(CASE WHEN Action <> 'FLAGGED' THEN IssueCount END) AS issues,
  coalesce(sum(CASE WHEN CheckName IN ('missing_filled', 'missing_imputed', 'missing_required') THEN IssueCount END), 0) AS missing,
  coalesce(sum(CASE WHEN CheckName = 'duplicate' THEN IssueCount END), 0) AS duplicates,
  coalesce(sum(CASE WHEN CheckName IN ('invalid_category', 'invalid_number', 'invalid_date', 'out_of_range') THEN IssueCount END), 0) AS invalid,
  coalesce(sum(CASE WHEN CheckName = 'orphan_key' THEN IssueCount END), 0) AS orphans, (SELECT sum(RowsRejected) FROM fl) AS rejected FROM ql""",
                                extra={**staged("z"), "ql": QLOG, "fl": FILES}))
def _(u):
    cleaned = clean(u)
    return Q.data_quality(C.file_counts(cleaned), C.quality_log(cleaned))


@register("quality_by_table", query("""SELECT 'deliveries' AS TableName, count(*) AS Files, sum(RowsRead) AS RowsRead, sum(RowsLoaded) AS RowsLoaded,
  sum(RowsRejected) AS RowsRejected, (SELECT sum(IssueCount) FROM ql WHERE Action <> 'FLAGGED') AS Issues,
  1 - (SELECT sum(IssueCount) FROM ql WHERE Action <> 'FLAGGED')::DOUBLE / sum(RowsRead) AS QualityScore FROM fl""",
                                    extra={**staged("z"), "ql": QLOG, "fl": FILES}))
def _(u):
    cleaned = clean(u)
    return Q.quality_by_table(C.file_counts(cleaned), C.quality_log(cleaned))


@register("last_good_run", query("""SELECT RunID, Status FROM (SELECT RunID, arg_max(Status, happened) AS Status FROM r GROUP BY 1)
WHERE Status = 'SUCCESS' ORDER BY RunID DESC LIMIT 1""", extra={"r": RUNS}))
def _(u):
    return Q.last_good_run(C.run_log(run_events(u))).select("RunID", "Status")


# ------------------------------------------------------------------ warehouse
ACADEMIC = """SELECT k AS SemesterKey, (1994 + k // 2) || '-' || (1995 + k // 2) AS AcademicYear, CASE WHEN k % 2 = 0 THEN 'Kuz' ELSE 'Bahor' END AS SemesterName,
  CASE WHEN k % 2 = 0 THEN make_date(1994 + k // 2, 9, 1) ELSE make_date(1995 + k // 2, 2, 1) END AS StartDate,
  CASE WHEN k % 2 = 0 THEN make_date(1995 + k // 2, 1, 31) ELSE make_date(1995 + k // 2, 8, 31) END AS EndDate FROM range(18) t(k)"""


def academic(u):
    return D.semester_dim(u.spark, first_year=1994, years=9)


def calendar(u):
    return D.date_dim(academic(u), "1994-09-01", "2003-08-31")


def days(u):
    return u.table("orders").groupBy(F.to_date("o_orderdate").alias("Date")).agg(F.count(F.lit(1)).alias("Orders"))


@register("semester_dim", query("SELECT s.*, AcademicYear || ' ' || SemesterName AS SemesterLabel, (SELECT count(*) FROM orders WHERE o_orderdate::DATE BETWEEN StartDate AND EndDate) "
                                "AS Orders FROM a s", extra={"a": ACADEMIC}))
def _(u):
    per = D.date_in_semester(days(u), academic(u)).groupBy("SemesterKey").agg(F.sum("Orders").alias("Orders"))
    return academic(u).join(per, "SemesterKey", "left").na.fill(0, ["Orders"])


@register("date_dim", query("""SELECT strftime(d, '%Y%m%d')::INT AS DateKey, d AS Date, year(d) AS Year, quarter(d) AS Quarter, month(d) AS Month,
  ['Yanvar','Fevral','Mart','Aprel','May','Iyun','Iyul','Avgust','Sentabr','Oktabr','Noyabr','Dekabr'][month(d)] AS MonthName, day(d) AS Day,
  ['Dushanba','Seshanba','Chorshanba','Payshanba','Juma','Shanba','Yakshanba'][isodow(d)] AS WeekdayName, isodow(d) >= 6 AS IsWeekend,
  (SELECT SemesterKey FROM a WHERE d BETWEEN StartDate AND EndDate) AS SemesterKey, n AS Orders
FROM (SELECT o_orderdate::DATE AS d, count(*) AS n FROM orders GROUP BY 1)""", extra={"a": ACADEMIC}))
def _(u):
    return calendar(u).join(days(u), "Date")


@register("date_in_semester", query("SELECT o_orderkey, (SELECT SemesterKey FROM a WHERE o_orderdate::DATE BETWEEN StartDate AND EndDate) AS SemesterKey FROM orders",
                                    extra={"a": ACADEMIC}))
def _(u):
    orders = u.table("orders").select("o_orderkey", F.to_date("o_orderdate").alias("Date"))
    return D.date_in_semester(orders, academic(u)).select("o_orderkey", "SemesterKey")


CHANGED = """SELECT CASE WHEN c_custkey % 11 = 0 THEN c_custkey + 10000000 ELSE c_custkey END AS c_custkey, c_name, c_nationkey,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 7 <> 0"""
MERGED = """SELECT coalesce(t.c_custkey, s.c_custkey) AS c_custkey, CASE WHEN t.c_custkey IS NULL THEN 'INSERT' WHEN s.c_custkey IS NULL THEN 'KEEP'
  WHEN t.c_acctbal IS DISTINCT FROM s.c_acctbal THEN 'UPDATE' ELSE 'KEEP' END AS Action, CASE WHEN s.c_custkey IS NULL THEN t.c_acctbal ELSE s.c_acctbal END AS c_acctbal,
  coalesce(t.c_name, s.c_name) AS c_name FROM customer t FULL JOIN s ON s.c_custkey = t.c_custkey"""


def merged(u):
    target = u.table("customer")
    key = F.when(F.col("c_custkey") % 11 == 0, F.col("c_custkey") + 10000000).otherwise(F.col("c_custkey"))
    balance = F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal"))
    source = target.where("c_custkey % 7 <> 0").select(key.alias("c_custkey"), "c_name", "c_nationkey", balance.alias("c_acctbal"), "c_mktsegment")
    return U.upsert_type1(target, source, ["c_custkey"])


@register("upsert_type1", query(MERGED, extra={"s": CHANGED}))
def _(u):
    return merged(u).select("c_custkey", F.col("_action").alias("Action"), "c_acctbal", "c_name")


MOVED = """SELECT o_orderkey + CASE WHEN o_orderkey % 11 = 0 THEN 100000000 ELSE 0 END AS PaymentID, (year(o_orderdate) - 1995) * 2 + (month(o_orderdate) > 6)::INT
  + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS SemesterKey, o_totalprice + CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS Amount
  FROM orders WHERE o_orderpriority = '1-URGENT'"""
HELD = "SELECT o_orderkey AS PaymentID, (year(o_orderdate) - 1995) * 2 + (month(o_orderdate) > 6)::INT AS SemesterKey, o_totalprice AS Amount FROM orders"


@register("merge_partitioned", query("SELECT PaymentID, SemesterKey, round(Amount, 2) AS Amount FROM moved UNION ALL SELECT PaymentID, SemesterKey, round(Amount, 2) FROM held "
                                     "WHERE PaymentID NOT IN (SELECT PaymentID FROM moved)", extra={"held": HELD, "moved": MOVED}))
def _(u):
    """Two loads into one table partitioned by semester; in the second, rows are new, changed, as they were, or move to the next semester."""
    orders, path, key = u.table("orders"), fresh_path(u.spark, "payments"), F.col("o_orderkey")
    semester = season_of(F.col("o_orderdate"))
    held = orders.select(key.alias("PaymentID"), semester.alias("SemesterKey"), F.col("o_totalprice").alias("Amount"))
    moved = orders.where("o_orderpriority = '1-URGENT'").select(
        (key + F.when(key % 11 == 0, 100000000).otherwise(0)).alias("PaymentID"), (semester + F.when(key % 3 == 0, 1).otherwise(0)).alias("SemesterKey"),
        (F.col("o_totalprice") + F.when(key % 2 == 0, 1).otherwise(0)).alias("Amount"))
    for rows in (held, moved):
        U.merge_partitioned(u.spark, path, PAYMENTS, rows, ["PaymentID"], "SemesterKey")
    return read_partitioned(u.spark, path, PAYMENTS).withColumn("Amount", F.round("Amount", 2))


PAYMENTS = "PaymentID long, SemesterKey int, Amount double"


@register("load_audit", query("SELECT 'customer' AS TableName, (SELECT count(*) FROM s) AS RowsStaged, sum((Action = 'INSERT')::INT) AS RowsInserted, "
                              "sum((Action = 'UPDATE')::INT) AS RowsUpdated, 0 AS RowsOrphaned FROM m", extra={"s": CHANGED, "m": MERGED}))
def _(u):
    return U.load_audit(merged(u), "customer")


@register("upsert_log", query("SELECT * FROM s UNION ALL SELECT * FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM s)", extra={"s": CHANGED}))
def _(u):
    target = u.table("customer")
    key = F.when(F.col("c_custkey") % 11 == 0, F.col("c_custkey") + 10000000).otherwise(F.col("c_custkey"))
    source = target.where("c_custkey % 7 <> 0").withColumns({
        "c_acctbal": F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")), "c_custkey": key})
    return U.upsert_log(target, source, ["c_custkey"])


STG_ENR = """SELECT l_orderkey * 1000 + l_linenumber AS EnrollmentID, StudentKey AS StudentID, l_partkey AS CourseID, l_suppkey AS TeacherID, AcademicYear, SemesterName AS Semester
FROM lines JOIN a ON Date BETWEEN StartDate AND EndDate"""


def staged_enrollments(u):
    semester = academic(u).select("SemesterKey", "AcademicYear", F.col("SemesterName").alias("Semester"))
    lines = D.date_in_semester(u.lines.drop("SemesterKey"), academic(u)).join(semester, "SemesterKey")
    return lines.select((F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("EnrollmentID"), F.col("StudentKey").alias("StudentID"),
                        F.col("l_partkey").alias("CourseID"), F.col("l_suppkey").alias("TeacherID"), "AcademicYear", "Semester", "Date")


@register("fact_enrollments", query("SELECT e.EnrollmentID, StudentID AS StudentKey, CourseID AS CourseKey, TeacherID AS TeacherKey, SemesterKey "
                                    "FROM e JOIN a ON a.AcademicYear = e.AcademicYear AND a.SemesterName = e.Semester", "lines", extra={"a": ACADEMIC, "e": STG_ENR}))
def _(u):
    return FT.fact_enrollments(staged_enrollments(u), academic(u))


ENROLLED = "SELECT StudentKey, l_partkey AS CourseKey, max(l_suppkey) AS TeacherKey, max(SemesterKey) AS SemesterKey FROM lines GROUP BY 1, 2"


def enrolled(u):
    return u.lines.groupBy("StudentKey", F.col("l_partkey").alias("CourseKey")).agg(
        F.max("l_suppkey").alias("TeacherKey"), F.max("SemesterKey").alias("SemesterKey"))


def staged_grades(u):
    return u.line_facts.select(
        F.monotonically_increasing_id().alias("GradeID"), F.col("StudentKey").alias("StudentID"), F.col("l_partkey").alias("CourseID"),
        "CurrentScore", "MidtermScore", "FinalScore", "AttendanceScore",
        F.when(F.col("IsAdmitted"), S.YES_NO[0]).otherwise(S.YES_NO[1]).alias("ExamAdmitted"), F.lit(False).alias("IsMidtermImputed"))


@register("fact_grades", query("""SELECT g.StudentKey, l_partkey AS CourseKey, e.TeacherKey, e.SemesterKey, CurrentScore, MidtermScore, FinalScore, TotalScore::DOUBLE AS TotalScore,
  IsAdmitted = 1 AS IsAdmitted, FinalGrade, GradePoints::DOUBLE AS GradePoints, 1 + p_size % 5 AS Credits, IsFailed = 1 AS IsFailed
FROM grades g JOIN e ON e.StudentKey = g.StudentKey AND e.CourseKey = g.l_partkey JOIN part ON p_partkey = l_partkey""", "grades", extra={"e": ENROLLED}))
def _(u):
    courses = u.table("part").select(F.col("p_partkey").alias("CourseKey"), (1 + F.col("p_size") % 5).alias("Credits"))
    rows = FT.fact_grades(staged_grades(u), enrolled(u), courses)
    return rows.drop("GradeID", "AttendanceScore", "IsMidtermImputed").withColumns(
        {c: F.col(c).cast("double") for c in ("TotalScore", "GradePoints")})


@register("fact_attendance", query("SELECT l_orderkey, l_partkey AS CourseKey, strftime(Date, '%Y%m%d')::INT AS DateKey, a.SemesterKey, CASE l_returnflag WHEN 'A' THEN 'Keldi' "
                                   "WHEN 'N' THEN 'Kelmadi' ELSE 'Sababli' END AS Status, l_returnflag = 'A' AS IsPresent FROM lines JOIN a ON Date BETWEEN StartDate AND EndDate",
                                   "lines", extra={"a": ACADEMIC}))
def _(u):
    status = F.when(F.col("l_returnflag") == "A", S.ATTENDANCE[0]).when(F.col("l_returnflag") == "N", S.ATTENDANCE[1]).otherwise(S.ATTENDANCE[2])
    stg = u.lines.select(F.col("l_orderkey").alias("AttendanceID"), F.col("StudentKey").alias("StudentID"), F.col("l_partkey").alias("CourseID"), "Date", status.alias("Status"))
    return FT.fact_attendance(stg, calendar(u)).withColumnRenamed("AttendanceID", "l_orderkey").drop("StudentKey")


@register("fact_payments", query("SELECT PaymentID, StudentKey, strftime(PaymentDate, '%Y%m%d')::INT AS DateKey, a.SemesterKey, TuitionAmount::DOUBLE AS TuitionAmount, "
                                 "PaidAmount::DOUBLE AS PaidAmount, RemainingDebt::DOUBLE AS RemainingDebt FROM payments JOIN a ON PaymentDate BETWEEN StartDate AND EndDate",
                                 "payments", extra={"a": ACADEMIC}))
def _(u):
    stg = u.payments.drop("DateKey", "SemesterKey").withColumnRenamed("StudentKey", "StudentID").withColumn("PaymentStatus", F.lit(""))
    rows = FT.fact_payments(stg, calendar(u)).drop("PaymentStatus")
    return rows.withColumns({c: F.col(c).cast("double") for c in ("TuitionAmount", "PaidAmount", "RemainingDebt")})


@register("fact_assignments", query("""SELECT l.l_orderkey, l.StudentKey, l_partkey AS CourseKey, e.SemesterKey, strftime(Date, '%Y%m%d')::INT AS DueDateKey,
  CASE WHEN l_linestatus = 'F' THEN strftime(l_shipdate, '%Y%m%d')::INT END AS SubmissionDateKey, l_linestatus = 'F' AS IsSubmitted,
  l_linestatus = 'F' AND l_shipdate::DATE > Date + 60 AS IsLate FROM lines l JOIN e ON e.StudentKey = l.StudentKey AND e.CourseKey = l_partkey""", "lines", extra={"e": ENROLLED}))
def _(u):
    handed, late = F.col("l_linestatus") == "F", F.to_date("l_shipdate") > F.date_add("Date", 60)
    status = F.when(~handed, S.SUBMISSION[2]).when(late, S.SUBMISSION[1]).otherwise(S.SUBMISSION[0])
    stg = u.lines.select(F.col("l_orderkey").alias("AssignmentID"), F.col("StudentKey").alias("StudentID"), F.col("l_partkey").alias("CourseID"),
                         F.col("Date").alias("DueDate"), F.when(handed, F.to_date("l_shipdate")).alias("SubmissionDate"), F.col("l_quantity").alias("Score"),
                         status.alias("SubmissionStatus"))
    return FT.fact_assignments(stg, enrolled(u), calendar(u)).withColumnRenamed("AssignmentID", "l_orderkey").drop("Score", "SubmissionStatus")


@register("fact_warnings", query("SELECT WarningID, StudentKey, strftime(WarningDate, '%Y%m%d')::INT AS DateKey, a.SemesterKey, WarningType, Severity FROM warnings "
                                 "JOIN a ON WarningDate BETWEEN StartDate AND EndDate", "warnings", extra={"a": ACADEMIC}))
def _(u):
    return FT.fact_warnings(u.warnings.drop("SemesterKey").withColumnRenamed("StudentKey", "StudentID"), calendar(u))


@register("full_name", query("SELECT s_suppkey, n_name || ' ' || s_name AS FullName FROM supplier JOIN nation ON n_nationkey = s_nationkey"))
def _(u):
    nation = u.table("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return u.table("supplier").join(nation, "s_nationkey").select("s_suppkey", FT.full_name("n_name", "s_name").alias("FullName"))


# ---------------------------------------------------------------------- checks
GAPS = "AttendanceRate IS NULL OR SubmissionRate IS NULL OR StudySemester NOT BETWEEN 1 AND 8"
CHECK_SQL = f"""SELECT 'Orders: no duplicate keys' AS Name, count(*) = count(DISTINCT o_orderkey) AND count(*) > 0 AS Passed, count(*) AS Found FROM orders
UNION ALL SELECT 'Lines: no duplicate keys', count(*) = count(DISTINCT l_orderkey * 10 + l_linenumber), count(*) FROM lineitem
UNION ALL SELECT 'every line has an order', count(*) = 0, count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'scores within valid range', count(*) = 0, count(*) FROM grades WHERE NOT (CurrentScore BETWEEN 0 AND 20 AND MidtermScore BETWEEN 0 AND 30 AND FinalScore BETWEEN 0 AND 50 AND GradePoints BETWEEN 2 AND 5)
UNION ALL SELECT 'grade agrees with the pass mark', count(*) = 0, count(*) FROM grades WHERE (TotalScore < 60) <> (IsFailed = 1)
UNION ALL SELECT 'payments: paid + debt = tuition', count(*) = 0, count(*) FROM payments WHERE PaidAmount + RemainingDebt <> TuitionAmount
UNION ALL SELECT 'snapshot covers every student-semester', (SELECT count(*) FROM snap) = (SELECT count(*) FROM (SELECT DISTINCT StudentKey, SemesterKey FROM grades)), (SELECT count(*) FROM snap)
UNION ALL SELECT 'snapshot has complete measures', count(*) = 0, count(*) FROM snap WHERE {GAPS}"""


def checks(u):
    lines = u.table("lineitem").select("l_orderkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"))
    orders = u.table("orders").select(F.col("o_orderkey").alias("l_orderkey"))
    return V.all_of(V.unique_key(orders, "Orders", "l_orderkey"), V.unique_key(lines, "Lines", "k"),
                    V.has_parent(lines, orders, ["l_orderkey"], "every line has an order"), V.scores_in_range(u.scored_lines),
                    V.grade_agrees(u.scored_lines), V.amounts_add_up(u.payments), V.snapshot_covers(u.snap, u.scored_lines),
                    V.snapshot_complete(u.snap))


@register("load_assertions", query(CHECK_SQL, "grades", "payments", "snap"), gold=True)
def _(u):
    return checks(u)


@register("run_status", query("SELECT CASE WHEN bool_and(Passed) THEN 'SUCCESS' ELSE 'FAILED' END AS Status, CASE WHEN bool_and(Passed) THEN count(*) || ' tests passed' ELSE "
                              "string_agg(CASE WHEN NOT Passed THEN Name END, '; ' ORDER BY Name) END AS Message FROM c", "grades", "payments", "snap", extra={"c": CHECK_SQL}), gold=True)
def _(u):
    return V.run_status(checks(u))
