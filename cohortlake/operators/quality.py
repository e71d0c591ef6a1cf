"""Data-quality report from the control tables."""

from pyspark.sql import DataFrame, functions as F

from cohortlake.functions.measures import ratio

# fixed values: how checks are grouped in the report
CATEGORIES = {
    "missing": ("missing_filled", "missing_imputed", "missing_required"), "duplicates": ("duplicate",),
    "invalid": ("invalid_category", "invalid_number", "invalid_date", "out_of_range"), "orphans": ("orphan_key",)}


def issues_by_check(checks: DataFrame) -> DataFrame:
    return checks.groupBy("CheckName", "Action").agg(F.sum("IssueCount").alias("IssueCount")).orderBy(F.desc("IssueCount"))


def quality_by_table(files: DataFrame, checks: DataFrame) -> DataFrame:
    """Rows, issues and score per table; flagged rows are information, not issues."""
    read = files.groupBy("TableName").agg(F.count(F.lit(1)).alias("Files"), *[
        F.sum(c).alias(c) for c in ("RowsRead", "RowsLoaded", "RowsRejected")])
    issues = checks.where(F.col("Action") != "FLAGGED").groupBy("TableName").agg(F.sum("IssueCount").alias("Issues"))
    out = read.join(issues, "TableName", "left").na.fill(0, ["Issues"])
    return out.withColumn("QualityScore", 1 - ratio("Issues", "RowsRead"))


def data_quality(files: DataFrame, checks: DataFrame) -> DataFrame:
    """The overall score and the issue counts by category, one row."""
    issues = F.coalesce(F.sum(F.when(F.col("Action") != "FLAGGED", F.col("IssueCount"))), F.lit(0))
    groups = [F.coalesce(F.sum(F.when(F.col("CheckName").isin(*names), F.col("IssueCount"))), F.lit(0)).alias(g)
              for g, names in CATEGORIES.items()]
    rows = files.agg(F.struct(F.sum("RowsRead").alias("rows"), F.sum("RowsRejected").alias("rejected"))).scalar()
    return checks.agg(issues.alias("issues"), *groups).select(
        (1 - ratio("issues", rows.getField("rows"))).alias("score"), rows.getField("rows").alias("total_rows"), "issues",
        *CATEGORIES, rows.getField("rejected").alias("rejected"))


def last_good_run(runs: DataFrame) -> DataFrame:
    """The newest successful run, however many failed since."""
    return runs.where(F.col("Status") == "SUCCESS").orderBy(F.desc("RunID")).limit(1)
