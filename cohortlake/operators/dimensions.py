"""Calendar dimensions."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlake import settings as S


def semester_dim(spark: SparkSession, first_year: int = S.FIRST_ACADEMIC_YEAR,
                 years: int = S.ACADEMIC_YEARS) -> DataFrame:
    """Two semesters per academic year; autumn keys are even, spring keys odd."""
    y = F.col("id").cast("int")
    label = F.concat_ws("-", y.cast("string"), (y + 1).cast("string"))
    year = spark.range(first_year, first_year + years)

    def season(offset, name, start, end):
        return year.select(
            ((y - first_year) * 2 + offset).alias("SemesterKey"), label.alias("AcademicYear"),
            F.lit(name).alias("SemesterName"), F.concat_ws(" ", label, F.lit(name)).alias("SemesterLabel"),
            start.alias("StartDate"), end.alias("EndDate"))

    day = F.make_date
    autumn = season(0, S.SEASONS[0], day(y, F.lit(9), F.lit(1)), day(y + 1, F.lit(1), F.lit(31)))
    spring = season(1, S.SEASONS[1], day(y + 1, F.lit(2), F.lit(1)), day(y + 1, F.lit(8), F.lit(31)))
    return autumn.unionAll(spring)


def date_dim(semesters: DataFrame, first: str = S.FACT_DATES[0], last: str = S.FACT_DATES[1]) -> DataFrame:
    """One row per day with calendar attributes and its semester (null outside all semesters)."""
    spark = semesters.sparkSession
    span = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))
    days = spark.range(1).select(F.explode(span).alias("Date"))
    weekday = F.weekday("Date")
    dim = days.select(
        F.date_format("Date", "yyyyMMdd").cast("int").alias("DateKey"), "Date", F.year("Date").alias("Year"),
        F.quarter("Date").alias("Quarter"), F.month("Date").alias("Month"),
        F.element_at(F.array(*[F.lit(m) for m in S.MONTHS]), F.month("Date")).alias("MonthName"),
        F.dayofmonth("Date").alias("Day"),
        F.element_at(F.array(*[F.lit(d) for d in S.WEEKDAYS]), weekday + 1).alias("WeekdayName"),
        (weekday >= 5).alias("IsWeekend"))
    return date_in_semester(dim, semesters)


def date_in_semester(days: DataFrame, semesters: DataFrame) -> DataFrame:
    """The semester whose date range holds the day.

    Each semester is unfolded to its days, which turns the range condition into an equality:
    a few thousand rows instead of comparing every day with every semester.
    """
    own = semesters.select("SemesterKey", F.explode(F.sequence("StartDate", "EndDate")).alias("Date"))
    return days.join(own, "Date", "left")
