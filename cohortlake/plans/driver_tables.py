"""The generic order tables read as a university, so that every operator runs on real tables.

Customers are students, regions faculties, nations departments, suppliers teachers, brands
courses, order lines grades, orders invoices, events the staff log. The half-year of the order
date is the semester: 0 is the first half of 1995.
"""

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortlake import settings as S
from cohortlake.functions.measures import grade_of
from cohortlake.operators import frames, performance, risk as R, snapshot
from cohortlake.operators.cleaning import TableSpec
from cohortlake.plans.fixed_scorer import THRESHOLD, linear_scorer
from cohortlake.session import written

YEAR0 = 1995
LIMITS = S.Thresholds(min_enrollment=30, min_group=20, teacher_overload=60)


def season_of(date: Column) -> Column:
    return ((F.year(date) - YEAR0) * 2 + F.when(F.month(date) > 6, 1).otherwise(0)).cast("int")


_gold: dict[tuple, DataFrame] = {}


def gold_frame(fn):
    """A derived frame that reports read again and again.

    With ``gold=True`` it is written to the shared folder once per session and folder of tables,
    as a nightly load would do, and then read from there; otherwise it is part of the plan.
    """
    def get(self):
        if not self.gold:
            return fn(self)
        key = (self.spark.sparkContext.applicationId, self.folder, fn.__name__)
        if key not in _gold:
            _gold[key] = written(fn(self), fn.__name__)
        return _gold[key]
    get.__doc__ = fn.__doc__
    return property(get)


def refresh_gold() -> None:
    """Forget the written frames, so that the next report builds them anew."""
    _gold.clear()


DELIVERY = TableSpec(
    "deliveries", "RecordID", ("RecordID", "CourseID", "Score", "Amount", "Status", "Date", "Name", "Gender"),
    names=("Name",), cats={"Status": S.ATTENDANCE, "Gender": S.GENDER}, ints=("RecordID", "CourseID"),
    floats=("Score", "Amount"), dates=("Date",), defaults={"Gender": S.GENDER_UNKNOWN}, impute={"Score": "CourseID"},
    required=("RecordID", "CourseID", "Score", "Status", "Date"), outliers=("Score", "Amount"),
    ranges={"Score": (0, 30), "Amount": (0, 100000)}, date_ranges={"Date": ("1995-01-01", "2001-12-31")},
    foreign={"CourseID": "part"})


class University:
    """Lazy frames over one folder of tables. Nothing is read before a result is asked for."""

    def __init__(self, spark: SparkSession, folder: str, gold: bool = False):
        self.spark, self.folder, self.gold = spark, folder, gold

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # ---------------------------------------------------------------- dimensions
    @cached_property
    def faculties(self) -> DataFrame:
        return self.table("region").select(F.col("r_regionkey").alias("FacultyKey"), F.col("r_name").alias("FacultyName"))

    @cached_property
    def departments(self) -> DataFrame:
        return self.table("nation").select(
            F.col("n_nationkey").alias("DepartmentKey"), F.col("n_name").alias("DepartmentName"),
            F.col("n_regionkey").alias("FacultyKey"))

    @cached_property
    def students(self) -> DataFrame:
        key = F.col("c_custkey")
        status = (F.when(key % 10 == 0, S.STUDENT_STATUS[1]).when(key % 10 <= 2, S.STUDENT_STATUS[2])
                  .otherwise(S.STUDENT_STATUS[0]))
        return (self.table("customer")
                .join(self.departments.select(F.col("DepartmentKey").alias("c_nationkey"), "FacultyKey"), "c_nationkey")
                .select(key.alias("StudentKey"), F.col("c_name").alias("FullName"),
                        F.col("c_mktsegment").alias("GroupName"), "FacultyKey",
                        F.col("c_nationkey").alias("DepartmentKey"),
                        (YEAR0 + key % 4).cast("int").alias("EnrollmentYear"),
                        (1 + key % 4).cast("int").alias("StudyYear"),
                        F.when(key % 5 == 0, S.TUITION_STATUS[0]).otherwise(S.TUITION_STATUS[1]).alias("TuitionStatus"),
                        status.alias("Status")))

    @cached_property
    def teachers(self) -> DataFrame:
        return self.table("supplier").select(
            F.col("s_suppkey").alias("TeacherKey"), F.col("s_name").alias("TeacherName"),
            F.col("s_nationkey").alias("DepartmentKey"))

    @cached_property
    def courses(self) -> DataFrame:
        brand = self.table("part").select(F.col("p_brand").alias("CourseName")).distinct()
        key = F.substring("CourseName", 7, 10).cast("int")
        return brand.select(key.alias("CourseKey"), "CourseName", (key % 25).alias("DepartmentKey"),
                            (1 + key % 8).alias("CurriculumSemester"))

    @cached_property
    def teachers_full(self) -> DataFrame:
        return frames.with_department(self.teachers, self.departments)

    @cached_property
    def courses_full(self) -> DataFrame:
        return frames.with_department(self.courses, self.departments)

    @cached_property
    def semesters(self) -> DataFrame:
        """All semesters from the first order's to the last one's."""
        season = season_of(F.col("o_orderdate"))
        first, last = self.table("orders").agg(F.min(season), F.max(season)).first()
        key = F.col("id").cast("int")
        year = F.floor(key / 2).cast("int") + YEAR0
        name = F.when(key % 2 == 0, S.SEASONS[0]).otherwise(S.SEASONS[1])
        return self.spark.range(*((0, 0) if first is None else (first, last + 1))).select(
            key.alias("SemesterKey"), name.alias("SemesterName"),
            F.concat_ws(" ", year.cast("string"), name).alias("SemesterLabel"),
            F.make_date(year, F.when(key % 2 == 0, 1).otherwise(7), F.lit(1)).alias("StartDate"),
            F.when(key % 2 == 0, F.make_date(year, F.lit(6), F.lit(30)))
            .otherwise(F.make_date(year, F.lit(12), F.lit(31))).alias("EndDate"))

    # --------------------------------------------------------------------- facts
    @cached_property
    def order_heads(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("StudentKey"),
            season_of(F.col("o_orderdate")).alias("SemesterKey"), F.to_date("o_orderdate").alias("Date"))

    @cached_property
    def lines(self) -> DataFrame:
        """Order lines with student, semester and date."""
        return self.table("lineitem").join(self.order_heads, "l_orderkey")

    @gold_frame
    def graded_lines(self) -> DataFrame:
        """What facts read of the order lines. Stored for reports, as the join of all lines with their orders is what costs most."""
        return self.lines.select(
            "StudentKey", "SemesterKey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax",
            "l_returnflag", "l_linestatus")

    @cached_property
    def line_facts(self) -> DataFrame:
        """One row per order line: a grade, an attendance check and an assignment."""
        number, flagged = F.col("l_linenumber"), F.col("l_returnflag") == "R"
        admitted = ~(flagged & (number == 1))
        handed_in = ~((F.col("l_linestatus") == "O") & (number <= 2))
        status = (F.when(number == 7, S.ATTENDANCE[1]).when((number == 6) & flagged, S.ATTENDANCE[2])
                  .otherwise(S.ATTENDANCE[0]))
        rows = self.graded_lines.select(
            "StudentKey", F.col("l_suppkey").alias("TeacherKey"), "SemesterKey", "l_partkey",
            (12 + F.round(F.col("l_tax") * 100)).alias("CurrentScore"),
            (16 + F.round(F.col("l_discount") * 100)).alias("MidtermScore"),
            F.when(admitted, F.least(F.lit(50.0), 5 + F.col("l_quantity"))).otherwise(0.0).alias("FinalScore"),
            admitted.alias("IsAdmitted"), (60 + number * 5).cast("double").alias("AttendanceScore"),
            (1 + number % 6).alias("Credits"),
            status.alias("Status"), (status == S.ATTENDANCE[0]).alias("IsPresent"),
            F.when(handed_in, F.col("l_quantity") * 2).otherwise(0.0).alias("Score"), handed_in.alias("IsSubmitted"))
        total = F.col("CurrentScore") + F.col("MidtermScore") + F.col("FinalScore")
        return rows.withColumn("TotalScore", total).withColumns({
            "FinalGrade": grade_of("TotalScore", 1), "GradePoints": grade_of("TotalScore", 2),
            "IsFailed": F.col("TotalScore") < S.PASS_MARK})

    @cached_property
    def scored_lines(self) -> DataFrame:
        """Grade rows without their course."""
        return self.line_facts.drop("l_partkey", "Status", "IsPresent", "Score", "IsSubmitted")

    @cached_property
    def grades(self) -> DataFrame:
        """Grade rows with their course."""
        part = self.table("part").select(
            F.col("p_partkey").alias("l_partkey"), F.substring("p_brand", 7, 10).cast("int").alias("CourseKey"))
        return (self.line_facts.drop("Status", "IsPresent", "Score", "IsSubmitted")
                .join(part, "l_partkey").drop("l_partkey"))

    @cached_property
    def attendance(self) -> DataFrame:
        return self.line_facts.select("StudentKey", "SemesterKey", "Status", "IsPresent")

    @cached_property
    def assignments(self) -> DataFrame:
        return self.line_facts.select("StudentKey", "SemesterKey", "Score", "IsSubmitted")

    @cached_property
    def payments(self) -> DataFrame:
        tuition = F.col("o_totalprice").cast("decimal(14,2)")
        paid = (F.when(F.col("o_orderstatus") == "F", tuition)
                .when(F.col("o_orderstatus") == "P", (tuition / 2).cast("decimal(14,2)"))
                .otherwise(F.lit(0).cast("decimal(14,2)")))
        return self.table("orders").select(
            F.col("o_orderkey").alias("PaymentID"), F.col("o_custkey").alias("StudentKey"),
            season_of(F.col("o_orderdate")).alias("SemesterKey"), F.to_date("o_orderdate").alias("PaymentDate"),
            F.date_format("o_orderdate", "yyyyMMdd").cast("int").alias("DateKey"),
            tuition.alias("TuitionAmount"), paid.alias("PaidAmount"),
            (tuition - paid).cast("decimal(14,2)").alias("RemainingDebt"))

    @cached_property
    def warnings(self) -> DataFrame:
        urgent = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F")
        return self.table("orders").where(urgent).select(
            F.col("o_orderkey").alias("WarningID"), F.col("o_custkey").alias("StudentKey"),
            season_of(F.col("o_orderdate")).alias("SemesterKey"), F.to_date("o_orderdate").alias("WarningDate"),
            F.element_at(F.array(*[F.lit(w) for w in S.WARNING_TYPES]), (F.col("o_orderkey") % 4 + 1).cast("int"))
            .alias("WarningType"),
            F.when(F.col("o_totalprice") > 250000, S.SEVERITY[1]).otherwise(S.SEVERITY[0]).alias("Severity"))

    @cached_property
    def enrollments(self) -> DataFrame:
        return self.graded_lines.select("StudentKey", F.col("l_suppkey").alias("TeacherKey"), "SemesterKey")

    @cached_property
    def interventions(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").alias("InterventionID"), F.col("user_id").alias("StudentKey"),
            F.col("event_type").alias("Status"), F.date_trunc("second", "ts").alias("CreatedAt"))

    # -------------------------------------------------------- delivered text rows
    @cached_property
    def deliveries(self) -> DataFrame:
        """Order lines as a delivery of text rows with planted dirt; one file per line number."""
        order, part, supp = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
        amount = F.floor("l_extendedprice")
        spaced = F.concat_ws(" ", F.floor(amount / 1000).cast("string"), F.lpad((amount % 1000).cast("string"), 3, "0"))
        status = (F.when(F.col("l_returnflag") == "A", S.ATTENDANCE[0]).when(F.col("l_returnflag") == "N", S.ATTENDANCE[1])
                  .otherwise(S.ATTENDANCE[2]))
        ship = F.to_date("l_shipdate")
        full_order = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
                      "l_linestatus", "l_shipdate"]
        return self.table("lineitem").select(
            F.concat(F.lit("lineitem_"), F.col("l_linenumber").cast("string")).alias("_file"),
            F.struct(*full_order).alias("_ord"),
            F.when(part % 199 != 0, (order * 10 + F.col("l_linenumber")).cast("string")).alias("RecordID"),
            F.when(part % 211 == 0, "n/a").when(order % 97 == 0, (part + 9000000).cast("string"))
            .otherwise(part.cast("string")).alias("CourseID"),
            F.when(order % 59 == 0, "1000").when(order % 53 != 0, (16 + F.round(F.col("l_discount") * 100)).cast("int").cast("string"))
            .alias("Score"),
            F.when(part % 41 == 0, spaced).otherwise(amount.cast("string")).alias("Amount"),
            F.when(supp % 11 == 0, F.upper(status)).when(supp % 13 == 0, F.lower(status))
            .when(supp % 17 == 0, F.concat(F.lit("  "), status, F.lit("\t"))).when(supp % 19 == 0, "xx").otherwise(status).alias("Status"),
            F.when(supp % 23 == 0, F.date_format(ship, "d.M.yyyy")).when(supp % 29 == 0, "not-a-date")
            .when(supp % 31 == 0, "2099-12-31").otherwise(ship.cast("string")).alias("Date"),
            F.when(supp % 3 == 0, "ali").otherwise("Vali").alias("Name"),
            F.when(order % 61 == 0, F.lit(None).cast("string")).when(order % 2 == 0, S.GENDER[0])
            .otherwise(S.GENDER[1].lower()).alias("Gender"))

    # ------------------------------------------------------------ derived frames
    @property
    def snap(self) -> DataFrame:
        return self.snap_retained.drop("Retained") if self.gold else self.snap_plan

    @cached_property
    def snap_plan(self) -> DataFrame:
        base = self.line_facts.groupBy(*snapshot.KEY).agg(
            *snapshot.grade_measures(), *snapshot.attendance_measures(), *snapshot.assignment_measures())
        sides = [snapshot.payment_side(self.payments), snapshot.warning_side(self.warnings),
                 snapshot.teacher_load_side(self.enrollments)]
        return snapshot.student_semester(base, sides, self.students, first_year=YEAR0)

    @gold_frame
    def snap_retained(self) -> DataFrame:
        return frames.with_retention(self.snap_plan, self.latest)

    @cached_property
    def latest(self) -> int:
        """The newest semester, fetched once: as a literal it prunes scans and keeps plans small."""
        return self.table("orders").agg(F.max(season_of(F.col("o_orderdate")))).first()[0]

    @gold_frame
    def course_sem(self) -> DataFrame:
        return frames.course_semester(self.grades)

    @gold_frame
    def exam_group(self) -> DataFrame:
        return frames.exam_group(self.scored_lines, self.students)

    @gold_frame
    def exam_dist(self) -> DataFrame:
        return frames.exam_dist(self.scored_lines, self.students)

    @gold_frame
    def payments_faculty(self) -> DataFrame:
        return frames.payments_by_faculty(self.payments, self.students)

    @cached_property
    def trend(self) -> DataFrame:
        return performance.semester_trend(self.snap_retained, self.payments_faculty, self.semesters)

    @cached_property
    def faculty_trend(self) -> DataFrame:
        return performance.faculty_trend(
            self.snap_retained, self.payments_faculty, self.semesters, self.faculties)

    @cached_property
    def course_history(self) -> DataFrame:
        return performance.course_summary(self.course_sem, self.courses_full, self.faculties)

    @cached_property
    def course_pooled(self) -> DataFrame:
        return performance.course_summary(self.course_sem, self.courses_full, self.faculties, pooled=True)

    def course_summary(self, semester) -> DataFrame:
        return performance.course_summary(self.course_sem, self.courses_full, self.faculties, semester)

    def teacher_summary(self, semester) -> DataFrame:
        return performance.teacher_summary(self.course_sem, self.teachers_full, self.faculties, semester, LIMITS)

    @cached_property
    def dataset(self) -> DataFrame:
        return R.build_dataset(R.add_features(R.risk_snapshot(self.snap, self.students)), self.latest)

    @cached_property
    def baseline(self) -> dict[str, float]:
        """Fourteen numbers, part of a trained model's parameters."""
        return R.baseline_profile(R.labelled(self.dataset)).first().asDict()

    @gold_frame
    def risk(self) -> DataFrame:
        return self.risk_plan

    @property
    def risk_plan(self) -> DataFrame:
        """Scored students. The scoring time is fixed so that results are repeatable."""
        return R.score_students(R.to_score(self.dataset), linear_scorer, self.baseline, THRESHOLD, "linear",
                                F.lit("2002-01-01 00:00:00").cast("timestamp"))
