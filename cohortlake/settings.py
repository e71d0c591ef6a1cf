"""Business constants. Everything that decides a figure lives here, once."""

from dataclasses import dataclass, field

# --- fixed values -----------------------------------------------------------
# Domain constants, category vocabularies and labels that every result has to
# agree on.

SCORE_MAX = {"current": 20, "midterm": 30, "final": 50}
PASS_MARK = 60
CONTROL_PASS_SHARE = 0.60
GRADE_SCALE = ((90, "5", 5), (70, "4", 4), (60, "3", 3), (0, "2", 2))

AT_RISK_GPA = 3.0
AT_RISK_FAILED = 2
RISK_LEVELS = ((0.25, "Past"), (0.50, "O'rta"), (0.75, "Yuqori"), (1.01, "Kritik"))
HIGH_RISK = ("Yuqori", "Kritik")
TARGET_RECALL = 0.80

HEALTH_WEIGHTS = {
    "academic": 0.25, "engagement": 0.10, "attendance": 0.15, "retention": 0.15,
    "faculty_load": 0.10, "financial": 0.15, "course_health": 0.10,
}
HEALTH_SCALES = {
    "academic": (3.0, 4.5), "engagement": (0.60, 0.98), "attendance": (0.60, 0.95),
    "retention": (0.80, 0.99), "faculty_load": (0.40, 0.0), "financial": (0.60, 1.0),
    "course_health": (0.30, 0.0),
}

GENDER = ("Erkak", "Ayol")
TUITION_STATUS = ("Grant", "Kontrakt")
SCHOLARSHIP = ("Stipendiya oladi", "Stipendiyasiz")
STUDENT_STATUS = ("Faol", "Chetlashtirilgan", "Bitirgan")
DEGREES = ("Magistr", "PhD", "Fan doktori (DSc)")
EMPLOYMENT = ("To'liq stavka", "Yarim stavka", "Soatbay")
COURSE_TYPE = ("Majburiy", "Tanlov")
SEASONS = ("Kuz", "Bahor")
ATTENDANCE = ("Keldi", "Kelmadi", "Sababli")
PAYMENT_STATUS = ("To'liq to'langan", "Qisman to'langan", "To'lanmagan")
SUBMISSION = ("Topshirildi", "Kechikib topshirildi", "Topshirilmadi")
WARNING_TYPES = ("Past o'zlashtirish", "Davomat pastligi", "Akademik qarzdorlik", "To'lov qarzdorligi")
SEVERITY = ("O'rta", "Yuqori")
YES_NO = ("Ha", "Yo'q")
GENDER_UNKNOWN = "Ko'rsatilmagan"
NO_FACTOR = "Sezilarli omil yo'q"

MONTHS = ("Yanvar", "Fevral", "Mart", "Aprel", "May", "Iyun",
          "Iyul", "Avgust", "Sentabr", "Oktabr", "Noyabr", "Dekabr")
WEEKDAYS = ("Dushanba", "Seshanba", "Chorshanba", "Payshanba", "Juma", "Shanba", "Yakshanba")

DIFFICULTY = ((0.10, "Yengil"), (0.20, "O'rtacha"), (0.30, "Qiyin"), (2.0, "Juda qiyin"))
DEBT_BANDS = ("Grant (to'lov yo'q)", "Qarzi yo'q", "Qarz 1-30%", "Qarz 31-60%", "Qarz 60% dan yuqori")
MIDTERM_LEVELS = ("80% va yuqori", "60-79%", "60% dan past")
NOT_ADMITTED = "Qo'yilmagan"

FEATURES = ("SemGPA", "PrevGPA", "CumGPA", "GPATrend", "AttendanceRate", "FailedCourses",
            "CumFailedCourses", "AvgAssignmentScore", "SubmissionRate", "WarningsCum",
            "DebtRatio", "StudySemester", "Credits", "AvgTeacherLoad")
FACTOR_GROUPS = {
    "F_GPA": ("SemGPA", "PrevGPA", "CumGPA", "GPATrend"),
    "F_Attendance": ("AttendanceRate",),
    "F_Failed": ("FailedCourses", "CumFailedCourses"),
    "F_Assignments": ("AvgAssignmentScore", "SubmissionRate"),
    "F_Debt": ("DebtRatio",),
    "F_History": ("WarningsCum", "StudySemester", "Credits"),
    "F_TeacherLoad": ("AvgTeacherLoad",),
}
FACTOR_LABELS = {
    "F_GPA": "GPA", "F_Attendance": "Davomat", "F_Failed": "Yiqilgan fanlar",
    "F_Assignments": "Topshiriqlar", "F_Debt": "Moliyaviy qarz",
    "F_History": "Akademik tarix", "F_TeacherLoad": "O'qituvchi yuklamasi",
}
LEVERS = ("AttendanceRate", "SubmissionRate", "AvgAssignmentScore", "AvgTeacherLoad")

SCENARIOS = {
    "attendance_drop": {"target": "all", "attendance": -0.05},
    "tutoring_30": {"target": "top_risk", "share": 0.30, "assignment_score": 8.0,
                    "submission": 0.05, "attendance": 0.02},
    "risk_intervention": {"target": "high_risk", "attendance": 0.05, "submission": 0.10},
    "teacher_load": {"target": "all", "teacher_load_pct": -0.10},
    "assignment_completion": {"target": "all", "submission": 0.15},
}

FACT_DATES = ("2022-01-01", "2033-08-31")
FIRST_ACADEMIC_YEAR, ACADEMIC_YEARS = 2022, 11
LAST_STUDY_SEMESTER = 8
REJECT_SAMPLE = 300
OUTLIER_K = 6.0
MAD_SCALE = 1.4826
# -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Thresholds:
    """Limits that depend on the size of the institution, so callers may change them."""

    high_risk_share: float = 0.08
    attendance_drop: float = 0.02
    course_failure: float = 0.25
    gpa_change: float = 0.03
    collection_rate: float = 0.85
    min_enrollment: int = 30
    min_group: int = 20
    anomaly_z: float = 3.0
    course_rise: float = 0.07
    teacher_overload: int = 700
    health_weights: dict = field(default_factory=lambda: dict(HEALTH_WEIGHTS))
    health_scales: dict = field(default_factory=lambda: dict(HEALTH_SCALES))


DEFAULTS = Thresholds()
