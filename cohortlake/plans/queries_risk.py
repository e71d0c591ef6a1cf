"""Registered queries: risk data set, evaluation, scoring, explanation and what-if."""

from pyspark.sql import functions as F

from cohortlake import settings as S
from cohortlake.functions.measures import risk_level
from cohortlake.operators import evaluation as E, risk as R, whatif as X
from cohortlake.plans.fixed_scorer import THRESHOLD, linear_scorer
from cohortlake.plans.oracle_base import FEATURES, GROUPS, level_sql, query, risk_sql
from cohortlake.plans.registry import register

FEATURE_LIST = ", ".join(FEATURES)
KEYS = "StudentKey, SemesterKey"


@register("risk_snapshot", query(
    "SELECT StudentKey, SemesterKey, FacultyKey, DepartmentKey, Status, CourseLoad, SemGPA, CumGPA, AttendanceRate, FailedCourses, "
    "CumFailedCourses, AvgAssignmentScore, SubmissionRate, WarningsCum, DebtRatio, StudySemester, Credits, AvgTeacherLoad, IsAtRisk, "
    "IsLastSemester, (SELECT s.PrevGPA::DOUBLE FROM snap s WHERE s.StudentKey = f.StudentKey AND s.SemesterKey = f.SemesterKey) AS PrevGPA FROM feat f",
    "feat", "snap"))
def _(u):
    return R.risk_snapshot(u.snap, u.students)


@register("add_features", query(f"SELECT {KEYS}, {FEATURE_LIST} FROM feat", "feat"))
def _(u):
    return R.add_features(R.risk_snapshot(u.snap, u.students)).select("StudentKey", "SemesterKey", *S.FEATURES)


OUTCOME_COLS = "NextAtRisk, NextGPA, NextFailed, NextLoad, NextFailRate, Dropout, Target, IsLabelled, ToScore"


@register("build_dataset", query(f"SELECT {KEYS}, {OUTCOME_COLS} FROM dataset", "dataset"))
def _(u):
    return u.dataset.select("StudentKey", "SemesterKey", *OUTCOME_COLS.split(", "))


SPLIT = """SELECT *, CASE WHEN SemesterKey = (SELECT max(SemesterKey) FROM dataset WHERE IsLabelled) THEN 'test'
  WHEN SemesterKey = (SELECT max(SemesterKey) - 1 FROM dataset WHERE IsLabelled) THEN 'validation' ELSE 'train' END AS Split FROM dataset WHERE IsLabelled"""


def split_rows(u):
    return R.temporal_split(R.labelled(u.dataset))


@register("temporal_split", query(f"SELECT Split, count(*) AS N, sum(Target) AS Positives FROM ({SPLIT}) GROUP BY 1", "dataset"), gold=True)
def _(u):
    return split_rows(u).groupBy("Split").agg(F.count(F.lit(1)).alias("N"), F.sum("Target").alias("Positives"))


@register("baseline_profile", query("SELECT " + ", ".join(f"m_{f} AS {f}" for f in FEATURES) + " FROM base", "base"), gold=True)
def _(u):
    return R.baseline_profile(R.labelled(u.dataset))


# two fixed models, so that comparisons have something to compare
MODELS_SQL = {
    "linear": "risk", "gpa_only": "least(greatest(1 - (SemGPA - 2) / 3, 0::DOUBLE), 1::DOUBLE)",
}


def scored_models(u):
    rows = linear_scorer(split_rows(u)).select(
        "Split", "Target", F.col("_risk").alias("linear"),
        F.least(F.greatest(1 - (F.col("SemGPA") - 2) / 3, F.lit(0.0)), F.lit(1.0)).alias("gpa_only"))
    return rows.unpivot(["Split", "Target"], ["linear", "gpa_only"], "Model", "Score")


SCORED = {"split": SPLIT, "scored": f"""SELECT 'linear' AS Model, Split, Target, {risk_sql()} AS Score FROM split
UNION ALL SELECT 'gpa_only', Split, Target, {MODELS_SQL['gpa_only']} FROM split"""}
CUTS = """SELECT Model, coalesce(least(min(Score), 0.99), 0.5) AS Threshold FROM (
  SELECT Model, Score, row_number() OVER (PARTITION BY Model ORDER BY Score DESC) AS r, count(*) OVER (PARTITION BY Model) AS n
  FROM scored WHERE Split = 'validation' AND Target = 1) WHERE r <= ceil(n * 0.8) GROUP BY 1"""


@register("threshold_for_recall", query(CUTS, "dataset", extra=SCORED), gold=True)
def _(u):
    return E.threshold_for_recall(scored_models(u).where(F.col("Split") == "validation"), by=["Model"])


AUC = """SELECT Model, Split, (sum(CASE WHEN Target = 1 THEN rk END) - p * (p + 1) / 2.0) / (p * q::DOUBLE) AS ROC_AUC FROM (
  SELECT *, sum(Target) OVER g AS p, sum(1 - Target) OVER g AS q,
    rank() OVER (PARTITION BY Model, Split ORDER BY Score) + (count(*) OVER (PARTITION BY Model, Split, Score) - 1) / 2.0 AS rk
  FROM scored WINDOW g AS (PARTITION BY Model, Split)) GROUP BY Model, Split, p, q"""


@register("roc_auc", query(f"SELECT Model, Split, round(ROC_AUC, 9) AS ROC_AUC FROM ({AUC})", "dataset", extra=SCORED), gold=True)
def _(u):
    return E.roc_auc(scored_models(u), ["Model", "Split"]).withColumn("ROC_AUC", F.round("ROC_AUC", 9))


CONFUSION = """SELECT Model, Split, Rule, Threshold, TN, FP, FN, TP, (TP + TN)::DOUBLE / (TP + TN + FP + FN) AS Accuracy,
  coalesce(TP::DOUBLE / nullif(TP + FP, 0), 0) AS Precision, coalesce(TP::DOUBLE / nullif(TP + FN, 0), 0) AS Recall,
  coalesce(2 * TP::DOUBLE / nullif(2 * TP + FP + FN, 0), 0) AS F1 FROM (
  SELECT Model, Split, Rule, Threshold, sum(CASE WHEN Target = 0 AND Score < Threshold THEN 1 ELSE 0 END) AS TN,
    sum(CASE WHEN Target = 0 AND Score >= Threshold THEN 1 ELSE 0 END) AS FP, sum(CASE WHEN Target = 1 AND Score < Threshold THEN 1 ELSE 0 END) AS FN,
    sum(CASE WHEN Target = 1 AND Score >= Threshold THEN 1 ELSE 0 END) AS TP FROM (
      SELECT s.Model, Split, 'recall target' AS Rule, Threshold, Target, Score FROM scored s JOIN cuts c ON c.Model = s.Model WHERE Split IN ('validation', 'test')
      UNION ALL SELECT Model, Split, 'default 0.5', 0.5, Target, Score FROM scored WHERE Split = 'test') GROUP BY 1, 2, 3, 4)"""


@register("binary_metrics", query("SELECT Split, TN, FP, FN, TP, Accuracy, Precision, Recall, F1 FROM conf WHERE Model = 'linear' AND Rule = 'default 0.5'",
                                  "dataset", extra={**SCORED, "cuts": CUTS, "conf": CONFUSION}), gold=True)
def _(u):
    rows = scored_models(u).where((F.col("Model") == "linear") & (F.col("Split") == "test")).withColumn("Threshold", F.lit(0.5))
    return E.confusion(rows, ["Split"])


@register("compare_models", query("""SELECT c.Model, c.Split, Rule, round_even(Threshold, 3) AS Threshold, TN, FP, FN, TP, Accuracy, Precision, Recall, F1,
  round(ROC_AUC, 9) AS ROC_AUC, CASE WHEN c.Model = (SELECT Model FROM auc WHERE Split = 'validation' ORDER BY ROC_AUC DESC, Model LIMIT 1) THEN 1 ELSE 0 END AS IsBest
FROM conf c JOIN auc a ON a.Model = c.Model AND a.Split = c.Split""", "dataset",
                                  extra={**SCORED, "cuts": CUTS, "conf": CONFUSION, "auc": AUC}), gold=True)
def _(u):
    return E.compare_models(scored_models(u)).withColumn("ROC_AUC", F.round("ROC_AUC", 9))


@register("model_trust", query("""SELECT c.Model, Threshold, round_even(Precision * 10, 0)::INT AS RightOf10, round_even(Recall * 10, 0)::INT AS FoundOf10
FROM conf c WHERE Split = 'test' AND Rule = 'recall target' AND Model = (SELECT Model FROM auc WHERE Split = 'validation' ORDER BY ROC_AUC DESC, Model LIMIT 1)""",
                               "dataset", extra={**SCORED, "cuts": CUTS, "conf": CONFUSION.replace("SELECT Model, Split, Rule, Threshold, TN", "SELECT Model, Split, Rule, round_even(Threshold, 3) AS Threshold, TN", 1), "auc": AUC}), gold=True)
def _(u):
    from cohortlake.operators.serving import model_trust
    return model_trust(E.compare_models(scored_models(u)))


def mixing_order(seed: int):
    """A repeatable pseudo-random order that SQL can also compute."""
    return (F.col("StudentKey") * 7919 + F.col("SemesterKey") * 104729 + (seed + 1) * 15485863) % 32452843


def _importance_sql(repeats: int):
    parts = []
    for seed in range(repeats):
        shifted = ", ".join(f"coalesce(lead({f}) OVER w, first_value({f}) OVER w) AS s_{f}" for f in FEATURES)
        mixed = f"""(SELECT Target, {FEATURE_LIST}, {shifted} FROM split WHERE Split = 'test'
  WINDOW w AS (ORDER BY (StudentKey * 7919 + SemesterKey * 104729 + {(seed + 1) * 15485863}) % 32452843, StudentKey, SemesterKey))"""
        parts += [f"SELECT '{f}' AS Feature, {seed} AS Seed, Target, {risk_sql(lambda g, f=f: 's_' + g if g == f else g)} AS Score FROM {mixed}" for f in FEATURES]
    auc = """SELECT {k} (sum(CASE WHEN Target = 1 THEN rk END) - p * (p + 1) / 2.0) / (p * q::DOUBLE) AS a FROM (
  SELECT *, sum(Target) OVER g AS p, sum(1 - Target) OVER g AS q, rank() OVER (PARTITION BY {g} ORDER BY Score)
    + (count(*) OVER (PARTITION BY {g}, Score) - 1) / 2.0 AS rk FROM {src} WINDOW g AS (PARTITION BY {g})) GROUP BY {k} p, q"""
    base = f"SELECT 1 AS one, Target, {risk_sql()} AS Score FROM split WHERE Split = 'test'"
    return query("SELECT Feature, round((SELECT a FROM a0) - avg(a), 9) AS Importance FROM a1 GROUP BY 1", "dataset", extra={
        "split": SPLIT, "var": " UNION ALL ".join(parts), "b0": base, "a0": auc.format(k="", g="one", src="b0"),
        "a1": auc.format(k="Feature, Seed,", g="Feature, Seed", src="var")})


@register("permutation_importance", _importance_sql(5), gold=True)
def _(u):
    test = split_rows(u).where(F.col("Split") == "test")
    return E.permutation_importance(test, linear_scorer, order=mixing_order).withColumn(
        "Importance", F.round("Importance", 9))


@register("predict", query(f"""SELECT StudentKey, least(greatest({risk_sql()}, 0.01), 0.99) AS RiskProbability,
  least(greatest(SemGPA * 0.6::DOUBLE + CumGPA * 0.4::DOUBLE, 2), 5) AS PredictedNextGPA, least(greatest(FailedCourses * 0.15::DOUBLE, 0), 1) AS PredictedFailRate,
  {risk_sql()} * 0.1::DOUBLE AS DropoutProbability FROM dataset WHERE ToScore""", "dataset"), gold=True)
def _(u):
    return R.predict(R.to_score(u.dataset), linear_scorer).select("StudentKey", *R.OUTPUTS)


@register("risk_level", query(f"SELECT {KEYS}, {level_sql(risk_sql())} AS RiskLevel FROM dataset", "dataset"), gold=True)
def _(u):
    return linear_scorer(u.dataset).select("StudentKey", "SemesterKey", risk_level("_risk").alias("RiskLevel"))


@register("explain_occlusion", query(f"SELECT StudentKey, {', '.join(GROUPS)} FROM risk", "risk"), gold=True)
def _(u):
    return R.explain(R.to_score(u.dataset), linear_scorer, u.baseline).select("StudentKey", *S.FACTOR_GROUPS)


@register("main_factors", query("SELECT StudentKey, MainFactors FROM risk", "risk"), gold=True)
def _(u):
    return u.risk.select("StudentKey", "MainFactors")


@register("score_students", query("SELECT * EXCLUDE (ScoredAt) FROM risk", "risk"), gold=True)
def _(u):
    return u.risk_plan.drop("ScoredAt")


def _levers_sql():
    xs = ["AttendanceRate", "SubmissionRate", "AvgAssignmentScore", "AvgTeacherLoad"]
    dm = ", ".join(f"{c} - avg({c}) OVER g AS {c}" for c in [*xs, "SemGPA", "FailRate"])
    pairs = [f"sum({xs[i]} * {xs[j]}) AS x{i}{j}" for i in range(4) for j in range(i, 4)]
    out = []
    for t in ("SemGPA", "FailRate"):
        ys = ", ".join(f"sum({xs[i]} * {t}) AS b{i}" for i in range(4))
        out.append(f"SELECT '{t}' AS Outcome, {', '.join(pairs)}, {ys} FROM dm")
    # Gaussian elimination, one common table per pivot
    extra = {"own": "SELECT *, FailedCourses / CourseLoad AS FailRate, count(*) OVER (PARTITION BY StudentKey) AS n FROM feat",
             "dm": f"SELECT {dm} FROM own WHERE n >= 2 WINDOW g AS (PARTITION BY StudentKey)", "m0": " UNION ALL ".join(out)}
    for k in range(3):
        keep = [f"x{i}{j}" for i in range(k + 1) for j in range(i, 4)] + [f"b{i}" for i in range(k + 1)]
        new = [f"x{i}{j} - x{k}{i} / x{k}{k} * x{k}{j} AS x{i}{j}" for i in range(k + 1, 4) for j in range(i, 4)]
        new += [f"b{i} - x{k}{i} / x{k}{k} * b{k} AS b{i}" for i in range(k + 1, 4)]
        extra[f"m{k + 1}"] = f"SELECT Outcome, {', '.join(keep + new)} FROM m{k}"
    extra["r3"] = "SELECT *, b3 / x33 AS c3 FROM m3"
    extra["r2"] = "SELECT *, (b2 - x23 * c3) / x22 AS c2 FROM r3"
    extra["r1"] = "SELECT *, (b1 - x12 * c2 - x13 * c3) / x11 AS c1 FROM r2"
    extra["r0"] = "SELECT *, (b0 - x01 * c1 - x02 * c2 - x03 * c3) / x00 AS c0 FROM r1"
    cols = ", ".join(f"round_even(c{i}, 6) AS {x}" for i, x in enumerate(xs))
    return query(f"SELECT Outcome, {cols} FROM r0", "feat", extra=extra)


@register("lever_effects", _levers_sql(), gold=True)
def _(u):
    return R.lever_effects(R.add_features(R.risk_snapshot(u.snap, u.students)))


# -------------------------------------------------------------------- what-if
# fixed values: lever effects used where results are compared with SQL
EFFECTS = {"SemGPA": {"AttendanceRate": 0.8, "SubmissionRate": 0.5, "AvgAssignmentScore": 0.01, "AvgTeacherLoad": -0.001},
           "FailRate": {"AttendanceRate": -0.3, "SubmissionRate": -0.2, "AvgAssignmentScore": -0.002, "AvgTeacherLoad": 0.0005}}
POP = f"""SELECT *, least(greatest({risk_sql()}, 0.01), 0.99) AS BaseRisk, {level_sql(f'least(greatest({risk_sql()}, 0.01), 0.99)')} AS BaseLevel
FROM dataset WHERE ToScore"""


def population(u):
    return X.population(R.to_score(u.dataset), linear_scorer)


@register("whatif_population", query(f"SELECT StudentKey, BaseRisk, BaseLevel FROM ({POP})", "dataset"), gold=True)
def _(u):
    return population(u).select("StudentKey", "BaseRisk", "BaseLevel")


def _mask(target):
    return {"high_risk": "BaseLevel IN ('Yuqori', 'Kritik')", "all": "true",
            "top_risk": "row_number() OVER (ORDER BY BaseRisk DESC, StudentKey) <= round_even(count(*) OVER () * 0.3, 0)"}[target]


for _target in ("top_risk", "high_risk"):
    @register(f"target_mask_{_target}", query(
        f"SELECT StudentKey, ({_mask(_target)}) AND FacultyKey IN (0, 2) AS Targeted FROM pop".replace(" AND FacultyKey IN (0, 2)", "")
        if _target == "top_risk" else f"SELECT StudentKey, ({_mask(_target)}) AND FacultyKey = 2 AS Targeted FROM pop",
        "dataset", extra={"pop": POP}), gold=True)
    def _(u, target=_target):
        faculty = None if target == "top_risk" else 2
        return X.target_mask(population(u), target, 0.3, faculty).select("StudentKey", "Targeted")


@register("target_mask_whole_history", query(
    f"SELECT StudentKey, SemesterKey, row_number() OVER (ORDER BY b DESC, StudentKey * 100 + SemesterKey) <= round_even(count(*) OVER () * 0.3, 0) AS Targeted "
    f"FROM (SELECT *, floor({risk_sql()} * 20) AS b FROM dataset)", "dataset"), gold=True)
def _(u):
    from cohortlake.functions.selection import top_share
    rows = linear_scorer(u.dataset).select("StudentKey", "SemesterKey", F.floor(F.col("_risk") * 20).alias("b"),
                                           (F.col("StudentKey") * 100 + F.col("SemesterKey")).alias("k"))
    return top_share(rows, "b", "k", 0.3, "Targeted").select("StudentKey", "SemesterKey", "Targeted")


def _levers_cte(target, attendance=0.0, submission=0.0, score=0.0, load=0.0):
    def c(x, lo, hi):
        return f"least(greatest({x}, {lo}::DOUBLE), {hi})"
    d = {"AttendanceRate": f"CASE WHEN Targeted THEN {c(f'AttendanceRate + {attendance}::DOUBLE', 0, '1::DOUBLE')} ELSE AttendanceRate END",
         "SubmissionRate": f"CASE WHEN Targeted THEN {c(f'SubmissionRate + {submission}::DOUBLE', 0, '1::DOUBLE')} ELSE SubmissionRate END",
         "AvgAssignmentScore": "CASE WHEN Targeted THEN " + c(
             f"AvgAssignmentScore * coalesce({c(f'SubmissionRate + {submission}::DOUBLE', 0, '1::DOUBLE')} / nullif(SubmissionRate, 0), 1) + {score}::DOUBLE", 0, "100::DOUBLE")
         + " ELSE AvgAssignmentScore END",
         "AvgTeacherLoad": f"CASE WHEN Targeted THEN AvgTeacherLoad * (1 + {load}::DOUBLE) ELSE AvgTeacherLoad END"}
    def eff(o):
        return "(((" + ") + ".join(f"(n_{k} - {k}) * {w}::DOUBLE" for k, w in EFFECTS[o].items()).replace(") + (", ") + (", 1) + ")"
    def effect(o):
        terms = [f"(n_{k} - {k}) * ({EFFECTS[o][k]})::DOUBLE" for k in ("AttendanceRate", "SubmissionRate", "AvgAssignmentScore", "AvgTeacherLoad")]
        return f"((({terms[0]} + {terms[1]}) + {terms[2]}) + {terms[3]})"
    step1 = f"SELECT *, {', '.join(f'{e} AS n_{k}' for k, e in d.items())} FROM marked"
    step2 = (f"SELECT *, {c('SemGPA + ' + effect('SemGPA'), 2, '5::DOUBLE')} AS n_SemGPA, "
             f"{c('FailedCourses + ' + effect('FailRate') + ' * CourseLoad', 0, 'CourseLoad')} AS n_FailedCourses FROM step1")
    step3 = (f"SELECT *, {c('CumGPA + (n_SemGPA - SemGPA) / nullif(StudySemester, 0)', 2, '5::DOUBLE')} AS n_CumGPA, n_SemGPA - PrevGPA AS n_GPATrend, "
             "greatest(CumFailedCourses + n_FailedCourses - FailedCourses, 0::DOUBLE) AS n_CumFailedCourses FROM step2")
    return {"pop": POP, "marked": f"SELECT *, {_mask(target)} AS Targeted FROM pop", "step1": step1, "step2": step2, "step3": step3}


CHANGED = ["AttendanceRate", "SubmissionRate", "AvgAssignmentScore", "AvgTeacherLoad", "SemGPA", "FailedCourses", "CumGPA", "GPATrend", "CumFailedCourses"]


@register("apply_levers", query(f"SELECT StudentKey, {', '.join(f'n_{k} AS {k}' for k in CHANGED)} FROM step3", "dataset",
                                extra=_levers_cte("top_risk", 0.02, 0.05, 8.0)), gold=True)
def _(u):
    marked = X.target_mask(population(u), "top_risk", 0.3)
    return X.apply_levers(marked, EFFECTS, attendance=0.02, submission=0.05, assignment_score=8.0).select("StudentKey", *CHANGED)


def _outcome_select(prefix):
    def v(f):
        return f"{prefix}{f}" if f in CHANGED and prefix else f
    p = f"least(greatest({risk_sql(v)}, 0.01), 0.99)"
    drop = f"{risk_sql(v)} * 0.1::DOUBLE"
    return f"""SELECT avg(least(greatest({v('SemGPA')} * 0.6::DOUBLE + {v('CumGPA')} * 0.4::DOUBLE, 2), 5)) AS predicted_gpa,
  sum(CASE WHEN {p} >= 0.45 THEN 1 ELSE 0 END)::DOUBLE AS at_risk_students, sum(CASE WHEN {p} >= 0.5 THEN 1 ELSE 0 END)::DOUBLE AS high_risk_students,
  avg(least(greatest({v('FailedCourses')} * 0.15::DOUBLE, 0), 1)) AS failure_rate, 1 - avg({drop}) AS retention,
  avg(pow(1 - {drop}, greatest(8 - StudySemester, 0))) AS graduation_probability FROM step3"""


OUTS = ["predicted_gpa", "at_risk_students", "high_risk_students", "failure_rate", "retention", "graduation_probability"]


@register("whatif_outcomes", query("SELECT " + ", ".join(f"round({k}, 9) AS {k}" for k in OUTS) + f" FROM ({_outcome_select('')})", "dataset",
                                   extra=_levers_cte("all")), gold=True)
def _(u):
    out = X.outcomes(population(u), linear_scorer, THRESHOLD)
    return out.select(*[F.round(k, 9).alias(k) for k in OUTS])


def _scenario_sql(target, **levers):
    parts = [f"""SELECT '{k}' AS Key, round(b.{k}, 9) AS Baseline, round(s.{k}, 9) AS Scenario, round(s.{k} - b.{k}, 9) AS Change,
  {'s.' + k + ' - b.' + k + ' > 0' if X.HIGHER_IS_BETTER[k] else 's.' + k + ' - b.' + k + ' < 0'} AS Improves,
  (SELECT count(*) FROM marked) AS Students, (SELECT sum(Targeted::INT) FROM marked) AS Affected FROM b, s""" for k in OUTS]
    return query(" UNION ALL ".join(parts), "dataset", extra={
        **_levers_cte(target, **levers), "b": _outcome_select(""), "s": _outcome_select("n_")})


def _rounded(table):
    return table.withColumns({c: F.round(c, 9) for c in ("Baseline", "Scenario", "Change")})


SCENARIO_SQL = {
    "attendance_drop": _scenario_sql("all", attendance=-0.05),
    "tutoring_30": _scenario_sql("top_risk", score=8.0, submission=0.05, attendance=0.02),
    "risk_intervention": _scenario_sql("high_risk", attendance=0.05, submission=0.10),
    "teacher_load": _scenario_sql("all", load=-0.10),
    "assignment_completion": _scenario_sql("all", submission=0.15),
}
for _scenario, _sql in SCENARIO_SQL.items():
    @register(f"scenario_{_scenario}", _sql, gold=True)
    def _(u, name=_scenario):
        return _rounded(X.run_scenario(population(u), linear_scorer, EFFECTS, THRESHOLD, name))


@register("negligible_effect", query(
    f"SELECT abs(max(CASE WHEN Key = 'predicted_gpa' THEN Change END)) < 0.015 AND abs(max(CASE WHEN Key = 'at_risk_students' THEN Change END)) "
    f"< 0.005 * max(Students) AS Negligible FROM ({SCENARIO_SQL['teacher_load'].split('WITH ', 1)[0]}scen)", "dataset", extra={
        **_levers_cte("all", load=-0.10), "b": _outcome_select(""), "s": _outcome_select("n_"),
        "scen": "SELECT 'predicted_gpa' AS Key, s.predicted_gpa - b.predicted_gpa AS Change, (SELECT count(*) FROM marked) AS Students FROM b, s "
                "UNION ALL SELECT 'at_risk_students', s.at_risk_students - b.at_risk_students, (SELECT count(*) FROM marked) FROM b, s"}), gold=True)
def _(u):
    return X.negligible_effect(X.run_scenario(population(u), linear_scorer, EFFECTS, THRESHOLD, "teacher_load"))
