"""Registered queries over fitted and published models. SQL cannot train, so they return what must hold for any fit: which rows
were scored, and whether figures and bounds agree with each other. The models are trained with the operators' defaults and published
once per session and folder; every query reads what was published."""

from pyspark.sql import functions as F

from cohortlake import settings as S
from cohortlake.functions.measures import count_where, risk_level
from cohortlake.operators import evaluation as E
from cohortlake.plans import risk_models as M
from cohortlake.plans.oracle_base import query
from cohortlake.plans.queries_risk import SPLIT
from cohortlake.plans.registry import register
from cohortlake.session import fresh_path

BINS = 1000
_stores: dict[tuple, M.Store] = {}


def store_of(u) -> M.Store:
    """The published models over these tables, trained by the first query that asks."""
    key = (u.spark.sparkContext.applicationId, u.folder)
    if key not in _stores:
        store = M.Store(u.spark, fresh_path(u.spark, "risk-models"))
        store.publish(M.train(u.dataset), u.dataset)
        _stores[key] = store
    return _stores[key]


def auc_bounds(scores, by):
    """Least and greatest area that counts by score, in bins, allow: pairs within a bin count not at all, or in full."""
    bins = scores.groupBy(*by, F.least(F.floor(F.col("Score") * BINS), F.lit(BINS - 1)).alias("bin")).agg(
        count_where(F.col("Target") == 1).alias("pos"), count_where(F.col("Target") == 0).alias("neg"))
    pairs = bins.alias("a").join(bins.select(*by, F.col("bin").alias("other"), F.col("neg").alias("other_neg")), list(by))  # at most BINS rows a model and split
    at_most = F.sum(F.when(F.col("other") <= F.col("bin"), F.col("pos") * F.col("other_neg")).otherwise(0))
    at_least = F.sum(F.when(F.col("other") < F.col("bin"), F.col("pos") * F.col("other_neg")).otherwise(0))
    both = pairs.groupBy(*by).agg(at_least.alias("least"), at_most.alias("most"))
    sizes = bins.groupBy(*by).agg((F.sum("pos") * F.sum("neg")).alias("all"))
    return both.join(sizes, list(by)).select(*by, F.try_divide("least", "all").alias("least"), F.try_divide("most", "all").alias("most"))


def metrics_checked(scores, metrics):
    """One row per model, split and rule: how many rows and positives it counts, and what must be true of its figures."""
    tuned = E.threshold_for_recall(scores.where("Split = 'validation'"), by=["Model"])
    # no higher threshold reaches the target
    above = scores.where("Split = 'validation' AND Target = 1").join(F.broadcast(tuned), "Model").groupBy("Model").agg(
        F.avg((F.col("Score") > F.col("Threshold")).cast("int")).alias("_above"), F.first("Threshold").alias("_tuned"))
    first = metrics.where("Split = 'validation'").agg(F.max("ROC_AUC")).scalar()
    rows = metrics.join(auc_bounds(scores, ["Model", "Split"]), ["Model", "Split"]).join(above, "Model")
    return rows.select(
        "Model", "Split", "Rule", (F.col("TN") + F.col("FP") + F.col("FN") + F.col("TP")).alias("N"), (F.col("FN") + F.col("TP")).alias("Positives"),
        ((F.col("Split") != "validation") | ((F.col("Recall") >= S.TARGET_RECALL) & ((F.col("_above") < S.TARGET_RECALL) | (F.col("_tuned") == 0.99)))).alias("RecallTargetMet"),
        F.coalesce(F.col("ROC_AUC").between(F.col("least") - 1e-9, F.col("most") + 1e-9), F.col("ROC_AUC").isNull()).alias("AucAgrees"),
        ((F.col("Split") != "validation") | (F.col("IsBest") == 0) | (F.col("ROC_AUC") == first)).alias("BestIsFirst"))


RULES = "(VALUES ('validation', 'recall target'), ('test', 'default 0.5'), ('test', 'recall target')) AS rules (Split, Rule)"
MODELS = "(VALUES ('Logistic Regression'), ('Decision Tree'), ('Random Forest'), ('Gradient Boosting')) AS models (Model)"


@register("fitted_model_metrics", query(f"""SELECT Model, s.Split, Rule, count(*) AS N, sum(Target)::BIGINT AS Positives, true AS RecallTargetMet, true AS AucAgrees, true AS BestIsFirst
FROM ({SPLIT}) s JOIN {RULES} ON rules.Split = s.Split CROSS JOIN {MODELS} GROUP BY ALL""", "dataset"), gold=True)
def _(u):
    """Four MLlib candidates fitted on the older semesters and compared on the newest two."""
    store = store_of(u)
    return metrics_checked(store.read("scores"), store.read("metrics"))


def students_checked(scored, threshold: float):
    """One row per scored student: whether its outputs are in range and agree with each other."""
    p, shares = F.col("RiskProbability"), sum(F.col(g) for g in S.FACTOR_GROUPS)
    return scored.select(
        "StudentKey", "SemesterKey", "FacultyKey", "DepartmentKey",
        (p.between(0.01, 0.99) & F.col("PredictedNextGPA").between(2, 5) & F.col("PredictedFailRate").between(0, 1) & F.col("DropoutProbability").between(0, 1)).alias("InRange"),
        # outputs are rounded to four decimals, so bounds within half a unit can fall either way
        ((F.col("RiskLevel") == risk_level(p - F.lit(5e-5))) | (F.col("RiskLevel") == risk_level(p + F.lit(5e-5)))).alias("LevelFits"),
        ((F.col("IsFlagged") == (p >= threshold).cast("int")) | (F.abs(p - threshold) <= 5e-5)).alias("FlagFits"),
        ((shares == 0) | (F.abs(shares - 100) < 0.4)).alias("SharesFit"))


@register("fitted_bundle_scores", query("""SELECT StudentKey, SemesterKey, FacultyKey, DepartmentKey, true AS InRange, true AS LevelFits, true AS FlagFits, true AS SharesFit
FROM dataset WHERE ToScore""", "dataset"), gold=True)
def _(u):
    """Students scored by the bundle, whose models are fitted on all labelled semesters."""
    store = store_of(u)
    return students_checked(store.read("scored"), store.bundle().threshold)


@register("published_models", query(f"""SELECT 'importance' AS Part, {len(S.FEATURES)} AS N, true AS Agrees UNION ALL SELECT 'metrics', 12, true
UNION ALL SELECT 'scores', 4 * count(*), true FROM ({SPLIT}) WHERE Split != 'train' UNION ALL SELECT 'scored', count(*), true FROM dataset WHERE ToScore""", "dataset"), gold=True)
def _(u):
    """The parts of one publication after the students were scored again: rows, and that models loaded from it give the same scores."""
    store = store_of(u)
    before = store.read("scored").drop("ScoredAt")
    store.rescore(u.dataset)
    agrees = {"scored": before.exceptAll(store.read("scored").drop("ScoredAt")).isEmpty()}
    parts = [store.read(p).agg(F.lit(p).alias("Part"), F.count(F.lit(1)).alias("N"), F.lit(agrees.get(p, True)).alias("Agrees")) for p in ("importance", "metrics", "scores", "scored")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])
