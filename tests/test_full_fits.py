"""The registered fits are the operators' own: full sizes, and the bundle's model chosen by comparison."""

from types import SimpleNamespace

from cohortlake.operators import risk as R, training as T
from cohortlake.plans import queries_risk as Q
from cohortlake.plans.catalog import QUERIES  # noqa: F401


class Table:
    def where(self, condition):
        assert "IsBest" in condition
        return self

    def first(self):
        return {"Model": "Random Forest", "Threshold": 0.31}


def test_registered_fits_are_whole(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(T, "compare_candidates", lambda rows, models: seen.append(models) or Table())
    monkeypatch.setattr(T, "fit_bundle", lambda dataset, winner, name, threshold, small=False: seen.append((winner, name, threshold, small)) or SimpleNamespace(
        scorer=None, baseline=None, threshold=threshold, model_name=name))
    monkeypatch.setattr(R, "score_students", lambda *a: None)
    monkeypatch.setattr(R, "to_score", lambda rows: rows)
    monkeypatch.setattr(Q, "split_rows", lambda u: None)
    for name in ("fitted_model_metrics", "fitted_bundle_scores"):
        QUERIES[name](spark, "/root/testdata/sf0.001")
    for models in (seen[0], seen[1]):
        assert models["Random Forest"].getStages()[-1].getNumTrees() == 300 and models["Gradient Boosting"].getStages()[-1].getMaxIter() == 300
    winner, name, threshold, small = seen[2]
    assert winner is seen[1]["Random Forest"] and (name, threshold, small) == ("Random Forest", 0.31, False)
