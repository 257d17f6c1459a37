"""The registered runs of screens and trees use the published settings."""

from panelcast.queries import models


def test_registered_runs_use_published_settings(monkeypatch):
    seen = {}

    def note(name):
        return lambda *args, **kw: seen.update({name: (args, kw)})

    monkeypatch.setattr(models, "flag_week", lambda spark, d: None)
    monkeypatch.setattr(models, "save_point", lambda df: df)
    monkeypatch.setattr(models, "_design", lambda panel: (None, None, ["x"]))
    monkeypatch.setattr(models, "_beats_mean", lambda fitted, train: None)
    monkeypatch.setattr(models.trees, "boosted_regressor", note("boosted"))
    models.boosted(None, "")
    kw = {"rounds": 500, "learning_rate": 0.03} | seen["boosted"][1]
    assert (kw["rounds"], kw["learning_rate"]) == (500, 0.03)
    assert models.SCREENED == tuple(range(3, 52))


def test_forests_by_entity_have_all_trees(monkeypatch):
    seen = []

    class Train:
        def groupBy(self, *_):
            return self

        agg = orderBy = groupBy

        def collect(self):
            return [{"entity": "A"}, {"entity": "B"}]

    class Fitted:
        def predict(self, held):
            return held

    monkeypatch.setattr(models, "flag_week", lambda spark, d: None)
    monkeypatch.setattr(models, "_design", lambda panel: (Train(), None, ["x"]))
    monkeypatch.setattr(models, "_inside", lambda *a: None)
    monkeypatch.setattr(models.F, "avg", lambda c: type("C", (), {"alias": lambda self, a: None})())
    monkeypatch.setattr(models.F, "desc", lambda c: None)
    monkeypatch.setattr(models, "fit_forests", lambda train, names, target, plans, *a: seen.append(plans) or Fitted())
    models.forest_by_entity(None, "")
    (plans,) = seen
    assert [(p.trees, p.min_leaf, p.extra, p.criterion, p.log_target) for p in plans.values()] == [
        (500, 5, True, "poisson", False), (500, 5, False, "squared", True)
    ]
