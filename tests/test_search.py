"""The registered search has all candidates and its refit."""

from voxdesk.operators import classifiers
from voxdesk.plans import registry

SF = "/root/testdata/sf0.001"


def test_search_scores_every_candidate(spark, monkeypatch):
    wanted = [c for grid in classifiers.default_grids() for c in grid]
    monkeypatch.setattr(classifiers, "tuning_scores", lambda df, column, listed, **_: [(c, 0.5) for c in listed])
    rows = registry.queries()["tuning_scores"](spark, SF).collect()
    assert [(r["c"], r["terms"], r["solver"], r["penalty"]) for r in rows] == [
        (c.c, c.terms, c.solver, c.penalty) for c in wanted
    ]


def test_winner_is_refitted_and_predicts(spark, monkeypatch):
    best = classifiers.Candidate(c=10.0, terms=10_000)
    monkeypatch.setattr(
        classifiers, "tuning_scores", lambda df, column, listed, **_: [(c, float(c == best)) for c in listed]
    )
    fitted = []
    fit = classifiers.fit_task
    monkeypatch.setattr(classifiers, "fit_task", lambda df, column, c: fitted.append(c) or fit(df, column, c))
    rows = registry.queries()["tuned_predictions"](spark, SF).collect()
    assert fitted == [best] and rows and all(r["y_pred"] is not None for r in rows)


def test_all_grids_are_searched_in_one_pass(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(classifiers, "tuning_scores", lambda df, column, listed, **_: asked.append(listed) or [(c, 0.5) for c in listed])
    monkeypatch.setattr(classifiers, "fit_task", lambda df, column, c: c)
    grids = classifiers.default_grids()
    _, best, score = classifiers.fit_best(None, "intent")
    assert asked == [[c for grid in grids for c in grid]]
    assert (best, score) == (grids[0][0], 0.5)  # the second grid wins only if strictly better


def test_both_tasks_share_one_vectorizer(spark, monkeypatch):
    from voxdesk.plans import model_queries
    from voxdesk.plans.views import Tables

    made, fit = [], classifiers.fit_vectorizer
    monkeypatch.setattr(classifiers, "fit_vectorizer", lambda df, *a: made.append(1) or fit(df, *a))
    intent, severity = model_queries._models(Tables(spark, SF))
    assert len(made) == 1
    df = Tables(spark, SF).documents()
    both = classifiers.predict_tasks([intent, severity], df).select("doc_id", "predicted_intent", "predicted_severity")
    own = classifiers.predict(intent, df).select("doc_id", "predicted_intent").join(
        classifiers.predict(severity, df).select("doc_id", "predicted_severity"), "doc_id"
    )
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, own.collect()))
