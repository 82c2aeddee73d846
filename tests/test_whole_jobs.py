"""Registered queries and operators do their whole job: defaults, selectors, sizes and parts without cuts."""

import inspect
import logging
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from panelspark.operators import impute, resample, select, synth

SF = "/root/testdata/sf0.001"


class _Fitted(Exception):
    """Stops a query where its model would be fitted."""


@pytest.mark.parametrize("name, trees", [("select_boosting", 500), ("feature_importance_rank", 500), ("boosting_importance_rank", 500), ("xgb_importance_rank", 100)])
def test_tree_queries_run_the_default_number_of_trees(spark, monkeypatch, name, trees):
    fitted = []

    def stop(model, data):
        fitted.append(model.getMaxIter() if model.hasParam("maxIter") else model.getNumTrees())
        raise _Fitted

    def stop_boosting(blocks, columns, bins, settings):
        fitted.append(settings.trees)
        raise _Fitted

    monkeypatch.setattr(select, "_fit_importances", stop)
    monkeypatch.setattr(select.boost, "fit_trees", stop_boosting)
    with pytest.raises(_Fitted):
        entry.queries()[name](spark, SF)
    assert set(fitted) == {trees}


@pytest.mark.parametrize(
    "module, operator, name, want",
    [(select, "adaboost_importance_rank", "adaboost_importance_rank", {"rounds": 500}), (impute, "impute_forest", "impute_forest", {"trees": 100, "rounds": 10})],
)
def test_round_queries_run_the_default_number_of_rounds(spark, monkeypatch, module, operator, name, want):
    given, shape = {}, inspect.signature(getattr(module, operator))

    def stop(*args, **kw):
        bound = shape.bind(*args, **kw)
        bound.apply_defaults()
        given.update(bound.arguments)
        raise _Fitted

    monkeypatch.setattr(module, operator, stop)
    with pytest.raises(_Fitted):
        entry.queries()[name](spark, SF)
    assert {k: given[k] for k in want} == want


def test_votes_are_those_of_the_six_selectors(spark, monkeypatch):
    """Fewer trees keep the test short; every selector is its own query's."""
    for name in ("select_forest", "select_boosting"):
        monkeypatch.setattr(select, name, partial(getattr(select, name), trees=3))
    picked = {}
    for name in ("select_correlation", "select_anova_f", "select_logistic", "select_forest", "select_rfe", "select_boosting"):
        for r in entry.queries()[name](spark, SF).collect():
            picked[r["feature"], r["selector"]] = int(r["picked"])
    assert {s for _, s in picked} == set(select.SELECTORS)
    votes = {r["feature"]: r for r in entry.queries()["vote_selectors"](spark, SF).collect()}
    assert {(f, s): r[s] for f, r in votes.items() for s in select.SELECTORS} == picked
    for f, r in votes.items():
        n = sum(picked[f, s] for s in select.SELECTORS)
        assert r["total"] == n and r["chosen"] == (n >= select.VOTES_NEEDED)


def points(n_rows):
    """Rows of which a third are one point."""
    rnd = np.random.default_rng(3)
    return [[1.5, 1.5] if i % 3 == 0 else rnd.normal(size=2).tolist() for i in range(n_rows)]


def lloyd(x, start, rounds):
    at = np.array(start)
    for _ in range(rounds):
        own = ((x[:, None] - at[None]) ** 2).sum(axis=2).argmin(axis=1)
        at = np.array([x[own == j].mean(axis=0) if (own == j).any() else at[j] for j in range(len(at))])
    return at


@pytest.mark.parametrize("center_bytes", [0, 16 << 20])
def test_centroids_are_those_of_lloyd_at_any_size(spark, monkeypatch, center_bytes):
    """The same rounds whether the centroids go to the tasks or meet the rows through the neighbour join."""
    monkeypatch.setattr(resample, "CENTER_BYTES", center_bytes)
    x = points(240)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "id long, vec array<double>").repartition(3)
    start = [tuple(r["vec"]) for r in resample.centroids(df, 20, rounds=0).orderBy("cid").collect()]
    assert len(set(start)) == 20 and set(start) <= set(map(tuple, x))
    got = np.array([r["vec"] for r in resample.centroids(df, 20, rounds=3, tol=0).orderBy("cid").collect()])
    assert np.allclose(got, lloyd(np.array(x), start, 3))


def test_centroids_are_the_means_of_their_rows(spark):
    rows = [(i, v, 0) for i, v in enumerate(points(400))] + [(1000 + i, [9.0, 9.0], 1) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, label int")
    out = resample.under_centroids(df, rounds=100, tol=0).collect()
    made = np.array([r["vec"] for r in out if r["label"] == 0])
    assert len(made) == 60 and sum(r["label"] == 1 for r in out) == 60
    assert all(r["synthetic"] and r["id"] is None for r in out if r["label"] == 0)
    assert np.allclose(lloyd(np.array(points(400)), made, 1), made)


def test_centroids_of_few_distinct_rows_repeat(spark):
    df = spark.createDataFrame([(i, [float(i % 2)]) for i in range(9)], "id long, vec array<double>")
    got = sorted(r["vec"][0] for r in resample.centroids(df, 5).collect())
    assert len(got) == 5 and got.count(0.0) in (2, 3)


def test_rebalancing_of_empty_and_unlabelled_tables(spark):
    schema = "id long, vec array<double>, label int"
    for rows in ([], [(1, [0.0], None), (2, [1.0], None)]):
        df = spark.createDataFrame(rows, schema)
        for name, f in (resample.OVER | resample.UNDER).items():
            out = f(df, nominal_from=1) if name == "cate_smote" else f(df)
            assert out.count() == 0, name
        assert resample.rebalance(df, "both", "ros", "rus").count() == 0


def test_wide_panel_keeps_every_planned_feature(caplog):
    numerics = [f"n{i}" for i in range(29)]
    feats = synth.plan_features(numerics, ["b"], ["c"])
    assert len(feats) == 29 * 7 + 29 * 28 + 3 + 2 and {f.agg for f in feats} == set(synth.AGGREGATES)
    with caplog.at_level(logging.WARNING):
        assert len(synth.plan_features(numerics, ["b"], ["c"], max_features=1018)) == 1018
    assert "leaves out 2 of 1020" in caplog.text and "mode__c" in caplog.text
