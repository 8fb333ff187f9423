"""Registered boosting runs fit with the full settings; fits are recorded, not run."""

import pytest

from blockreach.operators import explain as ex, models as md
from blockreach.plans import attribution, load_all, modeling as pm
from blockreach.plans.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"
load_all()


class Recorded(Exception):
    pass


@pytest.fixture
def asked(monkeypatch):
    """Settings of every fit of a run."""
    settings = []

    def record(df, features, target, chosen, *more):
        settings.extend(chosen)
        raise Recorded

    monkeypatch.setattr(md, "fit_models", record)
    return settings


def test_tuning_fits_the_candidates_as_they_are(spark, asked):
    with pytest.raises(Recorded):
        QUERIES["ml09_candidate_tuning"](spark, FOLDER)
    assert asked == list(md.CANDIDATES.values())
    assert {c.l2 for c in asked} == {1.0, 2.0, 3.0, 5.0} and {c.l1 for c in asked} == {0.0, 0.05}


@pytest.mark.parametrize("name, fits", [
    ("ml06_boosted_regression", 1), ("ml07_gain_importances", 1), ("ml08_leave_one_city_out_run", 10), ("ml14_boosted_attributions", 1), ("ml19_boosted_dependence", 1),
])
def test_boosted_runs_use_the_full_settings(spark, asked, name, fits):
    with pytest.raises(Recorded):
        QUERIES[name](spark, FOLDER)
    # Held-out cities differ in their seed only.
    assert asked == [md.Boosting(seed=42 + i) for i in range(fits)]


def test_clusters_are_the_best_of_fifty_starts(spark, monkeypatch):
    started = []

    def gather(rows, k, starts, seed):
        started.extend(range(starts))
        raise Recorded

    monkeypatch.setattr(ex, "fit_starts", gather)
    with pytest.raises(Recorded):
        QUERIES["ml17_attribution_clusters"](spark, FOLDER)
    assert started == list(range(50))


def test_curves_are_drawn_for_every_feature(spark, monkeypatch):
    drawn = []
    monkeypatch.setattr(attribution, "fitted", lambda spark, folder: (None, None))
    monkeypatch.setattr(ex, "partial_dependence", lambda model, df, features, curves, **more: drawn.extend(curves))
    QUERIES["ml19_boosted_dependence"](spark, FOLDER)
    assert drawn == list(pm.X)
