"""Models find a planted signal, find nothing in noise, and never see an owner twice."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ebbtide import PanelConfig
from ebbtide.models import survival as MS
from ebbtide.models.validate import assert_no_owner_leakage, group_folds, grouped_cv, null_outcome
from ebbtide.operators.concordance import concordance

CFG = PanelConfig()
FEATURES = ["x1", "x2"]


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(0)
    n, owners = 600, 40
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    t = np.exp(3.0 + 0.9 * x1 - 0.5 * x2 + 0.4 * rng.normal(size=n))
    d = pd.DataFrame({"entity": [f"e{i}" for i in range(n)], "owner": [f"o{i % owners}" for i in range(n)],
                      "x1": x1, "x2": np.where(rng.random(n) < 0.1, np.nan, x2), "x3": x1 * 2 + 1,
                      "duration": np.minimum(t, 336.0), "event": t <= 336.0})
    return spark.createDataFrame(d)


@pytest.mark.parametrize("model,bar", [
    (MS.WeibullAFT(["x1", "x2", "x3"]), 0.75), (MS.LogLinear(FEATURES), 0.75),
    (MS.GradientBoosted(FEATURES, rounds=8), 0.7),
    (MS.HazardForest(FEATURES, list(CFG.marks), trees=10), 0.7)])
def test_planted_signal_is_found(planted, model, bar):
    assert concordance(grouped_cv([model], planted, 2)).first().c_index > bar


def test_collinear_columns_are_dropped(planted):
    m = MS.WeibullAFT(["x1", "x2", "x3"]).fit(planted)
    assert m.design.columns == ("x1", "x2")


def test_aft_predicts_the_median(planted):
    p = MS.WeibullAFT(FEATURES).fit(planted).predict(planted)
    share = p.agg(F.avg((F.col("duration") > F.col("predicted")).cast("double"))).first()[0]
    assert 0.4 < share < 0.6


def test_constant_columns_fall_back(spark, planted):
    flat = planted.withColumn("x1", F.lit(1.0))
    p = MS.WeibullAFT(["x1"]).fit(flat).predict(flat).select("predicted").distinct().collect()
    assert len(p) == 1 and p[0].predicted > 0


def test_too_few_events_fall_back(planted):
    few = planted.withColumn("event", F.col("entity") == "e1")
    assert MS.LogLinear(FEATURES).fit(few).value > 0
    assert MS.HazardForest(FEATURES, list(CFG.marks)).fit(few).value > 0


def test_folds_differ_by_one_owner_at_most(spark, monkeypatch):
    """Sizes as uneven as can be; a deal over many pieces gives the same folds."""
    from ebbtide.models import validate
    from ebbtide.operators import skew
    rows = [(f"o{i:03d}",) for i in range(60) for _ in range(1 + (i * i) % 97)] + [("big",)] * 400
    d = spark.createDataFrame(rows, "owner string")
    f = {r.owner: r.fold for r in group_folds(d, 4).collect()}
    load = [0] * 4
    for (o,) in rows:
        load[f[o]] += 1
    assert len(f) == 61 and max(load) - min(load) <= 400
    monkeypatch.setattr(validate, "split_hot", lambda df, by, order: skew.split_hot(df, by, order, max_rows=7))
    assert {r.owner: r.fold for r in group_folds(d, 4).collect()} == f
    few = {r.owner: r.fold for r in group_folds(spark.createDataFrame([("a",), ("b",)], "owner string"), 5).collect()}
    assert sorted(few.values()) == [0, 1]


def test_folds_keep_owners_together_and_balance(planted):
    f = planted.join(group_folds(planted, 5), "owner")
    sizes = [r["count"] for r in assert_no_owner_leakage(f).groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 15
    with pytest.raises(AssertionError):
        assert_no_owner_leakage(planted.withColumn("fold", F.pmod(F.hash("entity"), F.lit(2))))
    with pytest.raises(ValueError):
        group_folds(planted.withColumn("owner", F.lit("one")))


def test_null_outcome_is_not_predictable_across_owners(planted):
    d = null_outcome(planted, 7).cache()
    m = MS.LogLinear(["log_follower_count"])
    grouped = concordance(grouped_cv([m], d, 3)).first().c_index
    # The same model scored on its own training owners does better: that is the leak.
    seen = concordance(MS.GradientBoosted(["log_follower_count"], rounds=15).fit(d).predict(d)).first().c_index
    assert grouped < 0.62 and seen > grouped + 0.05


def test_person_periods(spark):
    d = spark.createDataFrame([("a", 4.0, True), ("b", 4.0, False), ("c", 99.0, True)], "entity string, duration double, event boolean")
    got = {}
    for r in MS.person_periods(d, [1.0, 3.0, 6.0]).collect():
        got.setdefault(r.entity, []).append((r.mark, r.ended))
    assert {k: sorted(v) for k, v in got.items()} == {
        "a": [(1.0, 0.0), (3.0, 0.0), (6.0, 1.0)], "b": [(1.0, 0.0), (3.0, 0.0)], "c": [(1.0, 0.0), (3.0, 0.0), (6.0, 0.0)]}


def test_blend_runs_from_average_to_raw(spark):
    d = spark.createDataFrame([([0.9, 0.5], [0.6, 0.2])], "r array<double>, a array<double>")
    for b, want in ((1.0, [0.9, 0.5]), (0.0, [0.6, 0.2])):
        assert d.select(MS.blend("r", "a", b)).first()[0] == pytest.approx(want)


def test_curves_decrease(planted):
    m = MS.HazardForest(FEATURES, list(CFG.marks), trees=10).fit(planted)
    for r in m.curve(planted).limit(50).collect():
        assert all(a >= b for a, b in zip(r.curve, r.curve[1:])) and 0 <= r.curve[-1] <= r.curve[0] <= 1


def test_the_registered_evaluation_runs_in_full(monkeypatch):
    """No parameter of the query cuts the work: folds, draws, trees and rounds are those of the study."""
    import inspect
    from types import SimpleNamespace

    from checks import evaluation
    full, seen = inspect.signature(evaluation.E.evaluate), {}

    def record(*args, **kwargs):
        given = full.bind(*args, **kwargs)
        given.apply_defaults()
        seen.update(given.arguments)
        return SimpleNamespace(scores="scores")

    monkeypatch.setattr(evaluation, "staged", lambda spark, sf: SimpleNamespace(frame="frame"))
    monkeypatch.setattr(evaluation.E, "evaluate", record)
    assert evaluation.evaluate(None, "sf") == "scores"
    assert (seen["frame"], seen["models"], seen["trees"], seen["rounds"]) == ("frame", None, 300, 200)
    assert (seen["cfg"].draws, seen["cfg"].folds) == (2000, 5)


def test_folds_fitted_side_by_side_are_those_fitted_alone(planted):
    """Every fold is predicted by models of the other folds; no two models marked `alone` are fitted at once."""
    import threading
    import time
    busy, most = [], []

    class Alone(MS.LogLinear):
        alone = True

        def fit(self, train, profile=None):
            busy.append(threading.get_ident())
            most.append(len(busy))
            time.sleep(0.2)
            m = super().fit(train, profile)
            busy.pop()
            return m

    got = grouped_cv([Alone(FEATURES), MS.ConstantLifetime(5.0)], planted, 3)
    assert max(most) == 1 and len(most) == 3
    mine = {r.entity: (r.fold, r.predicted) for r in got.filter("model = 'loglinear_uncensored'").collect()}
    folds = planted.join(group_folds(planted, 3), "owner").cache()
    for f in range(3):
        m = MS.LogLinear(FEATURES).fit(folds.filter(F.col("fold") != f))
        for r in m.predict(folds.filter(F.col("fold") == f)).collect():
            assert mine[r.entity][0] == f and mine[r.entity][1] == pytest.approx(r.predicted, rel=1e-6)
    assert len(mine) == 600 and got.filter("model = 'constant_48h' AND predicted = 5.0").count() == 600
