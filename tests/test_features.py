"""Features never look past the cutoff."""

import datetime as dt
from math import isclose, log10

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ebbtide import PanelConfig
from ebbtide.operators import features as feat
from ebbtide.operators.history import prior_median
from ebbtide.operators.series import asof_join, value_at

CFG = PanelConfig(feature_cutoff=6.0)
EARLY = [(0.5, 50), (1, 100), (3, 300), (6, 600)]


def test_late_readings_change_nothing(series):
    late = [*EARLY, (12, 50000), (24, 900000), (72, 5000000)]
    a = feat.early_features(series(x=EARLY), CFG).drop("n_values").first()
    b = feat.early_features(series(x=late), CFG).drop("n_values").first()
    assert a == b and a.value_at_m3 == 600.0


def test_marks_are_interpolated_never_extrapolated(series):
    r = value_at(series(x=[(0, 0), (2, 20)], y=[(1, 5)]), [1.0, 2.0, 3.0]).orderBy("entity").collect()
    assert (r[0].v0, r[0].v1, r[0].v2) == (10.0, 20.0, None)
    assert (r[1].v0, r[1].n_readings) == (None, 1)


def test_gap_limit(series):
    d = series(x=[(1, 0), (12, 110)])
    assert value_at(d, [4.0], max_gap=8.0).first().v0 is None
    assert value_at(d, [4.0], max_gap=12.0).first().v0 == pytest.approx(30.0)


def test_growth_is_scale_free(series):
    f = lambda k: feat.early_features(series(x=[(t, v * k) for t, v in EARLY]), CFG).first()
    a, b = f(1), f(1000)
    assert isclose(a.log_growth_12, b.log_growth_12) and isclose(a.decay_ratio, b.decay_ratio)
    assert feat.early_features(series(x=[(0, 0), (1, 0), (3, 5), (6, 9)]), CFG).first().log_growth_12 is None


def test_leak_is_caught(spark):
    ok = spark.createDataFrame([(5.0,)], "first_observed_at_hours double")
    assert feat.assert_no_leak(ok, 6.0) is ok
    with pytest.raises(AssertionError):
        feat.assert_no_leak(spark.createDataFrame([(6.5,)], "first_observed_at_hours double"), 6.0)


def owner_frame(spark, rows):
    return spark.createDataFrame(
        [(f"e{i}", o, dt.datetime(2026, 9, d), v) for i, (o, d, v) in enumerate(rows)],
        "entity string, owner string, published_at timestamp, velocity_to_m3 double")


def test_owner_history_uses_earlier_entities_only(spark):
    base = [("a", 1, 10.0), ("a", 2, 20.0), ("a", 3, 60.0)]
    get = lambda rows: {r.entity: r for r in feat.owner_relative(owner_frame(spark, rows), CFG).collect()}
    a, b = get(base), get([*base, ("a", 4, 1e9)])
    assert a["e0"].log_rel_velocity is None and a["e1"].log_rel_velocity is None
    assert isclose(a["e2"].log_rel_velocity, log10(60 / 15)) and a["e2"].n_prior == 2
    assert all(a[k] == b[k] for k in a)


@pytest.mark.parametrize("rows", [None, 60, 9, 3])
def test_prior_median_of_a_cut_owner(spark, rows):
    import random
    rnd = random.Random(7)
    data = [(rnd.choice("aaaaab"), rnd.randint(1, 28), None if rnd.random() < 0.1 else float(rnd.randint(0, 40)))
            for _ in range(200)]
    d = owner_frame(spark, data)
    got = prior_median(d, "velocity_to_m3", rows).toPandas().set_index("entity").sort_index()
    p = pd.DataFrame([(f"e{i}", o, x, v) for i, (o, x, v) in enumerate(data)], columns=["entity", "owner", "day", "v"])
    p = p.sort_values(["owner", "day", "entity"])
    p["m"] = p.groupby("owner")["v"].transform(lambda s: s.shift(1).expanding().median())
    want = p.set_index("entity")["m"].sort_index()
    assert [None if pd.isna(x) else float(x) for x in got.prior_median] == [None if pd.isna(x) else x for x in want]


def test_engagement_ignores_readings_after_the_landmark(spark):
    rows = [("x", 1.0, 100, 10, 1), ("x", 6.5, 1000, 50, 5), ("x", 7.2, 2000, 1000, 900)]
    make = lambda r: spark.createDataFrame(r, "entity string, age_hours double, views long, likes long, comments long")
    a, b = feat.engagement_at(make(rows[:2]), 7.0).first(), feat.engagement_at(make(rows), 7.0).first()
    assert a == b and isclose(a.log_like_rate, log10(0.05))


def test_missing_counter_falls_back_to_an_earlier_reading(spark):
    d = spark.createDataFrame([("x", 1.0, 100, 10, 1), ("x", 6.0, 1000, None, 5)],
                              "entity string, age_hours double, views long, likes long, comments long")
    assert isclose(feat.engagement_at(d, 7.0).first().log_like_rate, log10(10 / 1000))


def test_trajectory(series):
    r = feat.trajectory_at(series(x=[(0, 0), (1, 100), (3, 200), (24, 410)]), 25.0).first()
    assert isclose(r.speed_share_at_landmark, 0.1) and isclose(r.log_value_at_landmark, log10(411))


def test_top_categories_break_ties_by_name(spark):
    d = spark.createDataFrame([("b",), (" B",), ("a",), ("A ",), ("c",), (None,), ("",)], "stratum_category string")
    assert feat.top_categories(d, limit=2) == ["a", "b"]
    out = feat.category_dummies(d, limit=2).filter(F.col("stratum_category").isNull()).first()
    assert (out.cat_a, out.cat_b) == (0.0, 0.0)


def test_usable_features(spark):
    d = spark.createDataFrame([(1.0, None, 3.0), (2.0, None, 3.0), (3.0, 1.0, 3.0)], "a double, b double, c double")
    assert feat.usable_features(d, ["a", "b", "c", "missing"]) == ["a"]


@pytest.mark.parametrize("rows", [None, 4])
def test_asof_join_against_pandas(spark, rows):
    import random
    rnd = random.Random(3)
    at = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rnd.randint(0, 500))
    left = pd.DataFrame({"k": [rnd.choice("ab") for _ in range(60)], "ts": [at() for _ in range(60)], "i": range(60)})
    right = pd.DataFrame({"k": [rnd.choice("ab") for _ in range(40)], "ts": [at() for _ in range(40)],
                          "v": range(40)}).drop_duplicates(["k", "ts"])
    got = asof_join(spark.createDataFrame(left), spark.createDataFrame(right), "k", "ts", ["v"], rows).toPandas()
    want = pd.merge_asof(left.sort_values("ts"), right.sort_values("ts"), on="ts", by="k")
    a = got.set_index("i")["asof_v"].sort_index().fillna(-1).astype(int)
    b = want.set_index("i")["v"].sort_index().fillna(-1).astype(int)
    assert a.tolist() == b.tolist()


def test_prior_medians_of_whole_arrays():
    """Every prefix's median at once, with values missing, repeated and left out below."""
    import numpy as np
    from ebbtide.operators.history import prefix_quantiles, prior_medians
    rng = np.random.default_rng(1)
    ranks = rng.permutation(77)
    length = rng.integers(1, 78, 200)
    k = (rng.random(200) * length).astype(int)
    assert prefix_quantiles(ranks, length, k).tolist() == [sorted(ranks[:n])[j] for n, j in zip(length, k)]
    for n in (0, 1, 2, 3, 50, 400):
        v = rng.integers(0, 30, n).astype(float)
        v[rng.random(n) < 0.2] = np.nan
        got, seen = prior_medians(v, np.empty(0), 0, 0)
        want = [np.nanmedian(v[:i]) if np.isfinite(v[:i]).any() else np.nan for i in range(n)]
        assert np.allclose(got, want, equal_nan=True) and seen.tolist() == [int(np.isfinite(v[:i]).sum()) for i in range(n)]
    earlier, v = np.sort(rng.random(101)), rng.random(12)
    got, seen = prior_medians(v, earlier[40:62], 40, 101)                # the values that can still be the median
    assert np.allclose(got, [np.median(np.concatenate((earlier, v[:i]))) for i in range(12)]) and seen[0] == 101


def test_medians_of_many_owners_at_once(spark, monkeypatch):
    """Whole tasks of owners in one pass, cut into chunks anywhere, give each owner's own medians; no call per owner."""
    import numpy as np
    from ebbtide.operators import chunks, history
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 9, 60)
    values, starts = rng.integers(0, 9, sizes.sum()).astype(float), np.concatenate(([0], np.cumsum(sizes)[:-1]))
    values[rng.random(len(values)) < 0.2] = np.nan
    zero = np.zeros(len(values), np.int64)
    got, seen = history.grouped_medians(values, np.zeros(len(values), bool), starts, zero, zero)
    for a, n in zip(starts, sizes):
        for i in range(a, a + n):
            before = values[a:i][~np.isnan(values[a:i])]
            assert seen[i] == len(before) and (np.isnan(got[i]) if not len(before) else got[i] == np.median(before))
    monkeypatch.setattr(chunks, "CHUNK", 7)
    base = dt.datetime(2024, 1, 1)
    rows = [(f"o{g}", f"e{a + i:03d}", base + dt.timedelta(days=i), None if np.isnan(values[a + i]) else float(values[a + i]))
            for g, (a, n) in enumerate(zip(starts, sizes)) for i in range(n)]
    d = spark.createDataFrame(rows, "owner string, entity string, published_at timestamp, v double").unionByName(
        spark.createDataFrame([(None, "x", base, 1.0), ("o0", "y", None, 1.0)], "owner string, entity string, published_at timestamp, v double"))
    out = prior_median(d, "v")
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
    have = {r.entity: (r.prior_median, r.n_prior) for r in out.collect()}
    assert have == {f"e{i:03d}": (None if np.isnan(got[i]) else got[i], seen[i]) for i in range(len(values))}


def test_pieces_are_bounded_by_their_number_not_by_a_small_limit(spark):
    """A small limit of rows never makes a task for every few rows of a large table; without a limit the rows decide."""
    from ebbtide.operators import skew
    assert skew.n_pieces(36_000_000, 200) == skew.PIECES and skew.n_pieces(100, 30) == 4
    assert skew.n_pieces(10_000 * skew.HOT_ROWS, 200) == skew.n_pieces(10_000 * skew.HOT_ROWS, skew.HOT_ROWS) == 10_000
    g = skew.split_hot(spark.range(3000).select((F.col("id") % 2).alias("k"), F.col("id").alias("at")), ["k"], "at", 2)
    rows = skew.running(g, ["at"], {"n": ("sum", F.lit(1))}).df.toPandas()
    assert 50 < rows[skew.SEG].nunique() <= skew.PIECES and (rows.n == rows["at"] // 2 + 1).all()
