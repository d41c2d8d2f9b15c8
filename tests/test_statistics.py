"""Survival statistics, concordance and resampling against brute force and known answers."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ebbtide import PanelConfig
from ebbtide.operators import metrics as M
from ebbtide.operators import survival as V
from ebbtide.operators.concordance import PairCounts, concordance
from ebbtide.operators.pairs import pair_counts
from ebbtide.operators.resample import (bootstrap_ci, concordance_draws, owner_bootstrap, owner_weights,
                                        paired_delta_bootstrap, score_models)
from ebbtide.operators.skew import average_ranks, exact_quantiles
from ebbtide.sources.tables import stack_models

CFG = PanelConfig()


def test_average_curve_on_marks(spark):
    d = spark.createDataFrame([("a", 3.0, True), ("b", 24.0, True), ("c", 24.0, False), ("d", 240.0, False)],
                              "entity string, fade_h double, faded boolean")
    s = dict(zip(CFG.marks, V.average_curve(d, CFG).first()["average"]))
    assert s[1.0] == 1 and s[3.0] == s[12.0] == 0.75
    assert s[24.0] == pytest.approx(0.75 * (1 - 1 / 3)) and s[240.0] == pytest.approx(0.5)


def test_rmst(spark):
    d = spark.createDataFrame([([0.5, 0.25, 0.1],)], "s array<double>")
    assert d.select(V.rmst([2.0, 4.0, 6.0], "s")).first()[0] == pytest.approx(3.5)
    assert d.select(V.rmst([5.0], "s")).first()[0] == 5.0
    assert d.select(V.rmst([], "s")).first()[0] == 0.0


def test_km_median_not_reached_is_the_largest_time(spark):
    d = spark.createDataFrame([(1.0, True), (5.0, False), (9.0, False)], "duration double, event boolean")
    r = V.km_median(d).first()
    assert (r.km_median, r.median_reached) == (9.0, False)


@pytest.mark.parametrize("rows", [None, 5])
def test_kaplan_meier_cut(spark, rows):
    rng = np.random.default_rng(2)
    t, e = rng.integers(1, 40, 300).astype(float), rng.random(300) < 0.6
    d = spark.createDataFrame(pd.DataFrame({"duration": t, "event": e}))
    got = V.kaplan_meier(d, max_rows=rows).orderBy("t").collect()
    s = 1.0
    for r in got:
        n, k = (t >= r.t).sum(), ((t == r.t) & e).sum()
        s *= 1 - k / n
        assert (r.at_risk, r.deaths) == (n, k) and r.s == pytest.approx(s, abs=1e-9)


def test_chi_square_tail():
    assert V.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert V.chi2_sf(5.991464547107979, 2) == pytest.approx(0.05, abs=1e-9)
    assert V.chi2_sf(11.070497693516351, 5) == pytest.approx(0.05, abs=1e-9)


def test_incomplete_beta_and_correlation_tails(spark):
    """Against closed forms: I_x(1, b), I_x(a, 1), symmetry, and Student's t with 1, 2 and 4 degrees."""
    from math import atan, lgamma, pi, sqrt
    from ebbtide.functions.special import correlation_p, incomplete_beta, log_gamma
    rows = [(a, b, x) for a in (0.5, 1.0, 3.0, 40.0, 900.0) for b in (0.5, 1.0, 2.5, 60.0) for x in (-0.1, 0.0, 1e-6, 0.03, 0.4, 0.7, 0.999, 1.0, 1.2)]
    d = spark.createDataFrame(rows, "a double, b double, x double")
    col = [F.col(c) for c in "abx"]
    got = {(r.a, r.b, r.x): r for r in d.select("*", incomplete_beta(*col).alias("i"), incomplete_beta(col[1], col[0], 1 - col[2]).alias("j"),
                                                log_gamma(col[0]).alias("g")).collect()}
    for (a, b, x), r in got.items():
        assert r.i + r.j == pytest.approx(1.0, abs=1e-11) and 0 <= r.i <= 1 and r.g == pytest.approx(lgamma(a), abs=1e-11, rel=1e-13)
        y = min(max(x, 0.0), 1.0)
        if a == 1.0:
            assert r.i == pytest.approx(1 - (1 - y) ** b, abs=1e-12)
        if b == 1.0:
            assert r.i == pytest.approx(y ** a, abs=1e-12)
    tail = {1: lambda t: 1 - 2 / pi * atan(t), 2: lambda t: 1 - t / sqrt(2 + t * t), 4: lambda t: 1 - t / sqrt(4 + t * t) * (1 + 2 / (4 + t * t))}
    for df, p in tail.items():
        r = 0.83
        t = r * sqrt(df / (1 - r * r))
        row = spark.range(1).select(correlation_p(F.lit(-r), F.lit(df + 2)).alias("p"), correlation_p(F.lit(1.0), F.lit(9)).alias("zero"),
                                    correlation_p(F.lit(0.0), F.lit(9)).alias("one"), correlation_p(F.lit(0.5), F.lit(2)).alias("few")).first()
        assert row.p == pytest.approx(p(t), abs=1e-12) and (row.zero, row.few) == (0.0, None) and row.one == pytest.approx(1.0)


def test_agreement_of_few_entities_says_so(spark):
    rows = [(10.0, 5.0, True), (20.0, 30.0, True), (30.0, -2.0, False), (5.0, None, True)]
    r = M.label_agreement(spark.createDataFrame(rows, "t_death double, t_saturation double, event_observed boolean")).first()
    assert (r.n_comparable, r.underpowered, r.spearman_rho, r.spearman_p) == (2, True, None, None)
    assert r.share_before_landmark == pytest.approx(1 / 3)


def test_logrank_separates_groups(spark):
    rng = np.random.default_rng(0)
    make = lambda scale: spark.createDataFrame(pd.DataFrame({
        "duration": np.concatenate([rng.exponential(10, 200), rng.exponential(scale, 200)]),
        "event": True, "stratum_tier": ["a"] * 200 + ["b"] * 200}))
    assert V.logrank_test(make(40)).first().p_value < 1e-6
    assert V.logrank_test(make(10)).first().p_value > 0.01


def brute(t, e, p):
    pairs = less = tied = 0
    for i in range(len(t)):
        if e[i]:
            later = (t > t[i]) | ((t == t[i]) & ~e)
            pairs += int(later.sum())
            less += int((later & (p > p[i])).sum())
            tied += int((later & (p == p[i])).sum())
    return pairs, less, tied


@pytest.mark.parametrize("seed,grain", [(0, 5), (1, 1000), (2, 2)])
@pytest.mark.parametrize("buckets", [1, 3, 30])
def test_concordance_equals_all_pairs(spark, seed, grain, buckets):
    rng = np.random.default_rng(seed)
    t, e, p = rng.integers(1, 25, 250).astype(float), rng.random(250) < 0.6, rng.integers(0, grain, 250).astype(float)
    t[:80] = 7.0                                    # a third at one time
    p[100:190] = 1.0                                # a third at one prediction
    d = spark.createDataFrame(pd.DataFrame({"duration": t, "event": e, "predicted": p}))
    r = concordance(d, buckets=buckets).first()
    assert (r.pairs, r.concordant, r.tied) == brute(t, e, p)


@pytest.mark.parametrize("leaf,fanout", [(4, 2), (10, 3)])
def test_concordance_split_again_and_again(spark, monkeypatch, leaf, fanout):
    """Oversized buckets are split until they fit, in several comparisons at once; the count stays exact."""
    from ebbtide.operators import concordance as C
    monkeypatch.setattr(C, "LEAF_ROWS", leaf), monkeypatch.setattr(C, "FANOUT", fanout), monkeypatch.setattr(C, "FEW_GROUPS", 2)
    rng = np.random.default_rng(leaf)
    m = np.array(["a", "b", "c"])[rng.integers(0, 3, 240)]
    t, e, p = rng.integers(1, 40, 240).astype(float), rng.random(240) < 0.6, np.round(rng.random(240), 2)
    t[:60], p[40:110] = 7.0, 0.5
    d = spark.createDataFrame(pd.DataFrame({"model": m, "duration": t, "event": e, "predicted": p}))
    got = {r.model: (r.pairs, r.concordant, r.tied) for r in concordance(d, by=["model"]).collect()}
    assert got == {x: brute(t[m == x], e[m == x], p[m == x]) for x in "abc"}


def test_resampled_c_equals_copies_of_owners(spark, monkeypatch):
    """Every draw's C is that of a table holding each owner as often as drawn, on a split grid as in one task."""
    from ebbtide.operators import concordance as C
    p = predictions(spark, 60, 12).round({"duration": 0, "predicted": 0})
    s = stack_models({"a": spark.createDataFrame(p), "b": spark.createDataFrame(p.assign(predicted=p.duration.to_numpy()[::-1]))})
    one = {(r.model, r.draw): (r.c_index, r.mae_log10) for r in concordance_draws(s, 8, 5).collect()}
    w = owner_weights(spark.createDataFrame(p), 8, 5).toPandas()
    for d in range(8):
        times = w[w.draw == d].set_index("owner").w
        x = p.loc[p.index.repeat(p.owner.map(times).fillna(0).astype(int))]
        pairs, less, tied = brute(x.duration.to_numpy(), x.event.to_numpy(), x.predicted.to_numpy())
        assert one["a", d][0] == pytest.approx((less + tied / 2) / pairs, abs=1e-12)
    monkeypatch.setattr(C, "LEAF_ROWS", 15), monkeypatch.setattr(C, "FANOUT", 4)
    many = {(r.model, r.draw): (r.c_index, r.mae_log10) for r in concordance_draws(s, 8, 5).collect()}
    assert many.keys() == one.keys() and all(many[k] == pytest.approx(one[k], abs=1e-12) for k in one)


def test_concordance_ends(spark):
    d = spark.createDataFrame([(float(i), True, float(i)) for i in range(1, 30)], "duration double, event boolean, predicted double")
    c = lambda x: concordance(d.withColumn("predicted", x)).first().c_index
    assert (c(F.col("predicted")), c(F.lit(3.0)), c(-F.col("predicted"))) == (1.0, 0.5, 0.0)
    assert concordance(d.withColumn("event", F.lit(False))).first().c_index is None


def test_weighted_pairs_equal_repeated_rows():
    rng = np.random.default_rng(5)
    t, p, w = rng.permutation(40).astype(float), rng.integers(0, 9, 40), rng.integers(0, 4, 40)
    less, equal, total = PairCounts(t, p).count(w, w)
    rep = np.repeat(np.arange(40), w)
    a, b = t[rep], p[rep]
    m = a[:, None] < a[None, :]
    assert total == m.sum() and less == (m & (b[:, None] < b[None, :])).sum()
    assert equal == (m & (b[:, None] == b[None, :])).sum()


@pytest.mark.parametrize("rows", [None, 10])
def test_pair_counts_equal_all_pairs(spark, rows):
    rng = np.random.default_rng(1)
    d = pd.DataFrame({"entity": [f"e{i}" for i in range(120)], "owner": rng.choice(["a", "b"], 120, p=[0.8, 0.2]),
                      "fade_h": rng.choice(CFG.marks, 120), "faded": rng.random(120) < 0.7,
                      "x": rng.integers(0, 15, 120).astype(float)})
    got = {r.owner: (r.score, r.pairs) for r in pair_counts(spark.createDataFrame(d), "x", max_rows=rows).collect()}
    for o, g in d.groupby("owner"):
        t, e, x = g.fade_h.to_numpy(), g.faded.to_numpy(), g.x.to_numpy()
        m = (t[:, None] < t[None, :]) & e[:, None]
        score = (m & (x[None, :] > x[:, None])).sum() + 0.5 * (m & (x[None, :] == x[:, None])).sum()
        assert got[o] == (score, m.sum())


@pytest.mark.parametrize("rows", [None, 3, 25])
def test_quantiles_and_ranks_when_cut(spark, rows):
    rng = np.random.default_rng(4)
    v = rng.integers(0, 30, 200).astype(float)
    d = spark.createDataFrame(pd.DataFrame({"v": v}))
    q = [0.0, 0.025, 0.2, 0.5, 0.975, 1.0]
    assert exact_quantiles(d, "v", q, max_rows=rows).first()["q"] == pytest.approx(np.quantile(v, q).tolist())
    want = pd.Series(v).rank().groupby(v).first().to_dict()
    assert {r.v: r["rank"] for r in average_ranks(d, "v", "rank", rows).collect()} == want


def test_rank_bins_of_a_constant_model(spark):
    d = spark.createDataFrame([(f"e{i}", 48.0) for i in range(101)], "entity string, predicted double")
    for rows in (None, 10):
        n = {r.bin: r["count"] for r in M.rank_bins(d, max_rows=rows).groupBy("bin").count().collect()}
        assert sorted(n) == list(range(10)) and max(n.values()) - min(n.values()) <= 1


def test_wilcoxon(spark):
    rng = np.random.default_rng(0)
    base = pd.DataFrame({"entity": [f"e{i}" for i in range(80)], "owner": "o", "duration": rng.exponential(50, 80) + 1, "event": True})
    s = lambda k: spark.createDataFrame(base.assign(predicted=base.duration * k))
    near, far = s(1.1 + 0.01 * rng.random(80)), s(3.0 + 0.01 * rng.random(80))
    r = M.wilcoxon_signed_rank(near, far).first()
    assert r.n_pairs == 80 and r.statistic == 0 and r.p_value < 1e-9 and r.median_diff < 0
    same = M.wilcoxon_signed_rank(near, near).first()
    assert same.statistic is None and same.p_value is None


def test_wilcoxon_exact_small_sample(spark):
    # Ten untied differences, all of one sign: p = 2 / 2^10.
    d = pd.DataFrame({"entity": [f"e{i}" for i in range(10)], "owner": "o", "duration": 10.0, "event": True})
    a = spark.createDataFrame(d.assign(predicted=10.0 * 10 ** (0.01 * np.arange(1, 11))))
    b = spark.createDataFrame(d.assign(predicted=10.0 * 10 ** (0.03 * np.arange(1, 11) + 0.001)))
    assert M.wilcoxon_signed_rank(a, b).first().p_value == pytest.approx(2 / 1024)


def predictions(spark, n=200, owners=20, seed=0):
    rng = np.random.default_rng(seed)
    t = rng.exponential(60, n) + 1
    return pd.DataFrame({"entity": [f"e{i}" for i in range(n)], "owner": [f"o{i % owners}" for i in range(n)],
                         "duration": t, "event": rng.random(n) < 0.8, "predicted": t * rng.lognormal(0, 0.5, n)})


def test_identical_models_never_differ(spark):
    p = spark.createDataFrame(predictions(spark))
    s = stack_models({"a": p, "b": p})
    r = paired_delta_bootstrap(score_models(s), concordance_draws(s, 40, 1), [("a", "b")]).first()
    assert (r.delta_c_index, r.delta_c_low, r.delta_c_high, r.delta_mae_log10) == (0, 0, 0, 0)
    assert r.draws == 40


def test_better_model_is_ahead(spark):
    p = predictions(spark)
    noise = p.assign(predicted=np.random.default_rng(9).exponential(60, len(p)))
    s = stack_models({"good": spark.createDataFrame(p), "bad": spark.createDataFrame(noise)})
    scores, drawn = score_models(s), concordance_draws(s, 60, 1)
    r = paired_delta_bootstrap(scores, drawn, [("good", "bad")]).first()
    assert r.delta_c_low > 0 and r.share_draws_ahead == 1.0
    ci = {x.model: x for x in bootstrap_ci(scores, drawn).collect()}
    assert ci["good"].c_low < ci["good"].c_index < ci["good"].c_high


def test_draws_repeat_and_sum_to_the_owners(spark):
    o = spark.createDataFrame([(f"o{i}",) for i in range(30)], "owner string")
    a = owner_weights(o, 20, 7).groupBy("draw").agg(F.sum("w").alias("n")).collect()
    assert len(a) == 20 and all(r.n == 30 for r in a)
    f = lambda d: sorted(tuple(r) for r in owner_weights(d, 20, 7).collect())
    assert f(o) == f(o.repartition(5))


def test_bootstrap_interval_has_the_right_width(spark):
    rng = np.random.default_rng(1)
    d = spark.createDataFrame(pd.DataFrame({"owner": [f"o{i}" for i in range(400)], "y": rng.random(400) < 0.3}))
    r = owner_bootstrap(d, {"n": F.lit(1), "y": F.col("y").cast("int")}, lambda: {"p": F.col("y") / F.col("n")}, 1000, 3).first()
    se = np.sqrt(0.3 * 0.7 / 400)
    assert r.low < r.point < r.high and (r.high - r.low) == pytest.approx(2 * 1.96 * se, rel=0.2)


def test_blend_weight_prefers_the_smallest_of_equal_losses(spark):
    row = {f"{k}_{h:g}": 0.4 for h in CFG.horizons for k in ("raw", "avg")}
    d = spark.createDataFrame([{**row, "faded": True, "fade_h": 24.0}, {**row, "faded": False, "fade_h": 240.0}])
    assert M.fit_blend_weight(d, CFG).first().b == 0.0


def test_unknown_status_is_left_out(spark):
    d = spark.createDataFrame([(True, 24.0), (False, 24.0), (False, 72.0)], "faded boolean, fade_h double")
    assert [r[0] for r in d.select(M.known_status(48.0)).collect()] == [True, False, True]


def test_draws_over_many_buckets_add_up_to_the_owners(spark, monkeypatch):
    """One scheme at any number of owners: every draw has as many as there are, each as likely."""
    from ebbtide.operators import resample
    monkeypatch.setattr(resample, "BUCKET_OWNERS", 10)
    o = spark.range(2000).select(F.col("id").cast("string").alias("owner"))
    w = owner_weights(o, 30, 1).cache()
    assert {r.n for r in w.groupBy("draw").agg(F.sum("w").alias("n")).collect()} == {2000}
    seen = w.agg(F.count("*").alias("k"), F.sum(F.col("w") * F.col("w")).alias("s")).first()
    assert seen.k / 60_000 == pytest.approx(1 - np.exp(-1), abs=0.01) and seen.s / 60_000 == pytest.approx(2.0, abs=0.05)
    assert replace(CFG, draws=5).draws == 5


def test_pair_counts_across_tiles_and_blocks():
    """Pairs inside a tile, inside a block of tiles and across blocks, with ties in both and any draws; few passes."""
    import numpy as np
    from ebbtide.operators import concordance as C
    rng = np.random.default_rng(8)
    for n, vals in ((1, 5), (130, 40), (3000, 70), (9000, 10 ** 6)):
        at = np.unique(rng.integers(0, vals, (n, 2)), axis=0)
        t, p = rng.permutation(at).T
        wi, wj = rng.integers(0, 4, (2, len(t), 2))
        k = C.PairCounts(t, p)
        assert len(k.levels) <= 2
        less, equal, total = k.count(wi, wj)
        first = t[:, None] < t[None, :]
        for got, m in ((less, first & (p[:, None] < p[None, :])), (equal, first & (p[:, None] == p[None, :])), (total, first)):
            assert got.tolist() == [float(wi[:, i] @ (m.astype(float) @ wj[:, i])) for i in range(2)]
    big = k.count(wi * 10 ** 6, wj)                                    # beyond single precision
    assert (big[0] == less * 10 ** 6).all()
