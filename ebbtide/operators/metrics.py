"""Scores, calibration and agreement over prediction tables.

A prediction table has `entity, owner, duration, event, predicted` (and `model`
where several are stacked).
"""

from __future__ import annotations

from math import erfc, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.config import PanelConfig
from ebbtide.functions.special import correlation_p
from ebbtide.operators.skew import average_ranks, exact_quantiles, group_total, running, split_hot
from ebbtide.operators.survival import km_median

_FLOOR = 1e-6


def known_status(h: float) -> Column:
    """Status at `h` is known: ended by then, or followed past it."""
    return F.col("faded") | (F.col("fade_h") > h)


def outcome_at(h: float) -> Column:
    return F.col("faded") & (F.col("fade_h") <= h)


def log_error(time: str = "duration", predicted: str = "predicted") -> Column:
    clip = lambda x: F.log10(F.greatest(F.col(x).cast("double"), F.lit(_FLOOR)))
    return clip(time) - clip(predicted)


def log_errors(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """MAE and RMSE on log10 time, over observed events only."""
    e = log_error()
    return df.filter("event").groupBy(*by).agg(
        F.avg(F.abs(e)).alias("mae_log10"), F.sqrt(F.avg(e * e)).alias("rmse_log10"),
        F.count(F.lit(1)).alias("n_events"))


def fold_scores(stacked: DataFrame, by: list[str] = ("model", "fold")) -> DataFrame:
    """Errors per model and fold of an out-of-fold table."""
    return log_errors(stacked, list(by))


def brier_skill(df: DataFrame, h: float, predicted: str, baseline: str, by: list[str] = ()) -> DataFrame:
    """1 - Brier(model) / Brier(baseline) over rows of known status."""
    y = outcome_at(h).cast("double")
    sq = lambda x: F.pow(F.col(x) - y, 2)
    return df.filter(known_status(h)).groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(y).alias("observed"), F.avg(predicted).alias("predicted"),
        (1 - F.sum(sq(predicted)) / F.nullif(F.sum(sq(baseline)), F.lit(0.0))).alias("brier_skill"))


def flag_metrics(df: DataFrame, predicted: str = "predicted", fast: str = "fast",
                 share: float = 0.20, max_rows: int | None = None) -> DataFrame:
    """Flag the `share` predicted shortest-lived: precision, base rate, recall, lift."""
    return (flagged(df, predicted, share, max_rows).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("flagged").alias("n_flagged"),
        F.count_if(F.col(fast)).alias("n_fast"),
        F.count_if(F.col("flagged") & F.col(fast)).alias("n_hit"))
        .withColumns({"precision": F.col("n_hit") / F.nullif("n_flagged", F.lit(0)),
                      "base_rate": F.col("n_fast") / F.nullif("n", F.lit(0)),
                      "recall": F.col("n_hit") / F.nullif("n_fast", F.lit(0))})
        .withColumns({"precision_minus_base": F.col("precision") - F.col("base_rate"),
                      "lift": F.col("precision") / F.nullif("base_rate", F.lit(0.0))}))


def flagged(df: DataFrame, predicted: str = "predicted", share: float = 0.20,
            max_rows: int | None = None) -> DataFrame:
    """The rows with a `flagged` column: prediction at or below its `share` quantile."""
    cut = exact_quantiles(df, predicted, [share], name="_q", max_rows=max_rows).select(F.col("_q")[0].alias("_cut"))
    return (df.crossJoin(F.broadcast(cut))                   # one row
            .withColumn("flagged", F.coalesce(F.col(predicted) <= F.col("_cut"), F.lit(False))).drop("_cut"))


def risk_thresholds(df: DataFrame, p: str, share: float = 0.20, max_rows: int | None = None) -> DataFrame:
    """High and low cut-offs: the top and bottom `share` of predicted chances."""
    return exact_quantiles(df, p, [1 - share, share], max_rows=max_rows).select(
        F.col("q")[0].alias("high"), F.col("q")[1].alias("low"))


def calibration_deciles(df: DataFrame, p: str, y: str, bins: int = 10,
                        max_rows: int | None = None) -> DataFrame:
    """Mean predicted and observed per quantile bin; equal edges merge."""
    edges = exact_quantiles(df, p, [i / bins for i in range(bins + 1)], name="_e", max_rows=max_rows)
    edges = edges.select(F.array_distinct("_e").alias("_e"))
    inner = F.slice("_e", 2, F.greatest(F.size("_e") - 2, F.lit(0)))
    d = df.filter(F.col(p).isNotNull()).crossJoin(F.broadcast(edges))        # one row
    d = d.withColumn("bin", F.size(F.filter(inner, lambda e: e < F.col(p))))
    return d.groupBy("bin").agg(F.avg(p).alias("predicted"), F.avg(F.col(y).cast("double")).alias("observed"),
                                F.count(F.lit(1)).alias("n"))


def rank_bins(df: DataFrame, predicted: str = "predicted", bins: int = 10, tie: str = "entity",
              max_rows: int | None = None) -> DataFrame:
    """Equal-count bins by rank of the prediction, ties in the order of a hash of `tie`.

    The rank is the number of rows with a smaller value plus the position among
    equal ones; a model that says one thing for everything is cut along the hash.
    """
    d = df.filter(F.col(predicted).isNotNull())
    values = d.groupBy(predicted).agg(F.count(F.lit(1)).alias("_c"))
    v = running(split_hot(values, [], predicted, max_rows), [predicted], {"_before": ("sum", "_c")}, inclusive=False)
    v = group_total(v, {"_n": ("sum", "_c")})
    base = v.df.select(predicted, F.coalesce("_before", F.lit(0)).alias("_before"), "_n")
    g = split_hot(d.withColumn("_h", F.xxhash64(tie)), [predicted], "_h", max_rows)
    g = running(g, ["_h", tie], {"_pos": ("sum", F.lit(1))})
    r, n = F.col("_before") + F.col("_pos"), F.col("_n")
    edge = F.when(n > 1, F.greatest(F.ceil((r - 1) * bins / (n - 1)) - 1, F.lit(0))).otherwise(0)
    return (g.result().join(base, predicted).withColumn("bin", edge.cast("int"))
            .select(*df.columns, "bin"))


def calibration_km(df: DataFrame, bins: int = 10, max_rows: int | None = None) -> DataFrame:
    """Median predicted against the Kaplan-Meier median per rank bin, censored rows included."""
    b = rank_bins(df, bins=bins, max_rows=max_rows)
    seen = km_median(b, by=["bin"], max_rows=max_rows)
    said = exact_quantiles(b, "predicted", [0.5], ["bin"], max_rows=max_rows)
    return said.select("bin", F.col("q")[0].alias("predicted_median")).join(seen, "bin").select(
        "bin", "predicted_median", F.when(F.col("median_reached"), F.col("km_median")).alias("km_median"))


def spearman(df: DataFrame, x: str, y: str, max_rows: int | None = None) -> DataFrame:
    """Rank correlation with average ranks; ranks are joined per distinct value."""
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    rx, ry = average_ranks(d, "_x", "_rx", max_rows), average_ranks(d, "_y", "_ry", max_rows)
    pairs = d.groupBy("_x", "_y").agg(F.count(F.lit(1)).alias("n"))
    j = pairs.join(rx, "_x").join(ry, "_y")
    return _weighted_corr(j, "_rx", "_ry", "n")


def _weighted_corr(j: DataFrame, x: str, y: str, w: str) -> DataFrame:
    """Correlation of (x, y) counted w times. Ranks are centred first to keep precision."""
    mid = j.agg((F.sum(F.col(w) * F.col(x)) / F.sum(w)).alias("_mx"),
                (F.sum(F.col(w) * F.col(y)) / F.sum(w)).alias("_my"))
    a, b = F.col(x) - F.col("_mx"), F.col(y) - F.col("_my")
    s = j.crossJoin(F.broadcast(mid)).agg(                                     # one row
        F.sum(w).alias("n"), F.sum(F.col(w) * a * b).alias("sxy"),
        F.sum(F.col(w) * a * a).alias("sxx"), F.sum(F.col(w) * b * b).alias("syy"))
    return s.select("n", (F.col("sxy") / F.nullif(F.sqrt("sxx") * F.sqrt("syy"), F.lit(0.0))).alias("rho"))


MIN_COMPARABLE = 20      # fixed value: comparable entities below which an agreement is no evidence


def label_agreement(df: DataFrame, primary: str = "t_death", second: str = "t_saturation",
                    event: str = "event_observed", max_rows: int | None = None) -> DataFrame:
    """How two outcome definitions agree: coverage, rank correlation with its p-value, ratio quartiles.

    Only observed events enter the comparison: a censored time is not a duration. `share_before_landmark` is
    over all fitted entities; fewer than MIN_COMPARABLE comparable ones are flagged as `underpowered`, and
    fewer than three have no correlation.
    """
    fitted = F.col(second).isNotNull()
    cover = df.agg(F.count(F.lit(1)).alias("n_entities"), F.count_if(fitted).alias("fitted"),
                   F.avg(fitted.cast("double")).alias("coverage"),
                   F.count_if(F.col(second) < 0).alias("before_landmark"),
                   F.avg(F.when(fitted, (F.col(second) < 0).cast("double"))).alias("share_before_landmark"),
                   F.count_if(F.col("saturation_beyond_window") if "saturation_beyond_window" in df.columns
                              else F.lit(False)).alias("beyond_window"))
    both = df.filter(fitted & F.col(event) & F.col(primary).isNotNull())
    n = F.coalesce("n", F.lit(0))
    rho = spearman(both, primary, second, max_rows).select(
        n.alias("n_comparable"), F.when(n >= 3, F.col("rho")).alias("spearman_rho"), correlation_p(F.col("rho"), n).alias("spearman_p"),
        (n < MIN_COMPARABLE).alias("underpowered"))
    ratio = both.select(F.when(F.col(primary) > 0, F.col(second) / F.col(primary)).alias("_ratio"))
    q = exact_quantiles(ratio, "_ratio", [0.25, 0.5, 0.75], max_rows=max_rows).select(
        F.col("q")[1].alias("median_ratio"), F.col("q")[0].alias("ratio_q25"), F.col("q")[2].alias("ratio_q75"))
    return cover.crossJoin(rho).crossJoin(q)                                   # one row each


def signed_rank_sums(a: DataFrame, b: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Paired errors of two models on the same events, reduced to signed-rank sums.

    Differences of zero are dropped; equal sizes share their average rank. The
    ranks come from counts per distinct size, so no ordered pass sees the rows.
    """
    err = lambda d, name: d.filter(F.col("event") & (F.col("duration") > 0) & (F.col("predicted") > 0)).select(
        "entity", F.abs(F.log10("duration") - F.log10("predicted")).alias(name))
    j = err(a, "ea").join(err(b, "eb"), "entity").select((F.col("ea") - F.col("eb")).alias("d"))
    sizes = (j.filter(F.col("d") != 0).groupBy(F.abs("d").alias("size"))
             .agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("d") > 0).alias("up")))
    g = running(split_hot(sizes, [], "size", max_rows), ["size"], {"cum": ("sum", "c")})
    rank = F.col("cum") - (F.col("c") - 1) / 2.0
    sums = g.df.agg(F.coalesce(F.sum(rank * F.col("up")), F.lit(0.0)).alias("w_plus"),
                    F.coalesce(F.sum(rank * (F.col("c") - F.col("up"))), F.lit(0.0)).alias("w_minus"),
                    F.coalesce(F.sum("c"), F.lit(0)).alias("n_nonzero"),
                    F.coalesce(F.sum(F.pow("c", F.lit(3.0)) - F.col("c")), F.lit(0.0)).alias("ties"),
                    F.coalesce(F.max(F.abs("size")), F.lit(0.0)).alias("largest"))
    med = exact_quantiles(j, "d", [0.5], max_rows=max_rows).select(F.col("q")[0].alias("median_diff"))
    return (j.agg(F.count(F.lit(1)).alias("n_pairs")).crossJoin(sums).crossJoin(med))  # one row each


def wilcoxon_signed_rank(a: DataFrame, b: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Paired Wilcoxon test on absolute log errors. Negative median favours `a`.

    Fewer than ten pairs, or no difference at all, give nulls. Up to 50 untied
    pairs use the exact distribution, more the normal one with tie correction.
    """
    r = signed_rank_sums(a, b, max_rows).first()
    n, stat = r["n_nonzero"], min(r["w_plus"], r["w_minus"])
    p = med = None
    if r["n_pairs"] < 10 or r["largest"] < 1e-8:
        stat = None
    else:
        med = r["median_diff"]
        if n <= 50 and not r["ties"] and n == r["n_pairs"]:
            ways = [1]                                       # subsets of 1..n by their sum
            for k in range(1, n + 1):
                grown = ways + [0] * k
                for s, x in enumerate(ways):
                    grown[s + k] += x
                ways = grown
            p = min(1.0, 2 * sum(ways[: int(stat) + 1]) / 2 ** n)
        else:
            mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - r["ties"] / 48
            p = erfc(abs(stat - mean) / sqrt(var) / sqrt(2)) if var > 0 else None
    return a.sparkSession.createDataFrame(
        [(r["n_pairs"], stat, p, med)], "n_pairs bigint, statistic double, p_value double, median_diff double")


def blended(raw: str, avg: str, b: Column) -> Column:
    """Chance of ending after pulling log S part of the way to the average curve."""
    s = lambda x: F.ln(F.greatest(F.least(1 - F.col(x), F.lit(1.0)), F.lit(_FLOOR)))
    return 1 - F.exp(b * s(raw) + (1 - b) * s(avg))


def blend_losses(oof: DataFrame, cfg: PanelConfig = PanelConfig()) -> DataFrame:
    """Brier score, averaged over the horizons and summed, for each weight 0.00 to 1.00.

    Rows are counted per distinct set of chances and outcomes, then scored for
    all 101 weights with partial sums combined map-side.
    """
    per = None
    for h in cfg.horizons:
        d = (oof.filter(known_status(h)).groupBy(
                F.col(f"raw_{h:g}").alias("raw"), F.col(f"avg_{h:g}").alias("avg"), outcome_at(h).alias("y"))
             .agg(F.count(F.lit(1)).alias("n")).withColumn("h", F.lit(h)))
        per = d if per is None else per.unionByName(d)
    w = (F.col("i") / 100.0)
    e = F.pow(blended("raw", "avg", w) - F.col("y").cast("double"), 2)
    return (per.select("*", F.explode(F.sequence(F.lit(0), F.lit(100))).alias("i"))
            .groupBy("i", "h").agg((F.sum(F.col("n") * e) / F.sum("n")).alias("loss"))
            .groupBy("i").agg(F.sum("loss").alias("loss")).select((F.col("i") / 100.0).alias("b"), "loss"))


def fit_blend_weight(oof: DataFrame, cfg: PanelConfig = PanelConfig()) -> DataFrame:
    """The weight with the smallest loss; within 1e-12 the smallest weight wins."""
    losses = blend_losses(oof, cfg)
    return losses.agg(F.min_by("b", F.struct(F.round("loss", 12), F.col("b"))).alias("b"),
                      F.min("loss").alias("loss"))


def saturation_frame(df: DataFrame, landmark: float) -> DataFrame:
    """The frame with saturation as the outcome; a failed fit is censored at the last reading."""
    fitted = F.col("t_saturation").isNotNull()
    return (df.withColumns({"t_death": F.when(fitted, F.col("t_saturation"))
                            .otherwise(F.col("last_observed_hours") - landmark),
                            "event_observed": fitted})
            .filter(F.col("t_death") > 0))


def saturation_fields(df: DataFrame, landmark: float) -> DataFrame:
    """Second outcome on the landmark clock, flagged where it is an extrapolation.

    Negative values stay: an entity saturated before the landmark is a real
    disagreement between the two definitions.
    """
    t = F.col("t_saturation")
    return df.withColumns({
        "t_saturation_from_publish": t, "t_saturation": t - landmark,
        "saturation_beyond_window": F.coalesce(t > F.col("last_observed_hours"), F.lit(False))})


def h2_table(deltas: DataFrame, tests: DataFrame) -> DataFrame:
    """Pass or fail per comparison: interval above 0, small p, and smaller errors."""
    return deltas.join(tests, ["model", "baseline"]).select(
        "model", "baseline", F.bround("delta_c_index", 3).alias("dc"), F.bround("delta_c_low", 3).alias("lo"),
        F.bround("delta_c_high", 3).alias("hi"), F.col("p_value").alias("p"),
        F.coalesce((F.col("delta_c_low") > 0) & (F.col("p_value") < 0.05) & (F.col("median_diff") < 0),
                   F.lit(False)).alias("both"))


def models_table(scores: DataFrame, constant: tuple[str, ...] = ("constant_48h", "km_median")) -> DataFrame:
    """Tidy score export; models that predict one number have no ranking interval."""
    same = F.col("model").isin(*constant)
    return scores.select(
        "model", F.when(same, F.lit(0.5)).otherwise(F.bround("c_index", 3)).alias("c"),
        F.when(~same, F.bround("c_low", 3)).alias("lo"), F.when(~same, F.bround("c_high", 3)).alias("hi"),
        F.bround(F.pow(F.lit(10.0), F.col("mae_log10")), 2).alias("error_x"))
