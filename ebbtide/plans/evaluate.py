"""Evaluation runs composed from models, metrics and resampling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.config import ENGAGEMENT_COLUMNS, FEATURE_COLUMNS, TRAJECTORY_COLUMNS, PanelConfig
from ebbtide.models.survival import (ConstantLifetime, GradientBoosted, HazardForest, KaplanMeierMedian, LogLinear,
                                     WeibullAFT, owner_size_only, peak_velocity_only)
from ebbtide.models.validate import grouped_cv, held_out_owner_predictions, instant_predictions
from ebbtide.operators import features as feat
from ebbtide.operators.concordance import concordance
from ebbtide.operators.metrics import (brier_skill, calibration_deciles, flag_metrics, flagged, fold_scores, h2_table,
                                       known_status, outcome_at, wilcoxon_signed_rank)
from ebbtide.operators.resample import (bootstrap_ci, concordance_draws, flag_bootstrap, owner_bootstrap,
                                        paired_delta_bootstrap, score_models)
from ebbtide.operators.survival import cohort_counts
from ebbtide.plans.analysis import predictor_columns
from ebbtide.session import cut_lineage
from ebbtide.sources.tables import stack_models

MIN_EVENTS, MIN_OWNERS = 50, 10            # fixed values: below these a run is a rehearsal
PRIMARY = ("weibull_aft", "random_survival_forest")
BASELINES = ("constant_48h", "km_median", "subscriber_only", "peak_velocity")


def survival_rows(frame: DataFrame) -> DataFrame:
    """An analysis frame as a training table: duration and event."""
    return frame.withColumns({"duration": F.col("t_death").cast("double"), "event": F.col("event_observed")})


def residual_grid(cfg: PanelConfig, landmark: float) -> list[float]:
    """The marks after the landmark, on the landmark's clock."""
    return [m - landmark for m in cfg.schedule if m > landmark]


def standard_models(features: list[str], grid: list[float], trees: int = 300, rounds: int = 200,
                    seed: int = 4177) -> list:
    """Two censoring-aware models, four baselines, two comparators."""
    return [WeibullAFT(features), HazardForest(features, grid, trees=trees, seed=seed), ConstantLifetime(48.0),
            KaplanMeierMedian(), owner_size_only(), peak_velocity_only(), LogLinear(features),
            GradientBoosted(features, rounds=rounds, seed=seed)]


@dataclass(frozen=True)
class Evaluation:
    counts: DataFrame          # entities, events, owners, censored share, power flag
    predictions: DataFrame     # stacked out-of-fold table
    scores: DataFrame          # per model, with intervals
    by_fold: DataFrame
    deltas: DataFrame          # every primary model against every baseline, shared draws
    tests: DataFrame           # paired signed-rank tests
    verdicts: DataFrame


def evaluate(frame: DataFrame, cfg: PanelConfig = PanelConfig(), models: list | None = None,
             landmark: float | None = None, trees: int = 300, rounds: int = 200,
             exploratory: bool = False, holdout: bool = False) -> Evaluation:
    """Owner-grouped cross-validation with intervals, tests and differences.

    `exploratory` adds the predictors that were not planned. On the holdout (`holdout`) they are refused: what is
    tried out on it cannot be confirmed by it.

    The frame is read once per model and fold, so it is first written to the
    shared folder; so are the stacked predictions, which every statistic reads.
    """
    if exploratory and holdout:
        raise ValueError("the holdout is not open to exploratory predictors")
    d = cut_lineage(survival_rows(frame))
    L = cfg.landmark if landmark is None else landmark
    used = predictor_columns(d, exploratory)
    if not used:
        raise ValueError("no predictor has enough coverage")
    models = models or standard_models(used, residual_grid(cfg, L), trees, rounds, cfg.seed)
    stacked = cut_lineage(grouped_cv(models, d, cfg.folds))
    names = [m.name for m in models]
    pairs = [(p, b) for p in PRIMARY if p in names for b in BASELINES if b in names]
    counts = cohort_counts(d).withColumn(
        "underpowered", (F.col("events") < MIN_EVENTS) | (F.col("owners") < MIN_OWNERS))
    drawn = cut_lineage(concordance_draws(stacked, cfg.draws, cfg.seed))
    scores = cut_lineage(score_models(stacked))
    deltas = paired_delta_bootstrap(scores, drawn, pairs) if pairs else None
    tests = None
    for p, b in pairs:
        t = wilcoxon_signed_rank(stacked.filter(F.col("model") == p), stacked.filter(F.col("model") == b))
        t = t.select(F.lit(p).alias("model"), F.lit(b).alias("baseline"), "*")
        tests = t if tests is None else tests.unionByName(t)
    return Evaluation(counts, stacked, bootstrap_ci(scores, drawn), fold_scores(stacked), deltas, tests,
                      h2_table(deltas, tests) if pairs else None)


def landmark_inputs(frame: DataFrame, readings: DataFrame, cfg: PanelConfig, landmark: float) -> DataFrame:
    """Add engagement at the landmark and, past the feature cutoff, the trajectory."""
    d = frame.join(feat.engagement_at(readings, landmark), "entity", "left")
    if landmark > cfg.feature_cutoff:
        d = d.join(feat.trajectory_at(readings, landmark), "entity", "left")
    return d


@dataclass(frozen=True)
class Practical:
    summary: DataFrame         # one row
    flag: DataFrame            # point values of the early-warning flag
    flag_intervals: DataFrame
    delta: DataFrame           # against owner size alone
    predictions: DataFrame


def practical_eval(train: DataFrame, test: DataFrame, cfg: PanelConfig, landmark: float, trees: int = 300) -> Practical:
    """Train on earlier cohorts, test on a later one, at one landmark.

    Two claims: the ranking beats owner size, and the share flagged as
    shortest-lived really ends fast more often than the base rate.
    """
    wanted = list(FEATURE_COLUMNS) + list(ENGAGEMENT_COLUMNS)
    if landmark > cfg.feature_cutoff:
        wanted += list(TRAJECTORY_COLUMNS)
    tr, te = cut_lineage(survival_rows(train)), cut_lineage(survival_rows(test))
    cols = feat.usable_features(tr, wanted)
    forest = HazardForest(cols, residual_grid(cfg, landmark), name="model", trees=trees, seed=cfg.seed)
    fast = F.col("event") & (F.col("t_death_from_publish") <= cfg.fast_hours)
    keep = ["entity", "owner", "duration", "event", "predicted", "fast"]
    by = {}
    for spec, name in ((forest, "model"), (owner_size_only(), "size"), (KaplanMeierMedian(), "km")):
        by[name] = spec.fit(tr).predict(te).withColumn("fast", fast).select(*keep)
    stacked = cut_lineage(stack_models(by))
    mine = stacked.filter(F.col("model") == "model")
    marked = flagged(mine, share=cfg.flag_share)
    scores = cut_lineage(score_models(stacked))
    drawn = concordance_draws(stacked.filter(F.col("model") != "km"), cfg.draws, cfg.seed)
    summary = scores.groupBy().pivot("model", ["model", "size", "km"]).agg(
        F.first("c_index").alias("c_index"), F.pow(F.lit(10.0), F.first("mae_log10")).alias("error_factor"))
    return Practical(summary.withColumn("landmark", F.lit(landmark)), flag_metrics(mine, share=cfg.flag_share),
                     flag_bootstrap(marked, "fast", cfg.draws, cfg.seed),
                     paired_delta_bootstrap(scores, drawn, [("model", "size")]),
                     stacked)


def instant_primary(pred: DataFrame, high: float, cfg: PanelConfig) -> DataFrame:
    """Brier skill of the fast-fade chance and the lift of the high-risk label, with intervals."""
    h = cfg.fast_hours
    y = outcome_at(h).cast("double")
    d = pred.filter(known_status(h))
    flag = (F.col(f"p_{h:g}") >= high).cast("double")
    ratio = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0.0))
    return owner_bootstrap(
        d, {"n": F.lit(1), "y": y, "f": flag, "fy": flag * y, "sm": F.pow(F.col(f"p_{h:g}") - y, 2),
            "sa": F.pow(F.col(f"avg_{h:g}") - y, 2)},
        lambda: {"brier_skill": 1 - ratio("sm", "sa"), "flag_precision_minus_base": ratio("fy", "f") - ratio("y", "n"),
                 "flag_precision": ratio("fy", "f"), "base_rate": ratio("y", "n")}, cfg.draws, cfg.seed)


def instant_by_horizon(pred: DataFrame, cfg: PanelConfig) -> DataFrame:
    out = None
    for h in cfg.horizons:
        d = brier_skill(pred, h, f"p_{h:g}", f"avg_{h:g}").withColumn("horizon", F.lit(h))
        out = d if out is None else out.unionByName(d)
    return out


def instant_by_age(pred: DataFrame, cfg: PanelConfig) -> DataFrame:
    h = cfg.fast_hours
    return brier_skill(pred, h, f"p_{h:g}", f"avg_{h:g}", ["mark"])


def instant_calibration(pred: DataFrame, cfg: PanelConfig) -> DataFrame:
    h = cfg.fast_hours
    d = pred.filter(known_status(h)).withColumn("_y", outcome_at(h).cast("double"))
    return calibration_deciles(d, f"p_{h:g}", "_y")


def instant_ranking(pred: DataFrame, cfg: PanelConfig) -> DataFrame:
    d = pred.withColumn("_long", -F.col(f"p_{cfg.fast_hours:g}"))
    return concordance(d, "fade_h", "faded", "_long")


def instant_low_risk(pred: DataFrame, low: float, cfg: PanelConfig) -> DataFrame:
    h = cfg.fast_hours
    d = pred.filter(known_status(h))
    y, lab = outcome_at(h).cast("double"), F.col(f"p_{h:g}") <= low
    return d.agg(F.avg(lab.cast("double")).alias("share_labelled"), F.avg(F.when(lab, y)).alias("ended_fast"),
                 F.avg(y).alias("base_rate"))


@dataclass(frozen=True)
class Instant:
    unseen: DataFrame          # predictions by models that never saw the owner
    seen: DataFrame            # predictions by one model on all training rows
    primary: DataFrame
    seen_primary: DataFrame
    by_horizon: DataFrame
    by_age: DataFrame
    calibration: DataFrame
    ranking: DataFrame
    low_risk: DataFrame


def instant_eval(train: DataFrame, test: DataFrame, cfg: PanelConfig, b: float, high: float, low: float,
                 trees: int = 300) -> Instant:
    """Assess the one-reading model on owners it has not seen, and on those it has."""
    tr, te = cut_lineage(train), cut_lineage(test)
    unseen = cut_lineage(held_out_owner_predictions(tr, te, cfg, b, trees))
    seen = cut_lineage(instant_predictions(tr, te, cfg, b, trees))
    return Instant(unseen, seen, instant_primary(unseen, high, cfg), instant_primary(seen, high, cfg),
                   instant_by_horizon(unseen, cfg), instant_by_age(unseen, cfg), instant_calibration(unseen, cfg),
                   instant_ranking(unseen, cfg), instant_low_risk(unseen, low, cfg))


