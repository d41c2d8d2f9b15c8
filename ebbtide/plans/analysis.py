"""The analysis frame: labels and leak-free features, with every exclusion counted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.config import EXPLORATORY_COLUMNS, FEATURE_COLUMNS, PanelConfig
from ebbtide.functions import scalars as S
from ebbtide.operators import features as feat
from ebbtide.operators.labels import decay_label, saturation_fit
from ebbtide.operators.metrics import saturation_fields
from ebbtide.operators.silver import owner_daily_cap

# Reasons in the order they are tested; the first that applies is recorded.
STAGES = ("over owner daily cap", "outside cohort", "no usable metric", "insufficient_observations",
          "no_positive_velocity", "died before the landmark", "not yet observed at the landmark",
          "no early observation")


@dataclass(frozen=True)
class AnalysisFrame:
    """`staged` holds every observed entity with its exclusion reason (null = analysed)."""

    staged: DataFrame
    cfg: PanelConfig

    @property
    def frame(self) -> DataFrame:
        return self.staged.filter(F.col("exclusion").isNull()).drop("exclusion", "exclude_reason")

    def attrition(self) -> DataFrame:
        return attrition(self.staged)


def in_cohort(published_at: str, start: str | None = None, end: str | None = None) -> Column:
    """Half-open interval of publication time."""
    ok = F.lit(True)
    if start is not None:
        ok = ok & (F.col(published_at) >= F.lit(start).cast("timestamp"))
    if end is not None:
        ok = ok & (F.col(published_at) < F.lit(end).cast("timestamp"))
    return F.coalesce(ok, F.lit(False))


def cohort_filter(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    return df.filter(in_cohort("published_at", start, end))


def landmark_eligible(labels: DataFrame, landmark: float) -> DataFrame:
    """Entities still alive and observed at the landmark, with the time remaining from it."""
    if not landmark:
        return labels.withColumn("residual", F.col("t_death"))
    return (labels.filter(~(F.col("event_observed") & (F.col("t_death") <= landmark))
                          & (F.col("last_observed_hours") >= landmark))
            .withColumn("residual", F.col("t_death") - landmark))


def positive_duration(df: DataFrame, column: str, floor: float = 1e-3) -> DataFrame:
    """Models reject zero durations: floor them and mark which rows were floored."""
    return df.withColumns({"floored": F.col(column) <= 0,
                           column: F.greatest(F.col(column), F.lit(floor))})


def analysis_frame(readings: DataFrame, entities: DataFrame, cfg: PanelConfig = PanelConfig(),
                   source: str | None = None, start: str | None = None, end: str | None = None,
                   landmark: float | None = None, frac: float | None = None,
                   saturation: bool = False, max_rows: int | None = None) -> AnalysisFrame:
    """One row per observed entity: outcome from the whole history, features from the start.

    The feature cutoff never exceeds the landmark. Entities outside the cohort are
    never labelled: their readings are filtered by publication time, without a
    join. Every join below is between tables of one row per entity.
    """
    from dataclasses import replace
    L = cfg.landmark if landmark is None else landmark
    cutoff = min(cfg.feature_cutoff, L) if L else cfg.feature_cutoff
    lab_cfg = cfg if frac is None else replace(cfg, frac=frac)
    if source is not None:
        readings = readings.filter(F.col("source") == source)
        entities = entities.filter(F.col("source") == source)

    dims = owner_daily_cap(entities, cfg.daily_cap)
    early = feat.early_features(readings, cfg, cutoff)
    staged = early.join(dims, "entity", "left").withColumn(
        "gate", S.ladder([
            (F.coalesce("over_daily_cap", F.lit(False)), F.lit(STAGES[0])),
            (~in_cohort("published_at", start, end) if start or end else F.lit(False), F.lit(STAGES[1])),
            (F.col("n_values") == 0, F.lit(STAGES[2]))]))
    mine = cohort_filter(readings, start, end) if (start or end) else readings
    seq = "seq" if "seq" in readings.columns else None
    labels = decay_label(mine, lab_cfg, seq=seq, max_rows=max_rows)
    d = staged.join(labels, "entity", "left")
    if saturation:
        fit = saturation_fit(mine, cfg, seq=seq, max_rows=max_rows)
        d = saturation_fields(d.join(fit.drop("sse"), "entity", "left"), L or 0.0)
    late = (F.col("event_observed") & (F.col("t_death") <= L)) if L else F.lit(False)
    unseen = (F.col("last_observed_hours") < L) if L else F.lit(False)
    d = d.withColumn("exclusion", S.ladder([
        (F.col("gate").isNotNull(), F.col("gate")),
        (F.col("exclude_reason").isNotNull(), F.col("exclude_reason")),
        (late, F.lit(STAGES[5])), (unseen, F.lit(STAGES[6])),
        (F.coalesce("n_early_observations", F.lit(0)) <= 0, F.lit(STAGES[7]))]))
    d = d.withColumns({"t_death_from_publish": F.col("t_death"), "t_death": F.col("t_death") - (L or 0.0)})
    return AnalysisFrame(feat.metadata_features(d).drop("gate", "n_values"), cfg)


def with_owner_history(frame: DataFrame, cfg: PanelConfig = PanelConfig(),
                       categories: list[str] | None = None, max_rows: int | None = None) -> DataFrame:
    """Add the owner-relative features and category dummies to an analysis frame."""
    return feat.category_dummies(feat.owner_relative(frame, cfg, max_rows=max_rows), categories=categories)


def attrition(staged: DataFrame) -> DataFrame:
    """Signed stage table (ord, stage, n) from one pass over the reasons."""
    n = staged.groupBy("exclusion").agg(F.count(F.lit(1)).alias("c"))
    one = n.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("all"),
                F.coalesce(F.sum(F.when(F.col("exclusion").isNull(), F.col("c"))), F.lit(0)).alias("final"),
                *[F.coalesce(F.sum(F.when(F.col("exclusion") == s, F.col("c"))), F.lit(0)).alias(f"s{i}")
                  for i, s in enumerate(STAGES)])
    rows = [F.struct(F.lit(0).alias("ord"), F.lit("observed").alias("stage"), F.col("all").alias("n"))]
    rows += [F.struct(F.lit(i + 1).alias("ord"), F.lit(f"excluded: {s}").alias("stage"), (-F.col(f"s{i}")).alias("n"))
             for i, s in enumerate(STAGES)]
    rows += [F.struct(F.lit(len(STAGES) + 1).alias("ord"), F.lit("final analysis set").alias("stage"),
                      F.col("final").alias("n"))]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def cohort_maturity(entities: DataFrame, now, cfg: PanelConfig = PanelConfig(), by: list[str] = ()) -> DataFrame:
    """Has every entity finished its window? From publication times only, no labels."""
    done = F.timestamp_add("SECOND", F.lit(int(cfg.max_track * 3600)), F.col("published_at"))
    d = entities.withColumn("_done", done).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("_done") > F.lit(now).cast("timestamp")).alias("immature"),
        F.max("_done").alias("matures_at"))
    return d.withColumn("mature", F.col("immature") == 0)


def predictor_columns(frame: DataFrame, exploratory: bool = False) -> list[str]:
    """Whitelisted predictors with enough coverage. Outcome columns can never be chosen."""
    names = list(FEATURE_COLUMNS)
    if exploratory:
        names += list(EXPLORATORY_COLUMNS) + sorted(x for x in frame.columns if x.startswith("cat_"))
    return feat.usable_features(frame, names)


def landmark_sweep(readings: DataFrame, entities: DataFrame, landmarks: list[float], fracs: list[float],
                   cfg: PanelConfig = PanelConfig()) -> DataFrame:
    """Analysed entities and events for each landmark and threshold.

    All thresholds come from one labelling pass; landmarks are conditions on its rows.
    """
    from ebbtide.operators.labels import decay_label_sweep
    seq = "seq" if "seq" in readings.columns else None
    labels = decay_label_sweep(readings.join(entities.select("entity"), "entity", "left_semi"), fracs, cfg, seq)
    d = labels.filter(F.col("exclude_reason").isNull()).withColumn(
        "landmark", F.explode(F.array(*[F.lit(float(x)) for x in landmarks])))
    ok = (F.col("last_observed_hours") >= F.col("landmark")) & ~(
        F.col("event_observed") & (F.col("t_death") <= F.col("landmark")))
    return d.filter(ok).groupBy("landmark", "frac").agg(
        F.count(F.lit(1)).alias("entities"), F.count_if("event_observed").alias("events"),
        F.avg(F.col("t_death") - F.col("landmark")).alias("mean_residual"))
