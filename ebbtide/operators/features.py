"""Everything a model may know at prediction time. Nothing after the cutoff."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.config import PanelConfig
from ebbtide.functions import scalars as S
from ebbtide.operators.history import prior_median
from ebbtide.operators.skew import column_medians
from ebbtide.operators.series import by_entity, clamped, last_at_or_before, value_at

EARLY_COLUMNS = [
    "n_early_observations", "first_observed_at_hours",
    "value_at_m1", "value_at_m2", "value_at_m3",
    "velocity_to_m1", "velocity_to_m2", "velocity_to_m3", "velocity_12", "velocity_23",
    "log_growth_12", "log_growth_23", "acceleration", "decay_ratio",
    "log_value_m1", "log_value_m2", "log_value_m3",
]


def early_window(readings: DataFrame, cutoff: float) -> DataFrame:
    """The leakage boundary: readings at or before the cutoff."""
    return readings.filter(F.col("age_hours") <= cutoff)


def assert_no_leak(features: DataFrame, cutoff: float) -> DataFrame:
    """Raise if any feature row needed a reading past the cutoff. One aggregate job."""
    worst = features.agg(F.max("first_observed_at_hours")).first()[0]
    if worst is not None and worst > cutoff:
        raise AssertionError(f"a feature used a reading at {worst} h, past the cutoff of {cutoff} h")
    return features


def early_features(readings: DataFrame, cfg: PanelConfig = PanelConfig(),
                   cutoff: float | None = None) -> DataFrame:
    """Levels, velocities, growth and curvature at the three early marks.

    One aggregation per entity. Growth ratios have no smoothing, so they are
    scale-free; a mark without readings on both sides stays null. Every entity
    with any reading gets a row (n_early_observations may be 0).
    """
    limit = cfg.feature_cutoff if cutoff is None else cutoff
    m = cfg.early_marks
    d = value_at(readings, list(m), until=limit)
    v1, v2, v3 = F.col("v0"), F.col("v1"), F.col("v2")
    vel12, vel23 = (v2 - v1) / (m[1] - m[0]), (v3 - v2) / (m[2] - m[1])
    return d.select(
        "entity", "n_values", F.col("n_readings").alias("n_early_observations"),
        F.col("first_age").alias("first_observed_at_hours"),
        v1.alias("value_at_m1"), v2.alias("value_at_m2"), v3.alias("value_at_m3"),
        *[(x / t).alias(f"velocity_to_m{i}") for i, (x, t) in enumerate(zip((v1, v2, v3), m), 1)],
        vel12.alias("velocity_12"), vel23.alias("velocity_23"),
        S.log_ratio(v2, v1).alias("log_growth_12"), S.log_ratio(v3, v2).alias("log_growth_23"),
        (vel23 - vel12).alias("acceleration"),
        (vel23 / F.nullif(vel12, F.lit(0.0))).alias("decay_ratio"),
        *[S.log10_or_null(x + 1).alias(f"log_value_m{i}") for i, x in enumerate((v1, v2, v3), 1)])


def metadata_features(entities: DataFrame) -> DataFrame:
    """Calendar and log-scaled attributes, all fixed at publication."""
    logged = lambda x: F.when(F.col(x) > 0, F.log10(F.col(x).cast("double") + 1))
    return entities.withColumns({
        **S.publish_calendar("published_at"),
        "log_duration_sec": logged("duration_sec"),
        "log_follower_count": logged("follower_count")})


def build_features(readings: DataFrame, entities: DataFrame, cfg: PanelConfig = PanelConfig(),
                   cutoff: float | None = None) -> DataFrame:
    """Feature table: known entities with readings."""
    early = early_features(readings, cfg, cutoff).drop("n_values")
    return early.join(metadata_features(entities), "entity")


def owner_relative(frame: DataFrame, cfg: PanelConfig = PanelConfig(), velocity: str = "velocity_to_m3",
                   max_rows: int | None = None) -> DataFrame:
    """How an entity is doing for its owner: against the median of earlier entities only.

    Uses early velocity, never outcomes, and only entities published before.
    Under `min_prior` earlier values there is no baseline.
    """
    p = prior_median(frame, velocity, max_rows)
    med = F.when(F.col("n_prior") >= cfg.min_prior, F.col("prior_median"))
    v = F.col(velocity)
    return (frame.join(p, "entity", "left").withColumns({
        "owner_median_velocity_prior": med,
        "log_owner_median_velocity": F.when(med > 0, F.log10(med + 1)),
        "log_rel_velocity": F.when((med > 0) & (v > 0), F.log10(v / med)),
        "n_prior": F.coalesce("n_prior", F.lit(0)).cast("bigint")}).drop("prior_median"))


def engagement_at(readings: DataFrame, landmark: float) -> DataFrame:
    """Log like and comment rates at the last reading at or before the landmark."""
    last = last_at_or_before(readings, landmark, ["views", "likes", "comments"])
    views = F.when(F.col("views") > 0, F.col("views").cast("double"))
    rate = lambda n, floor: F.when(F.col(n).isNotNull() & views.isNotNull(),
                                   F.log10(F.greatest(F.col(n) / views, F.lit(floor))))
    return last.select("entity", rate("likes", 1e-5).alias("log_like_rate"),
                       rate("comments", 1e-6).alias("log_comment_rate"))


def trajectory_at(readings: DataFrame, landmark: float, max_rows: int | None = None) -> DataFrame:
    """Level at the landmark and the latest speed as a share of the best so far."""
    g = clamped(by_entity(early_window(readings, landmark), max_rows=max_rows))
    speed = F.when(F.col("prev_age").isNotNull(), F.coalesce("velocity", F.lit(0.0)))
    d = g.df.withColumn("speed", speed).groupBy("entity").agg(
        F.max("clamped").alias("level"), F.max("speed").alias("peak"),
        F.max_by("speed", "age_hours").alias("latest"))
    return d.select("entity", F.log10(F.col("level") + 1).alias("log_value_at_landmark"),
                    F.when(F.col("peak") > 0, F.greatest("latest", F.lit(0.0)) / F.col("peak"))
                    .alias("speed_share_at_landmark"))


def top_categories(df: DataFrame, column: str = "stratum_category", limit: int = 10) -> list[str]:
    """Most frequent categories, ties by name. At most `limit` values reach the driver."""
    cat = F.nullif(F.lower(F.trim(column)), F.lit(""))
    rows = (df.select(cat.alias("cat")).filter(F.col("cat").isNotNull()).groupBy("cat")
            .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "cat").limit(limit).collect())
    return [r["cat"] for r in rows]


def category_dummies(df: DataFrame, column: str = "stratum_category", limit: int = 10,
                     categories: Sequence[str] | None = None) -> DataFrame:
    """0/1 columns for the top categories; an unknown category is all zero."""
    cat = F.nullif(F.lower(F.trim(column)), F.lit(""))
    names = top_categories(df, column, limit) if categories is None else list(categories)
    return df.withColumns({f"cat_{n}": F.coalesce(cat == n, F.lit(False)).cast("double") for n in names})


def usable_features(df: DataFrame, columns: Sequence[str], min_coverage: float = 0.5) -> list[str]:
    """Columns present on enough rows and not constant, from one aggregate row.

    Two different values is what matters, so min < max replaces a distinct count.
    """
    cols = [x for x in columns if x in df.columns]
    if not cols:
        return []
    row = df.agg(*[a for x in cols for a in _coverage(x)]).first()
    return [x for x in cols if (row[f"{x}__n"] or 0) >= min_coverage and row[f"{x}__v"]]


def coverage_table(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (),
                   min_coverage: float = 0.5) -> DataFrame:
    """The same test as a table: one row per column (and group)."""
    agg = df.groupBy(*by).agg(*[a for x in columns for a in _coverage(x)])
    cells = F.explode(F.array(*[F.struct(F.lit(x).alias("feature"), F.col(f"{x}__n").alias("coverage"),
                                         F.coalesce(F.col(f"{x}__v"), F.lit(False)).alias("varies"))
                                for x in columns])).alias("c")
    return agg.select(*by, cells).select(
        *by, "c.*", ((F.col("c.coverage") >= min_coverage) & F.col("c.varies")).alias("usable"))


def varying_table(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), min_rows: int = 10) -> DataFrame:
    """Per training fold: which columns have enough values and vary, with their exact medians."""
    aggs = []
    for x in columns:
        v = S.finite(x)
        aggs += [F.count(v).alias(f"{x}__c"), F.coalesce(F.min(v) < F.max(v), F.lit(False)).alias(f"{x}__v")]
    cells = F.explode(F.array(*[F.struct(F.lit(x).alias("feature"), F.col(f"{x}__c").alias("n_values"), F.col(f"{x}__v").alias("varies"))
                                for x in columns])).alias("c")
    medians = column_medians(df, {x: S.finite(x) for x in columns}, list(by))
    return df.groupBy(*by).agg(*aggs).select(*by, cells).select(*by, "c.*").join(medians, [*by, "feature"], "left").select(
        *by, "feature", "n_values", "median", ((F.col("n_values") >= min_rows) & F.col("varies")).alias("kept"))


def _coverage(x: str):
    v = S.finite(x)
    return [F.avg(F.when(v.isNotNull(), 1.0).otherwise(0.0)).alias(f"{x}__n"),
            (F.min(v) < F.max(v)).alias(f"{x}__v")]
