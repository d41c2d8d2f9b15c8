"""Predictors of remaining lifetime, from constants to a hazard forest."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import AFTSurvivalRegression, GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.models.base import EPSILON, Constant, Design, Profile
from ebbtide.operators.survival import km_median, rmst

MIN_EVENTS_FOREST = 5
MIN_EVENTS_REGRESSION = 20


@dataclass
class ConstantLifetime:
    """Everything ends at the same age."""

    hours: float = 48.0
    name: str = "constant_48h"
    features: tuple = ()

    def fit(self, train: DataFrame, profile: Profile | None = None) -> Constant:
        return Constant(self.hours)


@dataclass
class KaplanMeierMedian:
    """The cohort's median survival; the largest time where half never end."""

    name: str = "km_median"
    features: tuple = ()

    def fit(self, train: DataFrame, profile: Profile | None = None) -> Constant:
        return Constant(float(km_median(train).first()["km_median"]))


@dataclass
class WeibullAFT:
    """Weibull accelerated failure time; predicts the median.

    Spark's estimator has no penalty, so columns explained by earlier ones are
    dropped and times of zero are lifted to a small positive number.
    """

    features: list[str]
    name: str = "weibull_aft"
    max_iter: int = 100

    def fit(self, train: DataFrame, profile: Profile | None = None):
        profile = profile or Profile.of(train, self.features)
        design = Design.build(profile, self.features, train)
        if design is None or profile.n_events == 0:
            return Constant(profile.median_duration)
        d = design.transform(train).select(
            "features", F.greatest(F.col("duration").cast("double"), F.lit(EPSILON)).alias("duration"),
            F.col("event").cast("double").alias("event"))
        aft = AFTSurvivalRegression(featuresCol="features", labelCol="duration", censorCol="event",
                                    quantileProbabilities=[0.5], quantilesCol="_q", maxIter=self.max_iter)
        return _FittedAFT(design, aft.fit(d))


@dataclass
class _FittedAFT:
    design: Design
    model: object

    def predict(self, df: DataFrame) -> DataFrame:
        d = self.model.setPredictionCol("_scale").transform(self.design.transform(df))
        return d.withColumn("predicted", vector_to_array("_q")[0]).drop("features", "_q", "_scale")

    def coefficients(self) -> dict[str, float]:
        return dict(zip(self.design.columns, [float(x) for x in self.model.coefficients]))


def owner_size_only() -> WeibullAFT:
    return WeibullAFT(["log_follower_count"], "subscriber_only")


def peak_velocity_only() -> WeibullAFT:
    return WeibullAFT(["log_value_m3"], "peak_velocity")


@dataclass
class LogLinear:
    """Least squares on log10 time, observed events only. Not censoring-aware."""

    features: list[str]
    name: str = "loglinear_uncensored"

    def fit(self, train: DataFrame, profile: Profile | None = None):
        return _fit_log(self, train, profile, LinearRegression(featuresCol="features", labelCol="_y", predictionCol="_p",
                                                      solver="normal"))


@dataclass
class GradientBoosted:
    """Boosted trees on log10 time, observed events only. Not censoring-aware."""

    features: list[str]
    name: str = "gbm_uncensored"
    rounds: int = 200
    seed: int = 4177

    def fit(self, train: DataFrame, profile: Profile | None = None):
        return _fit_log(self, train, profile, GBTRegressor(featuresCol="features", labelCol="_y", predictionCol="_p",
                                                  maxDepth=3, maxIter=self.rounds, stepSize=0.06, seed=self.seed))


def _fit_log(spec, train: DataFrame, profile: Profile | None, estimator):
    profile = profile or Profile.of(train, spec.features)
    design = Design.build(profile, spec.features)
    if design is None or profile.n_events < MIN_EVENTS_REGRESSION:
        return Constant(profile.median_duration)
    y = F.log10(F.greatest(F.col("duration").cast("double"), F.lit(1e-6)))
    rows = design.transform(train.filter("event")).select("features", y.alias("_y"))
    return _FittedLog(design, estimator.fit(rows))


@dataclass
class _FittedLog:
    design: Design
    model: object

    def predict(self, df: DataFrame) -> DataFrame:
        d = self.model.transform(self.design.transform(df))
        return d.withColumn("predicted", F.pow(F.lit(10.0), F.col("_p"))).drop("features", "_p")


def person_periods(df: DataFrame, grid: list[float], time: str = "duration", event: str = "event") -> DataFrame:
    """One row per entity and grid interval in which it was still at risk.

    `ended` is 1 in the interval of an observed end. The first interval starts
    at 0; a time past the grid is at risk throughout. At most len(grid) rows
    come from one entity.
    """
    starts = [0.0, *grid[:-1]]
    cells = F.array(*[F.struct(F.lit(i).alias("slot"), F.lit(float(a)).alias("start"), F.lit(float(b)).alias("mark"))
                      for i, (a, b) in enumerate(zip(starts, grid))])
    t = F.col(time).cast("double")
    at_risk = F.filter(cells, lambda c: (c["start"] < t) | (c["slot"] == 0))
    # A censored interval is only counted when it was lived through to its mark.
    kept = F.filter(at_risk, lambda c: F.col(event) | (c["mark"] <= t))
    own = [x for x in df.columns if x not in ("slot", "start", "mark", "ended")]
    d = df.withColumn("_c", F.explode(kept)).select(*own, "_c.*")
    inside = F.col(event) & (t <= F.col("mark"))
    return d.withColumn("ended", inside.cast("double")).drop("start")


@dataclass
class HazardForest:
    """Random forest for the chance of ending in each interval of the mark grid.

    The survival curve is the product of the intervals' survival chances, and
    the prediction is the area under it (restricted mean), which orders entities
    even where the curve never reaches one half. The grid bounds the number of
    training rows per entity.
    """

    features: list[str]
    grid: list[float]
    name: str = "random_survival_forest"
    trees: int = 300
    min_leaf: int = 5
    max_depth: int = 8
    seed: int = 4177
    alone: bool = True              # its rows are held with a weight per tree: no second forest beside it

    def fit(self, train: DataFrame, profile: Profile | None = None):
        profile = profile or Profile.of(train, self.features)
        design = Design.build(profile, self.features)
        if design is None or profile.n_events < MIN_EVENTS_FOREST:
            return Constant(profile.median_duration)
        periods = design.transform(person_periods(train, self.grid), {"_mark": F.ln(F.col("mark") + 1)})
        forest = RandomForestClassifier(
            featuresCol="features", labelCol="ended", numTrees=self.trees, minInstancesPerNode=self.min_leaf,
            maxDepth=self.max_depth, featureSubsetStrategy="sqrt", subsamplingRate=1.0, seed=self.seed)
        model = forest.fit(periods.select("features", "ended"))
        return _FittedForest(design, model, list(self.grid))


@dataclass
class _FittedForest:
    design: Design
    model: object
    grid: list[float]
    scratch: list[str] = field(default_factory=list)

    def curve(self, df: DataFrame, name: str = "curve") -> DataFrame:
        """Add the survival curve on the grid as an array. No shuffle: one pass per mark."""
        d, keep = df, list(df.columns)
        for i, m in enumerate(self.grid):
            d = self.design.transform(d, {"_mark": F.log(F.lit(float(m) + 1))}, out=f"_f{i}").drop("_mark")
            one = (self.model.copy().setFeaturesCol(f"_f{i}").setProbabilityCol(f"_p{i}")
                   .setRawPredictionCol(f"_r{i}").setPredictionCol(f"_y{i}"))
            d = one.transform(d).withColumn(f"_h{i}", F.get(vector_to_array(f"_p{i}"), F.lit(1)))
            d = d.select(*keep, *[f"_h{j}" for j in range(i + 1)])
        s, out = F.lit(1.0), []
        for i in range(len(self.grid)):
            s = s * (1 - F.coalesce(f"_h{i}", F.lit(0.0)))
            out.append(s)
        return d.withColumn(name, F.array(*out)).select(*keep, name)

    def predict(self, df: DataFrame) -> DataFrame:
        return self.curve(df, "_s").withColumn("predicted", rmst(self.grid, "_s")).drop("_s")


def blend(raw: str, average: str, b: float) -> "F.Column":
    """Pull a curve part of the way to the average curve on the log scale."""
    clip = lambda x: F.greatest(F.least(x, F.lit(1.0)), F.lit(1e-6))
    return F.zip_with(raw, average, lambda r, a: F.exp(F.lit(b) * F.ln(clip(r)) + F.lit(1 - b) * F.ln(clip(a))))


def survival_at(curve: str, grid: list[float], h: float) -> "F.Column":
    """Value of the curve at a mark of the grid."""
    return F.get(F.col(curve), F.lit(list(grid).index(float(h))))


def fade_by(curve: str, grid: list[float], h: float) -> "F.Column":
    return 1 - survival_at(curve, grid, h)
