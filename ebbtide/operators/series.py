"""Ordered passes over each entity's readings.

Contract of a readings table: `entity`, `age_hours` (double), `value` (cumulative
counter), and optionally `seq`, a total order of ingestion used to settle equal
ages (the latest wins).

Four velocities exist and are kept apart: the label clamps to the running
maximum; features interpolate raw values; the benchmark job neither clamps nor
collapses; curves show raw velocities beside the clamped label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.operators.skew import SEG, Grouped, previous, running, split_hot


def usable(readings: DataFrame, value: str = "value") -> DataFrame:
    """Readings with an age and a finite value. NaN counts as missing."""
    ok = lambda x: F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))
    return readings.filter(ok("age_hours") & ok(value))


def collapse_equal_ages(g: Grouped, value: str = "value", seq: str | None = None) -> Grouped:
    """One reading per age (to 1e-9 h), the last ingested. Aggregated before the shuffle."""
    order = F.col(seq) if seq else F.col(value)
    key = F.round("age_hours", 9).alias("_age")
    d = (g.df.groupBy(*g.keys, key)
         .agg(F.max_by(value, order).alias(value), F.max_by("age_hours", order).alias("age_hours"))
         .drop("_age"))
    return g.with_df(d)


def by_entity(readings: DataFrame, value: str = "value", max_rows: int | None = None,
              extra: tuple[str, ...] = ()) -> Grouped:
    """Usable readings grouped for ordered scans, long entities cut into pieces."""
    cols = list(dict.fromkeys(["entity", "age_hours", value, *extra]))
    r = usable(readings, value).select(*cols).withColumns(
        {value: F.col(value).cast("double"), "age_hours": F.col("age_hours").cast("double")})
    return split_hot(r, ["entity"], "age_hours", max_rows)


def clamped(g: Grouped, value: str = "value", first: bool = False) -> Grouped:
    """Running-maximum clamp with velocity per interval.

    Adds `clamped`, `repaired` (a strict decrease was lifted), `prev_age`,
    `prev_value` and `velocity` (null on the first reading). The previous
    clamped value is the maximum of all earlier values, so one scan gives all. With `first`, so
    does `_first`, the age of the entity's first reading (null on that reading).
    """
    more = {"_first": ("min", "age_hours")} if first else {}
    g = running(g, ["age_hours"], {"prev_value": ("max", value), "prev_age": ("max", "age_hours"), **more}, inclusive=False)
    d = g.df.withColumns({
        "clamped": F.greatest(F.col(value), F.col("prev_value")),
        "repaired": F.coalesce(F.col(value) < F.col("prev_value"), F.lit(False)),
    })
    dt = F.col("age_hours") - F.col("prev_age")
    return g.with_df(d.withColumn(
        "velocity", F.when(dt > 0, (F.col("clamped") - F.col("prev_value")) / dt)))


def raw_velocity(g: Grouped, value: str = "value") -> Grouped:
    """Interval velocity of the values as read; null where time did not advance."""
    g = previous(g, "age_hours", {"prev_age": "age_hours", "prev_value": value})
    dt = F.col("age_hours") - F.col("prev_age")
    return g.with_df(g.df.withColumn(
        "velocity", F.when(dt > 0, (F.col(value) - F.col("prev_value")) / dt)))


def velocity_summary(readings: DataFrame, max_rows: int | None = None) -> DataFrame:
    """The benchmark job: per entity n_obs, max_age, peak and mean velocity, final value.

    Null values are kept in n_obs and max_age and skipped elsewhere. One shuffle:
    lag, aggregate and final value share the entity clustering, and `max_by`
    replaces a second window.
    """
    r = (readings.select("entity", F.col("age_hours").cast("double").alias("age_hours"),
                         F.nanvl(F.col("value").cast("double"), F.lit(None).cast("double")).alias("value"))
         .filter(F.col("age_hours").isNotNull()))
    g = raw_velocity(split_hot(r, ["entity"], "age_hours", max_rows))
    known = F.when(F.col("value").isNotNull(), F.col("age_hours"))
    return g.df.groupBy("entity").agg(
        F.count("age_hours").alias("n_obs"), F.max("age_hours").alias("max_age"),
        F.max("velocity").alias("peak_velocity"), F.avg("velocity").alias("mean_velocity"),
        F.max_by("value", known).alias("final_value"))


def value_at(readings: DataFrame, targets: list[float], value: str = "value",
             max_gap: float | None = None, extra: tuple[str, ...] = (),
             until: float | None = None) -> DataFrame:
    """Linear interpolation of `value` at each target age, one row per entity.

    Two readings must bracket the target; nothing is extrapolated. The brackets
    are aggregates, so a long entity combines map-side and needs no ordered pass.
    `extra` names further columns to interpolate between the same two readings;
    readings older than `until` are left out. Columns: entity, n_rows, n_values,
    n_readings (usable ones), first_age, last_age and, per target i, v{i} (and
    v{i}_{extra}).
    """
    ok = lambda x: F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))
    use = ok("age_hours") & ok(value)
    if until is not None:
        use = use & (F.col("age_hours") <= until)
    cols = [value, *extra]
    r = readings.select("entity", ok(value).alias("_has"), F.when(use, F.col("age_hours").cast("double")).alias("_a"),
                        *[F.col(x).cast("double").alias(x) for x in cols])
    a = F.col("_a")
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.count_if("_has").alias("n_values"),
            F.count(a).alias("n_readings"), F.min(a).alias("first_age"), F.max(a).alias("last_age")]
    for i, t in enumerate(targets):
        lo, hi = F.when(a < t, a), F.when(a >= t, a)
        aggs += [F.max(lo).alias(f"_a{i}"), F.min(hi).alias(f"_b{i}")]
        for x in cols:
            aggs += [F.max_by(x, lo).alias(f"_a{i}_{x}"), F.min_by(x, hi).alias(f"_b{i}_{x}")]
    d = r.groupBy("entity").agg(*aggs)
    sel = [F.col(x) for x in ("entity", "n_rows", "n_values", "n_readings", "first_age", "last_age")]
    for i, t in enumerate(targets):
        lo, hi = F.col(f"_a{i}"), F.col(f"_b{i}")
        for x in cols:
            va, vb = F.col(f"_a{i}_{x}"), F.col(f"_b{i}_{x}")
            line = va + (F.lit(t) - lo) / (hi - lo) * (vb - va)
            if max_gap is None:
                got = F.when((hi == t) & (F.col("n_readings") >= 2), vb).when(
                    (hi > t) & lo.isNotNull(), line)
            else:
                got = F.when(hi - lo <= max_gap, line)
            sel.append(got.alias(f"v{i}" if x == value else f"v{i}_{x}"))
    return d.select(*sel)


def last_at_or_before(readings: DataFrame, landmark: float, cols: list[str]) -> DataFrame:
    """As-of lookup per entity: each column's last non-null value at age <= landmark.

    Columns are taken separately, so a missing likes count falls back to an
    earlier reading while views does not. Pure aggregate, no ordered pass.
    """
    early = readings.filter(F.col("age_hours") <= landmark)
    return early.groupBy("entity").agg(
        *[F.max_by(x, F.when(F.col(x).isNotNull(), F.col("age_hours"))).alias(x) for x in cols])


def asof_join(left: DataFrame, right: DataFrame, on: str, ts: str, cols: list[str],
              max_rows: int | None = None) -> DataFrame:
    """For each left row, the latest right row with the same key and `ts` not after it.

    Both sides are stacked and scanned once in time order, so nothing is paired.
    `cols` are right columns carried over (null where there is no earlier row).
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    packed = F.struct(micros.alias("_t"), *[F.col(x) for x in cols])
    rows = F.struct(*[F.col(x) for x in left.columns])
    kind = left.select(rows.alias("_l")).schema["_l"].dataType
    pack_kind = right.select(packed.alias("_r")).schema["_r"].dataType
    both = (left.select(on, micros.alias("_at"), F.lit(1).alias("_side"), rows.alias("_l"),
                        F.lit(None).cast(pack_kind).alias("_r"))
            .unionByName(right.select(on, micros.alias("_at"), F.lit(0).alias("_side"),
                                      F.lit(None).cast(kind).alias("_l"), packed.alias("_r"))))
    g = running(split_hot(both.filter(F.col("_at").isNotNull()), [on], "_at", max_rows),
                ["_at", "_side"], {"_asof": ("max", "_r")})
    return g.df.filter(F.col("_side") == 1).select(
        "_l.*", *[F.col(f"_asof.{x}").alias(f"asof_{x}") for x in cols])


__all__ = ["SEG", "usable", "by_entity", "collapse_equal_ages", "clamped", "raw_velocity",
           "velocity_summary", "value_at", "last_at_or_before", "asof_join"]
