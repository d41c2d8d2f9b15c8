"""When does attention end? Decay events with right-censoring, and a second label."""

from __future__ import annotations

from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.config import PanelConfig
from ebbtide.operators.chunks import whole_groups
from ebbtide.operators.series import by_entity, clamped, collapse_equal_ages, raw_velocity
from ebbtide.operators.skew import SEG, WHOLE, Grouped, followers, group_total, running

INSUFFICIENT = "insufficient_observations"
NO_GROWTH = "no_positive_velocity"

LABEL_COLUMNS = ["entity", "t_death", "event_observed", "peak_velocity", "peak_at_hours",
                 "n_observations", "n_intervals", "last_observed_hours", "final_value",
                 "monotonicity_repairs", "exclude_reason"]


def intervals(readings: DataFrame, cfg: PanelConfig = PanelConfig(), seq: str | None = None,
              unique_ages: bool = False, max_rows: int | None = None) -> Grouped:
    """Clamped readings with velocity, the entity's peak, and the slowest-k test value.

    `sustained` on a reading is the fastest of the `sustain` intervals starting
    there, or null where fewer remain: the event cannot be confirmed then.
    """
    g = by_entity(readings, max_rows=max_rows, extra=(seq,) if seq else ())
    if not unique_ages:
        g = collapse_equal_ages(g, seq=seq)
    elif seq:
        g = g.with_df(g.df.drop(seq))
    g = clamped(g, first=cfg.skip_first)
    if cfg.skip_first:
        # The first interval starts at the first reading; keep it if it is the only one.
        later = F.when(F.col("prev_age") != F.col("_first"), F.col("velocity"))
        g = group_total(g, {"_n": ("sum", F.when(F.col("velocity").isNotNull(), 1).otherwise(0)), "_all": ("max", "velocity"), "_later": ("max", later)})
        g = g.with_df(g.df.withColumn("_pool", F.when(F.col("_n") <= 1, F.col("velocity")).otherwise(later))
                      .withColumn("peak", F.when(F.col("_n") <= 1, F.col("_all")).otherwise(F.col("_later"))).drop("_all", "_later"))
    else:
        g = group_total(g.with_df(g.df.withColumn("_pool", F.col("velocity"))), {"peak": ("max", "_pool")})
    k = cfg.sustain
    if k == 1:
        return g.with_df(g.df.withColumn("sustained", F.col("velocity")))
    g = followers(g, "age_hours", "velocity", k - 1, "_next")
    enough = F.col("velocity").isNotNull() & (F.size("_next") == k - 1)
    return g.with_df(g.df.withColumn(
        "sustained", F.when(enough, F.greatest("velocity", F.array_max("_next")))).drop("_next"))


def decay_label(readings: DataFrame, cfg: PanelConfig = PanelConfig(), seq: str | None = None,
                unique_ages: bool = False, max_rows: int | None = None) -> DataFrame:
    """One label per entity.

    Velocity under `frac` of the own peak (strictly) for `sustain` consecutive
    intervals is the event, dated at the end of the first of them. The search
    starts at the first interval, so a slow starter can end before its peak.
    Otherwise the entity is censored at its last reading. Pass `unique_ages` for
    readings already deduplicated by (entity, time): the whole operator is then
    one shuffle.
    """
    return _labels(readings, cfg, [cfg.frac], seq, unique_ages, max_rows).drop("frac")


def decay_label_sweep(readings: DataFrame, fracs: list[float], cfg: PanelConfig = PanelConfig(),
                      seq: str | None = None, unique_ages: bool = False,
                      max_rows: int | None = None) -> DataFrame:
    """Labels at several thresholds from one pass, with a `frac` column."""
    return _labels(readings, cfg, list(fracs), seq, unique_ages, max_rows)


def _labels(readings, cfg, fracs, seq, unique_ages, max_rows) -> DataFrame:
    g = intervals(readings, cfg, seq, unique_ages, max_rows)
    deaths = [F.min(F.when(F.col("sustained") < F.lit(f) * F.col("peak"), F.col("age_hours")))
              .alias(f"_d{i}") for i, f in enumerate(fracs)]
    d = g.df.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n_observations"),
        F.count("velocity").alias("n_intervals"),
        F.max("age_hours").alias("last_observed_hours"),
        F.max("clamped").alias("final_value"),
        F.sum(F.col("repaired").cast("int")).alias("monotonicity_repairs"),
        F.max("peak").alias("_peak"),
        F.min(F.when(F.col("_pool") == F.col("peak"), F.col("age_hours"))).alias("_peak_at"),
        *deaths)
    reason = (F.when(F.col("n_intervals") < cfg.min_intervals, F.lit(INSUFFICIENT))
              .when(F.col("_peak") <= 0, F.lit(NO_GROWTH)))
    few = F.col("n_intervals") < cfg.min_intervals
    d = d.withColumns({"exclude_reason": reason,
                       "peak_velocity": F.when(~few, F.col("_peak")),
                       "peak_at_hours": F.when(~few, F.col("_peak_at"))})
    d = d.withColumn("_d", F.explode(F.array(*[
        F.struct(F.lit(float(f)).alias("frac"), F.col(f"_d{i}").alias("death"))
        for i, f in enumerate(fracs)])))
    usable = F.col("exclude_reason").isNull()
    d = d.withColumns({
        "frac": F.col("_d.frac"),
        "event_observed": usable & F.col("_d.death").isNotNull(),
        "t_death": F.when(usable, F.coalesce(F.col("_d.death"), F.col("last_observed_hours"))),
    })
    return d.select("frac", *LABEL_COLUMNS)


def saturation_fit(readings: DataFrame, cfg: PanelConfig = PanelConfig(), seq: str | None = None,
                   grid: int = 48, rounds: int = 3, max_rows: int | None = None) -> DataFrame:
    """Robustness label: time to reach `saturation_target` of A in C(t) = A(1 - exp(-kt)).

    For a fixed k the best A has a closed form, so the fit is a search over k
    alone, on a log grid between 1e-6 and 10 that is refined around the best cell
    `rounds` times. Whole entities are searched where they lie, many at a time, in arrays. An entity that was cut is
    searched by totals over its pieces: the sums (c*f, f*f) of all grid points stand next to its readings and narrow
    the grid for the next round. Readings are neither multiplied by the grid nor joined. A is held inside [0.5, 100]
    times the largest value. Entities with under three readings or no growth have no fit; equal errors go to the smaller k.
    """
    g = collapse_equal_ages(by_entity(readings, max_rows=max_rows, extra=(seq,) if seq else ()), seq=seq)
    g = running(g, ["age_hours"], {"v": ("max", "value")})
    g = g.with_df(g.df.select(*g.keys, F.col("age_hours").alias("t"), "v"))
    whole = g.df.filter(F.col(SEG) == WHOLE) if g.hot else g.df
    rows = whole.select("entity", "t", "v").repartition("entity").sortWithinPartitions("entity", "t")
    kind = f"entity {g.df.schema['entity'].dataType.simpleString()}, sse double, log_k double, a double"
    best = rows.mapInArrow(whole_groups(_fit_whole(grid, rounds), ["entity"]), kind)
    if g.hot:
        best = best.unionByName(_fit_cut(g.with_df(g.pieces()), grid, rounds))
    target = -log(1.0 - cfg.saturation_target)
    k = F.exp("log_k")
    return best.select("entity", (F.lit(target) / k).alias("t_saturation"), F.col("a").alias("fitted_A"), k.alias("fitted_k"), "sse")


K_ENDS = log(1e-6), log(10.0)


def _fit_whole(grid: int, rounds: int):
    """(entity, sse, log_k, a) of whole entities, many at a time."""
    def run(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        t, v = (table.column(c).to_numpy() for c in "tv")
        sizes = np.diff(np.append(starts, len(t)))
        use = (sizes >= 3) & (np.maximum.reduceat(v, starts) > 0)
        names, rows, sizes = table.column("entity").take(pa.array(starts[use])).combine_chunks(), np.repeat(use, sizes), sizes[use]
        t, v, m = t[rows], v[rows], len(sizes)
        at, lo, hi = np.cumsum(sizes) - sizes, np.full(m, K_ENDS[0]), np.full(m, K_ENDS[1])
        sse, a, ok, pick, each = np.empty((m, grid)), np.empty((m, grid)), np.zeros((m, grid), bool), np.zeros(m, int), np.arange(m)
        if m:
            top, cc = np.maximum.reduceat(v, at), np.add.reduceat(v * v, at)
            for _ in range(rounds):
                step = (hi - lo) / (grid - 1)
                for i in range(grid):
                    f = 1 - np.exp(-np.repeat(np.exp(lo + step * i), sizes) * t)
                    cf, ff = np.add.reduceat(v * f, at), np.add.reduceat(f * f, at)
                    with np.errstate(all="ignore"):
                        a[:, i] = np.maximum(np.minimum(cf / ff, top * 100), top * 0.5)
                        sse[:, i], ok[:, i] = cc - 2 * a[:, i] * cf + a[:, i] * a[:, i] * ff, ff > 0
                found = ok.any(axis=1)
                pick = np.where(ok, np.where(np.isnan(sse), np.finfo(float).max, sse), np.inf).argmin(axis=1)
                log_k = lo + step * pick
                lo, hi = (np.where(found, x, end) for x, end in zip((np.maximum(log_k - step, K_ENDS[0]), np.minimum(log_k + step, K_ENDS[1])), K_ENDS))
        else:
            found, log_k = np.zeros(0, bool), lo
        out = [sse[each, pick], log_k, a[each, pick]]
        return pa.RecordBatch.from_arrays([names.filter(pa.array(found)), *[pa.array(x[found]) for x in out]], ["entity", "sse", "log_k", "a"])
    return run


def _fit_cut(g: Grouped, grid: int, rounds: int) -> DataFrame:
    """The same for entities in pieces."""
    g = group_total(g, {"n": ("sum", F.lit(1)), "top": ("max", "v"), "cc": ("sum", F.col("v") * F.col("v"))})
    g = g.with_df(g.df.filter((F.col("n") >= 3) & (F.col("top") > 0)).withColumns({"lo": F.lit(K_ENDS[0]), "hi": F.lit(K_ENDS[1])}))
    for _ in range(rounds):
        step = (F.col("hi") - F.col("lo")) / (grid - 1)
        f = [1 - F.exp(-F.exp(F.col("lo") + step * i) * F.col("t")) for i in range(grid)]
        g = group_total(g, {f"{kind}{i}": ("sum", x) for i in range(grid) for kind, x in (("cf", F.col("v") * f[i]), ("ff", f[i] * f[i]))})
        cells = []
        for i in range(grid):
            cf, ff = F.col(f"cf{i}"), F.col(f"ff{i}")
            a = F.greatest(F.least(cf / ff, F.col("top") * 100), F.col("top") * 0.5)
            cells.append(F.when(ff > 0, F.struct((F.col("cc") - 2 * a * cf + a * a * ff).alias("sse"), (F.col("lo") + step * i).alias("log_k"), a.alias("a"))))
        d = g.df.withColumn("_best", F.array_min(F.array_compact(F.array(*cells)))).drop(*[f"{kind}{i}" for i in range(grid) for kind in ("cf", "ff")])
        g = g.with_df(d.withColumns({"lo": F.greatest(F.col("_best.log_k") - step, F.lit(K_ENDS[0])), "hi": F.least(F.col("_best.log_k") + step, F.lit(K_ENDS[1]))}))
    return g.df.filter("_best IS NOT NULL").groupBy("entity").agg(F.max("_best").alias("b")).select("entity", "b.*")


def curve_points(readings: DataFrame, cfg: PanelConfig = PanelConfig(), seq: str | None = None,
                 max_rows: int | None = None) -> DataFrame:
    """Per-reading view of a labelled entity: clamped value, speed as a share of the own peak."""
    g = intervals(readings, cfg, seq, max_rows=max_rows)
    share = F.when(F.col("peak") > 0, F.greatest(F.col("velocity"), F.lit(0.0)) / F.col("peak"))
    return g.df.select("entity", "age_hours", "clamped", "velocity", share.alias("speed_share"),
                       (F.col("peak") * cfg.frac).alias("threshold"))


def raw_curve(readings: DataFrame, max_rows: int | None = None) -> DataFrame:
    """The curve as it was read: values and interval speeds without clamp or merging, null where time did not advance."""
    g = raw_velocity(by_entity(readings, max_rows=max_rows))
    return g.df.select("entity", "age_hours", "value", "velocity")


def curve_notes(readings: DataFrame, labels: DataFrame, first_mark: float = 1.0) -> DataFrame:
    """Flags shown beside a curve: corrected counters, and a first reading past the first mark."""
    first = (readings.filter(F.col("value").isNotNull()).groupBy("entity")
             .agg(F.min("age_hours").alias("first_age")))
    return labels.join(first, "entity").select(
        "entity", F.when(F.col("monotonicity_repairs") > 0, F.col("monotonicity_repairs")).alias("corrections"),
        F.when(F.col("first_age") > first_mark, F.col("first_age")).alias("late_first_reading"))
