"""Censoring-aware summaries of (time, event) tables."""

from __future__ import annotations

from math import erfc, exp, lgamma, log, sqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.config import PanelConfig
from ebbtide.operators.skew import group_total, running, split_hot

HALF = 0.5 + 1e-12          # S(t) <= 1/2, allowing for rounding in the product
Z95 = 1.959963984540054


def kaplan_meier(df: DataFrame, time: str = "duration", event: str = "event", by: list[str] = (),
                 band: bool = False, max_rows: int | None = None) -> DataFrame:
    """Survival curve per group, one row per distinct time.

    Rows are counted per distinct time first (map-side), so the ordered scan
    runs over times, not entities. Columns: by, t, deaths, at_risk, s and, with
    `band`, the log-log 95 % limits.
    """
    per = (df.filter(F.col(time).isNotNull()).groupBy(*by, F.col(time).cast("double").alias("t"))
           .agg(F.sum(F.col(event).cast("bigint")).alias("deaths"), F.count(F.lit(1)).alias("_c")))
    g = split_hot(per, list(by), "t", max_rows)
    g = running(g, ["t"], {"_gone": ("sum", "_c")}, inclusive=False)
    g = group_total(g, {"_n": ("sum", "_c")})
    risk = F.col("_n") - F.coalesce("_gone", F.lit(0))
    left = risk - F.col("deaths")
    g = g.with_df(g.df.withColumns({
        "at_risk": risk,
        "_ln": F.when(left > 0, F.ln(left / risk)).otherwise(F.lit(0.0)),
        "_end": F.when(left <= 0, 1).otherwise(0),
        "_var": F.when(left > 0, F.col("deaths") / (risk * left)).otherwise(F.lit(0.0))}))
    g = running(g, ["t"], {"_sum": ("sum", "_ln"), "_over": ("max", "_end"), "_green": ("sum", "_var")})
    d = g.df.withColumn("s", F.when(F.col("_over") == 1, F.lit(0.0)).otherwise(F.exp("_sum")))
    out = [*by, "t", "deaths", "at_risk", "s"]
    if band:
        inside = (F.col("s") > 0) & (F.col("s") < 1)
        v = F.sqrt("_green") / F.ln("s")
        edge = lambda z: F.when(inside, F.exp(-F.exp(F.ln(-F.ln("s")) + z * v))).otherwise(F.col("s"))
        d = d.withColumns({"s_low": edge(-Z95), "s_high": edge(Z95)})
        d = d.withColumns({"s_low": F.least("s_low", "s_high"), "s_high": F.greatest("s_low", "s_high")})
        out += ["s_low", "s_high"]
    return d.select(*out)


def km_median(df: DataFrame, time: str = "duration", event: str = "event", by: list[str] = (),
              max_rows: int | None = None) -> DataFrame:
    """Median survival per group; the largest time where half are never reached."""
    curve = kaplan_meier(df, time, event, by, max_rows=max_rows)
    return curve.groupBy(*by).agg(
        F.coalesce(F.min(F.when(F.col("s") <= HALF, F.col("t"))), F.max("t")).alias("km_median"),
        (F.min("s") <= HALF).alias("median_reached"))


def km_thin(curve: DataFrame, by: list[str] = ()) -> DataFrame:
    """Last value of the curve in each half hour."""
    return (curve.groupBy(*by, (F.bround(F.col("t") * 2) / 2).alias("t_bin"))
            .agg(F.max_by("s", "t").alias("s")))


def average_curve(rows: DataFrame, cfg: PanelConfig = PanelConfig(), entity: str = "entity") -> DataFrame:
    """Kaplan-Meier on the mark grid, each entity once: one row with an array of S.

    Fade times lie on the marks, so at-risk and event counts per mark are
    conditional counts of a single aggregation.
    """
    one = rows.groupBy(entity).agg(F.min("fade_h").alias("fade_h"), F.max("faded").alias("faded"))
    aggs = []
    for i, m in enumerate(cfg.marks):
        aggs += [F.count_if(F.col("fade_h") >= m).alias(f"n{i}"),
                 F.count_if((F.col("fade_h") == m) & F.col("faded")).alias(f"d{i}")]
    d = one.agg(*aggs)
    s, curve = F.lit(1.0), []
    for i in range(len(cfg.marks)):
        s = s * F.when(F.col(f"n{i}") > 0, 1.0 - F.col(f"d{i}") / F.col(f"n{i}")).otherwise(1.0)
        curve.append(s)
    return d.select(F.array(*curve).alias("average"))


def rmst(times: list[float], surv: str) -> "F.Column":
    """Area under a step curve given as an array column over `times`: 1 before the first time."""
    if not times:
        return F.lit(0.0)
    widths = [b - a for a, b in zip(times, times[1:])]
    return F.lit(float(times[0])) + sum(
        (F.get(surv, F.lit(i)) * w for i, w in enumerate(widths)), F.lit(0.0))


def logrank_counts(df: DataFrame, time: str, event: str, group: str,
                   max_rows: int | None = None) -> tuple[DataFrame, list]:
    """Observed minus expected events per group and their covariance, as one row."""
    groups = [r[0] for r in df.select(group).filter(F.col(group).isNotNull()).distinct()
              .orderBy(group).limit(101).collect()]
    if len(groups) > 100:
        raise ValueError("the log-rank test compares at most 100 groups")
    k = len(groups)
    mine = lambda i: F.col(group) == F.lit(groups[i])
    per = (df.filter(F.col(group).isNotNull()).groupBy(F.col(time).cast("double").alias("t"))
           .agg(*[F.count_if(mine(i)).alias(f"c{i}") for i in range(k)],
                *[F.count_if(mine(i) & F.col(event)).alias(f"d{i}") for i in range(k)]))
    g = running(split_hot(per, [], "t", max_rows), ["t"],
                {f"g{i}": ("sum", f"c{i}") for i in range(k)}, inclusive=False)
    g = group_total(g, {f"n{i}": ("sum", f"c{i}") for i in range(k)})
    risk = [F.col(f"n{i}") - F.coalesce(f"g{i}", F.lit(0)) for i in range(k)]
    d = g.df.withColumns({f"r{i}": risk[i] for i in range(k)})
    n = sum(F.col(f"r{i}") for i in range(k))
    dd = sum(F.col(f"d{i}") for i in range(k))
    d = d.withColumns({"n": n, "d": dd}).filter((F.col("d") > 0) & (F.col("n") > 0))
    spread = F.when(F.col("n") > 1, F.col("d") * (F.col("n") - F.col("d")) / (F.col("n") - 1)).otherwise(0.0)
    share = [F.col(f"r{i}") / F.col("n") for i in range(k)]
    z = [F.sum(F.col(f"d{i}") - F.col("d") * share[i]).alias(f"z{i}") for i in range(k)]
    v = [F.sum(spread * share[i] * ((1.0 if i == j else 0.0) - share[j])).alias(f"v{i}_{j}")
         for i in range(k) for j in range(k)]
    obs = [F.sum(f"d{i}").alias(f"o{i}") for i in range(k)]
    return d.agg(*obs, *z, *v), groups


def logrank_groups(df: DataFrame, time: str = "duration", event: str = "event",
                   group: str = "stratum_tier") -> DataFrame:
    """Observed and expected events per group."""
    row, groups = logrank_counts(df, time, event, group)
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(x).alias("group"), F.col(f"o{i}").alias("observed"),
                 (F.col(f"o{i}") - F.col(f"z{i}")).alias("expected"),
                 F.col(f"v{i}_{i}").alias("variance"))
        for i, x in enumerate(groups)])).alias("g")).select("g.*")


def logrank_test(df: DataFrame, time: str = "duration", event: str = "event",
                 group: str = "stratum_tier") -> DataFrame:
    """k-sample log-rank test. Only k + k*k sums reach the driver."""
    row, groups = logrank_counts(df, time, event, group)
    r, k = row.first(), len(groups)
    stat, p = float("nan"), float("nan")
    if k > 1 and r["z0"] is not None:
        z = np.array([r[f"z{i}"] for i in range(k - 1)])
        v = np.array([[r[f"v{i}_{j}"] for j in range(k - 1)] for i in range(k - 1)])
        stat = float(z @ np.linalg.pinv(v) @ z)
        p = chi2_sf(stat, k - 1)
    return df.sparkSession.createDataFrame([(k, stat, k - 1, p)],
                                           "groups int, statistic double, dof int, p_value double")


def chi2_sf(x: float, dof: int) -> float:
    """Upper tail of the chi-square distribution for a whole number of degrees of freedom."""
    if x <= 0 or dof < 1:
        return 1.0
    h = x / 2
    total, a = (erfc(sqrt(h)), 0.5) if dof % 2 else (exp(-h), 1.0)
    while a < dof / 2:
        total += exp(a * log(h) - h - lgamma(a + 1))
        a += 1
    return min(1.0, total)


def tier_table(df: DataFrame, strata: list[str], time: str = "duration", event: str = "event") -> DataFrame:
    """Entities, events, owners and median survival per stratum, with subtotals.

    Null in a stratum column marks the total over it.
    """
    base = df.select(*strata, "owner", F.col(time).alias("_t"), F.col(event).cast("boolean").alias("_e"))
    counts = base.rollup(*strata).agg(
        F.grouping_id().alias("_gid"), F.count(F.lit(1)).alias("entities"), F.count_if("_e").alias("events"),
        F.count_distinct("owner").alias("owners"))
    medians = None
    for depth in range(len(strata) + 1):
        have, gid = strata[:depth], 2 ** (len(strata) - depth) - 1
        m = km_median(base, "_t", "_e", have).withColumn("_gid", F.lit(gid).cast("bigint"))
        m = m.select(*[F.col(s) if s in have else F.lit(None).cast(base.schema[s].dataType).alias(s)
                       for s in strata], "_gid", "km_median")
        medians = m if medians is None else medians.unionByName(m)
    on = counts["_gid"] == medians["_gid"]
    for s in strata:
        on = on & counts[s].eqNullSafe(medians[s])
    return counts.join(medians, on, "left").select(
        *[counts[s] for s in strata], "entities", "events", "owners", "km_median")


def cohort_counts(df: DataFrame, event: str = "event_observed", by: list[str] = ()) -> DataFrame:
    """Entities, events, owners and the censored share."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("entities"), F.count_if(F.col(event)).alias("events"),
        F.count_distinct("owner").alias("owners"),
        F.avg(F.when(F.col(event), 0.0).otherwise(1.0)).alias("censored_share"))
