"""Is data arriving, and on time?"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.config import PanelConfig
from ebbtide.functions import scalars as S

# The alarm limits.
MAX_MISSED_HOURS = 2
MAX_SILENT_HOURS = 3.0
COLLAPSE_BELOW = 0.50
MIN_TO_JUDGE = 50


def mark_coverage(posts: DataFrame, readings: DataFrame, now, cfg: PanelConfig = PanelConfig(),
                  horizon=None) -> DataFrame:
    """One row per entity and expected mark: on time, late or missed, and the lateness.

    On time: the nearest reading within the tolerance. Late: the earliest reading
    after the mark that is not already a reading of the next one. Both are
    conditional minima per entity, so readings are aggregated once and only then
    spread over the marks.
    """
    a = F.col("age_hours")
    aggs = []
    for i, m in enumerate(cfg.schedule):
        later = [x for x in cfg.schedule if x > m]
        ceiling = min(m + 6 * cfg.tolerance, later[0] - cfg.tolerance if later else float("inf"))
        aggs += [F.max(F.when((a <= m) & (F.abs(a - m) <= cfg.tolerance), a)).alias(f"_b{i}"),
                 F.min(F.when((a > m) & (F.abs(a - m) <= cfg.tolerance), a)).alias(f"_a{i}"),
                 F.min(F.when((a > m) & (a < ceiling), a)).alias(f"_l{i}")]
    per = readings.filter(a.isNotNull()).groupBy("entity").agg(*aggs)
    e = posts.select("entity", "published_at")
    if horizon is not None:
        e = e.filter(F.col("published_at") >= F.lit(horizon).cast("timestamp"))
    age_now = S.hours_between("published_at", F.lit(now).cast("timestamp"))
    d = e.withColumn("age_now", age_now).join(per, "entity", "left")
    # At equal distance the earlier reading counts as the nearest.
    near = lambda i, m: (F.when(F.col(f"_a{i}") - m < m - F.col(f"_b{i}"), F.col(f"_a{i}"))
                         .otherwise(F.coalesce(f"_b{i}", f"_a{i}")))
    cells = F.array(*[F.struct(F.lit(float(m)).alias("mark"), near(i, m).alias("near"),
                               F.col(f"_l{i}").alias("late")) for i, m in enumerate(cfg.schedule)])
    d = d.select("entity", "age_now", F.explode(F.filter(cells, lambda x: x["mark"] <= F.col("age_now"))).alias("c"))
    strict, late = F.col("c.near").isNotNull(), F.col("c.near").isNull() & F.col("c.late").isNotNull()
    return d.select("entity", F.col("c.mark").alias("mark"), strict.alias("on_time"), late.alias("late"),
                    (strict | late).alias("hit"),
                    (F.coalesce("c.near", F.when(late, F.col("c.late"))) - F.col("c.mark")).alias("lateness"))


def completeness_by_entity(coverage: DataFrame) -> DataFrame:
    return coverage.groupBy("entity").agg(
        F.count(F.lit(1)).alias("expected"), F.count_if("hit").alias("hits"),
        F.avg(F.col("hit").cast("double")).alias("completeness"),
        F.avg(F.col("on_time").cast("double")).alias("strict_completeness"))


def completeness(coverage: DataFrame) -> DataFrame:
    """One row: means, share under 80 %, lateness."""
    per = completeness_by_entity(coverage).agg(
        F.count(F.lit(1)).alias("entities_evaluated"),
        F.coalesce(F.avg("completeness"), F.lit(0.0)).alias("mean_completeness"),
        F.coalesce(F.avg("strict_completeness"), F.lit(0.0)).alias("mean_strict_completeness"),
        F.count_if(F.col("completeness") < 0.80).alias("entities_below_80pct"))
    late = coverage.agg(F.coalesce(F.avg("lateness"), F.lit(0.0)).alias("mean_lateness_hours"),
                        F.coalesce(F.max("lateness"), F.lit(0.0)).alias("max_lateness_hours"))
    return per.crossJoin(late)                               # one row by one row


def counts_by_mark(coverage: DataFrame, cfg: PanelConfig = PanelConfig()) -> DataFrame:
    """Hits per scheduled mark. Marks with no hit are listed with zeros."""
    seen = coverage.groupBy("mark").agg(
        F.count(F.lit(1)).alias("expected"), F.count_if("hit").alias("hits"),
        F.count_if("on_time").alias("on_time"), F.count_if("late").alias("late"))
    grid = coverage.sparkSession.createDataFrame([(float(m),) for m in cfg.schedule], "mark double")
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return grid.join(seen, "mark", "left").select("mark", zero("expected"), zero("hits"), zero("on_time"), zero("late"))


def coverage_by_mark(posts: DataFrame, readings: DataFrame, cfg: PanelConfig = PanelConfig()) -> DataFrame:
    """Share of observed entities with any reading within tolerance of each mark."""
    a = F.col("age_hours")
    per = (readings.join(posts.select("entity"), "entity", "left_semi").groupBy("entity")
           .agg(*[F.max((F.abs(a - m) <= cfg.tolerance).cast("double")).alias(f"_{i}")
                  for i, m in enumerate(cfg.schedule)]))
    means = per.agg(*[F.avg(f"_{i}").alias(f"_{i}") for i in range(len(cfg.schedule))])
    return means.select(F.explode(F.array(*[
        F.struct(F.lit(float(m)).alias("mark"), F.col(f"_{i}").alias("on_time"))
        for i, m in enumerate(cfg.schedule)])).alias("c")).select("c.*")


def active_hours(readings: DataFrame, ts: str = "reading_ts") -> DataFrame:
    """Distinct hours with data: at most 24 rows per day, whatever the volume."""
    return (readings.filter(F.col(ts).isNotNull())
            .select(F.date_trunc("HOUR", ts).alias("hour")).distinct())


def outages(readings: DataFrame, horizon=None, max_missed: int = MAX_MISSED_HOURS,
            ts: str = "reading_ts") -> DataFrame:
    """Closed runs of more than `max_missed` hours without data: start and length.

    The ordered scan runs over distinct hours (a calendar, not the readings).
    """
    h = active_hours(readings, ts)
    if horizon is not None:
        h = h.filter(F.col("hour") >= F.date_trunc("HOUR", F.lit(horizon).cast("timestamp")))
    w = Window.orderBy("hour")
    d = h.withColumn("prev", F.lag("hour").over(w))
    missed = F.timestamp_diff("HOUR", F.col("prev"), F.col("hour")) - 1
    return (d.withColumn("hours_missing", missed).filter(F.col("hours_missing") > max_missed)
            .select(F.timestamp_add("HOUR", F.lit(1), F.col("prev")).alias("start"), "hours_missing"))


def silence(readings: DataFrame, now, ts: str = "reading_ts") -> DataFrame:
    """Hours since the last hour with data, from the full history (never windowed)."""
    last = readings.agg(F.date_trunc("HOUR", F.max(ts)).alias("last_data_at"))
    return last.withColumn("hours_since_last_data",
                           S.hours_between("last_data_at", F.lit(now).cast("timestamp")))


def health(posts: DataFrame, readings: DataFrame, now, cfg: PanelConfig = PanelConfig(),
           recent_hours: float | None = None) -> DataFrame:
    """One row: the figures the alarm looks at and the list of problems."""
    now_ts = F.lit(now).cast("timestamp")
    horizon = None if recent_hours is None else (
        now_ts - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(recent_hours * 3600)))
    known = readings.join(posts.select("entity"), "entity", "left_semi")
    c = completeness(mark_coverage(posts, readings, now, cfg, horizon))
    gaps = outages(readings, horizon).agg(F.count(F.lit(1)).alias("n_outages"))
    tracked = posts.agg(F.count(F.lit(1)).alias("entities_total"))
    seen = known.agg(F.count(F.lit(1)).alias("readings_total"))
    row = tracked.crossJoin(seen).crossJoin(c).crossJoin(gaps).crossJoin(silence(readings, now))  # one row each
    stale = F.col("hours_since_last_data") > MAX_SILENT_HOURS
    problems = F.array_compact(F.array(
        F.when(F.col("entities_total") == 0, "nothing tracked"),
        F.when((F.col("entities_total") > 0) & (F.col("readings_total") == 0), "tracked but never read"),
        F.when(F.col("n_outages") > 0, F.concat(F.col("n_outages").cast("string"), F.lit(" outage(s)"))),
        F.when(stale, "collection stopped"),
        F.when((F.col("entities_evaluated") >= MIN_TO_JUDGE) & (F.col("mean_completeness") < COLLAPSE_BELOW),
               "completeness collapsed")))
    return row.withColumn("problems", problems).withColumn("healthy", F.size("problems") == 0)


def empty_rounds(attempts: DataFrame, order: str = "started_at") -> DataFrame:
    """Length of the latest unbroken run of attempts that called accounts and saw nothing.

    A dry run is skipped. An attempt that called nobody, or saw something, ends
    the run. The answer is a count past the latest such attempt: no ordered scan.
    """
    real = attempts.filter(~F.coalesce("dry_run", F.lit(False)))
    ends = (F.coalesce("accounts_called", F.lit(0)) <= 0) | (F.coalesce("posts_seen", F.lit(0)) > 0)
    last = real.agg(F.max(F.when(ends, F.col(order))).alias("_last"))
    return (real.crossJoin(F.broadcast(last))               # one row
            .agg(F.count_if(F.col("_last").isNull() | (F.col(order) > F.col("_last"))).alias("empty_rounds")))


def daily_volume(readings: DataFrame, posts: DataFrame, cycles: DataFrame | None = None,
                 start=None) -> DataFrame:
    """Per day on a dense calendar: readings, new entities, runs, blocked days."""
    per = (readings.groupBy(F.to_date("reading_ts").alias("day")).agg(F.count(F.lit(1)).alias("readings"))
           .filter(F.col("day").isNotNull()))
    new = posts.groupBy(F.to_date("published_at").alias("day")).agg(F.count(F.lit(1)).alias("new_entities"))
    first = F.min("day") if start is None else F.lit(start).cast("date")
    days = per.agg(first.alias("a"), F.max("day").alias("b")).select(
        F.explode(F.sequence("a", "b")).alias("day"))
    d = days.join(per, "day", "left").join(new, "day", "left")
    cols = ["readings", "new_entities"]
    if cycles is not None:
        runs = cycles.groupBy(F.to_date("started_at").alias("day")).agg(
            F.count(F.lit(1)).alias("runs"), F.max(F.coalesce("quota_exceeded", F.lit(False)).cast("int")).alias("blocked"))
        d, cols = d.join(runs, "day", "left"), cols + ["runs", "blocked"]
    return d.select("day", *[F.coalesce(x, F.lit(0)).alias(x) for x in cols])


def spend_by_endpoint(cycles: DataFrame) -> DataFrame:
    return (cycles.select(F.explode("quota.by_endpoint").alias("endpoint", "units"))
            .groupBy("endpoint").agg(F.sum("units").alias("units"), F.count(F.lit(1)).alias("runs")))


def spend_per_day(cycles: DataFrame) -> DataFrame:
    return (cycles.groupBy(F.to_date("started_at").alias("day"))
            .agg(F.sum("quota.units_spent").alias("units"), F.count(F.lit(1)).alias("runs")))


def spend_summary(cycles: DataFrame) -> DataFrame:
    """Units per run: median, mean, range."""
    u = cycles.select(F.col("quota.units_spent").alias("u")).filter(F.col("u").isNotNull())
    from ebbtide.operators.skew import exact_quantiles
    med = exact_quantiles(u, "u", [0.5]).select(F.col("q")[0].alias("median_units"))
    return u.agg(F.count(F.lit(1)).alias("runs"), F.avg("u").alias("mean_units"),
                 F.min("u").alias("min_units"), F.max("u").alias("max_units")).crossJoin(med)


def equivalence_check(a: DataFrame, b: DataFrame, keys: list[str], rtol: float = 1e-9,
                      atol: float = 1e-9) -> DataFrame:
    """One row: do two result tables agree, null for null, within tolerance?"""
    cols = [x for x in a.columns if x not in keys]
    x = a.select(*keys, F.lit(True).alias("_a"), *[F.col(n).alias(f"a_{n}") for n in cols])
    y = b.select(*keys, F.lit(True).alias("_b"), *[F.col(n).alias(f"b_{n}") for n in cols])
    j = x.join(y, keys, "full_outer")
    numeric = {f.name for f in a.schema.fields
               if f.dataType.typeName() in ("double", "float", "long", "integer", "short", "byte", "decimal")}

    def same(n):
        p, q = F.col(f"a_{n}"), F.col(f"b_{n}")
        if n in numeric:
            p, q = p.cast("double"), q.cast("double")
            close = (p == q) | (F.abs(p - q) <= atol + rtol * F.abs(q))
        else:
            close = p == q
        return (p.isNull() & q.isNull()) | F.coalesce(close, F.lit(False))

    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    ok = both
    for n in cols:
        ok = ok & same(n)
    return j.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~both).alias("unmatched"),
                 F.count_if(~ok).alias("different")).withColumn("agrees", F.col("different") == 0)
