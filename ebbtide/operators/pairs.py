"""Comparisons inside an owner: did the one with more of a factor last longer?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.config import PanelConfig
from ebbtide.operators.resample import owner_bootstrap
from ebbtide.operators.series import by_entity, clamped
from ebbtide.operators.skew import exact_quantiles, running, split_hot
from ebbtide.session import cut_lineage


def pair_counts(df: DataFrame, factor: str, by: list[str] = (), cfg: PanelConfig = PanelConfig(),
                max_rows: int | None = None) -> DataFrame:
    """Per owner: comparable pairs and the share-sum in which more of `factor` lasted longer.

    A pair counts when one entity's end was seen at an earlier mark than the
    other's time. No pair is formed: entities are counted per (owner, factor
    value, mark), and a running total of seen ends per mark, in order of the
    factor, says how many ended earlier with less, or with the same.
    """
    keys = [*by, "owner"]
    marks = list(cfg.marks)
    slot = F.lit(None).cast("int")
    for i, m in reversed(list(enumerate(marks))):
        slot = F.when(F.col("fade_h") == m, F.lit(i)).otherwise(slot)
    base = (df.filter(F.col(factor).isNotNull()).select(*keys, F.col(factor).cast("double").alias("x"),
                                                        slot.alias("k"), F.col("faded").alias("e"))
            .filter(F.col("k").isNotNull()))
    cells = base.groupBy(*keys, "x").agg(
        *[F.count_if((F.col("k") == i) & F.col("e")).alias(f"e{i}") for i in range(len(marks))],
        *[F.count_if(F.col("k") == i).alias(f"n{i}") for i in range(len(marks))])
    g = running(split_hot(cells, keys, "x", max_rows), ["x"],
                {f"b{i}": ("sum", f"e{i}") for i in range(len(marks) - 1)}, inclusive=False)
    score = tot = F.lit(0.0)
    less = same = F.lit(0)
    for j in range(1, len(marks)):
        less = less + F.coalesce(f"b{j - 1}", F.lit(0))
        same = same + F.col(f"e{j - 1}")
        score = score + F.col(f"n{j}") * (less + same * 0.5)
    per = g.df.groupBy(*keys).agg(
        F.sum(score).alias("score"),
        *[F.sum(f"e{i}").alias(f"E{i}") for i in range(len(marks))],
        *[F.sum(f"n{i}").alias(f"N{i}") for i in range(len(marks))])
    pairs, ended = F.lit(0), F.lit(0)
    for j in range(1, len(marks)):
        ended = ended + F.col(f"E{j - 1}")
        pairs = pairs + F.col(f"N{j}") * ended
    return per.select(*keys, "score", pairs.cast("bigint").alias("pairs")).filter("pairs > 0")


def pair_share(df: DataFrame, factor: str, by: list[str] = (), cfg: PanelConfig = PanelConfig()) -> DataFrame:
    """Share of pairs in which the entity with more of the factor lasted longer."""
    return pair_counts(df, factor, by, cfg).groupBy(*by).agg(
        (F.sum("score") / F.sum("pairs")).alias("share"), F.sum("pairs").alias("pairs"),
        F.count(F.lit(1)).alias("owners"))


def pair_share_interval(df: DataFrame, factor: str, cfg: PanelConfig = PanelConfig(),
                        draws: int | None = None) -> DataFrame:
    """The share with an owner-resampled interval, for one cohort."""
    pc = pair_counts(df, factor, cfg=cfg)
    return owner_bootstrap(pc, {"s": F.col("score"), "n": F.col("pairs")},
                           lambda: {"share": F.col("s") / F.nullif("n", F.lit(0.0))},
                           draws or cfg.draws, cfg.seed).withColumn("factor", F.lit(factor))


def keep_patterns(intervals: DataFrame, cohorts: tuple[str, str] = ("A", "B")) -> DataFrame:
    """Factors whose interval leaves 0.5 on the same side in both cohorts.

    Input: one row per (factor, cohort) with low and high.
    """
    side = F.when(F.col("low") > 0.5, "more").when(F.col("high") < 0.5, "less")
    first, second = [F.max(F.when(F.col("cohort") == c, side)) for c in cohorts]
    d = intervals.groupBy("factor").agg(first.alias("side_a"), second.alias("side_b"))
    kept = F.coalesce(F.col("side_a") == F.col("side_b"), F.lit(False))
    return d.select("factor", kept.alias("kept"), F.when(kept, F.col("side_a")).alias("direction"))


def early_share_facts(readings: DataFrame, first_hours: float = 7.0, day: float = 24.0,
                      followed: float = 200.0, max_rows: int | None = None) -> DataFrame:
    """Share of entities fastest in their first hours, and the median share reached by `day`.

    Entities with three readings, growth, and at least `followed` hours.
    """
    g = clamped(by_entity(readings, max_rows=max_rows))
    age = F.col("age_hours")
    speed = F.when(F.col("prev_age").isNotNull(), F.coalesce("velocity", F.lit(0.0)))
    # The earliest of equal peaks decides. The clamped curve never falls, so its values around `day` are a maximum and a minimum.
    j = g.df.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n"), F.max(age).alias("last"), F.max("clamped").alias("final"), F.min(age).alias("first"),
        F.min_by("clamped", age).alias("start"), F.max_by(age, F.when(speed.isNotNull(), F.struct(speed, -age))).alias("peak_at"),
        F.max(F.when(age < day, age)).alias("a0"), F.max(F.when(age < day, F.col("clamped"))).alias("c0"),
        F.min(F.when(age >= day, age)).alias("a1"), F.min(F.when(age >= day, F.col("clamped"))).alias("c1"))
    j = j.filter((F.col("n") >= 3) & (F.col("final") > 0) & (F.col("last") >= followed))
    line = F.col("c0") + (day - F.col("a0")) / (F.col("a1") - F.col("a0")) * (F.col("c1") - F.col("c0"))
    # Before the first reading the curve is held flat, as interpolation with clamped ends does.
    level = F.when(F.col("a1") == day, F.col("c1")).when(F.col("a0").isNotNull(), line).when(F.col("first") > day, F.col("start"))
    j = j.withColumns({"early": F.col("peak_at") <= first_hours, "by_day": level / F.col("final")})
    med = exact_quantiles(j, "by_day", [0.5], max_rows=max_rows).select(F.col("q")[0].alias("median_share_by_day"))
    return j.agg(F.count(F.lit(1)).alias("entities"),
                 F.avg(F.col("early").cast("double")).alias("share_fastest_early")).crossJoin(med)


def decided_pairs(df: DataFrame, n: int, min_gap: float, seed: int, time: str = "t_death", picks: dict[str, str] | None = None) -> DataFrame:
    """`n` sampled pairs of ended entities at least `min_gap` apart; fewer only if the deal has no more.

    A sampling operator: entities are dealt in hash order and paired with their neighbour, so no pair
    is formed twice. The deal goes on, four times as far each time, until `n` pairs are found or
    all entities are dealt. `picks` names prediction columns: `<name>_pick` is the side it expects to end first.
    """
    picks = picks or {}
    ended = df.filter("event_observed").withColumn("_h", F.xxhash64(F.lit(seed), "entity"))
    for c in picks.values():
        ended = ended.filter(F.col(c).isNotNull())
    ended = cut_lineage(ended.select("entity", F.col(time).cast("double").alias("t"), *dict.fromkeys(picks.values()), "_h"))
    total, dealt = ended.count(), 4 * n
    while True:
        pool = ended if dealt >= total else ended.orderBy("_h", "entity").limit(dealt)
        g = running(split_hot(pool, [], "_h"), ["_h", "entity"], {"_r": ("sum", F.lit(1))})
        side, columns = (F.col("_r") - 1) % 2, ["entity", "t", *dict.fromkeys(picks.values())]
        p = g.df.groupBy(F.floor((F.col("_r") - 1) / 2).alias("slot")).agg(*[F.max(F.when(side == i, F.col(c))).alias(f"{k}_{c}")
                                                                             for i, k in ((0, "a"), (1, "b")) for c in columns])
        p = p.filter(F.abs(F.col("a_t") - F.col("b_t")) >= min_gap).orderBy("slot").limit(n)
        if dealt >= total or p.count() == n:
            break
        dealt *= 4
    first = lambda c: F.when(F.col(f"a_{c}") < F.col(f"b_{c}"), "a").otherwise("b")
    return p.withColumns({"first": first("t"), **{f"{name}_pick": first(c) for name, c in picks.items()}}).drop("slot")
