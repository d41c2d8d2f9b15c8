"""Who is tracked and what is due, derived from the readings alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.config import PanelConfig
from ebbtide.functions import scalars as S


def panel_state(posts: DataFrame, readings: DataFrame, cfg: PanelConfig = PanelConfig(),
                sighted: str | None = None) -> DataFrame:
    """Per entity: reading count, readings old enough to satisfy a mark, last reading.

    The first sighting's metadata wins. Readings of unknown entities are ignored.
    """
    order = F.col(sighted) if sighted else F.col("published_at")
    e = (posts.filter(F.col("entity").isNotNull() & F.col("published_at").isNotNull())
         .groupBy("entity").agg(F.min_by("owner", order).alias("owner"),
                                F.min_by("source", order).alias("source"),
                                F.min_by("published_at", order).alias("published_at")))
    r = readings.groupBy("entity").agg(
        F.count(F.lit(1)).alias("reading_count"),
        F.count_if(F.col("age_hours") >= cfg.first_mark_opens).alias("scheduled_count"),
        F.max("reading_ts").alias("last_reading_at"))
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return e.join(r, "entity", "left").select(
        "entity", "owner", "source", "published_at", zero("reading_count"), zero("scheduled_count"),
        "last_reading_at")


def with_schedule(panel: DataFrame, now, cfg: PanelConfig = PanelConfig()) -> DataFrame:
    """Age now, marks passed, and whether an entity is active or owed a reading."""
    age = S.hours_between("published_at", F.lit(now).cast("timestamp"))
    passed = sum((F.col("age_now") >= m).cast("int") for m in cfg.schedule)
    return (panel.withColumn("age_now", age)
            .withColumns({"marks_passed": passed,
                          "active": F.col("age_now").between(0, cfg.max_track)})
            .withColumn("due", F.col("active") & (F.col("scheduled_count") < F.col("marks_passed"))))


def due_list(panel: DataFrame, now, cfg: PanelConfig = PanelConfig()) -> DataFrame:
    """Entities owed a reading, oldest first.

    Only readings inside some mark's reach count towards the schedule: one taken
    at discovery would otherwise use up the first mark.
    """
    return with_schedule(panel, now, cfg).filter("due").orderBy("published_at", "entity")


def panel_stats(panel: DataFrame, now, cfg: PanelConfig = PanelConfig()) -> DataFrame:
    return with_schedule(panel, now, cfg).agg(
        F.count(F.lit(1)).alias("entities_total"), F.count_if("active").alias("entities_active"),
        F.count_if("due").alias("entities_due"),
        F.coalesce(F.sum("reading_count"), F.lit(0)).alias("readings_total"),
        F.coalesce(F.avg("reading_count"), F.lit(0.0)).alias("readings_per_entity"))


def label_summary(labels: DataFrame) -> DataFrame:
    """How many entities can be labelled, have ended, or are censored."""
    ok = F.col("exclude_reason").isNull()
    return labels.agg(F.count(F.lit(1)).alias("entities"), F.count_if(ok).alias("labelled"),
                      F.count_if("event_observed").alias("events"),
                      F.count_if(ok & ~F.col("event_observed")).alias("censored"),
                      F.coalesce(F.sum("monotonicity_repairs"), F.lit(0)).alias("repairs"))
