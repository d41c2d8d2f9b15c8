"""The same derivations as SQL functions, inlined by Catalyst (no Python at run time)."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ebbtide.config import PanelConfig


def register(spark: SparkSession, cfg: PanelConfig = PanelConfig()) -> list[str]:
    """Create temporary SQL functions for a session; returns their names."""
    inside = " ".join(f"WHEN age BETWEEN {m - cfg.tolerance}D AND {m + cfg.late_tolerance}D THEN {m}D"
                      for m in cfg.marks)
    fade = " ".join(f"WHEN {m}D <= t + {cfg.tolerance}D THEN {m}D" for m in reversed(cfg.marks))
    part = lambda i: (rf"coalesce(try_cast(regexp_extract(s, '^PT(?:(\\d+)H)?(?:(\\d+)M)?"
                      rf"(?:(\\d+(?:\\.\\d+)?)S)?$', {i}) AS DOUBLE), 0D)")
    bodies = {
        "mark_of": ("age DOUBLE", "DOUBLE", f"CASE {inside} END"),
        "fade_mark": ("t DOUBLE", "DOUBLE",
                      f"CASE WHEN t IS NULL THEN NULL {fade} ELSE {cfg.marks[0]}D END"),
        "owner_fold": ("owner STRING", "INT",
                       "CAST(aggregate(split(sha2(owner, 256), ''), 0, (a, d) -> "
                       "a + coalesce(try_cast(conv(d, 16, 10) AS INT), 0)) % 5 AS INT)"),
        "iso_duration_seconds": (
            "s STRING", "DOUBLE",
            r"CASE WHEN s RLIKE '^PT(?:(\\d+)H)?(?:(\\d+)M)?(?:(\\d+(?:\\.\\d+)?)S)?$' THEN "
            f"nullif({part(1)} * 3600 + {part(2)} * 60 + {part(3)}, 0D) END"),
        "tier_of": ("n DOUBLE", "STRING",
                    "CASE WHEN n IS NULL THEN 'unknown' WHEN n < 10000 THEN 'micro' "
                    "WHEN n < 500000 THEN 'mid' ELSE 'large' END"),
    }
    for name, (args, out, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {out} RETURN {body}")
    return list(bodies)
