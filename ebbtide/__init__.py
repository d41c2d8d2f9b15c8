"""ebbtide: panel-decay analytics on Spark.

Repeated readings of cumulative counters go in as DataFrames; decay labels,
leak-free features, censoring-aware statistics, monitoring tables and
disclosure-safe exports come out as DataFrames.
"""

from ebbtide.config import PanelConfig
from ebbtide.session import build_session

__all__ = ["PanelConfig", "build_session"]
