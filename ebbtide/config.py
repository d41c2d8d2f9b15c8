"""Parameters of a panel study. Every operator takes one of these, never globals."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Mapping

# The observation schedule in hours since publication.
SCHEDULE_HOURS = (1.0, 3.0, 6.0, 12.0, 24.0, 36.0, 48.0, 72.0, 96.0, 120.0, 168.0, 240.0, 336.0)


@dataclass(frozen=True)
class PanelConfig:
    # Observation schedule. `marks` is the grid on which fade times are recorded.
    schedule: tuple[float, ...] = SCHEDULE_HOURS
    marks: tuple[float, ...] = SCHEDULE_HOURS[:-1]
    checkpoints: tuple[float, ...] = (1.0, 3.0, 6.0, 12.0)
    tolerance: float = 0.75
    late_tolerance: float = 1.0
    max_track: float = 336.0
    simulation_max_gap: float = 8.0

    # Decay event: velocity under `frac` of the own peak for `sustain` intervals.
    frac: float = 0.05
    sustain: int = 2
    min_intervals: int = 4
    skip_first: bool = False
    saturation_target: float = 0.90

    # Prediction design.
    feature_cutoff: float = 7.0
    landmark: float = 7.0
    early_marks: tuple[float, float, float] = (1.0, 3.0, 6.0)
    horizons: tuple[float, ...] = (24.0, 48.0, 72.0, 168.0)
    fast_hours: float = 48.0
    flag_share: float = 0.20
    min_prior: int = 2
    folds: int = 5
    draws: int = 2000
    seed: int = 4177

    # Per-source rules. A cap of 0 means no cap.
    primary_metric: Mapping[str, str] = field(default_factory=lambda: {"video": "views", "photo": "likes"})
    daily_cap: Mapping[str, int] = field(default_factory=lambda: {"video": 5, "photo": 0})

    def __post_init__(self) -> None:
        if not 0 < self.frac < 1:
            raise ValueError("frac must lie between 0 and 1")
        if self.sustain < 1 or self.min_intervals < 1:
            raise ValueError("sustain and min_intervals must be at least 1")
        if list(self.schedule) != sorted(set(self.schedule)):
            raise ValueError("schedule must be strictly increasing")

    @property
    def first_mark_opens(self) -> float:
        """Age at which the first mark's tolerance window opens."""
        return min(self.schedule) - self.tolerance

    @property
    def min_odds_age(self) -> float:
        return self.checkpoints[0] - self.tolerance

    @property
    def max_odds_age(self) -> float:
        return self.checkpoints[-1] + self.late_tolerance

    def scaled(self, k: float) -> "PanelConfig":
        """The same design on a clock `k` times slower (for panels read less often)."""
        times = lambda xs: tuple(x * k for x in xs)
        return replace(
            self, schedule=times(self.schedule), marks=times(self.marks),
            checkpoints=times(self.checkpoints), early_marks=times(self.early_marks),
            horizons=times(self.horizons), tolerance=self.tolerance * k,
            late_tolerance=self.late_tolerance * k, max_track=self.max_track * k,
            simulation_max_gap=self.simulation_max_gap * k,
            feature_cutoff=self.feature_cutoff * k, landmark=self.landmark * k,
            fast_hours=self.fast_hours * k)


# Predictor whitelists (fixed values). Outcome columns can never enter a model.
FEATURE_COLUMNS = (
    "log_value_m1", "log_value_m2", "log_value_m3", "velocity_to_m3",
    "log_growth_12", "log_growth_23", "decay_ratio", "log_follower_count",
    "log_duration_sec", "publish_hour_utc", "title_len",
)
EXPLORATORY_COLUMNS = (
    "acceleration", "publish_weekday", "publish_is_weekend", "tag_count",
    "log_owner_median_velocity", "log_rel_velocity",
)
INSTANT_COLUMNS = (
    "age_h", "log_views", "log_views_per_h", "log_like_rate", "log_comment_rate",
    "log_views_per_sub", "log_subscribers", "log_duration_sec", "publish_hour_utc",
    "title_len",
)
ENGAGEMENT_COLUMNS = ("log_like_rate", "log_comment_rate")
TRAJECTORY_COLUMNS = ("log_value_at_landmark", "speed_share_at_landmark")
