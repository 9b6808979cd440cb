"""Every constant of the scheduling rules in one place."""

from __future__ import annotations

from dataclasses import dataclass

#: Fixed values of the domain.
DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday")
DAY_NAMES = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")
BLANKS = ("", "nan", "None", "NULL", "(unassigned)")
WEEKS = (1, 2, 3, 4)


@dataclass(frozen=True)
class SchedulingConfig:
    capacity_hours: float = 8.0
    default_minutes: float = 15.0
    longest_minutes: float = 480.0
    working_days: int = 20
    admin_tokens: tuple[str, ...] = ("Admin",)
    lat_range: tuple[float, float] = (-39.5, -33.9)
    lon_range: tuple[float, float] = (140.5, 150.5)
    seed: int = 42
    mad_multiplier: float = 2.0
    neighbours: int = 7
    least_votes: int = 3
    filter_passes: int = 10
    gap_km: float = 15.0
    rebalance_moves: int = 500
    tabu: int = 15
    joint_passes: int = 500
    cycle_anchor: str = "2025-05-19"
    least_weight: float = 0.001
    #: Departures from the reference behaviour, all off by default.
    multi_day_multiplier: bool = False
    cap_overlong_in_clustering: bool = False
    allow_empty_slots: bool = False


DEFAULT = SchedulingConfig()
