"""Workload of a setup: services, durations, contributions, tiers, bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roundsmith.config import BLANKS, DAY_NAMES, DEFAULT, SchedulingConfig


def normalised(text: Column) -> Column:
    """Blank texts in all their spellings are NULL."""
    return F.when(~F.trim(text).isin(*BLANKS), F.trim(text))


def services_per_year(kind: Column, n: Column) -> Column:
    """From type and interval only: no multiple for several days a week."""
    has = lambda word: F.coalesce(kind.contains(word), F.lit(False))
    return F.when(has("Monthly"), F.try_divide(F.lit(12.0), n)).when(has("Weekly"), F.try_divide(F.lit(52.0), n))


def effective_duration(new: Column, current: Column, default: float) -> Column:
    minutes = F.coalesce(new.try_cast("double"), current.try_cast("double"))
    return F.when(minutes == 0, default).otherwise(minutes)


def workload(setups: DataFrame, config: SchedulingConfig = DEFAULT, cap_overlong: bool = True) -> DataFrame:
    """services_per_year/month, effective_duration, duration_flagged, capacity_duration and monthly contributions."""
    c = F.col
    n_days = F.when(c("frequency_type").contains("Multi Day"), F.size(F.split("dow_number", ","))).otherwise(1)
    spy = services_per_year(c("frequency_type"), c("num_recurrences").cast("double"))
    spy = spy * n_days if config.multi_day_multiplier else spy
    out = setups.withColumns({"services_per_year": spy, "effective_duration": effective_duration(c("new_duration"), c("service_duration"), config.default_minutes)})
    out = out.withColumns({
        "services_per_month": c("services_per_year") / 12, "duration_flagged": F.coalesce(c("effective_duration") > config.longest_minutes, F.lit(False)),
        "capacity_duration": F.when(c("effective_duration") <= config.longest_minutes, c("effective_duration")),
    })
    minutes = c("capacity_duration" if cap_overlong else "effective_duration") * c("services_per_month")
    return out.withColumn("monthly_contrib_mins", minutes).withColumn("monthly_contrib_hrs", c("monthly_contrib_mins") / 60)


def dow_label(code: Column) -> Column:
    """One day code to its name, anything else to Unknown."""
    names = F.create_map(*(F.lit(x) for i, name in enumerate(DAY_NAMES) for x in (str(i), name)))
    return F.coalesce(F.try_element_at(names, code), F.lit("Unknown"))


def frequency_tier(spy: Column) -> Column:
    """5 (most frequent) to 1."""
    return F.when(spy >= 26, 5).when(spy >= 12, 4).when(spy >= 4, 3).when(spy >= 1.5, 2).otherwise(1)


def run_days(hours: Column, capacity: float) -> Column:
    """Days of work, rounded up to halves."""
    return F.ceil(hours / capacity * 2) / 2


def new_pattern(kind: Column, week: Column, day: Column) -> Column:
    weekly = kind.contains("Weekly")
    return F.when(weekly, F.concat(F.lit("Every "), day)).when(kind == "Monthly - Week Pattern", F.concat(week.cast("string"), F.lit("-"), day)).otherwise("")


def current_pattern(kind: Column, label: Column, drop_week: Column, dow_name: Column) -> Column:
    every = (kind == "Weekly - Multi Day") | (label == "1 Weekly")
    part = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    return F.when(every, F.concat(F.lit("Every "), part(dow_name))).otherwise(F.concat(part(drop_week), F.lit("-"), part(dow_name)))


def heat_band(load: Column) -> Column:
    return F.when(load > 12, "over 12").when(load > 10, "over 10").when(load > 8, "over 8").when(load > 6, "over 6").otherwise("light")


def marker(disconnected: Column, outlier: Column) -> Column:
    return F.when(disconnected, "disconnected").when(outlier, "outlier").otherwise("plain")
