"""Slots: loads, capacity, topology, votes, indicators and report tables of an assignment (tech, fl_id, week, day)."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundsmith.config import DAYS, DEFAULT, WEEKS, SchedulingConfig
from roundsmith.functions import geo
from roundsmith.functions.workload import new_pattern
from roundsmith.operators.assign import neighbours


def search_load(placed: DataFrame) -> DataFrame:
    """Monthly hours of each used slot, weekly work counted where it is placed."""
    return placed.groupBy("tech", "week", "day").agg(F.sum("monthly_hrs").alias("load_hrs"))


def skeleton(techs: DataFrame) -> DataFrame:
    """Every technician's 20 slots."""
    slots = F.explode(F.array(*(F.struct(F.lit(w).alias("week"), F.lit(d).alias("day")) for w in WEEKS for d in DAYS)))
    return techs.select("tech").distinct().withColumn("s", slots).select("tech", "s.week", "s.day")


def apply_slots(setups: DataFrame, placed: DataFrame) -> DataFrame:
    """Setups with their site's slot and new pattern."""
    out = setups.join(placed.select("tech", "fl_id", "week", "day"), ["tech", "fl_id"], "left")
    return out.withColumn("new_date_pattern", new_pattern(F.col("frequency_type"), F.col("week"), F.col("day")))


def capacity(applied: DataFrame, config: SchedulingConfig = DEFAULT) -> DataFrame:
    """Week-pattern minutes count in their slot, weekly minutes in every week at a quarter."""
    minutes = F.coalesce("monthly_contrib_mins", F.lit(0.0))
    exact = applied.where("is_mwp").groupBy("tech", "week", "day").agg(F.sum(minutes).alias("mwp"))
    daily = applied.where("is_weekly").groupBy("tech", "day").agg(F.sum(minutes).alias("weekly"))
    out = skeleton(applied).join(exact, ["tech", "week", "day"], "left").join(daily, ["tech", "day"], "left")
    load = (F.coalesce("mwp", F.lit(0.0)) + F.coalesce("weekly", F.lit(0.0)) / 4) / 60
    out = out.withColumn("load", load)
    return out.select("tech", "week", "day", F.bround("load", 2).alias("load_hrs"), F.lit(config.capacity_hours).alias("capacity_hrs"), (F.col("load") > config.capacity_hours).alias("over_capacity"))


def count_components(group: pd.DataFrame, gap_km: float) -> int:
    """Components of the graph of points at most ``gap_km`` apart, one row of distances at a time."""
    lat, lon = np.radians(group["latitude"].to_numpy()), np.radians(group["longitude"].to_numpy())
    unseen, count = np.ones(len(lat), bool), 0
    while unseen.any():
        count += 1
        front = [int(unseen.argmax())]
        unseen[front[0]] = False
        while front:
            i = front.pop()
            chord = np.sin((lat - lat[i]) / 2) ** 2 + np.cos(lat[i]) * np.cos(lat) * np.sin((lon - lon[i]) / 2) ** 2
            near = np.flatnonzero(unseen & (2 * geo.EARTH_KM * np.arcsin(np.sqrt(np.minimum(chord, 1))) <= gap_km))
            unseen[near] = False
            front.extend(near.tolist())
    return count


def gap_edges(placed: DataFrame, gap_km: float) -> DataFrame:
    """Pairs of a slot's sites at most ``gap_km`` apart, each once: only sites of the same or adjacent bands of latitude meet."""
    band = F.floor(F.col("latitude") / (1.0001 * gap_km / geo.EARTH_KM * 180 / np.pi))
    a = placed.select("tech", "week", "day", "fl_id", "latitude", "longitude", F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    b = placed.select("tech", "week", "day", F.col("fl_id").alias("other"), F.col("latitude").alias("lat2"), F.col("longitude").alias("lon2"), band.alias("band"))
    near = (F.col("fl_id") < F.col("other")) & (geo.haversine(F.col("latitude"), F.col("longitude"), F.col("lat2"), F.col("lon2")) <= gap_km)
    return a.join(b, ["tech", "week", "day", "band"]).where(near).select("tech", "fl_id", "other")


def zones(placed: DataFrame, config: SchedulingConfig = DEFAULT) -> DataFrame:
    """Per used slot: sites, components and hours."""
    gap = config.gap_km

    def one(group: pd.DataFrame) -> pd.DataFrame:
        head = group.iloc[0]
        return pd.DataFrame({"tech": [head.tech], "week": [head.week], "day": [head.day], "fls": [len(group)], "components": [count_components(group, gap)], "monthly_hrs": [group.monthly_hrs.sum()]})

    columns = placed.select("tech", F.col("week").cast("int").alias("week"), "day", "fl_id", "latitude", "longitude", "monthly_hrs")
    return columns.groupBy("tech", "week", "day").applyInPandas(one, "tech string, week int, day string, fls long, components long, monthly_hrs double")


def flag_disconnected(placed: DataFrame, zone: DataFrame) -> DataFrame:
    """Every site of a zone of more than one component is flagged."""
    bad = zone.where("components > 1").select("tech", "week", "day", F.lit(True).alias("bad"))
    return placed.join(bad, ["tech", "week", "day"], "left").withColumn("in_disconnected_zone", F.coalesce("bad", F.lit(False))).drop("bad")


def votes(placed: DataFrame, k: int) -> DataFrame:
    """The slot most of a site's k neighbours have (ties: the one seen first), its count, and the own slot's count.

    Technicians with k sites or fewer take no part.
    """
    many = placed.groupBy("tech").agg(F.count("*").alias("n")).where(F.col("n") > k).select("tech")
    near = neighbours(placed.join(many, "tech"), k)
    other = placed.select("tech", F.col("fl_id").alias("other"), F.col("week").alias("o_week"), F.col("day").alias("o_day"))
    counted = near.join(other, ["tech", "other"]).groupBy("tech", "fl_id", "o_week", "o_day").agg(F.count("*").alias("n"), F.min("nn_rank").alias("first"))
    own = counted.join(placed.select("tech", "fl_id", "week", "day"), ["tech", "fl_id"])
    same = (F.col("week") == F.col("o_week")) & (F.col("day") == F.col("o_day"))
    best = F.max_by(F.struct("o_week", "o_day", "n"), F.struct("n", -F.col("first")))
    out = own.groupBy("tech", "fl_id").agg(best.alias("b"), F.first("week").alias("week"), F.first("day").alias("day"), F.coalesce(F.max(F.when(same, F.col("n"))), F.lit(0)).alias("own_votes"))
    return out.select("tech", "fl_id", "week", "day", F.col("b.o_week").alias("top_week"), F.col("b.o_day").alias("top_day"), F.col("b.n").alias("top_votes"), "own_votes")


def enclaves(vote: DataFrame, least: int) -> DataFrame:
    """Strict and loose enclave counts and rates."""
    moved = (F.col("top_week") != F.col("week")) | (F.col("top_day") != F.col("day"))
    rate = lambda c: F.coalesce(F.avg(c.cast("double")) * 100, F.lit(0.0))
    strict, loose = moved & (F.col("top_votes") >= least), moved & (F.col("top_votes") > F.col("own_votes"))
    return vote.agg(F.count("*").alias("total"), F.count_if(strict).alias("strict"), F.count_if(loose).alias("loose"), rate(strict).alias("strict_pct"), rate(loose).alias("loose_pct"))


def gate(src, dst, hours, cap: float):
    """May the move go ahead: not over capacity, or at least lighter than where it came from."""
    return ~((dst + hours > cap) & (dst + hours >= src))


def tech_summary(placed: DataFrame) -> DataFrame:
    return placed.groupBy("tech").agg(
        F.count("*").alias("fls"), F.sum("monthly_hrs").alias("monthly_hrs"), F.countDistinct("day").alias("days_used"), F.countDistinct("week").alias("weeks_used"), F.count_if("is_outlier").alias("outliers")
    )


def centroid_km(placed: DataFrame, config: SchedulingConfig = DEFAULT) -> DataFrame:
    """Distance of every site to its technician's weighted centre."""
    weight = F.greatest("monthly_hrs", F.lit(config.least_weight))
    centre = placed.groupBy("tech").agg(geo.weighted_mean("latitude", weight).alias("c_lat"), geo.weighted_mean("longitude", weight).alias("c_lon"))
    return placed.join(centre, "tech").withColumn("km", geo.haversine(F.col("latitude"), F.col("longitude"), F.col("c_lat"), F.col("c_lon")))


def slot_matrix(slots: DataFrame) -> DataFrame:
    """Technicians by 20 slots, their load."""
    names = [f"{w}-{d[:3]}" for w in WEEKS for d in DAYS]
    return slots.withColumn("slot", F.concat(F.col("week").cast("string"), F.lit("-"), F.substring("day", 1, 3))).groupBy("tech").pivot("slot", names).agg(F.sum("load_hrs"))


def site_records(applied: DataFrame, placed: DataFrame) -> DataFrame:
    """The nested report rows: each (tech, site) with its setups, weeks and frequencies."""
    setup = F.struct("booking_setup_id", F.col("recurrence_frequency").alias("freq"), F.col("effective_duration").alias("duration"), F.col("new_date_pattern").alias("pattern"))
    nested = applied.groupBy("tech", "fl_id").agg(
        F.sort_array(F.collect_list(setup)).alias("setup_list"), F.array_sort(F.collect_set("week")).alias("weeks"), F.array_sort(F.collect_set("recurrence_frequency")).alias("freqs")
    )
    return placed.join(nested, ["tech", "fl_id"], "left")


def matching(records: DataFrame, techs=(), days=(), weeks=(), freqs=(), text: str = "") -> DataFrame:
    """The dashboard's filter: empty choices match all; a site passes by any setup whose frequency is chosen or blank, and blank weeks pass."""
    found = F.lit(True)
    if techs:
        found &= F.col("tech").isin(*techs)
    if days:
        found &= F.col("day").isin(*days)
    if weeks:
        found &= F.col("week").isNull() | F.col("week").isin(*weeks)
    if freqs:
        found &= F.exists("setup_list", lambda x: F.coalesce(x["freq"], F.lit("")).isin("", *freqs))
    if text:
        found &= F.lower("fl_name").contains(text.lower()) | F.lower("city").contains(text.lower())
    return records.where(found)


def crowded(slot_loads: DataFrame, techs=(), config: SchedulingConfig = DEFAULT) -> DataFrame:
    """The dashboard's slot filter: slots of the chosen technicians (none: all) that are over capacity."""
    chosen = F.col("tech").isin(*techs) if techs else F.lit(True)
    return slot_loads.where(chosen & (F.col("over_capacity") | (F.col("load_hrs") > config.capacity_hours)))


def filter_lists(placed: DataFrame, applied: DataFrame) -> DataFrame:
    """The dashboard's choices in their order: technicians by hours (most first), frequencies and cities by name. (list, position, value)."""

    def listed(name: str, values: DataFrame, key, value: str) -> DataFrame:
        # Each list is as short as a choice box: one row of an array.
        held = values.agg(F.sort_array(F.collect_list(F.struct(key.alias("k"), F.col(value).alias("v")))).alias("l"))
        return held.select(F.lit(name).alias("list"), F.posexplode("l").alias("position", "x")).select("list", (F.col("position") + 1).alias("position"), F.col("x.v").alias("value"))

    techs = placed.groupBy("tech").agg(F.sum("monthly_hrs").alias("hrs"))
    freqs = applied.select(F.col("recurrence_frequency").alias("freq")).where("freq IS NOT NULL").distinct()
    cities = placed.select("city").where("city IS NOT NULL").distinct()
    return listed("tech", techs, -F.round("hrs", 6), "tech").union(listed("freq", freqs, F.lit(0), "freq")).union(listed("city", cities, F.lit(0), "city"))


def indicator_parts(placed: DataFrame, applied: DataFrame, config: SchedulingConfig = DEFAULT) -> list[DataFrame]:
    """The indicators of a schedule as tables of one row each: loads, distances, zones, enclaves, what was allocated."""
    cap = capacity(applied, config)
    over = F.col("over_capacity")
    loads = cap.agg(F.count_if(over).alias("over_slots"), (F.avg(over.cast("double")) * 100).alias("over_pct"), F.max("load_hrs").alias("max_load"))
    far = centroid_km(placed, config).agg(F.count("*").alias("fls"), F.avg("km").alias("mean_km"), F.count_if("is_outlier").alias("outliers"))
    apart = zones(placed, config).agg(F.count_if(F.col("components") > 1).alias("disconnected_zones"))
    enclave = enclaves(votes(placed, config.neighbours), config.least_votes).select("strict_pct", "loose_pct")
    given = applied.agg((F.avg((F.length("new_date_pattern") > 0).cast("double")) * 100).alias("allocated_pct"))
    return [loads, far, apart, enclave, given]


def indicators(placed: DataFrame, applied: DataFrame, config: SchedulingConfig = DEFAULT) -> DataFrame:
    """One row of all indicators of a schedule, for diagnostics at the end of a run."""
    return functools.reduce(DataFrame.join, indicator_parts(placed, applied, config))
