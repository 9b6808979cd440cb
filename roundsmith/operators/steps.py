"""One step of each iterative search as a plan: what a kernel's first step does, over all technicians at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roundsmith.config import DEFAULT, SchedulingConfig
from roundsmith.functions import geo
from roundsmith.operators import slots


def _weight(config: SchedulingConfig):
    return F.greatest("monthly_hrs", F.lit(config.least_weight))


def _centres(placed: DataFrame, by: list[str], config: SchedulingConfig) -> DataFrame:
    return placed.groupBy(*by).agg(geo.weighted_mean("latitude", _weight(config)).alias("c_lat"), geo.weighted_mean("longitude", _weight(config)).alias("c_lon"))


def lloyd_step(placed: DataFrame, zone: str, config: SchedulingConfig = DEFAULT) -> DataFrame:
    """Sites go to the nearest zone centre of their technician (planar, ties to the first zone); the zones' new weighted centres."""
    centres = _centres(placed, ["tech", zone], config).withColumnRenamed(zone, "to")
    d = geo.planar(F.col("latitude"), F.col("longitude"), F.col("c_lat"), F.col("c_lon"))
    near = placed.join(centres, "tech").groupBy("tech", "fl_id").agg(F.min(F.struct(F.round(d, 9).alias("d"), F.col("to")))["to"].alias("zone"))
    moved = placed.select("tech", "fl_id", "latitude", "longitude", "monthly_hrs").join(near, ["tech", "fl_id"])
    return _centres(moved, ["tech", "zone"], config)


def median_step(placed: DataFrame, config: SchedulingConfig = DEFAULT) -> DataFrame:
    """One Weiszfeld step of each technician's weighted geometric median, from the weighted mean."""
    start = _centres(placed, ["tech"], config)
    d = F.greatest(geo.planar(F.col("latitude"), F.col("longitude"), F.col("c_lat"), F.col("c_lon")), F.lit(1e-9))
    pulled = placed.join(start, "tech").withColumn("pull", _weight(config) / d)
    return pulled.groupBy("tech").agg(geo.weighted_mean("latitude", F.col("pull")).alias("m_lat"), geo.weighted_mean("longitude", F.col("pull")).alias("m_lon"))


def first_move(placed: DataFrame, config: SchedulingConfig = DEFAULT) -> DataFrame:
    """The rebalance's first move: out of the heaviest slot over capacity, to the slot whose centre gains most distance."""
    load = slots.search_load(placed)
    heavy = load.where(F.col("load_hrs") > config.capacity_hours).groupBy("tech")
    source = heavy.agg(F.min_by(F.struct("week", "day", "load_hrs"), F.struct(-F.round("load_hrs", 9), F.col("week"), F.col("day"))).alias("src"))
    centres = _centres(placed, ["tech", "week", "day"], config).join(load, ["tech", "week", "day"])
    own = placed.join(source, "tech").where("week = src.week AND day = src.day").join(centres.drop("load_hrs"), ["tech", "week", "day"])
    own = own.select("tech", "fl_id", "latitude", "longitude", "monthly_hrs", "src", F.col("c_lat").alias("s_lat"), F.col("c_lon").alias("s_lon"))
    km = lambda a, b: geo.haversine(F.col("latitude"), F.col("longitude"), F.col(a), F.col(b))
    moves = own.join(centres, "tech").where("NOT (week = src.week AND day = src.day)").where(F.col("load_hrs") + F.col("monthly_hrs") < F.col("src.load_hrs"))
    best = F.min(F.struct((-F.round(km("s_lat", "s_lon") - km("c_lat", "c_lon"), 6)).alias("loss"), "fl_id", "week", "day", "src"))
    return moves.groupBy("tech").agg(best.alias("b")).select("tech", "b.fl_id", F.col("b.src.week").alias("from_week"), F.col("b.src.day").alias("from_day"), F.col("b.week").alias("to_week"), F.col("b.day").alias("to_day"))


def vote_candidates(placed: DataFrame, config: SchedulingConfig = DEFAULT) -> DataFrame:
    """Sites that the majority filter (``filter``) or the joint search (``joint``) would move in its first pass, by the loads at its start."""
    load = slots.search_load(placed)
    other = load.select("tech", F.col("week").alias("top_week"), F.col("day").alias("top_day"), F.col("load_hrs").alias("dst"))
    vote = slots.votes(placed, config.neighbours).where("top_week <> week OR top_day <> day")
    full = vote.join(placed.select("tech", "fl_id", "monthly_hrs"), ["tech", "fl_id"]).join(load, ["tech", "week", "day"]).join(other, ["tech", "top_week", "top_day"])
    may = slots.gate(F.round("load_hrs", 9), F.round("dst", 9), F.col("monthly_hrs"), config.capacity_hours)
    out = full.withColumns({"filter": may & (F.col("top_votes") >= config.least_votes), "joint": may & (F.col("top_votes") > F.col("own_votes"))})
    return out.where("filter OR joint").select("tech", "fl_id", F.col("top_week").alias("to_week"), F.col("top_day").alias("to_day"), "filter", "joint")
