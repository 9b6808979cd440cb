"""From the working set to the (technician, site) table."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundsmith.config import DEFAULT, SchedulingConfig
from roundsmith.functions import geo
from roundsmith.functions.workload import frequency_tier, normalised, workload
from roundsmith.kernels.near import nearest_sites
from roundsmith.operators.profile import first_by


def in_box(config: SchedulingConfig = DEFAULT):
    return F.col("latitude").between(*config.lat_range) & F.col("longitude").between(*config.lon_range)


def rejected_sites(site: DataFrame, config: SchedulingConfig = DEFAULT) -> DataFrame:
    """Sites without coordinates or outside the box, with the reason."""
    missing = F.col("latitude").isNull() | F.col("longitude").isNull()
    return site.withColumn("reason", F.when(missing, "no coordinates").when(~in_box(config), "outside box")).where("reason IS NOT NULL")


def cleaned(work: DataFrame, site: DataFrame, config: SchedulingConfig = DEFAULT) -> DataFrame:
    """Setups of accepted sites with re-derived workload and technician texts."""
    kept = work.join(rejected_sites(site, config).select("fl_id"), "fl_id", "left_anti")
    again = workload(kept, config, cap_overlong=config.cap_overlong_in_clustering)
    return again.withColumns({
        "tech_raw": F.trim(F.coalesce("preferred_resource", F.lit(""))), "is_unassigned": normalised(F.coalesce("preferred_resource", F.lit(""))).isNull(),
        "is_mwp": F.coalesce(F.col("frequency_type") == "Monthly - Week Pattern", F.lit(False)), "is_weekly": F.coalesce(F.col("frequency_type").contains("Weekly"), F.lit(False)),
    })


def tech_centroids(setups: DataFrame, config: SchedulingConfig = DEFAULT) -> DataFrame:
    """Weighted centre of each technician's own setups."""
    own = setups.where(~F.col("is_unassigned") & F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    weight = F.greatest(F.coalesce("monthly_contrib_hrs", F.lit(0.0)), F.lit(config.least_weight))
    return own.groupBy(F.col("tech_raw").alias("tech")).agg(
        geo.weighted_mean("latitude", weight).alias("c_lat"), geo.weighted_mean("longitude", weight).alias("c_lon"),
        F.coalesce(F.sum("monthly_contrib_hrs"), F.lit(0.0)).alias("monthly_hrs"), F.countDistinct("fl_id").alias("fls"),
    )


def rosters(points: DataFrame, centroids: DataFrame, nth: int = 1, cell_degrees: float = 0.5, most: int = 5_000) -> DataFrame:
    """``points`` with ``roster``, an array by name of (tech, c_lat, c_lon) that holds the ``nth`` nearest technicians.

    A roster of at most ``most`` technicians travels in one row beside the points.  A larger one is thinned, per cell
    of ``cell_degrees``, to the technicians who can be that near to some point of the cell.
    """
    listed = F.sort_array(F.collect_list(F.struct("tech", "c_lat", "c_lon"))).alias("roster")
    if centroids.limit(most + 1).count() <= most:
        return points.join(F.broadcast(centroids.agg(listed)))
    cell = lambda c: F.floor(F.col(c) / cell_degrees)
    placed = points.withColumns({"cell_lat": cell("latitude"), "cell_lon": cell("longitude")})
    by = ["cell_lat", "cell_lon"]
    cells = placed.select(*by).where("cell_lat IS NOT NULL AND cell_lon IS NOT NULL").distinct()
    middle = [(F.col(c) + 0.5) * cell_degrees for c in by]
    # The globe has at most 360 * 180 / cell_degrees ** 2 cells, so they are the side to broadcast.
    away = centroids.select("tech", "c_lat", "c_lon").join(F.broadcast(cells)).withColumn("km", geo.haversine(*middle, F.col("c_lat"), F.col("c_lon")))
    least = cells.withColumn("least", F.lit(-1.0))
    for _ in range(nth):
        least = away.join(least, by).where(F.col("km") > F.col("least")).groupBy(*by).agg(F.min("km").alias("least"))
    # No point of a cell is farther from its middle than half its diagonal at the equator.
    reach = 1.0001 * cell_degrees * (2**0.5) / 2 * geo.EARTH_KM * math.pi / 180
    kept = away.join(least, by).where(F.col("km") <= F.col("least") + 2 * reach)
    return placed.join(kept.groupBy(*by).agg(listed), by, "left").drop(*by)


def nearest_tech(setups: DataFrame, centroids: DataFrame, **thinning) -> DataFrame:
    """Adds ``tech``: the own one, or for unassigned setups that of the nearest centre (ties to the first name)."""
    km = lambda c: geo.haversine(F.col("latitude"), F.col("longitude"), c["c_lat"], c["c_lon"])
    near = F.array_min(F.transform("roster", lambda c: F.struct(km(c).alias("d"), c["tech"].alias("tech"))))["tech"]
    found = rosters(setups, centroids, **thinning)
    return found.withColumn("tech", F.when(F.col("is_unassigned"), near).otherwise(F.col("tech_raw"))).drop("roster")


def multi_tech(setups: DataFrame) -> DataFrame:
    """Setups and hours per technician of sites that more than one serves."""
    shared = setups.groupBy("fl_id").agg(F.countDistinct("tech").alias("techs")).where("techs > 1")
    return setups.join(shared, "fl_id").groupBy("fl_id", "tech").agg(F.count("*").alias("setups"), F.coalesce(F.sum("monthly_contrib_hrs"), F.lit(0.0)).alias("monthly_hrs"))


def tech_sites(setups: DataFrame, site: DataFrame) -> DataFrame:
    """One row per (tech, fl_id) with hours, place, names, anchor frequency and tier."""
    out = setups.groupBy("tech", "fl_id").agg(
        F.coalesce(F.sum("monthly_contrib_hrs"), F.lit(0.0)).alias("monthly_hrs"), F.count("booking_setup_id").alias("setups"),
        first_by("latitude", "booking_setup_id").alias("latitude"), first_by("longitude", "booking_setup_id").alias("longitude"), F.coalesce(F.max("services_per_year"), F.lit(1.0)).alias("anchor_freq"),
    )
    return out.withColumn("anchor_tier", frequency_tier(F.col("anchor_freq"))).join(site.select("fl_id", "fl_name", "city"), "fl_id", "left")


def neighbours(placed: DataFrame, k: int, asking: int = 4096) -> DataFrame:
    """The k nearest other sites of the same technician: tech, fl_id, other, km, nn_rank.

    A technician's asking sites are dealt into parts of about ``asking``; each part sees all the sites.  Sites without a place have no neighbours.
    """
    sites = placed.select("tech", "fl_id", "latitude", "longitude").where("latitude IS NOT NULL AND longitude IS NOT NULL")
    sizes = sites.groupBy("tech").agg(F.ceil(F.count("*") / asking).cast("int").alias("parts"))
    dealt = sites.join(sizes, "tech").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumn("asked", F.pmod(F.xxhash64("fl_id"), F.col("parts")) == F.col("part")).drop("parts")

    def one(group: pd.DataFrame) -> pd.DataFrame:
        ids = group["fl_id"].to_numpy()
        a, b, km = nearest_sites(group["latitude"].to_numpy(float), group["longitude"].to_numpy(float), ids, group["asked"].to_numpy(bool), k)
        first = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, int)
        rank = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a)))) + 1
        return pd.DataFrame({"tech": group["tech"].iloc[0], "fl_id": ids[a], "other": ids[b], "km": km, "nn_rank": rank.astype("int32")})

    return dealt.groupBy("tech", "part").applyInPandas(one, "tech string, fl_id long, other long, km double, nn_rank int")


def mad_outliers(distances: DataFrame, multiplier: float) -> DataFrame:
    """distances(tech, fl_id, km) → is_outlier by median + multiplier * MAD per technician; no spread, no outlier."""
    med = distances.groupBy("tech").agg(F.percentile("km", 0.5).alias("med"))
    dev = distances.join(med, "tech").withColumn("dev", F.abs(F.col("km") - F.col("med")))
    mad = dev.groupBy("tech").agg(F.percentile("dev", 0.5).alias("mad"))
    return dev.join(mad, "tech").withColumn("is_outlier", (F.col("mad") > 0) & (F.col("km") > F.col("med") + multiplier * F.col("mad"))).drop("dev")
