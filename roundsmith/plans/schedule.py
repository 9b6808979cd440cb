"""The scheduling pipeline: profile, clean, assign, seed, search, diagnose."""

from __future__ import annotations

import zlib
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundsmith.config import DAYS, DEFAULT, SchedulingConfig
from roundsmith.functions import recurrence
from roundsmith.kernels import cluster, search
from roundsmith.operators import assign, export, profile, slots
from roundsmith.sources import tables

SLOTTED = "tech string, fl_id long, latitude double, longitude double, monthly_hrs double, anchor_tier int, week int, day string, is_outlier boolean, moves_rebalance int, moves_filter int, log array<struct<iter:int,moves:int>>"

FLAGGED = "tech string, fl_id long, week int, day string, is_outlier boolean, in_disconnected_zone boolean"


def place_technician(pdf: pd.DataFrame, variant: str = "filter", config: SchedulingConfig = DEFAULT) -> pd.DataFrame:
    """A slot for every site of one technician; besides the sites it holds a few numbers for each of them."""
    pdf = pdf.sort_values("fl_id", ignore_index=True)
    points, hours = pdf[["latitude", "longitude"]].to_numpy(float), pdf["monthly_hrs"].to_numpy(float)
    rng = np.random.default_rng([config.seed, zlib.crc32(pdf["tech"].iloc[0].encode())])
    days, weeks, outlier = cluster.seed_slots(points, hours, pdf["anchor_tier"].to_numpy(), rng, config.mad_multiplier, config.least_weight)
    code, log, first, second = search.slot_code(weeks, [DAYS[d] for d in days]), [], 0, 0
    balance = lambda c: search.rebalance(points, hours, c, config.capacity_hours, config.rebalance_moves, config.tabu, config.least_weight, config.allow_empty_slots)
    if variant == "filter":
        code, first = balance(code)
        code, second = search.majority_filter(points, hours, code, config.neighbours, config.least_votes, config.filter_passes, config.capacity_hours)
    elif variant == "joint":
        code, log = search.joint_search(points, hours, code, config.neighbours, config.joint_passes, config.tabu, config.capacity_hours)
        code, first = balance(code)
    week, day = search.slot_parts(code)
    steps = [{"iter": i, "moves": m} for i, m in log]
    return pdf.assign(week=week.astype("int32"), day=day, is_outlier=outlier, moves_rebalance=first, moves_filter=second, log=[steps] + [[]] * (len(pdf) - 1))


def place(tech_sites: DataFrame, variant: str = "filter", config: SchedulingConfig = DEFAULT) -> DataFrame:
    """A slot for every (tech, site).  ``variant``: "seed", "filter" (rebalance, majority filter) or "joint" (joint search, rebalance).

    The search is sequential within a technician, so a technician is a group; its table holds a few numbers per site.
    """
    columns = tech_sites.select("tech", "fl_id", "latitude", "longitude", "monthly_hrs", "anchor_tier")
    return columns.groupBy("tech").applyInPandas(lambda pdf: place_technician(pdf, variant, config), SLOTTED)


def flag_technician(pdf: pd.DataFrame, variant: str = "filter", config: SchedulingConfig = DEFAULT) -> pd.DataFrame:
    """The placed sites of one technician; those of a slot of more than one component are flagged."""
    placed = place_technician(pdf, variant, config)
    apart = np.zeros(len(placed), bool)
    for at in placed.groupby(["week", "day"]).indices.values():
        apart[at] = slots.count_components(placed.iloc[at], config.gap_km) > 1
    return placed[["tech", "fl_id", "week", "day", "is_outlier"]].assign(in_disconnected_zone=apart)


def place_flagged(tech_sites: DataFrame, variant: str = "filter", config: SchedulingConfig = DEFAULT) -> DataFrame:
    """``place`` and ``flag_disconnected`` in one pass: all zones of a technician are in its group."""
    columns = tech_sites.select("tech", "fl_id", "latitude", "longitude", "monthly_hrs", "anchor_tier")
    return columns.groupBy("tech").applyInPandas(lambda pdf: flag_technician(pdf, variant, config), FLAGGED)


def convergence(placed: DataFrame) -> DataFrame:
    """The joint search's log: tech, iter, moves, fls.  ``placed`` is read once, so the search that it stands for runs once."""
    steps = F.flatten(F.collect_list(F.when(F.size("log") > 0, F.col("log"))))
    logs = placed.groupBy("tech").agg(F.count("*").alias("fls"), steps.alias("log"))
    return logs.select("tech", F.explode("log").alias("l"), "fls").select("tech", "l.iter", "l.moves", "fls")


class Schedule:
    """Every table of a run over a domain; a table's plan is built when first asked for, from the ones before it.

    Tables that many others start from are written once to the shared folder, as they are when first asked for.
    """

    def __init__(self, domain, config: SchedulingConfig = DEFAULT, compact: bool = False):
        self.domain, self.config, self.compact = domain, config, compact
        self._stored: dict[str, DataFrame] = {}

    @cached_property
    def derived(self) -> DataFrame:
        sites = self.domain.table("compact").withColumn("address", F.lit(None).cast("string")) if self.compact else self.domain.locations
        place_of = sites.select("fl_id", "fl_name", "city", "address", "latitude", "longitude")
        return tables.stored(recurrence.derive(export.latest(self.domain.setups), self.domain.setups, self.config).join(place_of, "fl_id", "left"), "derived")

    @cached_property
    def rules(self):
        return profile.exclusion_rules(self.config)

    @cached_property
    def marked(self) -> DataFrame:
        return profile.waterfall(self.derived, self.rules)

    @cached_property
    def work(self) -> DataFrame:
        return profile.working_set(self.marked, self.config)

    @cached_property
    def site(self) -> DataFrame:
        return profile.sites(self.work)

    @cached_property
    def area(self) -> DataFrame:
        return profile.areas(self.site, self.config)

    @cached_property
    def clean(self) -> DataFrame:
        return assign.cleaned(self.work, self.site, self.config)

    @cached_property
    def centroids(self) -> DataFrame:
        return assign.tech_centroids(self.clean, self.config)

    @cached_property
    def assigned(self) -> DataFrame:
        return tables.stored(assign.nearest_tech(self.clean, self.centroids), "assigned")

    @cached_property
    def tech_sites(self) -> DataFrame:
        return tables.stored(assign.tech_sites(self.assigned, self.site), "tech-sites")

    def stub(self) -> DataFrame:
        """A fixed assignment by arithmetic, for checking everything that follows an assignment."""
        day = F.element_at(F.array(*map(F.lit, DAYS)), (F.col("fl_id") % 5 + 1).cast("int"))
        return self.tech_sites.withColumns({"week": (F.col("fl_id") % 4 + 1).cast("int"), "day": day, "is_outlier": F.col("fl_id") % 11 == 0})

    def placed(self, variant: str = "filter") -> DataFrame:
        return place(self.tech_sites, variant, self.config)

    def stored_placed(self, variant: str = "filter") -> DataFrame:
        """``placed`` written once to the shared folder: the search is not run again for each table that follows it."""
        if variant not in self._stored:
            self._stored[variant] = tables.stored(self.placed(variant), f"placed-{variant}")
        return self._stored[variant]

    def diagnosed(self, placed: DataFrame) -> DataFrame:
        return slots.flag_disconnected(placed, slots.zones(placed, self.config))

    def flagged(self, variant: str = "filter") -> DataFrame:
        """``diagnosed`` of a variant: of its stored placement if there is one, or else without storing any."""
        if variant in self._stored:
            return self.diagnosed(self._stored[variant]).select("tech", "fl_id", "week", "day", "is_outlier", "in_disconnected_zone")
        return place_flagged(self.tech_sites, variant, self.config)
