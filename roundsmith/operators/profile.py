"""Profiling stage: exclusion waterfall, working set, site, area and tier roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roundsmith.config import DEFAULT, SchedulingConfig
from roundsmith.functions.workload import dow_label, run_days, workload

Rule = tuple[str, Column]


def exclusion_rules(config: SchedulingConfig = DEFAULT) -> list[Rule]:
    """Ordered (label, predicate); a predicate on NULL is false."""
    kind = F.col("frequency_type")
    sure = lambda c: F.coalesce(c, F.lit(False))
    admin = reduce(lambda a, b: a | b, (F.col("preferred_resource").contains(t) for t in config.admin_tokens))
    return [
        ("admin only", sure(admin)),
        ("yearly", sure(kind == "Yearly")),
        ("daily", sure(kind == "Daily")),
        ("fixed date", sure(kind == "Monthly - Fixed Date")),
        ("no type", kind.isNull() | sure(F.trim(kind).isin("", "NULL"))),
        ("weekend pattern", sure((kind == "Monthly - Week Pattern") & F.col("dow_number").isin("0", "6"))),
        ("week zero", sure((kind == "Monthly - Week Pattern") & (F.col("week_number").cast("string") == "0"))),
    ]


def waterfall(setups: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds ``exclusion_reason``: the first rule that matches, NULL for survivors."""
    chain = reduce(lambda acc, rule: acc.when(rule[1], rule[0]), rules[1:], F.when(rules[0][1], rules[0][0]))
    return setups.withColumn("exclusion_reason", chain)


def waterfall_log(marked: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rows charged to each rule, rules without rows included; a handful of rows."""
    named = marked.sparkSession.createDataFrame([(i, label) for i, (label, _) in enumerate(rules)], "step int, rule string")
    counts = marked.groupBy(F.col("exclusion_reason").alias("rule")).agg(F.count("*").alias("n"))
    return named.join(counts, "rule", "left").select("step", "rule", F.coalesce("n", F.lit(0)).alias("excluded"))


def working_set(marked: DataFrame, config: SchedulingConfig = DEFAULT) -> DataFrame:
    kept = marked.where("exclusion_reason IS NULL").drop("exclusion_reason", "services_per_year")
    return workload(kept, config).withColumn("dow_name", dow_label(F.col("dow_number")))


def first_by(value: str, order: str) -> Column:
    """The first non-null value in row order."""
    return F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order)))


def sites(work: DataFrame) -> DataFrame:
    distinct_text = lambda c: F.array_join(F.array_sort(F.collect_set(c)), " | ")
    return work.groupBy("fl_id").agg(
        *(first_by(c, "booking_setup_id").alias(c) for c in ("fl_name", "city", "address", "latitude", "longitude")),
        F.count("booking_setup_id").alias("setup_count"),
        F.coalesce(F.sum("monthly_contrib_hrs"), F.lit(0.0)).alias("monthly_contrib_hrs"),
        F.max("services_per_year").alias("anchor_spy"),
        distinct_text("frequency_type").alias("frequency_types"),
        distinct_text("dow_name").alias("dow_names"),
    )


def areas(site: DataFrame, config: SchedulingConfig = DEFAULT) -> DataFrame:
    """Per city; sites without a city have no area."""
    out = site.where("city IS NOT NULL").groupBy("city").agg(
        F.count("fl_id").alias("fl_count"), F.sum("setup_count").alias("setup_count"), F.sum("monthly_contrib_hrs").alias("total_monthly_hrs"),
        F.avg("latitude").alias("centroid_lat"), F.avg("longitude").alias("centroid_lon"),
    )
    return out.withColumn("required_run_days", run_days(F.col("total_monthly_hrs"), config.capacity_hours))


def tiers(work: DataFrame) -> DataFrame:
    """Per frequency.  Hours are rounded to six places first, so that the order of the sum doesn't decide a half."""
    return work.where("recurrence_frequency IS NOT NULL").groupBy("recurrence_frequency").agg(
        F.count("booking_setup_id").alias("setup_count"), F.countDistinct("fl_id").alias("fl_count"),
        F.bround(F.avg("effective_duration"), 1).alias("avg_duration_mins"), F.bround(F.round(F.coalesce(F.sum("monthly_contrib_hrs"), F.lit(0.0)), 6), 1).alias("monthly_hrs"),
    )


def hours_distribution(site: DataFrame) -> DataFrame:
    h = F.col("monthly_contrib_hrs")
    return site.agg(F.avg(h).alias("mean"), F.median(h).alias("median"), F.percentile(h, 0.9).alias("p90"), F.max(h).alias("max"), F.count_if(F.col("latitude").isNull()).alias("no_coordinates"))


def portfolio(area: DataFrame, config: SchedulingConfig = DEFAULT) -> DataFrame:
    out = area.agg(F.count("*").alias("areas"), F.sum("fl_count").alias("fls"), F.sum("total_monthly_hrs").alias("hours"), F.sum("required_run_days").alias("run_days"))
    return out.withColumn("implied_techs", F.col("run_days") / config.working_days)
