"""Base export, service history and branch-ready export."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roundsmith.config import DEFAULT, SchedulingConfig
from roundsmith.functions import recurrence, workload

DIVISIONS = ("Division AUTOMOBILE", "Division BUILDING", "Division MACHINERY")
COMPLETED = ("Completed", "Posted")


def product_totals(products: DataFrame) -> DataFrame:
    """Per setup, deleted rows left out; NULL counts as 0."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return products.where("is_delete IS NULL").groupBy("booking_setup_id").agg(
        F.count("*").alias("product_count"), F.sum(zero("quantity") * zero("unit_amount")).alias("setup_value"), F.sum(zero("quantity")).alias("setup_quantity")
    )


def latest(setups: DataFrame) -> DataFrame:
    """The newest row of each setup; equal times go to the greater rule text."""
    newest = Window.partitionBy("booking_setup_id").orderBy(F.desc("createdon"), F.desc("rule"))
    return setups.withColumn("rn", F.row_number().over(newest)).where("rn = 1").drop("rn")


def first_branch(branches: DataFrame) -> DataFrame:
    by = Window.partitionBy("territory", "division").orderBy("branch_id", "branch_name")
    return branches.withColumn("rn", F.row_number().over(by)).where("rn = 1").drop("rn")


def base_export(domain, config: SchedulingConfig = DEFAULT, divisions: tuple[str, ...] = DIVISIONS) -> DataFrame:
    """One row per active setup of an active agreement in a listed division, with every derived column."""
    setups, agreements = latest(domain.setups), domain.table("agreement").withColumnRenamed("status", "agreement_status")
    options, zones = domain.table("option_set"), domain.table("branch_timezone")
    branches = first_branch(domain.table("branch_territory")).select("territory", "division", F.col("branch_name").alias("service_branch"))
    joined = (
        setups.join(domain.locations, "fl_id", "left")
        .join(agreements, "agreement_id", "left")
        .join(options.select(F.col("code").alias("division_code"), F.col("label").alias("division")), "division_code", "left")
        .where((F.col("agreement_status") == 1) & (F.col("status") == 1) & F.col("division").isin(*divisions))
        .join(product_totals(domain.table("product")), "booking_setup_id", "left")
        .join(branches, ["territory", "division"], "left")
        .join(zones, "branch_id", "left")
        .join(domain.table("invoice_option"), "invoice_code", "left")
        .join(domain.table("branch"), "branch_id", "left")
    )
    derived = recurrence.derive(joined, domain.setups, config)
    blank = lambda c: F.coalesce(c, F.lit(""))
    local = F.timestamp_add("MINUTE", F.coalesce("utc_offset_minutes", F.lit(0)), F.col("createdon"))
    return derived.select(
        "booking_setup_id", "fl_id", "fl_name", blank("city").alias("city"), "address", "latitude", "longitude", blank("division").alias("division"), blank("service_branch").alias("service_branch"),
        "branch_id", "service_branch_id", blank("setup_branch").alias("setup_branch"), "territory", blank("invoice_frequency").alias("invoice_frequency"), "billing_account", blank("preferred_resource").alias("preferred_resource"), blank("products").alias("products"),
        F.to_date(F.col("createdon") + F.expr("INTERVAL 10 HOURS")).alias("last_modifiedon"), F.date_format(local, "HH:mm:ss").alias("preferred_start_time"),
        F.when(F.col("auto_generate") == 0, "No").otherwise("Yes").alias("auto_generate_booking"), "service_duration", "new_duration",
        F.round("setup_value", 2).alias("setup_value"), "setup_quantity", "services_per_year", F.round(F.col("setup_value") * F.col("services_per_year"), 2).alias("annual_value"),
        "rule", "recurrence_frequency", "num_recurrences", "frequency_type", "dow_number", "dow_name", "week_number", "start_date", "is_valid_start_date", "drop_month", "drop_week",
    )


def serviced(orders: DataFrame, setups: DataFrame, since: str, until: str) -> DataFrame:
    """Completed work orders of known setups in [since, until), with the pattern served."""
    when = F.col("completed_on")
    done = orders.where(F.col("status").isin(*COMPLETED) & (when >= F.lit(since).cast("timestamp_ntz")) & (when < F.lit(until).cast("timestamp_ntz")))
    pattern = F.concat(recurrence.week_of_month(when).cast("string"), F.lit("-"), F.date_format(when, "EEEE"))
    return done.join(setups.select("booking_setup_id", "fl_id"), "booking_setup_id").withColumn("pattern", pattern)


def best_pattern(done: DataFrame) -> DataFrame:
    """The pattern a site was served in most often; ties to the first pattern."""
    counts = done.groupBy("fl_id", "pattern").agg(F.countDistinct("booking_setup_id").alias("setups"), F.count("pattern").alias("n"))
    by = Window.partitionBy("fl_id").orderBy(F.desc("n"), "pattern")
    return counts.withColumn("rating", F.dense_rank().over(by))


def tech_history(done: DataFrame) -> DataFrame:
    """Per setup: the technician with most work orders, and all of them in one text."""
    counts = done.where("tech_name IS NOT NULL").groupBy("booking_setup_id", "tech_name").agg(F.countDistinct("wo_id").alias("n"))
    by = Window.partitionBy("booking_setup_id").orderBy(F.desc("n"), "tech_name")
    ranked = counts.withColumn("rank", F.rank().over(by))
    line = F.struct((-F.col("n")).alias("k"), F.col("tech_name"), F.concat(F.col("n").cast("string"), F.lit(" service from "), "tech_name").alias("t"))
    return ranked.groupBy("booking_setup_id").agg(
        F.min_by("tech_name", "rank").alias("most_serviced_tech"), F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["t"]), "  |  ").alias("full_history")
    )


def branch_export(domain, since: str = "1999-01-01", until: str = "2000-01-01", config: SchedulingConfig = DEFAULT) -> DataFrame:
    base = base_export(domain, config)
    done = serviced(domain.table("work_order"), base, since, until)
    pattern = best_pattern(done).where("rating = 1").select("fl_id", F.col("pattern").alias("serviced_pattern"), F.col("n").alias("pattern_count"))
    joined = base.join(pattern, "fl_id", "left").join(tech_history(done), "booking_setup_id", "left")
    return joined.withColumns({
        "current_pattern": workload.current_pattern(F.col("frequency_type"), F.col("recurrence_frequency"), F.col("drop_week"), F.col("dow_name")),
        "new_date_pattern": F.lit(""), "on_agb": F.lit(""), "current_duration": F.col("service_duration"),
    })
