"""One query for each operator of the inventory, with its oracle where SQL can express it.

A query is named after the operators that it shows.  Doubles are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roundsmith.config import DEFAULT
from roundsmith.fixtures import Domain
from roundsmith.functions import geo, recurrence
from roundsmith.functions import workload as wl
from roundsmith.operators import assign, export, profile, slots, spec, steps
from roundsmith.plans.oracle import PREFIX, km
from roundsmith.plans.schedule import Schedule, convergence
from roundsmith.sources import files, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


_SCHEDULES: dict[tuple[str, str, bool], Schedule] = {}


def _schedule(spark: SparkSession, sf_dir: str, compact: bool) -> Schedule:
    """One set of plans for an application and folder; another application's plans go."""
    key = (spark.sparkContext.applicationId, sf_dir, compact)
    if key not in _SCHEDULES:
        for old in [k for k in _SCHEDULES if k[0] != key[0]]:
            del _SCHEDULES[old]
        _SCHEDULES[key] = Schedule(Domain(spark, sf_dir), compact=compact)
    return _SCHEDULES[key]


def query(name: str, sql: str | None = None, compact: bool = False):
    def register(build: Callable[[Schedule], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(_schedule(spark, sf_dir, compact))

        QUERIES[name] = run
        if sql:
            SQL[name] = f"{PREFIX} {sql}"
        return build

    return register


def r(c, places: int = 6):
    return F.round(c, places)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(r(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def pick(*columns: str):
    return lambda df: rounded(df.select(*columns))


# Projections and recurrence -------------------------------------------------------------------------------------------
@query("prj_1_display_rename", "SELECT booking_setup_id AS \"%booking_setup_id\", fl_id AS \"%FL_id\", rule AS recurrence_string, '' AS \"~New Duration\" FROM latest")
def _(s):
    return export.latest(s.domain.setups).select(F.col("booking_setup_id").alias("%booking_setup_id"), F.col("fl_id").alias("%FL_id"), F.col("rule").alias("recurrence_string"), F.lit("").alias("~New Duration"))


@query("prj_2_3_defaults_and_fallbacks", "SELECT booking_setup_id, coalesce(city,'') city, coalesce(new_duration, service_duration)::INT AS minutes, drop_week FROM derived")
def _(s):
    return s.derived.select("booking_setup_id", F.coalesce("city", F.lit("")).alias("city"), F.coalesce("new_duration", "service_duration").cast("int").alias("minutes"), "drop_week")


@query("prj_4_boolean_decode", "SELECT booking_setup_id, CASE WHEN auto_generate = 0 THEN 'No' ELSE 'Yes' END auto_generate_booking FROM latest")
def _(s):
    return export.latest(s.domain.setups).select("booking_setup_id", F.when(F.col("auto_generate") == 0, "No").otherwise("Yes").alias("auto_generate_booking"))


@query("prj_5_frequency_type", "SELECT booking_setup_id, frequency_type FROM derived")
def _(s):
    return s.derived.select("booking_setup_id", "frequency_type")


@query("prj_6_7_label_and_count", "SELECT booking_setup_id, recurrence_frequency, num_recurrences FROM derived")
def _(s):
    return s.derived.select("booking_setup_id", "recurrence_frequency", "num_recurrences")


@query("prj_8_services_per_year_with_days", "SELECT booking_setup_id, sql_spy AS services_per_year FROM derived")
def _(s):
    return s.derived.select("booking_setup_id", "services_per_year")


_WORK = ("booking_setup_id", "services_per_year", "services_per_month", "effective_duration", "duration_flagged", "capacity_duration", "monthly_contrib_hrs", "dow_name")


@query("prj_9_to_13_workload", "SELECT booking_setup_id, round(services_per_year,6) services_per_year, round(services_per_month,6) services_per_month, effective_duration, duration_flagged, capacity_duration, round(monthly_contrib_hrs,6) monthly_contrib_hrs, dow_name FROM work")
def _(s):
    return pick(*_WORK)(s.work)


@query("prj_14_15_tiers_and_flags", "SELECT booking_setup_id, is_mwp, is_weekly, CASE WHEN services_per_year >= 26 THEN 5 WHEN services_per_year >= 12 THEN 4 WHEN services_per_year >= 4 THEN 3 WHEN services_per_year >= 1.5 THEN 2 ELSE 1 END tier FROM clean")
def _(s):
    return s.clean.select("booking_setup_id", "is_mwp", "is_weekly", wl.frequency_tier(F.col("services_per_year")).alias("tier"))


@query("prj_16_new_pattern", "SELECT booking_setup_id, new_date_pattern FROM applied")
def _(s):
    return slots.apply_slots(s.assigned, s.stub()).select("booking_setup_id", "new_date_pattern")


@query("prj_17_current_pattern", "SELECT booking_setup_id, CASE WHEN frequency_type = 'Weekly - Multi Day' OR recurrence_frequency = '1 Weekly' THEN 'Every '||sql_dow_name ELSE coalesce(drop_week::VARCHAR,'')||'-'||sql_dow_name END current_pattern FROM derived")
def _(s):
    return s.derived.select("booking_setup_id", wl.current_pattern(F.col("frequency_type"), F.col("recurrence_frequency"), F.col("drop_week"), F.col("dow_name")).alias("current_pattern"))


def _done(s):
    return export.serviced(s.domain.table("work_order"), export.latest(s.domain.setups), "1999-01-01", "2000-01-01")


@query("prj_18_serviced_pattern", "SELECT wo_id, pattern FROM done")
def _(s):
    return _done(s).select("wo_id", "pattern")


@query("prj_19_drop_by_suffix", "SELECT booking_setup_id, tech FROM assigned")
def _(s):
    wide = s.assigned.select("booking_setup_id", "tech", F.col("latitude").alias("latitude_fl"), F.col("longitude").alias("longitude_fl"))
    return wide.drop(*(c for c in wide.columns if c.endswith("_fl")))


@query("prj_20_heat_band", "SELECT tech, week, day, CASE WHEN load > 12 THEN 'over 12' WHEN load > 10 THEN 'over 10' WHEN load > 8 THEN 'over 8' WHEN load > 6 THEN 'over 6' ELSE 'light' END heat_band FROM (SELECT tech, week, day, round_even(load,2) load FROM cap)")
def _(s):
    return _cap(s).select("tech", "week", "day", wl.heat_band(F.col("load_hrs")).alias("heat_band"))


@query("prj_21_marker", "SELECT tech, fl_id, CASE WHEN fl_id % 2 = 0 THEN 'disconnected' WHEN is_outlier THEN 'outlier' ELSE 'plain' END marker FROM stub")
def _(s):
    return s.stub().select("tech", "fl_id", wl.marker(F.col("fl_id") % 2 == 0, F.col("is_outlier")).alias("marker"))


@query("str_1_to_6_rule_tags", "SELECT booking_setup_id, len(days) n_days, nw AS n_weeks, nm AS n_months, nd AS n_daily, wd AS weekday, wf AS weekdef, dy AS day, array_to_string(days[1:4], ',') AS days FROM derived")
def _(s):
    return s.derived.select("booking_setup_id", F.size("days").cast("long").alias("n_days"), "n_weeks", "n_months", "n_daily", "weekday", "weekdef", F.col("month_day").alias("day"), F.array_join(F.slice("days", 1, 4), ",").alias("days"))


@query("str_7_8_day_numbers_and_names", "SELECT booking_setup_id, dow_number, sql_dow_name AS dow_name FROM derived")
def _(s):
    return s.derived.select("booking_setup_id", "dow_number", "dow_name")


@query("str_9_concat_nulls", "SELECT booking_setup_id, coalesce(week_number::VARCHAR,'')||'-x' AS kept, week_number::VARCHAR||'-x' AS lost FROM derived")
def _(s):
    w = F.col("week_number").cast("string")
    return s.derived.select("booking_setup_id", F.concat(F.coalesce(w, F.lit("")), F.lit("-x")).alias("kept"), F.concat(w, F.lit("-x")).alias("lost"))


@query("str_11_12_unassigned_and_contains", "SELECT booking_setup_id, is_unassigned, preferred_resource LIKE '%Tech-0%' AS low FROM clean")
def _(s):
    return s.clean.select("booking_setup_id", "is_unassigned", F.coalesce(F.col("preferred_resource").contains("Tech-0"), F.lit(False)).alias("low"))


@query("str_15_slot_text", "SELECT tech, fl_id, week||'-'||substr(day,1,3) AS slot FROM stub")
def _(s):
    return s.stub().select("tech", "fl_id", F.concat(F.col("week").cast("string"), F.lit("-"), F.substring("day", 1, 3)).alias("slot"))


@query("dat_1_start_date", "SELECT booking_setup_id, start_date FROM derived")
def _(s):
    return s.derived.select("booking_setup_id", "start_date")


@query("dat_2_3_shifts", "SELECT booking_setup_id, (createdon + INTERVAL 10 HOURS)::DATE AS local_day, strftime(createdon + to_minutes(coalesce(utc_offset_minutes,0)), '%H:%M:%S') AS local_time FROM latest LEFT JOIN branch_timezone USING (branch_id)")
def _(s):
    j = export.latest(s.domain.setups).join(s.domain.table("branch_timezone"), "branch_id", "left")
    local = F.timestamp_add("MINUTE", F.coalesce("utc_offset_minutes", F.lit(0)), F.col("createdon"))
    return j.select("booking_setup_id", F.to_date(F.col("createdon") + F.expr("INTERVAL 10 HOURS")).alias("local_day"), F.date_format(local, "HH:mm:ss").alias("local_time"))


@query("dat_4_to_8_calendar", "SELECT booking_setup_id, dayofweek(start_date)::INT dow, ((day(start_date)-1)//7+1)::INT week_of_month, (((date_diff('day', DATE '2025-05-19', start_date)//7)%4+4)%4+1)::INT cycle_week, dayname(start_date) AS name FROM derived")
def _(s):
    d = F.col("start_date")
    return s.derived.select("booking_setup_id", recurrence.day_of_week(d).alias("dow"), recurrence.week_of_month(d).alias("week_of_month"), recurrence.cycle_week(d, DEFAULT.cycle_anchor).alias("cycle_week"), F.date_format(d, "EEEE").alias("name"))


@query("dat_9_to_12_validity_and_drops", "SELECT booking_setup_id, week_number, is_valid_start_date, drop_month, drop_week FROM derived")
def _(s):
    return s.derived.select("booking_setup_id", "week_number", "is_valid_start_date", "drop_month", "drop_week")


# Filters and profiling ------------------------------------------------------------------------------------------------
@query("flt_1_waterfall", "SELECT r.step, r.rule, count(booking_setup_id) excluded FROM (VALUES (0,'admin only'),(1,'yearly'),(2,'daily'),(3,'fixed date'),(4,'no type'),(5,'weekend pattern'),(6,'week zero')) r(step, rule) LEFT JOIN marked m ON m.exclusion_reason = r.rule GROUP BY ALL")
def _(s):
    return profile.waterfall_log(s.marked, s.rules)


@query("flt_2_to_6_exclusion_predicates", "SELECT booking_setup_id, exclusion_reason FROM marked")
def _(s):
    return s.marked.select("booking_setup_id", "exclusion_reason")


@query("flt_7_8_set_1_rejected_sites", "SELECT fl_id, reason FROM rejected")
def _(s):
    return assign.rejected_sites(s.site).select("fl_id", "reason")


@query("flt_9_jn_12_anti_join", "SELECT booking_setup_id FROM clean")
def _(s):
    return s.clean.select("booking_setup_id")


@query("flt_10_agg_1_product_totals", "SELECT booking_setup_id, product_count, round(setup_value,4) setup_value, round(setup_quantity,4) setup_quantity FROM products0")
def _(s):
    return export.product_totals(s.domain.table("product")).select("booking_setup_id", "product_count", r(F.col("setup_value"), 4).alias("setup_value"), r(F.col("setup_quantity"), 4).alias("setup_quantity"))


@query("flt_12_dat_13_history_window", "SELECT count(*) n, count(DISTINCT booking_setup_id) setups FROM done")
def _(s):
    return _done(s).agg(F.count("*").alias("n"), F.countDistinct("booking_setup_id").alias("setups"))


@query("flt_13_win_1_latest_setup", "SELECT booking_setup_id, createdon FROM latest")
def _(s):
    return export.latest(s.domain.setups).select("booking_setup_id", "createdon")


@query("flt_14_agg_8_9_multi_tech_sites", "SELECT fl_id, tech, count(*) setups, round(sum(hrs),6) monthly_hrs FROM assigned WHERE fl_id IN (SELECT fl_id FROM assigned GROUP BY 1 HAVING count(DISTINCT tech) > 1) GROUP BY ALL")
def _(s):
    return rounded(assign.multi_tech(s.assigned))


@query("jn_14_multi_tech_names", "SELECT fl_id, tech, fl_name, any_value(city) city FROM assigned WHERE fl_id IN (SELECT fl_id FROM assigned GROUP BY 1 HAVING count(DISTINCT tech) > 1) GROUP BY ALL")
def _(s):
    return assign.multi_tech(s.assigned).join(s.site.select("fl_id", "fl_name", "city"), "fl_id").select("fl_id", "tech", "fl_name", "city")


@query("agg_2_str_13_sites", "SELECT * EXCLUDE (latitude, longitude, monthly_contrib_hrs, anchor_spy), round(latitude,6) latitude, round(longitude,6) longitude, round(monthly_contrib_hrs,6) monthly_contrib_hrs, round(anchor_spy,6) anchor_spy FROM site")
def _(s):
    return rounded(s.site)


_AREA = "SELECT city, fl_count, setup_count, round(total_monthly_hrs,6) total_monthly_hrs, round(centroid_lat,6) centroid_lat, round(centroid_lon,6) centroid_lon, required_run_days FROM area"


@query("agg_3_mth_4_areas", _AREA)
def _(s):
    return rounded(s.area)


@query("srt_1_top_areas", _AREA + " ORDER BY total_monthly_hrs DESC, city LIMIT 25")
def top_areas(s):
    return rounded(s.area).orderBy(F.desc("total_monthly_hrs"), "city").limit(25)


@query("agg_4_mth_2_srt_2_tiers", "SELECT recurrence_frequency, count(*) setup_count, count(DISTINCT fl_id) fl_count, round_even(avg(effective_duration),1) avg_duration_mins, round_even(round(coalesce(sum(monthly_contrib_hrs),0),6),1) monthly_hrs FROM work GROUP BY 1")
def _(s):
    return profile.tiers(s.work).orderBy(F.desc("setup_count"), "recurrence_frequency")


@query("agg_5_snk_5_hours_distribution", "SELECT round(avg(monthly_contrib_hrs),6) mean, round(median(monthly_contrib_hrs),6) median, round(quantile_cont(monthly_contrib_hrs,0.9),6) p90, round(max(monthly_contrib_hrs),6) max, count(*) FILTER (latitude IS NULL) no_coordinates FROM site")
def _(s):
    return rounded(profile.hours_distribution(s.site))


@query("agg_6_portfolio", "SELECT count(*) areas, sum(fl_count)::BIGINT fls, round(sum(total_monthly_hrs),6) AS hours, sum(required_run_days) run_days, round(sum(required_run_days)/20,6) implied_techs FROM area")
def _(s):
    return rounded(profile.portfolio(s.area))


# Export ---------------------------------------------------------------------------------------------------------------
_BASE_FROM = """FROM latest l JOIN agreement a USING (agreement_id) JOIN derived d USING (booking_setup_id) JOIN location x ON x.fl_id = l.fl_id LEFT JOIN products0 p USING (booking_setup_id)
LEFT JOIN branch1 b ON b.territory = x.territory AND b.division = 'Division '||a.division_code LEFT JOIN branch_timezone z ON z.branch_id = l.branch_id LEFT JOIN invoice_option i ON i.invoice_code = a.invoice_code LEFT JOIN branch h ON h.branch_id = l.branch_id
WHERE a.status = 1 AND l.status = 1 AND a.division_code IN ('AUTOMOBILE','BUILDING','MACHINERY')"""
_BASE = f"""SELECT l.booking_setup_id, x.fl_name, round(x.latitude,6) latitude, round(x.longitude,6) longitude, 'Division '||a.division_code AS division, coalesce(b.branch_name,'') service_branch, coalesce(h.setup_branch,'') setup_branch, x.territory, coalesce(i.invoice_frequency,'') invoice_frequency,
strftime(l.createdon + to_minutes(coalesce(z.utc_offset_minutes,0)), '%H:%M:%S') preferred_start_time, round(round(p.setup_value*d.sql_spy,6)/1000,0) annual_thousands, a.billing_account, round(round(p.setup_value,2),2) setup_value, round(p.setup_quantity,4) setup_quantity, d.recurrence_frequency, d.drop_month, d.drop_week {_BASE_FROM}"""


@query("jn_1_to_6_flt_11_base_export", _BASE)
def _(s):
    plain = ("fl_name", "division", "service_branch", "setup_branch", "territory", "invoice_frequency", "preferred_start_time", "billing_account", "recurrence_frequency", "drop_month", "drop_week")
    numbers = (r(F.col("latitude")).alias("latitude"), r(F.col("longitude")).alias("longitude"), r(F.col("annual_value") / 1000, 0).alias("annual_thousands"), r(F.col("setup_value"), 2).alias("setup_value"), r(F.col("setup_quantity"), 4).alias("setup_quantity"))
    return export.base_export(s.domain).select("booking_setup_id", *plain, *numbers)


@query("jn_11_split_schedule", "SELECT booking_setup_id, split FROM typed")
def _(s):
    return s.derived.select("booking_setup_id", "split")


@query("jn_7_8_agg_17_bridge", "SELECT DISTINCT wo_id, booking_setup_id FROM done")
def _(s):
    return _done(s).select("wo_id", "booking_setup_id").distinct()


@query("win_2_first_branch", "SELECT territory, division, branch_id, branch_name FROM branch1")
def _(s):
    return export.first_branch(s.domain.table("branch_territory"))


_RATED = "SELECT *, dense_rank() OVER (PARTITION BY fl_id ORDER BY n DESC, pattern)::INT rating FROM (SELECT fl_id, pattern, count(DISTINCT booking_setup_id) setups, count(pattern) n FROM done GROUP BY ALL)"


@query("win_3_agg_14_pattern_rating", _RATED)
def _(s):
    return export.best_pattern(_done(s))


@query("win_4_agg_15_16_jn_10_tech_history", "SELECT booking_setup_id, arg_min(tech_name, (-n, tech_name)) most_serviced_tech, string_agg(n||' service from '||tech_name, '  |  ' ORDER BY n DESC, tech_name) full_history FROM techn GROUP BY 1")
def _(s):
    return export.tech_history(_done(s))


@query("win_5_window_count", "SELECT wo_id, count(*) OVER (PARTITION BY booking_setup_id, fl_id) n FROM done")
def _(s):
    from pyspark.sql import Window

    return _done(s).select("wo_id", F.count("*").over(Window.partitionBy("booking_setup_id", "fl_id")).alias("n"))


_CURRENT = "CASE WHEN frequency_type = 'Weekly - Multi Day' OR recurrence_frequency = '1 Weekly' THEN 'Every '||sql_dow_name ELSE coalesce(drop_week::VARCHAR,'')||'-'||sql_dow_name END"
_BRANCH = f"""SELECT m.booking_setup_id, {_CURRENT} current_pattern, o.pattern serviced_pattern, o.n pattern_count, t.most_serviced_tech, t.full_history
FROM (SELECT l.booking_setup_id, l.fl_id {_BASE_FROM}) m JOIN derived USING (booking_setup_id)
LEFT JOIN (SELECT fl_id, pattern, n FROM (SELECT *, row_number() OVER (PARTITION BY fl_id ORDER BY n DESC, pattern) rn FROM (SELECT fl_id, pattern, count(pattern) n FROM done WHERE booking_setup_id IN (SELECT l.booking_setup_id {_BASE_FROM}) GROUP BY ALL)) WHERE rn = 1) o ON o.fl_id = m.fl_id
LEFT JOIN (SELECT booking_setup_id, arg_min(tech_name, (-n, tech_name)) most_serviced_tech, string_agg(n||' service from '||tech_name, '  |  ' ORDER BY n DESC, tech_name) full_history FROM techn GROUP BY 1) t ON t.booking_setup_id = m.booking_setup_id"""


@query("jn_9_src_4_branch_export", _BRANCH)
def _(s):
    return export.branch_export(s.domain).select("booking_setup_id", "current_pattern", "serviced_pattern", "pattern_count", "most_serviced_tech", "full_history")


# Geography and assignment ---------------------------------------------------------------------------------------------
@query("geo_1_haversine", f"SELECT fl_id, round({km('latitude', 'longitude', '-37.8136', '144.9631')},4) km FROM location")
def _(s):
    return s.domain.locations.select("fl_id", r(geo.haversine(F.col("latitude"), F.col("longitude"), F.lit(-37.8136), F.lit(144.9631)), 4).alias("km"))


@query("geo_2_planar", "SELECT fl_id, round(sqrt(pow(latitude+37.8136,2)+pow(longitude-144.9631,2)),6) degrees FROM location")
def _(s):
    return s.domain.locations.select("fl_id", r(geo.planar(F.col("latitude"), F.col("longitude"), F.lit(-37.8136), F.lit(144.9631))).alias("degrees"))


@query("agg_7_geo_4_tech_centroids", "SELECT tech, round(c_lat,6) c_lat, round(c_lon,6) c_lon, round(monthly_hrs,6) monthly_hrs, fls FROM centre")
def _(s):
    return rounded(s.centroids)


@query("jn_19_nearest_tech", "SELECT booking_setup_id, tech FROM assigned")
def _(s):
    return s.assigned.select("booking_setup_id", "tech")


_TECH_SITE = "SELECT tech, fl_id, round(monthly_hrs,6) monthly_hrs, setups, round(latitude,6) latitude, round(longitude,6) longitude, round(anchor_freq,6) anchor_freq, anchor_tier, fl_name, city FROM stub"


@query("agg_10_11_jn_15_tech_sites", _TECH_SITE)
def _(s):
    return rounded(s.tech_sites)


@query("jn_20_geo_3_neighbours", "SELECT tech, fl_id, other, round(km,4) km, nn_rank FROM knn")
def _(s):
    return assign.neighbours(s.stub(), 7).select("tech", "fl_id", "other", r(F.col("km"), 4).alias("km"), "nn_rank")


@query("agg_20_geo_6_7_outliers", "SELECT tech, fl_id, mad > 0 AND km > med + 2*mad is_outlier FROM (SELECT *, median(abs(km-med)) OVER (PARTITION BY tech) mad FROM (SELECT *, median(km) OVER (PARTITION BY tech) med FROM dist))")
def _(s):
    return assign.mad_outliers(slots.centroid_km(s.stub()).select("tech", "fl_id", "km"), 2.0).select("tech", "fl_id", "is_outlier")


@query("jn_21_gap_edges", f"SELECT a.tech, a.fl_id, b.fl_id other FROM stub a JOIN stub b ON a.tech=b.tech AND a.week=b.week AND a.day=b.day AND a.fl_id<b.fl_id WHERE {km('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} <= 15")
def _(s):
    return slots.gap_edges(s.stub(), 15)


_ZONES = f"""SELECT tech, week, day, fls, components, round(monthly_hrs,6) monthly_hrs FROM (
SELECT s.tech, s.week, s.day, count(*) fls, count(DISTINCT root) components, sum(monthly_hrs) monthly_hrs FROM stub s JOIN (
  WITH RECURSIVE e AS (SELECT a.tech, a.fl_id x, b.fl_id y FROM stub a JOIN stub b ON a.tech=b.tech AND a.week=b.week AND a.day=b.day WHERE {km('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} <= 15),
  reach AS (SELECT tech, x, y FROM e UNION SELECT r.tech, r.x, e.y FROM reach r JOIN e ON e.tech=r.tech AND e.x=r.y)
  SELECT tech, x AS fl_id, min(y) root FROM reach GROUP BY 1, 2) c USING (tech, fl_id) GROUP BY ALL)"""


@query("geo_8_9_zone_components", _ZONES)
def _(s):
    return rounded(slots.zones(s.stub()))


@query("geo_9_disconnected_flag", f"SELECT s.tech, s.fl_id, coalesce(z.components > 1, FALSE) in_disconnected_zone FROM stub s LEFT JOIN ({_ZONES}) z USING (tech, week, day)")
def _(s):
    return s.diagnosed(s.stub()).select("tech", "fl_id", "in_disconnected_zone")


# Slots, capacity, indicators -------------------------------------------------------------------------------------------
def _cap(s):
    return slots.capacity(slots.apply_slots(s.assigned, s.stub()))


@query("agg_12_search_load", "SELECT tech, week, day, round(sum(monthly_hrs),6) load_hrs FROM stub GROUP BY ALL")
def _(s):
    return rounded(slots.search_load(s.stub()))


@query("agg_13_jn_22_capacity", "SELECT tech, week, day, round_even(load,2) load_hrs, 8.0::DOUBLE capacity_hrs, load > 8 over_capacity FROM cap")
def _(s):
    return _cap(s)


@query("jn_13_16_apply_slots", "SELECT booking_setup_id, tech, week, day FROM applied")
def _(s):
    return slots.apply_slots(s.assigned, s.stub()).select("booking_setup_id", "tech", "week", "day")


@query("agg_18_tech_summary", "SELECT tech, count(*) fls, round(sum(monthly_hrs),6) monthly_hrs, count(DISTINCT day) days_used, count(DISTINCT week) weeks_used, count(*) FILTER (is_outlier) outliers FROM stub GROUP BY 1")
def _(s):
    return rounded(slots.tech_summary(s.stub()))


@query("agg_21_votes", "SELECT tech, fl_id, week, day, top_week, top_day, top_votes, own_votes FROM vote")
def _(s):
    return slots.votes(s.stub(), 7)


_TECHS, _FREQS = ("Tech-01", "Tech-02", "Tech-05", "Tech-11", "Tech-17"), ("1 Monthly", "2 Weekly", "3 Monthly")
_CHOSEN = ", ".join(f"'{t}'" for t in _TECHS)


@query("agg_22_flt_15_dashboard", f"SELECT count(*) n, round(sum(monthly_hrs),6) hrs, count(DISTINCT tech) techs, (SELECT count(*) FROM cap WHERE tech IN ({_CHOSEN}) AND load > 8) over_slots FROM stub s WHERE tech IN ({_CHOSEN}) AND day IN ('Monday','Friday') AND week IN (1,2,4) AND EXISTS (SELECT 1 FROM applied a WHERE a.tech = s.tech AND a.fl_id = s.fl_id AND coalesce(a.recurrence_frequency,'') IN ('', '1 Monthly','2 Weekly','3 Monthly')) AND (lower(fl_name) LIKE '%1%' OR lower(city) LIKE '%1%')")
def _(s):
    records = slots.site_records(slots.apply_slots(s.assigned, s.stub()), s.stub())
    found = slots.matching(records, techs=_TECHS, days=("Monday", "Friday"), weeks=(1, 2, 4), freqs=_FREQS, text="1")
    over = slots.crowded(_cap(s), _TECHS).agg(F.count("*").alias("over_slots"))
    return found.agg(F.count("*").alias("n"), r(F.sum("monthly_hrs")).alias("hrs"), F.countDistinct("tech").alias("techs")).join(over)


@query("flt_16_crowded_slots", f"SELECT tech, week, day, round_even(load,2) load_hrs FROM cap WHERE tech IN ({_CHOSEN}) AND (load > 8 OR round_even(load,2) > 8)")
def _(s):
    return slots.crowded(_cap(s), _TECHS).select("tech", "week", "day", "load_hrs")


@query("srt_7_filter_lists", "SELECT 'tech' list, row_number() OVER (ORDER BY round(sum(monthly_hrs),6) DESC, tech)::INT AS position, tech AS value FROM stub GROUP BY tech UNION ALL SELECT 'freq', row_number() OVER (ORDER BY f)::INT, f FROM (SELECT DISTINCT recurrence_frequency f FROM applied WHERE recurrence_frequency IS NOT NULL) UNION ALL SELECT 'city', row_number() OVER (ORDER BY city)::INT, city FROM (SELECT DISTINCT city FROM stub WHERE city IS NOT NULL)")
def _(s):
    return slots.filter_lists(s.stub(), slots.apply_slots(s.assigned, s.stub()))


_PIVOT = ", ".join(f"sum(l) FILTER (week={w} AND day='{d}') AS \"{w}-{d[:3]}\"" for w in (1, 2, 3, 4) for d in ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday"))


@query("agg_23_slot_matrix", f"SELECT tech, {_PIVOT} FROM (SELECT tech, week, day, round_even(load,2) l FROM cap) GROUP BY 1")
def _(s):
    return slots.slot_matrix(_cap(s))


@query("agg_24_jn_17_nested_records", "SELECT tech, fl_id, count(*) n_setups, string_agg(DISTINCT recurrence_frequency, ',' ORDER BY recurrence_frequency) freqs FROM applied GROUP BY ALL")
def _(s):
    rec = slots.site_records(slots.apply_slots(s.assigned, s.stub()), s.stub())
    return rec.select("tech", "fl_id", F.size("setup_list").cast("long").alias("n_setups"), F.array_join("freqs", ",").alias("freqs"))


@query("snk_3_json_payload", "SELECT s.fl_id, s.fl_name AS name, s.city, s.tech, s.day, s.week, round(s.monthly_hrs,6) monthly_hrs, s.is_outlier, a.n_setups, a.minutes, a.freqs FROM stub s JOIN (SELECT tech, fl_id, count(*) n_setups, round(sum(effective_duration),6) AS minutes, string_agg(DISTINCT recurrence_frequency, ',' ORDER BY recurrence_frequency) freqs FROM applied GROUP BY ALL) a USING (tech, fl_id)")
def _(s):
    # What the JSON texts hold when they are read again.
    rec = slots.site_records(slots.apply_slots(s.assigned, s.stub()), s.stub()).withColumnRenamed("fl_name", "name")
    held = rec.select("fl_id", "name", "city", "tech", "day", "week", "monthly_hrs", "is_outlier", "setup_list", "weeks", "freqs")
    back = held.select(F.from_json(F.to_json(F.struct(*held.columns)), held.schema).alias("j")).select("j.*")
    minutes = F.aggregate("setup_list", F.lit(0.0), lambda a, x: a + x["duration"])
    return back.select("fl_id", "name", "city", "tech", "day", "week", r(F.col("monthly_hrs")).alias("monthly_hrs"), "is_outlier", F.size("setup_list").cast("long").alias("n_setups"), r(minutes).alias("minutes"), F.array_join("freqs", ",").alias("freqs"))


@query("kpi_1_2_agg_25_rates", "SELECT round(avg((length(new_date_pattern)>0)::INT)*100,6) allocated_pct, (SELECT round(avg((d = 1 AND w <= 1)::INT)*100,6) FROM (SELECT count(DISTINCT day) d, count(DISTINCT week) w FROM applied GROUP BY tech, fl_id)) same_site_pct FROM applied")
def _(s):
    ap = slots.apply_slots(s.assigned, s.stub())
    one = ap.groupBy("tech", "fl_id").agg(F.countDistinct("day").alias("d"), F.countDistinct("week").alias("w")).agg((F.avg(((F.col("d") == 1) & (F.col("w") <= 1)).cast("double")) * 100).alias("same_site_pct"))
    return ap.agg(r(F.avg((F.length("new_date_pattern") > 0).cast("double")) * 100).alias("allocated_pct")).join(one)


@query("kpi_3_jn_18_centroid_km", "SELECT round(avg(km),4) mean_km, round(sum(km),4) total_km FROM dist")
def _(s):
    return slots.centroid_km(s.stub()).agg(r(F.avg("km"), 4).alias("mean_km"), r(F.sum("km"), 4).alias("total_km"))


_MOVED = "(top_week <> week OR top_day <> day)"


@query("kpi_4_5_enclaves", f"SELECT count(*) total, count(*) FILTER ({_MOVED} AND top_votes >= 3) strict, count(*) FILTER ({_MOVED} AND top_votes > own_votes) loose, round(avg(({_MOVED} AND top_votes >= 3)::INT)*100,6) strict_pct, round(avg(({_MOVED} AND top_votes > own_votes)::INT)*100,6) loose_pct FROM vote")
def _(s):
    return rounded(slots.enclaves(slots.votes(s.stub(), 7), 3))


@query("kpi_6_disconnected_zones", f"SELECT count(*) FILTER (components > 1) zones FROM ({_ZONES})")
def _(s):
    return slots.zones(s.stub()).agg(F.count_if(F.col("components") > 1).alias("zones"))


@query("kpi_7_slot_loads", "SELECT count(*) n, count(*) FILTER (load > 8) over_cap, round(avg((load>8)::INT)*100,6) pct, round(avg(round_even(load,2)),6) mean_load, max(round_even(load,2)) max_load FROM cap")
def _(s):
    over = F.col("over_capacity")
    return _cap(s).agg(F.count("*").alias("n"), F.count_if(over).alias("over_cap"), r(F.avg(over.cast("double")) * 100).alias("pct"), r(F.avg("load_hrs")).alias("mean_load"), F.max("load_hrs").alias("max_load"))


@query("opt_4_capacity_gate", "SELECT tech, fl_id, NOT (4.0+monthly_hrs > 8 AND 4.0+monthly_hrs >= 9.0) passes FROM stub")
def _(s):
    return s.stub().select("tech", "fl_id", slots.gate(F.lit(9.0), F.lit(4.0), F.col("monthly_hrs"), 8.0).alias("passes"))


@query("srt_6_heaviest_slot", "SELECT tech, week, day, l AS load_hrs, over_slots FROM (SELECT *, row_number() OVER (PARTITION BY tech ORDER BY l DESC, week, day) rn, count(*) OVER (PARTITION BY tech) over_slots FROM (SELECT tech, week, day, round(sum(monthly_hrs),6) l FROM stub GROUP BY ALL) WHERE l > 8) WHERE rn = 1")
def _(s):
    over = rounded(slots.search_load(s.stub())).where("load_hrs > 8")
    best = F.min_by(F.struct("week", "day", "load_hrs"), F.struct(-F.col("load_hrs"), F.col("week"), F.col("day")))
    return over.groupBy("tech").agg(best.alias("b"), F.count("*").alias("over_slots")).select("tech", "b.week", "b.day", "b.load_hrs", "over_slots")


@query("srt_4_zone_order", "SELECT tech, day, row_number() OVER (PARTITION BY tech ORDER BY avg(longitude), day)::INT west_east FROM stub GROUP BY tech, day")
def _(s):
    from pyspark.sql import Window

    return s.stub().groupBy("tech", "day").agg(F.avg("longitude").alias("lon")).select("tech", "day", F.row_number().over(Window.partitionBy("tech").orderBy("lon", "day")).alias("west_east"))


@query("srt_5_week_order", "SELECT tech, day, week, row_number() OVER (PARTITION BY tech, day ORDER BY avg(latitude) DESC, week)::INT north_south FROM stub GROUP BY tech, day, week")
def _(s):
    from pyspark.sql import Window

    north = Window.partitionBy("tech", "day").orderBy(F.desc("lat"), "week")
    return s.stub().groupBy("tech", "day", "week").agg(F.avg("latitude").alias("lat")).select("tech", "day", "week", F.row_number().over(north).alias("north_south"))


@query("jn_23_clu_4_nearest_zone", f"SELECT s.tech, s.fl_id, arg_min(c.day, ({km('s.latitude', 's.longitude', 'c.la', 'c.lo')}, c.day)) zone FROM stub s JOIN (SELECT tech, day, avg(latitude) la, avg(longitude) lo FROM stub GROUP BY ALL) c USING (tech) GROUP BY ALL")
def _(s):
    st = s.stub()
    c = st.groupBy("tech", F.col("day").alias("zone")).agg(F.avg("latitude").alias("la"), F.avg("longitude").alias("lo"))
    d = geo.haversine(F.col("latitude"), F.col("longitude"), F.col("la"), F.col("lo"))
    return st.join(c, "tech").groupBy("tech", "fl_id").agg(F.min_by("zone", F.struct(d.alias("d"), F.col("zone"))).alias("zone"))


# Search (no SQL form: invariants are tested) ---------------------------------------------------------------------------
@query("clu_1_to_7_seed", compact=True)
def _(s):
    return s.placed("seed").select("tech", "fl_id", "week", "day", "is_outlier")


@query("opt_1_2_6_rebalance_and_filter", compact=True)
def _(s):
    return s.placed("filter").drop("log")


@query("opt_3_7_joint_search", compact=True)
def _(s):
    return s.placed("joint").drop("log")


@query("opt_5_agg_19_srt_3_convergence", compact=True)
def _(s):
    return convergence(s.placed("joint")).groupBy("iter").agg(F.sum("moves").alias("moves"), F.count_if(F.col("moves") > 0).alias("active_techs")).orderBy("iter").limit(20)


_LOAD = "(SELECT tech, week, day, sum(monthly_hrs) l, sum(latitude*greatest(monthly_hrs,0.001))/sum(greatest(monthly_hrs,0.001)) c_lat, sum(longitude*greatest(monthly_hrs,0.001))/sum(greatest(monthly_hrs,0.001)) c_lon FROM stub GROUP BY ALL)"
_MASS = "sum({0}*greatest(monthly_hrs,0.001))/sum(greatest(monthly_hrs,0.001))"


@query("clu_1_lloyd_step", f"SELECT tech, z AS zone, round({_MASS.format('latitude')},6) c_lat, round({_MASS.format('longitude')},6) c_lon FROM (SELECT s.tech, s.fl_id, any_value(s.latitude) latitude, any_value(s.longitude) longitude, any_value(s.monthly_hrs) monthly_hrs, arg_min(c.day, (round(sqrt(pow(c.la-s.latitude,2)+pow(c.lo-s.longitude,2)),9), c.day)) z FROM stub s JOIN (SELECT tech, day, {_MASS.format('latitude')} la, {_MASS.format('longitude')} lo FROM stub GROUP BY ALL) c USING (tech) GROUP BY 1, 2) GROUP BY 1, 2")
def _(s):
    return rounded(steps.lloyd_step(s.stub(), "day"))


@query("geo_5_median_step", f"SELECT tech, round(sum(latitude*p)/sum(p),6) m_lat, round(sum(longitude*p)/sum(p),6) m_lon FROM (SELECT *, greatest(monthly_hrs,0.001)/greatest(sqrt(pow(c_lat-latitude,2)+pow(c_lon-longitude,2)),1e-9) p FROM stub JOIN (SELECT tech, {_MASS.format('latitude')} c_lat, {_MASS.format('longitude')} c_lon FROM stub GROUP BY 1) USING (tech)) GROUP BY 1")
def _(s):
    return rounded(steps.median_step(s.stub()))


@query("opt_1_first_move", f"""SELECT tech, fl_id, from_week, from_day, to_week, to_day FROM (SELECT o.tech, o.fl_id, o.week from_week, o.day from_day, t.week to_week, t.day to_day,
  row_number() OVER (PARTITION BY o.tech ORDER BY round({km('o.latitude', 'o.longitude', 'f.c_lat', 'f.c_lon')} - {km('o.latitude', 'o.longitude', 't.c_lat', 't.c_lon')}, 6) DESC, o.fl_id, t.week, t.day) rn
  FROM (SELECT *, row_number() OVER (PARTITION BY tech ORDER BY round(l,9) DESC, week, day) h FROM {_LOAD} WHERE l > 8) f JOIN stub o ON f.h = 1 AND o.tech = f.tech AND o.week = f.week AND o.day = f.day
  JOIN {_LOAD} t ON t.tech = o.tech AND NOT (t.week = o.week AND t.day = o.day) AND t.l + o.monthly_hrs < f.l) WHERE rn = 1""")
def _(s):
    return steps.first_move(s.stub())


_GATE = "NOT (round(b.l,9)+s.monthly_hrs > 8 AND round(b.l,9)+s.monthly_hrs >= round(a.l,9))"


@query("opt_2_3_first_candidates", f"SELECT v.tech, v.fl_id, v.top_week to_week, v.top_day to_day, {_GATE} AND v.top_votes >= 3 AS filter, {_GATE} AND v.top_votes > v.own_votes AS joint FROM vote v JOIN stub s USING (tech, fl_id) JOIN {_LOAD} a ON a.tech = v.tech AND a.week = v.week AND a.day = v.day JOIN {_LOAD} b ON b.tech = v.tech AND b.week = v.top_week AND b.day = v.top_day WHERE {_MOVED.replace('top_', 'v.top_').replace('<> week', '<> v.week').replace('<> day', '<> v.day')} AND {_GATE} AND (v.top_votes >= 3 OR v.top_votes > v.own_votes)")
def _(s):
    return steps.vote_candidates(s.stub())


# Whole variants, through diagnostics -----------------------------------------------------------------------------------
@query("opt_6_variant_v1", compact=True)
def _(s):
    return s.flagged("filter")


@query("opt_7_variant_v2", compact=True)
def _(s):
    return s.flagged("joint")


@query("opt_6_7_indicators", compact=True)
def _(s):
    rows, kinds = [], {}
    for variant in ("seed", "filter", "joint"):
        placed = s.stored_placed(variant)
        # Part by part: the driver has no room for one plan of all variants.
        parts = [rounded(p) for p in slots.indicator_parts(placed, slots.apply_slots(s.assigned, placed))]
        kinds = dict(x for p in parts for x in p.dtypes)
        rows.append((*(v for row in tables.settled(parts) for v in row), variant))
    return s.domain.spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", variant string").coalesce(1)


# Files -----------------------------------------------------------------------------------------------------------------
_FILED = "SELECT booking_setup_id::VARCHAR booking_setup_id, fl_id::VARCHAR fl_id, nullif(frequency_type,'') frequency_type, nullif(dow_number,'') dow_number, week_number::VARCHAR week_number, nullif(preferred_resource,'') preferred_resource FROM derived"


@query("src_1_snk_1_csv_strings", _FILED)
def _(s):
    table = s.derived.select("booking_setup_id", "fl_id", "frequency_type", "dow_number", "week_number", "preferred_resource")
    path = tables.new_path(s.domain.spark, "csv")
    shown = files.to_display(table)
    files.write_csv(shown, path)
    return files.from_display(files.read_strings(s.domain.spark, path, shown.columns))


@query("src_2_snk_2_csv_typed", "SELECT city, fl_count, setup_count, required_run_days, round(total_monthly_hrs,6) total_monthly_hrs FROM area")
def _(s):
    table = s.area.select("city", "fl_count", "setup_count", "required_run_days", "total_monthly_hrs")
    path = tables.new_path(s.domain.spark, "csv")
    if not files.write_if_any(table, path):
        return rounded(table)
    return rounded(files.read_typed(s.domain.spark, path, table.schema))


@query("snk_4_report", "SELECT (SELECT count(*) FROM stub) fls, (SELECT count(*) FROM applied) setups, (SELECT count(*) FROM cap) slots, (SELECT count(DISTINCT tech) FROM stub) techs, TRUE AS readable")
def _(s):
    # One page holds what a person reads, so the whole schedule takes as many pages as it needs.
    pages = files.report_pages(s.stub(), slots.apply_slots(s.assigned, s.stub()), _cap(s))
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    techs = F.countDistinct(F.when(F.col("fls") > 0, F.col("tech"))).alias("techs")
    return pages.drop("html").agg(count("fls"), count("setups"), count("slots"), techs, F.coalesce(F.bool_and("readable"), F.lit(True)).alias("readable"))


# Operators that the design documents specify -----------------------------------------------------------------------------
for _name, (_build, _sql) in spec.queries(_done, slots, F, r).items():
    query(_name, _sql)(_build)
