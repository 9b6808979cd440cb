"""Operators that the design documents specify but nobody implemented there (spec-derived; open points decided here)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roundsmith.functions import geo
from roundsmith.functions.recurrence import day_of_week, nth_weekday
from roundsmith.operators.assign import rosters


def projection(derived: DataFrame, months: int = 12) -> DataFrame:
    """Booking dates of week-pattern setups over the months from their start: (booking_setup_id, date)."""
    own = derived.where("frequency_type = 'Monthly - Week Pattern' AND start_date IS NOT NULL AND num_recurrences > 0")
    steps = F.explode(F.sequence(F.lit(0), F.lit(months - 1), F.col("num_recurrences")))
    out = own.withColumn("k", steps).withColumn("month", F.add_months(F.trunc("start_date", "MM"), F.col("k")))
    date = nth_weekday(F.col("month"), F.col("weekday").try_cast("int"), F.col("weekdef").try_cast("int"))
    return out.select("booking_setup_id", "fl_id", date.alias("date")).where("date IS NOT NULL")


def projected(derived: DataFrame, months: int = 12) -> DataFrame:
    """Booking dates of every rule over the months from its start: (booking_setup_id, fl_id, date).

    Weekly rules run from the start on each of their days for 365 / 12 days a month; monthly fixed dates fall on the last day of shorter
    months; yearly rules come once.
    """
    days = 365 * months // 12
    some = derived.where("start_date IS NOT NULL AND num_recurrences > 0")
    start, n = F.col("start_date"), F.col("num_recurrences")
    every = lambda first, step: F.explode(F.sequence(first, F.lit(days - 1), step))
    daily = some.where("frequency_type = 'Daily'").withColumn("k", every(F.lit(0), n))
    on_days = some.where("frequency_type IN ('Weekly', 'Weekly - Multi Day')").withColumn("d", F.explode("days"))
    offset = F.pmod(F.col("d").try_cast("int") - day_of_week(start) + 7, F.lit(7))
    weekly = on_days.where(offset.isNotNull()).withColumn("k", every(offset, n * 7))
    by_day = daily.select("booking_setup_id", "fl_id", F.date_add(start, F.col("k")).alias("date")).union(weekly.select("booking_setup_id", "fl_id", F.date_add(start, F.col("k"))))
    fixed = some.where("frequency_type = 'Monthly - Fixed Date' AND try_cast(month_day AS int) > 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(months - 1), n)))
    month = F.add_months(F.trunc("start_date", "MM"), F.col("k"))
    in_month = fixed.select("booking_setup_id", "fl_id", F.least(F.date_add(month, F.col("month_day").try_cast("int") - 1), F.last_day(month)).alias("date"))
    yearly = some.where("frequency_type = 'Yearly'").select("booking_setup_id", "fl_id", start.alias("date"))
    return projection(derived, months).union(by_day).union(in_month).union(yearly)


def projected_load(derived: DataFrame, months: int = 12) -> DataFrame:
    """Projected bookings by area, frequency, technician and month."""
    of = derived.select("booking_setup_id", F.coalesce("city", F.lit("")).alias("city"), "recurrence_frequency", F.coalesce("preferred_resource", F.lit("")).alias("resource"))
    return projected(derived, months).join(of, "booking_setup_id").groupBy("city", "recurrence_frequency", "resource", F.trunc("date", "MM").alias("month")).agg(F.count("*").alias("bookings"))


def visit_minutes(bookings: DataFrame, minutes: DataFrame | None = None, start_minutes: float = 5.0) -> DataFrame:
    """Five minutes of site start are shared by the bookings of a site and day; with ``minutes(booking_setup_id, minutes)``, the whole visit's."""
    same = Window.partitionBy("fl_id", "date")
    out = bookings.withColumn("overhead", start_minutes / F.count("*").over(same))
    if minutes is None:
        return out
    return out.join(minutes, "booking_setup_id").withColumn("visit_minutes", F.sum("minutes").over(same) + start_minutes)


def product_minutes(products: DataFrame, lookup: DataFrame) -> DataFrame:
    """Minutes of each setup's products that are not deleted: quantity times the lookup's minutes per unit; unknown products count nothing."""
    held = products.where("is_delete IS NULL").join(lookup, "product_id", "left")
    return held.groupBy("booking_setup_id").agg(F.coalesce(F.sum(F.col("quantity") * F.col("minutes_per_unit")), F.lit(0.0)).alias("minutes"))


def long_frequency(label):
    """Week rules that are better month rules."""
    return F.when(label == "52 Weekly", "12 Monthly").when(label == "26 Weekly", "6 Monthly")


CALENDAR_RULES, WEEK_RULES = ("Monthly - Fixed Date", "Yearly", "Daily"), ("Weekly", "Weekly - Multi Day", "Monthly - Week Pattern")


def conformance(derived: DataFrame, by_calendar=None) -> DataFrame:
    """Setups whose rule is of the other stream's kind: week streams must not be anchored to calendar dates, calendar streams not to weeks.

    ``by_calendar`` tells the calendar stream's setups; without it all are of the week stream.
    """
    calendar = F.lit(False) if by_calendar is None else by_calendar
    kind = F.col("frequency_type")
    wrong = F.when(~calendar & kind.isin(*CALENDAR_RULES), F.concat(F.lit("calendar rule: "), kind)).when(calendar & kind.isin(*WEEK_RULES), F.concat(F.lit("week rule: "), kind))
    return derived.select("booking_setup_id", wrong.alias("violation")).where("violation IS NOT NULL")


def anchors(assigned: DataFrame) -> DataFrame:
    """Each site's anchor: the setup with most services a year (ties: the smallest id), its technician and its day."""
    best = F.max_by(F.struct("booking_setup_id", "tech", "dow_name"), F.struct(F.coalesce("services_per_year", F.lit(0.0)), -F.col("booking_setup_id")))
    return assigned.groupBy("fl_id").agg(best.alias("b")).select("fl_id", F.col("b.booking_setup_id").alias("anchor_setup"), F.col("b.tech").alias("anchor_tech"), F.col("b.dow_name").alias("anchor_day"))


def aligned(assigned: DataFrame) -> DataFrame:
    """Every setup with its site's anchor, and whether technician or day change when it follows the anchor."""
    out = assigned.join(anchors(assigned), "fl_id")
    moves = (F.col("tech") != F.col("anchor_tech")) | (F.col("dow_name") != F.col("anchor_day"))
    return out.select("booking_setup_id", "fl_id", "anchor_setup", "anchor_tech", "anchor_day", moves.alias("changes"))


def day_adjacency(placed: DataFrame) -> DataFrame:
    """Kilometres between the centres of a technician's consecutive days."""
    order = F.array_position(F.array(*map(F.lit, ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday"))), F.col("day"))
    c = placed.groupBy("tech", "day").agg(F.avg("latitude").alias("la"), F.avg("longitude").alias("lo")).withColumn("o", order)
    by = Window.partitionBy("tech").orderBy("o")
    return c.select("tech", "day", geo.haversine(F.lag("la").over(by), F.lag("lo").over(by), F.col("la"), F.col("lo")).alias("km"))


def stable_changes(before: DataFrame, after: DataFrame, least_gain: float) -> DataFrame:
    """Keep the current slot unless the change gains ``least_gain`` kilometres: before/after(tech, fl_id, slot, km)."""
    both = before.join(after.select("tech", "fl_id", F.col("slot").alias("new_slot"), F.col("km").alias("new_km")), ["tech", "fl_id"])
    return both.withColumn("decision", F.when((F.col("slot") != F.col("new_slot")) & (F.col("km") - F.col("new_km") >= least_gain), "change").otherwise("keep"))


def change_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of (tech, fl_id, slot) that differ between two runs."""
    a, b = before.select("tech", "fl_id", F.col("slot").alias("was")), after.select("tech", "fl_id", F.col("slot").alias("now"))
    return a.join(b, ["tech", "fl_id"], "full_outer").where(~F.col("was").eqNullSafe(F.col("now")))


def change_rate(before: DataFrame, after: DataFrame) -> DataFrame:
    """Percent of (tech, fl_id) of either run whose slot differs."""
    all_rows = before.select("tech", "fl_id").union(after.select("tech", "fl_id")).distinct().agg(F.count("*").alias("n"))
    return change_diff(before, after).agg(F.count("*").alias("changed")).join(all_rows).select("changed", (F.col("changed") / F.col("n") * 100).alias("pct"))


def seasonal_load(bookings: DataFrame) -> DataFrame:
    """Bookings per month and whether the month holds a tenth more than the mean month."""
    months = bookings.groupBy(F.trunc("date", "MM").alias("month")).agg(F.count("*").alias("n"))
    mean = months.agg(F.avg("n").alias("mean"))
    return months.join(F.broadcast(mean)).select("month", "n", (F.col("n") > 1.1 * F.col("mean")).alias("over"))


def staggered(bookings: DataFrame) -> DataFrame:
    """Smoothing by the least shift: a crowded month gives what exceeds a tenth over the mean to the month after it, as far as that has room; the rest is flagged.

    (month, n, shifted, flagged); the setups that shift are the month's last ones by date and id.
    """
    months = seasonal_load(bookings)
    limit = months.agg(F.floor(1.1 * F.avg("n")).alias("limit"))
    nxt = months.select(F.add_months("month", -1).alias("month"), F.col("n").alias("after"))
    full = months.join(F.broadcast(limit)).join(nxt, "month", "left")
    excess, room = F.greatest(F.col("n") - F.col("limit"), F.lit(0)), F.greatest(F.col("limit") - F.coalesce("after", F.lit(0)), F.lit(0))
    return full.select("month", "n", F.least(excess, room).alias("shifted"), (excess - F.least(excess, room)).alias("flagged"))


def shifted_bookings(bookings: DataFrame) -> DataFrame:
    """The bookings that staggering moves, with their new month."""
    by = Window.partitionBy("month").orderBy(F.desc("date"), F.desc("booking_setup_id"))
    ranked = bookings.withColumn("month", F.trunc("date", "MM")).withColumn("rank", F.row_number().over(by))
    moved = ranked.join(F.broadcast(staggered(bookings).where("shifted > 0").select("month", "shifted")), "month").where("rank <= shifted")
    return moved.select("booking_setup_id", "date", F.add_months("month", 1).alias("to_month"))


def boundary_sites(placed: DataFrame, centres: DataFrame, gap_km: float, **thinning) -> DataFrame:
    """Sites whose own technician's centre is hardly nearer (by less than ``gap_km``) than the nearest other one; centres(tech, c_lat, c_lon)."""
    km = lambda c: geo.haversine(F.col("latitude"), F.col("longitude"), c["c_lat"], c["c_lon"])
    own = placed.select("tech", "fl_id", "latitude", "longitude").join(centres.select("tech", "c_lat", "c_lon"), "tech")
    own = own.withColumn("own_km", geo.haversine(F.col("latitude"), F.col("longitude"), F.col("c_lat"), F.col("c_lon"))).drop("c_lat", "c_lon").withColumnRenamed("tech", "of")
    found = rosters(own, centres, nth=2, **thinning)
    others = F.transform(F.filter("roster", lambda c: c["tech"] != F.col("of")), lambda c: F.struct(km(c).alias("km"), c["tech"].alias("of")))
    out = found.withColumn("other", F.array_min(others))
    return out.select(F.col("of").alias("tech"), "fl_id", F.col("other.of").alias("other"), (F.col("other.km") - F.col("own_km")).alias("gap")).where(F.col("gap") < gap_km)


def travel(placed: DataFrame) -> DataFrame:
    """Straight-line kilometres between a slot's stops from west to east (ties by site): tech, week, day, stops, km. Homes are unknown."""
    by = Window.partitionBy("tech", "week", "day").orderBy("longitude", "fl_id")
    leg = geo.haversine(F.lag("latitude").over(by), F.lag("longitude").over(by), F.col("latitude"), F.col("longitude"))
    return placed.withColumn("leg", leg).groupBy("tech", "week", "day").agg(F.count("*").alias("stops"), F.coalesce(F.sum("leg"), F.lit(0.0)).alias("km"))


def queries(done, slots, F, r) -> dict:
    """name → (query over a schedule, DuckDB SQL)."""

    def visits(s):
        return done(s).select("booking_setup_id", "fl_id", F.to_date("completed_on").alias("d"), "tech_name").distinct()

    def hours(s):
        return s.stub().groupBy("tech").agg(F.sum("monthly_hrs").alias("h"))

    slot = lambda df: df.withColumn("slot", F.concat_ws("-", "week", "day"))
    shifted = lambda s: slot(s.stub().where("fl_id % 23 <> 0").withColumn("week", F.when(F.col("fl_id") % 7 == 0, F.col("week") % 4 + 1).otherwise(F.col("week"))))
    km = "2*6371.0*asin(sqrt(least(1.0, pow(sin(radians(la-p1)/2),2)+cos(radians(p1))*cos(radians(la))*pow(sin(radians(lo-p2)/2),2))))"
    proj = "SELECT booking_setup_id, fl_id, (m + ((wd::INT - dayofweek(m) + 7) % 7 + (wf::INT-1)*7)::INT) AS date FROM (SELECT booking_setup_id, fl_id, wd, wf, (date_trunc('month', start_date) + to_months(k::INT))::DATE m FROM (SELECT *, unnest(range(0, 12, num_recurrences)) k FROM derived WHERE frequency_type = 'Monthly - Week Pattern' AND start_date IS NOT NULL))"
    minutes = lambda s: s.derived.select("booking_setup_id", F.coalesce("new_duration", "service_duration").cast("double").alias("minutes"))
    whole = f"""{proj} UNION ALL SELECT booking_setup_id, fl_id, start_date + k::INT FROM (SELECT *, unnest(range(0, 365, num_recurrences)) k FROM derived WHERE frequency_type = 'Daily' AND start_date IS NOT NULL)
  UNION ALL SELECT booking_setup_id, fl_id, start_date + k::INT FROM (SELECT *, unnest(range(((d::INT - dayofweek(start_date) + 7) % 7)::BIGINT, 365, num_recurrences*7)) k FROM (SELECT *, unnest(days) d FROM derived WHERE frequency_type IN ('Weekly','Weekly - Multi Day') AND start_date IS NOT NULL))
  UNION ALL SELECT booking_setup_id, fl_id, least(m + (dy::INT - 1), last_day(m)) FROM (SELECT booking_setup_id, fl_id, dy, (date_trunc('month', start_date) + to_months(k::INT))::DATE m FROM (SELECT *, unnest(range(0, 12, num_recurrences)) k FROM derived WHERE frequency_type = 'Monthly - Fixed Date' AND start_date IS NOT NULL))
  UNION ALL SELECT booking_setup_id, fl_id, start_date FROM derived WHERE frequency_type = 'Yearly' AND start_date IS NOT NULL"""
    far = km.replace("p1", "s.latitude").replace("p2", "s.longitude")
    centre_of = "(SELECT tech, week, day, avg(latitude) la, avg(longitude) lo FROM stub GROUP BY ALL)"
    over = f"(SELECT *, floor(1.1*avg(n) OVER ()) lim FROM (SELECT date_trunc('month', date)::DATE AS month, count(*) n FROM ({proj}) GROUP BY 1))"
    stag = f"SELECT a.month, a.n, least(greatest(a.n-a.lim,0), greatest(a.lim-coalesce(b.n,0),0))::BIGINT shifted, (greatest(a.n-a.lim,0)-least(greatest(a.n-a.lim,0), greatest(a.lim-coalesce(b.n,0),0)))::BIGINT flagged FROM {over} a LEFT JOIN {over} b ON b.month = (a.month + INTERVAL 1 MONTH)::DATE"
    slot_km = lambda s: s.stub().groupBy("tech", "week", "day").agg(F.avg("latitude").alias("la"), F.avg("longitude").alias("lo"))

    def with_km(s, placed):
        joined = slot(placed.select("tech", "fl_id", "latitude", "longitude", "week", "day").join(slot_km(s), ["tech", "week", "day"]))
        return joined.select("tech", "fl_id", "slot", geo.haversine(F.col("latitude"), F.col("longitude"), F.col("la"), F.col("lo")).alias("km"))

    return {
        "spec_1_projection": (lambda s: projection(s.derived), proj),
        "spec_1_projected_load": (lambda s: projected_load(s.derived), f"SELECT coalesce(city,'') city, recurrence_frequency, coalesce(preferred_resource,'') resource, date_trunc('month', date)::DATE AS month, count(*) bookings FROM ({whole}) JOIN derived USING (booking_setup_id) GROUP BY ALL"),
        "spec_2_visit_minutes": (lambda s: visit_minutes(projection(s.derived), minutes(s)).select("booking_setup_id", "date", r(F.col("visit_minutes")).alias("visit_minutes")), f"SELECT booking_setup_id, date, round(sum(coalesce(new_duration, service_duration)::DOUBLE) OVER (PARTITION BY p.fl_id, date) + 5.0,6) visit_minutes FROM ({proj}) p JOIN (SELECT booking_setup_id, new_duration, service_duration FROM derived) USING (booking_setup_id)"),
        "spec_5_aligned": (lambda s: aligned(s.assigned), "SELECT booking_setup_id, fl_id, anchor_setup, anchor_tech, anchor_day, tech <> anchor_tech OR dow_name <> anchor_day AS changes FROM assigned JOIN (SELECT fl_id, arg_max(booking_setup_id, (coalesce(services_per_year,0), -booking_setup_id)) anchor_setup, arg_max(tech, (coalesce(services_per_year,0), -booking_setup_id)) anchor_tech, arg_max(dow_name, (coalesce(services_per_year,0), -booking_setup_id)) anchor_day FROM assigned GROUP BY 1) USING (fl_id)"),
        "spec_7_stable_changes": (
            lambda s: stable_changes(with_km(s, s.stub()), with_km(s, shifted(s)), 5.0).select("tech", "fl_id", "slot", "new_slot", "decision"),
            f"SELECT b.tech, b.fl_id, b.slot, a.slot new_slot, CASE WHEN b.slot <> a.slot AND b.km - a.km >= 5 THEN 'change' ELSE 'keep' END decision FROM (SELECT s.tech, s.fl_id, s.week||'-'||s.day AS slot, {far} AS km FROM stub s JOIN {centre_of} c USING (tech, week, day)) b JOIN (SELECT s.tech, s.fl_id, s.w||'-'||s.day AS slot, {far} AS km FROM (SELECT *, CASE WHEN fl_id % 7 = 0 THEN week % 4 + 1 ELSE week END w FROM stub WHERE fl_id % 23 <> 0) s JOIN {centre_of} c ON c.tech = s.tech AND c.week = s.w AND c.day = s.day) a USING (tech, fl_id)",
        ),
        "spec_8_staggered": (lambda s: staggered(projection(s.derived)), stag),
        "spec_8_shifted_bookings": (lambda s: shifted_bookings(projection(s.derived)), f"SELECT booking_setup_id, date, (month + INTERVAL 1 MONTH)::DATE to_month FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY date DESC, booking_setup_id DESC) rk FROM (SELECT booking_setup_id, date, date_trunc('month', date)::DATE AS month FROM ({proj}))) JOIN (SELECT month, shifted FROM ({stag})) USING (month) WHERE rk <= shifted"),
        "spec_10_boundary_sites": (
            lambda s: boundary_sites(s.stub(), s.centroids, 5.0).select("tech", "fl_id", "other", r(F.col("gap"), 4).alias("gap")),
            f"SELECT * FROM (SELECT tech, fl_id, arg_min(o, (km, o)) FILTER (o <> tech) other, round(min(km) FILTER (o <> tech) - min(km) FILTER (o = tech), 4) gap FROM (SELECT s.tech, s.fl_id, c.tech o, {far.replace('la', 'c_lat').replace('c_lattitude', 'latitude').replace('lo-', 'c_lon-')} km FROM stub s, centre c) GROUP BY 1, 2) WHERE gap < 5",
        ),
        "spec_14_travel": (
            lambda s: travel(s.stub()).select("tech", "week", "day", "stops", r(F.col("km"), 4).alias("km")),
            f"SELECT tech, week, day, count(*) stops, round(coalesce(sum({km.replace('la', 'latitude').replace('lo-', 'longitude-')}),0),4) km FROM (SELECT *, lag(latitude) OVER w p1, lag(longitude) OVER w p2 FROM stub WINDOW w AS (PARTITION BY tech, week, day ORDER BY longitude, fl_id)) GROUP BY ALL",
        ),
        "spec_17_change_rate": (lambda s: change_rate(slot(s.stub()), shifted(s)).select("changed", r(F.col("pct")).alias("pct")), "SELECT count(*) FILTER (fl_id % 23 = 0 OR fl_id % 7 = 0) changed, round(count(*) FILTER (fl_id % 23 = 0 OR fl_id % 7 = 0) / count(*) * 100, 6) pct FROM stub"),
        "spec_2_site_start_overhead": (lambda s: visit_minutes(projection(s.derived)).select("booking_setup_id", "date", r(F.col("overhead")).alias("overhead")), f"SELECT booking_setup_id, date, round(5.0/count(*) OVER (PARTITION BY fl_id, date),6) overhead FROM ({proj})"),
        "spec_3_product_minutes": (lambda s: product_minutes(s.domain.table("product"), s.domain.table("product_minutes")).select("booking_setup_id", r(F.col("minutes"), 4).alias("minutes")), "SELECT booking_setup_id, round(coalesce(sum(quantity*minutes_per_unit),0),4) AS minutes FROM product LEFT JOIN product_minutes USING (product_id) WHERE is_delete IS NULL GROUP BY 1"),
        "spec_4_conformance": (lambda s: conformance(s.derived, F.col("products") == "1-URGENT"), "SELECT booking_setup_id, CASE WHEN products = '1-URGENT' THEN 'week rule: ' ELSE 'calendar rule: ' END||frequency_type violation FROM derived WHERE CASE WHEN products = '1-URGENT' THEN frequency_type IN ('Weekly','Weekly - Multi Day','Monthly - Week Pattern') ELSE frequency_type IN ('Monthly - Fixed Date','Yearly','Daily') END"),
        "spec_5_anchors": (lambda s: anchors(s.assigned).drop("anchor_day"), "SELECT fl_id, arg_max(booking_setup_id, (coalesce(services_per_year,0), -booking_setup_id)) anchor_setup, arg_max(tech, (coalesce(services_per_year,0), -booking_setup_id)) anchor_tech FROM assigned GROUP BY 1"),
        "spec_6_day_adjacency": (lambda s: day_adjacency(s.stub()).select("tech", "day", r(F.col("km"), 4).alias("km")), f"SELECT tech, day, round({km},4) km FROM (SELECT *, lag(la) OVER (PARTITION BY tech ORDER BY o) p1, lag(lo) OVER (PARTITION BY tech ORDER BY o) p2 FROM (SELECT tech, day, avg(latitude) la, avg(longitude) lo, list_position(['Monday','Tuesday','Wednesday','Thursday','Friday'], day) o FROM stub GROUP BY tech, day))"),
        "spec_8_seasonal_load": (lambda s: seasonal_load(projection(s.derived)), f"SELECT month, n, n > 1.1*avg(n) OVER () AS over FROM (SELECT date_trunc('month', date)::DATE AS month, count(*) n FROM ({proj}) GROUP BY 1)"),
        "spec_9_tech_overlap": (lambda s: visits(s).groupBy("fl_id", "d").agg(F.countDistinct("tech_name").alias("techs")).where("techs > 1"), "SELECT fl_id, d, count(DISTINCT tech_name) techs FROM visits GROUP BY ALL HAVING count(DISTINCT tech_name) > 1"),
        "spec_10_loaded_runs": (lambda s: slots.search_load(s.stub()).withColumn("h", r(F.col("load_hrs"))).where("h > 8 OR h < 1").select("tech", "week", "day", F.when(F.col("h") > 8, "over").otherwise("under").alias("finding")), "SELECT tech, week, day, CASE WHEN h > 8 THEN 'over' ELSE 'under' END finding FROM (SELECT tech, week, day, round(sum(monthly_hrs),6) h FROM stub GROUP BY ALL) WHERE h > 8 OR h < 1"),
        "spec_11_coverage_gaps": (lambda s: s.domain.table("agreement").join(s.domain.setups.where("auto_generate = 1"), "agreement_id", "left_anti").select("agreement_id"), "SELECT agreement_id FROM agreement WHERE agreement_id NOT IN (SELECT agreement_id FROM setup WHERE auto_generate = 1)"),
        "spec_12_site_visits": (lambda s: visits(s).select("fl_id", "d").distinct().groupBy(F.trunc("d", "MM").alias("month")).agg(F.count("*").alias("visits")), "SELECT date_trunc('month', d)::DATE AS month, count(DISTINCT (fl_id, d)) visits FROM visits GROUP BY 1"),
        "spec_13_site_overlap_rate": (lambda s: s.assigned.groupBy("fl_id").agg(F.countDistinct("tech").alias("t")).agg(r(F.avg((F.col("t") > 1).cast("double")) * 100).alias("pct")), "SELECT round(avg((t>1)::INT)*100,6) pct FROM (SELECT count(DISTINCT tech) t FROM assigned GROUP BY fl_id)"),
        "spec_15_workload_variance": (lambda s: s.stub().groupBy("tech", "day").agg(F.sum("monthly_hrs").alias("h")).groupBy("day").agg(r(F.var_pop("h"), 4).alias("variance")), "SELECT day, round(var_pop(h),4) variance FROM (SELECT tech, day, sum(monthly_hrs) h FROM stub GROUP BY ALL) GROUP BY 1"),
        "spec_17_change_diff": (lambda s: change_diff(slot(s.stub()), shifted(s)), "SELECT a.tech, a.fl_id, a.week||'-'||a.day was, b.now FROM stub a LEFT JOIN (SELECT tech, fl_id, CASE WHEN fl_id % 7 = 0 THEN week % 4 + 1 ELSE week END||'-'||day now FROM stub WHERE fl_id % 23 <> 0) b USING (tech, fl_id) WHERE a.week||'-'||a.day IS DISTINCT FROM b.now"),
        "spec_16_locked_compliance": (lambda s: slot(s.stub()).where("fl_id % 3 = 0").join(shifted(s).select("tech", "fl_id", F.col("slot").alias("now")), ["tech", "fl_id"]).agg(r(F.avg((F.col("slot") == F.col("now")).cast("double")) * 100).alias("pct")), "SELECT round(avg((fl_id % 7 <> 0)::INT)*100,6) pct FROM stub WHERE fl_id % 3 = 0 AND fl_id % 23 <> 0"),
        "spec_18_utilisation_range": (lambda s: hours(s).agg(r(F.max("h") - F.min("h")).alias("hours")), "SELECT round(max(h)-min(h),6) AS hours FROM (SELECT sum(monthly_hrs) h FROM stub GROUP BY tech)"),
        "spec_19_activation_rate": (lambda s: s.derived.agg(r(F.avg(F.coalesce(F.col("auto_generate") != 0, F.lit(True)).cast("double")) * 100).alias("pct")), "SELECT round(avg(CASE WHEN auto_generate = 0 THEN 0 ELSE 1 END)*100,6) pct FROM latest"),
        "spec_20_long_frequency": (lambda s: s.derived.select("booking_setup_id", long_frequency(F.col("recurrence_frequency")).alias("better")), "SELECT booking_setup_id, CASE recurrence_frequency WHEN '52 Weekly' THEN '12 Monthly' WHEN '26 Weekly' THEN '6 Monthly' END better FROM derived"),
        "spec_21_branch_mismatch": (lambda s: s.derived.where("branch_id IS DISTINCT FROM service_branch_id").select("booking_setup_id", "branch_id", "service_branch_id"), "SELECT booking_setup_id, branch_id, service_branch_id FROM latest WHERE branch_id IS DISTINCT FROM service_branch_id"),
    }
