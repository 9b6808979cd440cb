"""The recurrence calculus as Column functions, layered so that each regular expression runs once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roundsmith.config import DAY_NAMES, DEFAULT, SchedulingConfig


def some_text(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def tag_text(rule: Column, tag: str) -> Column:
    """Text of the first element of that name; NULL without one."""
    return some_text(F.regexp_extract(rule, f"<{tag}>([^<]*)</{tag}>", 1))


def every(rule: Column, tag: str) -> Column:
    """The ``every`` attribute of the element."""
    return some_text(F.regexp_extract(rule, f"<{tag}[^>]*?every='([^']+)'", 1))


def daily_every(rule: Column) -> Column:
    """A daily rule's interval is the first ``every`` after its period."""
    return some_text(F.regexp_extract(rule, "(?s)<period>daily.*?every='([^']+)'", 1))


def all_days(rule: Column) -> Column:
    return F.regexp_extract_all(rule, F.lit("<days>([^<]*)</days>"), F.lit(1))


def start_date(rule: Column) -> Column:
    """MM/DD/YYYY; malformed dates are NULL."""
    text = F.regexp_extract(rule, "<start>(.{10})", 1)
    iso = F.concat(F.substring(text, 7, 4), F.lit("-"), F.substring(text, 1, 2), F.lit("-"), F.substring(text, 4, 2))
    return iso.try_cast("date")


def day_of_week(date: Column) -> Column:
    """0 for Sunday to 6 for Saturday."""
    return F.dayofweek(date) - 1


def week_of_month(date: Column) -> Column:
    return F.floor((F.dayofmonth(date) - 1) / 7).cast("int") + 1


def cycle_week(date: Column, anchor: str) -> Column:
    """Place in the four-week cycle, 1 to 4; days before the anchor truncate toward zero."""
    days = F.datediff(date, F.lit(anchor).cast("date"))
    weeks = F.signum(days) * F.floor(F.abs(days) / 7)
    return (F.pmod(weeks.cast("int"), F.lit(4)) + 1).cast("int")


def nth_weekday(date: Column, dow: Column, n: Column) -> Column:
    """The n-th ``dow`` of the date's month."""
    first = F.trunc(date, "MM")
    return F.date_add(first, (F.pmod(dow - day_of_week(first) + 7, F.lit(7)) + (n - 1) * 7).cast("int"))


def day_names(codes: Column) -> Column:
    """'1,3' → 'Monday,Wednesday'; codes outside 0 to 6 stay as they are."""
    names = F.array(*map(F.lit, DAY_NAMES))
    return F.array_join(F.transform(F.split(codes, ","), lambda c: F.when(c.rlike("^[0-6]$"), F.element_at(names, c.try_cast("int") + 1)).otherwise(c)), ",")


def parse(setups: DataFrame) -> DataFrame:
    """Tags of ``rule``: has_*, n_*, days, month_day, weekday, weekdef, start_date."""
    rule = F.col("rule")
    return setups.withColumns({
        "has_years": rule.contains("<years"), "has_daily": rule.contains("<period>daily"), "has_weeks": rule.contains("<weeks"), "has_months": rule.contains("<months"),
        "n_daily": daily_every(rule), "n_weeks": every(rule, "weeks"), "n_months": every(rule, "months"), "days": all_days(rule),
        "month_day": tag_text(rule, "day"), "weekday": tag_text(rule, "weekday"), "weekdef": tag_text(rule, "weekdef"), "start_date": start_date(rule),
    })


def frequency(parsed: DataFrame) -> DataFrame:
    """services_per_year, recurrence_frequency and num_recurrences."""
    c = F.col
    number = lambda x: F.col(x).try_cast("double")
    per_year = (
        F.when(c("has_years"), 1.0)
        .when(c("has_daily"), 365.0)
        .when(c("has_weeks") & c("n_weeks").isNotNull(), F.try_divide(F.lit(52.0), number("n_weeks")) * F.size("days"))
        .when(c("has_months") & c("n_months").isNotNull(), F.try_divide(F.lit(12.0), number("n_months")))
    )
    kinds = (("has_daily", "n_daily", " Daily"), ("has_weeks", "n_weeks", " Weekly"), ("has_months", "n_months", " Monthly"))
    label, count = F.when(c("has_years"), "Yearly"), F.when(c("has_years"), 1)
    for has, n, word in kinds:
        label = label.when(c(has) & c(n).isNotNull(), F.concat(n, F.lit(word)))
        count = count.when(c(has) & c(n).isNotNull(), c(n).try_cast("int"))
    return parsed.withColumns({"services_per_year": F.round(per_year, 2), "recurrence_frequency": label, "num_recurrences": count})


def split_schedule(parsed: DataFrame, all_setups: DataFrame) -> DataFrame:
    """Adds ``split``: another active setup has the same site and products, both run every week, on another day."""
    one = lambda s: s.where(F.col("rule").contains("<weeks every='1'"))
    first_day = F.coalesce(F.get("days", F.lit(0)), F.lit(""))
    other = one(parse(all_setups.where("status = 1"))).where(F.size("days") > 0).select(F.col("fl_id").alias("_fl"), F.col("products").alias("_p"), F.col("booking_setup_id").alias("_id"), first_day.alias("_d"))
    mine = one(parsed).select("booking_setup_id", "fl_id", "products", first_day.alias("d"))
    same = (F.col("fl_id") == F.col("_fl")) & (F.col("products") == F.col("_p")) & (F.col("booking_setup_id") != F.col("_id")) & (F.col("d") != F.col("_d"))
    found = mine.join(other, same, "left_semi").select("booking_setup_id").distinct().withColumn("split", F.lit(True))
    return parsed.join(found, "booking_setup_id", "left").withColumn("split", F.coalesce("split", F.lit(False)))


def classify(parsed: DataFrame) -> DataFrame:
    """frequency_type, in the order of its rules; needs ``split``."""
    c = F.col
    return parsed.withColumn(
        "frequency_type",
        F.when(c("has_years"), "Yearly")
        .when(c("has_daily"), "Daily")
        .when(c("has_weeks") & ((F.size("days") > 1) | c("split")), "Weekly - Multi Day")
        .when(c("has_weeks"), "Weekly")
        .when(c("has_months") & c("rule").contains("<weekdef>"), "Monthly - Week Pattern")
        .when(c("has_months"), "Monthly - Fixed Date"),
    )


def calendar(typed: DataFrame, config: SchedulingConfig = DEFAULT) -> DataFrame:
    """dow_number, dow_name, week_number, is_valid_start_date, drop_month and drop_week."""
    c, start, kind = F.col, F.col("start_date"), F.col("frequency_type")
    number = lambda x: x.try_cast("int")
    first_day = F.get("days", F.lit(0))
    dow = (
        F.when(c("has_daily"), None)
        .when(c("has_weeks") & (F.size("days") > 1), F.array_join(F.slice("days", 1, 4), ","))
        .when(c("has_months"), F.coalesce(number(c("weekday")), day_of_week(start)).cast("string"))
        .when(c("has_weeks"), F.coalesce(number(first_day), number(c("month_day")), number(c("weekday"))).cast("string"))
        .when(c("has_years"), day_of_week(start).cast("string"))
    )
    week = (
        F.when((kind == "Weekly") & start.isNotNull(), cycle_week(start, config.cycle_anchor))
        .when((kind == "Monthly - Week Pattern") & c("weekdef").isNotNull(), number(c("weekdef")))
        .when(kind.isin("Monthly - Fixed Date", "Yearly") & start.isNotNull(), week_of_month(start))
    )
    verdict = lambda ok: F.when(ok, "Valid").otherwise("Invalid")
    valid = (
        F.when(kind.isin("Yearly", "Daily", "Weekly - Multi Day"), "Valid")
        .when((kind == "Weekly") & start.isNotNull() & first_day.isNotNull(), verdict(day_of_week(start) <= number(first_day)))
        .when((kind == "Monthly - Fixed Date") & start.isNotNull() & c("month_day").isNotNull(), verdict(F.dayofmonth(start) <= number(c("month_day"))))
        .when((kind == "Monthly - Week Pattern") & start.isNotNull() & c("weekday").isNotNull(), verdict(start <= nth_weekday(start, number(c("weekday")), number(c("weekdef")))))
    )
    with_week = typed.withColumns({"dow": dow, "week_number": week, "valid": valid})
    month = lambda d: F.date_format(d, "MMMM")
    drop_month = (
        F.when(~kind.isin("Monthly - Fixed Date", "Monthly - Week Pattern", "Yearly"), "N/A")
        .when(c("recurrence_frequency") == "1 Monthly", "N/A")
        .when(c("recurrence_frequency") == "Yearly", month(start))
        .when(c("valid") == "Valid", month(start))
        .when(c("valid") == "Invalid", month(F.add_months(start, 1)))
    )
    drop_week = F.when((kind == "Weekly") & (c("valid") == "Invalid"), c("week_number") % 4 + 1)
    blank = lambda x: F.coalesce(x, F.lit(""))
    return with_week.withColumns({
        "dow_number": blank(c("dow")), "dow_name": blank(day_names(c("dow"))), "is_valid_start_date": blank(c("valid")),
        "drop_month": blank(drop_month), "drop_week": F.coalesce(drop_week, c("week_number")),
    }).drop("dow", "valid")


def derive(setups: DataFrame, all_setups: DataFrame | None = None, config: SchedulingConfig = DEFAULT) -> DataFrame:
    """Every recurrence column of ``setups``; ``all_setups`` is where split schedules are looked up."""
    parsed = split_schedule(parse(setups), setups if all_setups is None else all_setups)
    return calendar(classify(frequency(parsed)), config)
