"""CSV and report files: all-string or typed scans, display names at the edges, guarded writes."""

from __future__ import annotations

import html
import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roundsmith.functions.workload import heat_band, normalised
from roundsmith.operators import slots

#: Display names of the export, in its order, and the names used inside.
DISPLAY_NAMES = {
    "booking_setup_id": "%booking_setup_id", "fl_id": "%FL_id", "setup_branch": "%setup_branch", "division": "division", "service_branch": "service_branch",
    "billing_account": "billing_account", "fl_name": "FL_name", "latitude": "latitude", "longitude": "longitude", "address": "Address 1", "city": "city",
    "products": "products", "setup_value": "setup_value", "setup_quantity": "setup_quantity", "current_duration": "Current Duration", "new_duration": "~New Duration",
    "recurrence_frequency": "Recurrence Frequency", "num_recurrences": "num_recurrences", "frequency_type": "%frequency_type", "dow_number": "%recc_dow_number",
    "week_number": "%recc_week_number", "start_date": "%start_date", "is_valid_start_date": "%is_valid_start_date", "current_pattern": "Current Date Pattern",
    "serviced_pattern": "Serviced Date Pattern", "pattern_count": "%NoOfPattern", "new_date_pattern": "*New Date Pattern", "drop_month": "~Drop Month", "on_agb": "*On AGB?",
    "preferred_resource": "*Preferred Resource", "most_serviced_tech": "Most Serviced Tech", "full_history": "Full History",
}


def read_strings(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Every column as text, header names stripped of blanks and byte-order marks, blank spellings to NULL."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)
    return rows.select(*(normalised(F.col(f"`{c}`")).alias(c.strip().lstrip("﻿")) for c in columns))


def read_typed(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def to_display(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).alias(DISPLAY_NAMES.get(c, c)) for c in df.columns))


def from_display(df: DataFrame) -> DataFrame:
    inside = {v: k for k, v in DISPLAY_NAMES.items()}
    return df.select(*(F.col(f"`{c}`").alias(inside.get(c.strip(), c.strip())) for c in df.columns))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_if_any(df: DataFrame, path: str) -> bool:
    """Write only when there is a row; says whether it did."""
    if df.isEmpty():
        return False
    write_csv(df, path)
    return True


def report_payload(placed: DataFrame, applied: DataFrame, slot_loads: DataFrame, most: int = 200_000) -> dict:
    """What the report shows, as plain values: sites with their setups, slot loads, and the choices in their order.

    A page is read by a person, so it holds at most ``most`` sites; ``report_pages`` makes as many pages as a larger schedule takes.
    """
    records = slots.site_records(applied, placed)
    if records.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} sites are too many for one page")
    setup = lambda x: F.struct(x["booking_setup_id"].alias("id"), x["freq"].alias("freq"), x["duration"].alias("minutes"), x["pattern"].alias("pattern"))
    fls = records.select("fl_id", F.col("fl_name").alias("name"), "city", "tech", "week", "day", F.round("monthly_hrs", 2).alias("hrs"), "is_outlier", F.transform("setup_list", setup).alias("setups"))
    loads = slot_loads.select("tech", "week", "day", F.col("load_hrs").alias("load"), "over_capacity", heat_band(F.col("load_hrs")).alias("band"))
    lists = slots.filter_lists(placed, applied).orderBy("list", "position").collect()
    held = {name: [r.value for r in lists if r.list == name] for name in ("tech", "freq", "city")}
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    return {"fls": rows(fls.orderBy("tech", "fl_id")), "slots": rows(loads.orderBy("tech", "week", "day")), "techs": held["tech"], "freqs": held["freq"], "cities": held["city"]}


def report_pages(placed: DataFrame, applied: DataFrame, slot_loads: DataFrame, per_page: int = 500, title: str = "Schedule") -> DataFrame:
    """A whole schedule as pages of some ``per_page`` sites of one technician each: tech, part, html, and what a page holds when it is read again.

    Every site is on one page, with all its setups; a technician's slots are on the first page (part 0), also where no
    site is on it.  A page offers the choices of its own rows.  Pages are made and read by the executors; ``fls``, ``setups`` and ``slots``
    count what was read, ``readable`` says whether it is what was to be shown.
    """
    setup = F.transform("setup_list", lambda x: F.struct(x["booking_setup_id"].alias("id"), x["freq"].alias("freq"), x["duration"].alias("minutes"), x["pattern"].alias("pattern")))
    fl = F.struct("fl_id", F.col("fl_name").alias("name"), "city", "tech", "week", "day", F.round("monthly_hrs", 2).alias("hrs"), "is_outlier", setup.alias("setups"))
    slot = F.struct("tech", "week", "day", F.col("load_hrs").alias("load"), "over_capacity", heat_band(F.col("load_hrs")).alias("band"))
    parts = placed.groupBy(F.col("tech").alias("of")).agg(F.ceil(F.count("*") / per_page).cast("int").alias("parts"))
    sites = slots.site_records(applied, placed).join(parts, F.col("tech").eqNullSafe(F.col("of")))
    text = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
    sites = sites.select("tech", F.pmod(F.xxhash64("fl_id"), F.col("parts")).cast("int").alias("part"), F.lit("fl").alias("kind"), text(fl).alias("row"))
    rows = sites.union(slot_loads.select("tech", F.lit(0).alias("part"), F.lit("slot").alias("kind"), text(slot).alias("row")))

    def page(group: pd.DataFrame) -> pd.DataFrame:
        tech, part = group["tech"].iloc[0], int(group["part"].iloc[0])
        fls = sorted(map(json.loads, group["row"][group["kind"] == "fl"]), key=lambda x: x["fl_id"])
        loads = sorted(map(json.loads, group["row"][group["kind"] == "slot"]), key=lambda x: (x["week"], x["day"]))
        for f in fls:
            f["setups"] = f["setups"] or []
        freqs, cities = {s["freq"] for f in fls for s in f["setups"]}, {f["city"] for f in fls}
        held = {"fls": fls, "slots": loads, "techs": [] if tech is None else [tech], "freqs": sorted(freqs - {None}), "cities": sorted(cities - {None})}
        made = report_page(held, f"{title}: {tech}, part {part + 1}")
        back = payload_of(made)
        return pd.DataFrame({"tech": [tech], "part": [part], "html": [made], "fls": [len(back["fls"])], "setups": [sum(len(f["setups"]) for f in back["fls"])], "slots": [len(back["slots"])], "readable": [back == held]})

    return rows.groupBy("tech", "part").applyInPandas(page, "tech string, part int, html string, fls long, setups long, slots long, readable boolean")


#: The page shows values as text nodes only, so no name can be markup.
_PAGE = """<!DOCTYPE html><html><head><meta charset="utf-8"><title>{title}</title>
<style>table{{border-collapse:collapse}}td,th{{border:1px solid #ccc;padding:2px 6px}}.b0{{background:#fff}}.b1{{background:#eef}}.b2{{background:#ffd}}.b3{{background:#fda}}.b4{{background:#f88}}</style></head><body>
<h1>{title}</h1><p id="stats"></p>
<p><input id="q" placeholder="site or city"><select id="tech" multiple></select><select id="day" multiple></select><select id="week" multiple></select><select id="freq" multiple></select></p>
<h2>Loads</h2><table id="heat"></table><h2>Slots over capacity</h2><table id="over"></table><h2>Sites</h2><table id="sites"></table>
<script id="data" type="application/json">{data}</script>
<script>const data = JSON.parse(document.getElementById("data").textContent);
const DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday"], WEEKS = [1, 2, 3, 4], BANDS = ["light", "over 6", "over 8", "over 10", "over 12"];
const el = id => document.getElementById(id), chosen = id => new Set([...el(id).selectedOptions].map(o => o.value));
const fill = (id, values) => values.forEach(v => {{ const o = document.createElement("option"); o.textContent = o.value = v; el(id).append(o); }});
fill("tech", data.techs); fill("day", DAYS); fill("week", WEEKS); fill("freq", data.freqs);
const row = (table, values, classes = []) => {{ const r = table.insertRow(); values.forEach((v, i) => {{ const c = r.insertCell(); c.textContent = v; c.className = classes[i] || ""; }}); }};
const show = () => {{
  const techs = chosen("tech"), days = chosen("day"), weeks = chosen("week"), freqs = chosen("freq"), q = el("q").value.toLowerCase();
  const any = (set, v) => set.size === 0 || v === null || v === "" || set.has(String(v));
  const fls = data.fls.filter(f => any(techs, f.tech) && any(days, f.day) && any(weeks, f.week) && (freqs.size === 0 || f.setups.some(s => any(freqs, s.freq)))
    && ((f.name || "") + " / " + (f.city || "")).toLowerCase().includes(q));
  const slots = data.slots.filter(s => any(techs, s.tech)), over = slots.filter(s => s.over_capacity || s.load > 8);
  el("stats").textContent = fls.length + " sites, " + fls.reduce((a, f) => a + f.hrs, 0).toFixed(1) + " hours a month, " + new Set(fls.map(f => f.tech)).size + " technicians, " + over.length + " slots over capacity";
  ["heat", "over", "sites"].forEach(id => el(id).replaceChildren());
  row(el("heat"), ["", ...WEEKS.flatMap(w => DAYS.map(d => w + "-" + d.slice(0, 3)))]);
  data.techs.filter(t => any(techs, t)).forEach(t => {{
    const of = WEEKS.flatMap(w => DAYS.map(d => slots.find(s => s.tech === t && s.week === w && s.day === d)));
    row(el("heat"), [t, ...of.map(s => s ? s.load : "")], ["", ...of.map(s => s ? "b" + BANDS.indexOf(s.band) : "")]); }});
  over.forEach(s => row(el("over"), [s.tech, s.week, s.day, s.load]));
  fls.forEach(f => row(el("sites"), [f.name, f.city, f.tech, f.week, f.day, f.hrs, f.is_outlier ? "outlier" : "", f.setups.length]));
}};
["tech", "day", "week", "freq"].forEach(id => el(id).onchange = show); el("q").oninput = show; show();</script></body></html>"""


def report_page(payload: dict, title: str = "Schedule") -> str:
    """A self-contained page around a report payload."""
    return _PAGE.format(title=html.escape(title), data=json.dumps(payload, sort_keys=True).replace("<", "\\u003c"))


def payload_of(page: str) -> dict:
    """The payload that a page holds."""
    mark = '<script id="data" type="application/json">'
    begin = page.index(mark) + len(mark)
    return json.loads(page[begin:page.index("</script>", begin)])


def write_report(payload: dict, path: str, title: str = "Schedule") -> dict:
    """Writes the page; the size report: characters, kilobytes, sites, slots."""
    page = report_page(payload, title)
    with open(path, "w", encoding="utf-8") as file:
        file.write(page)
    return {"characters": len(page), "kilobytes": round(len(page.encode()) / 1024, 1), "sites": len(payload["fls"]), "slots": len(payload["slots"])}
