"""Plans against plain arithmetic and against the kernels: neighbours, rosters, single steps, projections, report."""

import datetime
import random
import tracemalloc
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from roundsmith.config import DAYS, SchedulingConfig
from roundsmith.kernels import cluster, search
from roundsmith.operators import assign, slots, spec, steps
from roundsmith.plans import schedule
from roundsmith.sources import files

PLACED = "tech string, fl_id long, latitude double, longitude double, monthly_hrs double, week int, day string, is_outlier boolean, fl_name string, city string"


def placed(spark, n, seed, techs=("A", "B")):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append((rng.choice(techs), i, -37 + rng.gauss(0, 0.4), 145 + rng.gauss(0, 0.4), rng.expovariate(0.8), rng.randrange(1, 5), rng.choice(DAYS), False, f"site {i}", "town"))
    return rows, spark.createDataFrame(rows, PLACED)


@pytest.mark.parametrize("spread", [0.001, 0.5, 5])
def test_nearest_sites_equal_brute_force(spread):
    rng = np.random.default_rng(1)
    lat, lon, ids = -37 + rng.normal(0, spread, 600), 145 + rng.normal(0, spread, 600), rng.permutation(600)
    lat[:20], lon[:20] = lat[20:40], lon[20:40]
    asked = rng.random(600) < 0.5
    a, b, km = assign.nearest_sites(lat, lon, ids, asked, 7)
    far = cluster.haversine(np.column_stack([lat, lon]), np.column_stack([lat, lon]))
    np.fill_diagonal(far, np.inf)
    for i in np.flatnonzero(asked):
        want = np.lexsort((ids, np.round(far[i], 9)))[:7]
        assert ids[b[a == i]].tolist() == ids[want].tolist()
        np.testing.assert_allclose(km[a == i], far[i][want], atol=1e-6)


def test_neighbours_do_not_depend_on_the_parts(spark):
    _, table = placed(spark, 300, 2)
    rows = lambda asking: sorted(map(tuple, assign.neighbours(table, 5, asking).select("tech", "fl_id", "other", "nn_rank").collect()))
    assert rows(4096) == rows(20) and len(rows(4096)) == 1500
    assert assign.neighbours(table.where("false"), 5).count() == 0


def test_thinned_rosters_find_the_same_technicians(spark):
    rng = random.Random(3)
    centres = spark.createDataFrame([(f"T{i:03}", -37 + rng.gauss(0, 2), 145 + rng.gauss(0, 2)) for i in range(300)], "tech string, c_lat double, c_lon double")
    setups = spark.createDataFrame([(i, -37 + rng.gauss(0, 2), 145 + rng.gauss(0, 2), i % 3 > 0, "own") for i in range(400)], "id long, latitude double, longitude double, is_unassigned boolean, tech_raw string")
    whole, thin = (sorted((r.id, r.tech) for r in assign.nearest_tech(setups, centres, **p).collect()) for p in ({}, {"most": 10}))
    assert whole == thin and {t for i, t in whole if i % 3 == 0} == {"own"}
    sites = setups.join(centres.select("tech", F.lit(1).alias("x")).limit(0), F.lit(False), "left").drop("tech").withColumn("tech", F.format_string("T%03d", F.col("id") % 300)).withColumnRenamed("id", "fl_id")
    whole, thin = (sorted((r.fl_id, r.other, round(r.gap, 6)) for r in spec.boundary_sites(sites, centres, 5.0, **p).collect()) for p in ({}, {"most": 10}))
    assert whole == thin and whole


def test_first_move_is_the_rebalance_kernels(spark):
    rows, table = placed(spark, 60, 5, techs=("A",))
    rows.sort(key=lambda r: r[1])
    points, hours = np.array([r[2:4] for r in rows]), np.array([r[4] for r in rows])
    code = search.slot_code([r[5] for r in rows], [r[6] for r in rows])
    after, n = search.rebalance(points, hours, code, cap=4.0, moves=1)
    (moved,) = np.flatnonzero(after != code)
    week, day = search.slot_parts(after)
    from roundsmith.config import SchedulingConfig

    got = steps.first_move(table, SchedulingConfig(capacity_hours=4.0)).collect()
    assert n == 1 and [(r.fl_id, r.to_week, r.to_day) for r in got] == [(moved, week[moved], day[moved])]


def test_median_steps_lead_to_the_kernels_median(spark):
    rows, table = placed(spark, 40, 7, techs=("A",))
    points, weights = np.array([r[2:4] for r in rows]), np.maximum([r[4] for r in rows], 0.001)
    got = steps.median_step(table).first()
    mean = np.average(points, axis=0, weights=weights)
    pull = weights / np.maximum(np.sqrt(((points - mean) ** 2).sum(axis=1)), 1e-9)
    assert (got.m_lat, got.m_lon) == pytest.approx(tuple(np.average(points, axis=0, weights=pull)), abs=1e-9)


def test_projection_of_every_kind_of_rule(spark):
    day = datetime.date
    rows = [
        (1, 1, "Weekly", 26, day(2025, 1, 1), ["3"], None, None, None), (2, 1, "Daily", 100, day(2025, 1, 1), [], None, None, None), (3, 2, "Yearly", 1, day(2025, 3, 4), [], None, None, None),
        (4, 2, "Monthly - Fixed Date", 4, day(2025, 1, 9), [], "31", None, None), (5, 2, "Monthly - Week Pattern", 6, day(2025, 1, 9), [], None, "1", "2"), (6, 2, "Weekly", 1, None, ["1"], None, None, None),
    ]
    table = spark.createDataFrame(rows, "booking_setup_id long, fl_id long, frequency_type string, num_recurrences int, start_date date, days array<string>, month_day string, weekday string, weekdef string")
    got = sorted((r.booking_setup_id, str(r.date)) for r in spec.projected(table).collect())
    assert got == [(1, "2025-01-01"), (1, "2025-07-02"), (1, "2025-12-31"), (2, "2025-01-01"), (2, "2025-04-11"), (2, "2025-07-20"), (2, "2025-10-28"), (3, "2025-03-04"), (4, "2025-01-31"), (4, "2025-05-31"), (4, "2025-09-30"), (5, "2025-01-13"), (5, "2025-07-14")]


def test_report_holds_its_payload_and_no_markup_of_names(spark, tmp_path):
    _, table = placed(spark, 30, 9)
    table = table.withColumn("fl_name", F.when(F.col("fl_id") == 3, "<img src=x onerror=alert(1)></script>").otherwise(F.col("fl_name")))
    applied = table.select("tech", "fl_id", "week", "day", F.col("fl_id").alias("booking_setup_id"), F.lit("1 Monthly").alias("recurrence_frequency"), F.lit(30.0).alias("effective_duration"), F.lit("1-Monday").alias("new_date_pattern"), F.lit(True).alias("is_mwp"), F.lit(False).alias("is_weekly"), F.lit(30.0).alias("monthly_contrib_mins"))
    held = files.report_payload(table, applied, slots.capacity(applied))
    size = files.write_report(held, str(tmp_path / "page.html"), "A & B")
    page = (tmp_path / "page.html").read_text()
    assert files.payload_of(page) == held and size["sites"] == 30 and size["slots"] == 40 and size["characters"] == len(page)
    assert "<img" not in page and "innerHTML" not in page and "A &amp; B" in page
    with pytest.raises(ValueError):
        files.report_payload(table, applied, slots.capacity(applied), most=5)


def test_files_go_round(spark, tmp_path):
    table = spark.createDataFrame([(1, "x", None), (2, " (unassigned) ", "b")], "booking_setup_id long, city string, preferred_resource string")
    files.write_csv(files.to_display(table), str(tmp_path / "t"))
    back = files.from_display(files.read_strings(spark, str(tmp_path / "t"), files.to_display(table).columns))
    assert sorted(map(tuple, back.collect())) == [("1", "x", None), ("2", None, "b")] and back.columns == table.columns
    assert not files.write_if_any(table.where("false"), str(tmp_path / "none")) and not (tmp_path / "none").exists()
    assert files.write_if_any(table, str(tmp_path / "some")) and files.read_typed(spark, str(tmp_path / "some"), table.schema).count() == 2


def test_counting_votes_at_once_changes_no_search():
    """The searches restated with every vote counted when its site is visited."""
    rng = np.random.default_rng(11)
    for trial in range(6):
        n = int(rng.integers(5, 90))
        points, hours = np.array([-37, 145]) + rng.normal(0, 0.2, (n, 2)), rng.gamma(1.5, 0.6, n)
        code = rng.integers(0, 20 if trial % 2 else 4, n)
        near = search.nearest(points, 7) if n > 7 else None
        slot, total = code.copy(), 0
        for _ in range(10 if n > 7 else 0):
            frozen, load, moved = slot.copy(), np.bincount(slot, hours, 20), 0
            for i in range(n):
                top, votes, _ = search.tally(frozen[near[i]], frozen[i])
                here = frozen[i]
                if votes >= 3 and top != here and search.passes_gate(load[here], load[top], hours[i], 8.0):
                    load[here], load[top] = max(0.0, load[here] - hours[i]), load[top] + hours[i]
                    slot[i], moved = top, moved + 1
            total += moved
            if not moved:
                break
        after, moves = search.majority_filter(points, hours, code)
        assert (after == slot).all() and moves == total
        slot, log, recent = code.copy(), [], []
        for step in range(1, 501 if n > 7 else 1):
            barred, load, moved = set(recent), np.bincount(slot, hours, 20), 0
            for i in range(n):
                here = int(slot[i])
                top, votes, own = search.tally(slot[near[i]], here)
                if votes > own and (i, top) not in barred and search.passes_gate(load[here], load[top], hours[i], 8.0):
                    load[here], load[top] = max(0.0, load[here] - hours[i]), load[top] + hours[i]
                    recent = [*recent, (i, here)][-15:]
                    slot[i], moved = top, moved + 1
            log.append((step, moved))
            if not moved:
                break
        after, steps_ = search.joint_search(points, hours, code)
        assert (after == slot).all() and steps_ == log


def symmetric_sites():
    """Sites of a lattice: some are equally far from others but for the last bits, as in larger tables."""
    ids = sorted({b + d for b in range(12_000, 12_600, 5) for d in (-1976, 0, 1976, 58_039)})
    return [(i, -39 + ((i * 7919) % 4001) / 1000, 141 + ((i * 104729) % 8009) / 1000) for i in ids]


def distances_by_sql(rows):
    duckdb = pytest.importorskip("duckdb")
    from roundsmith.plans.oracle import km

    con = duckdb.connect()
    con.execute("CREATE TABLE stub (fl_id BIGINT, latitude DOUBLE, longitude DOUBLE)")
    con.executemany("INSERT INTO stub VALUES (?, ?, ?)", rows)
    far = f"SELECT a.fl_id, b.fl_id other, {km('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} km FROM stub a JOIN stub b ON a.fl_id <> b.fl_id"
    ranked = con.execute(f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fl_id ORDER BY km, other) nn_rank FROM ({far})) WHERE nn_rank <= 7 ORDER BY fl_id, nn_rank").fetchall()
    return [(a, b, d) for a, b, d, _ in ranked]


def test_neighbours_that_are_equally_far_come_in_the_order_of_the_sql():
    rows = symmetric_sites()
    ids, lat, lon = (np.array(x) for x in zip(*rows))
    a, b, km = assign.nearest_sites(lat, lon, ids, np.ones(len(ids), bool), 7)
    got = sorted(zip(ids[a].tolist(), range(len(a)), ids[b].tolist(), km.tolist()))
    assert [(x, y, d) for x, _, y, d in got] == distances_by_sql(rows)


def stub_and_sql(spark, name):
    """Equally far sites with slots by arithmetic, and what the SQL of a query says of them."""
    duckdb = pytest.importorskip("duckdb")
    from roundsmith.plans.oracle import PREFIX
    from roundsmith.plans.queries import SQL

    # Three slots, so that many votes are equal and the first of them decides.
    rows = [("A", i, lat, lon, 0.01, i * 31 // 3 % 3 + 1, DAYS[0]) for i, lat, lon in symmetric_sites()]
    con = duckdb.connect()
    con.execute("CREATE TABLE stub (tech VARCHAR, fl_id BIGINT, latitude DOUBLE, longitude DOUBLE, monthly_hrs DOUBLE, week INT, day VARCHAR)")
    con.executemany("INSERT INTO stub VALUES (?, ?, ?, ?, ?, ?, ?)", rows)
    votes = PREFIX[PREFIX.index("knn AS ("):PREFIX.index("dist AS (")].rstrip().rstrip(",")
    table = spark.createDataFrame(rows, "tech string, fl_id long, latitude double, longitude double, monthly_hrs double, week int, day string")
    return table, sorted(con.execute(f"WITH {votes} {SQL[name].removeprefix(PREFIX)}").fetchall())


def test_votes_of_equally_far_neighbours_are_those_of_the_sql(spark):
    table, want = stub_and_sql(spark, "agg_21_votes")
    assert sorted(map(tuple, slots.votes(table, 7).collect())) == want


def test_enclaves_of_equally_far_neighbours_are_those_of_the_sql(spark):
    table, want = stub_and_sql(spark, "kpi_4_5_enclaves")
    got = slots.enclaves(slots.votes(table, 7), 3).first()
    assert [(*got[:3], round(got.strict_pct, 6), round(got.loose_pct, 6))] == want


def test_first_candidates_of_equally_far_neighbours_are_those_of_the_sql(spark):
    table, want = stub_and_sql(spark, "opt_2_3_first_candidates")
    assert sorted(map(tuple, steps.vote_candidates(table).collect())) == want


def peak_of(work):
    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1] / 2**20
    finally:
        tracemalloc.stop()


def many_sites(n=8000):
    rng = np.random.default_rng(4)
    return np.array([-37, 145]) + rng.integers(-200, 201, (n, 2)) / 1000, rng.gamma(1.5, 0.01, n), rng.integers(0, 20, n)


def test_neighbours_in_the_majority_filter_need_no_table_of_all_distances():
    points, hours, code = many_sites()
    near, peak = peak_of(lambda: search.nearest(points, 7))
    assert peak < 60
    far = cluster.haversine(points[:300], points)
    far[np.arange(300), np.arange(300)] = np.inf
    np.testing.assert_allclose(np.take_along_axis(far, near[:300], 1), np.sort(far, axis=1)[:, :7], atol=1e-9)
    (_, moves), peak = peak_of(lambda: search.majority_filter(points, hours, code))
    assert moves > 0 and peak < 60


def test_the_joint_search_needs_no_table_of_all_distances():
    (_, log), peak = peak_of(lambda: search.joint_search(*many_sites(), passes=2))
    assert log[0][1] > 0 and peak < 60


def test_a_report_of_any_size_is_whole_over_its_pages(spark):
    _, table = placed(spark, 60, 13)
    table = table.withColumn("fl_name", F.when(F.col("fl_id") == 3, "</script><b>").otherwise(F.col("fl_name")))
    setups = table.select("tech", "fl_id", "week", "day", F.explode(F.array(F.col("fl_id"), F.col("fl_id") + 1000)).alias("booking_setup_id"), F.lit("1 Monthly").alias("recurrence_frequency"), F.lit(30.0).alias("effective_duration"), F.lit("1-Monday").alias("new_date_pattern"), F.lit(True).alias("is_mwp"), F.lit(False).alias("is_weekly"), F.lit(30.0).alias("monthly_contrib_mins"))
    whole = files.report_payload(table, setups, slots.capacity(setups))
    pages = files.report_pages(table, setups, slots.capacity(setups), per_page=5).collect()
    back = [files.payload_of(p.html) for p in pages]
    assert len(pages) > 8 and all(p.readable and "<b>" not in p.html for p in pages)
    assert sorted((f for b in back for f in b["fls"]), key=lambda f: (f["tech"], f["fl_id"])) == whole["fls"]
    assert sorted((x for b in back for x in b["slots"]), key=lambda x: (x["tech"], x["week"], x["day"])) == whole["slots"]
    assert [(p.fls, p.setups, p.slots) for p in pages] == [(len(b["fls"]), 2 * len(b["fls"]), len(b["slots"])) for b in back]
    empty = files.report_pages(table.where("false"), setups.where("false"), slots.capacity(setups.where("false")))
    assert empty.count() == 0


def test_the_report_query_has_no_limit_of_sites(spark, monkeypatch):
    from roundsmith.plans import queries

    def one_page(*_):
        raise ValueError("too many for one page")

    monkeypatch.setattr(files, "report_payload", one_page)
    row = queries.QUERIES["snk_4_report"](spark, "/root/testdata/sf0.001").first()
    assert row.fls > 0 and row.setups >= row.fls and row.slots == 20 * row.techs and row.readable


#: Few moves: they take no memory, only time.
FEW = SchedulingConfig(joint_passes=2, filter_passes=2, rebalance_moves=5)


def one_technician(n=4000):
    points, hours, _ = many_sites(n)
    return pd.DataFrame({"tech": "A", "fl_id": np.arange(n), "latitude": points[:, 0], "longitude": points[:, 1], "monthly_hrs": hours, "anchor_tier": np.arange(n) % 5 + 1})


def test_the_joint_variant_of_one_technician_needs_no_table_of_all_distances():
    sites = one_technician()
    placed, peak = peak_of(lambda: schedule.place_technician(sites, "joint", FEW))
    assert len(placed) == len(sites) and placed["log"].iloc[0][0]["moves"] > 0 and peak < 60


def test_indicators_of_many_sites_need_no_table_of_all_distances():
    """Every variant of one technician, and what the indicators ask of its zones and neighbours."""
    sites = one_technician()

    def work():
        for variant in ("seed", "filter", "joint"):
            placed = schedule.place_technician(sites, variant, FEW)
            zones = [slots.count_components(zone, 15.0) for _, zone in placed.groupby(["week", "day"])]
            asking, _, _ = assign.nearest_sites(placed["latitude"].to_numpy(), placed["longitude"].to_numpy(), placed["fl_id"].to_numpy(), placed["fl_id"].to_numpy() % 4 == 0, 7)
        return zones, asking

    (zones, asking), peak = peak_of(work)
    assert len(zones) == 20 and len(asking) == 7 * len(sites) / 4 and peak < 60


def test_convergence_of_many_sites_is_the_log_of_a_search_without_a_table_of_all_distances(spark):
    sites = one_technician()
    placed, peak = peak_of(lambda: schedule.place_technician(sites, "joint", FEW))
    points, hours = sites[["latitude", "longitude"]].to_numpy(), sites["monthly_hrs"].to_numpy()
    seed = schedule.place_technician(sites, "seed", FEW)
    _, log = search.joint_search(points, hours, search.slot_code(seed["week"], seed["day"]), passes=2)
    got = schedule.convergence(schedule.place(spark.createDataFrame(sites.astype({"anchor_tier": "int32"})), "joint", FEW))
    assert peak < 60 and sorted((r.tech, r.iter, r.moves, r.fls) for r in got.collect()) == [("A", i, m, len(sites)) for i, m in log]


def test_the_filter_variant_of_one_technician_needs_no_table_of_all_distances():
    sites = one_technician()
    placed, peak = peak_of(lambda: schedule.place_technician(sites, "filter", FEW))
    assert len(placed) == len(sites) and placed["moves_filter"].iloc[0] > 0 and peak < 60


def test_the_diagnosed_joint_variant_of_many_sites_needs_no_table_of_all_distances():
    sites = one_technician()
    # One site far from the others of its slot.
    sites.loc[0, "latitude"] += 3

    def work():
        placed = schedule.place_technician(sites, "joint", FEW)
        return placed, {key: slots.count_components(zone, 15.0) for key, zone in placed.groupby(["week", "day"])}

    (placed, components), peak = peak_of(work)
    far = placed.loc[0]
    assert len(placed) == len(sites) and components[(far["week"], far["day"])] > 1 and peak < 60


def stored_files(spark, tables_of, monkeypatch):
    """Files of each table that ``tables_of`` a schedule stores from many partitions, with its name."""
    from roundsmith.fixtures import Domain
    from roundsmith.sources import tables

    kept, paths, path_of = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "40"}, {}, tables.new_path
    before = {key: spark.conf.get(key) for key in kept}
    monkeypatch.setattr(tables, "new_path", lambda session, name: paths.setdefault(name, path_of(session, name)))
    try:
        for key, value in kept.items():
            spark.conf.set(key, value)
        tables_of(schedule.Schedule(Domain(spark, "/root/testdata/sf0.001"), FEW, compact=True))
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    most = 2 * spark.sparkContext.defaultParallelism
    return {name: len(list(Path(path.removeprefix("file://")).glob("*.parquet"))) for name, path in paths.items()}, most


def test_tables_that_the_indicators_store_are_few_files_with_all_rows(spark, monkeypatch):
    seen = []
    files_of, most = stored_files(spark, lambda s: seen.extend(s.stored_placed(v).count() for v in ("seed", "filter", "joint")) or seen.append(s.tech_sites.count()), monkeypatch)
    assert sorted(files_of) == ["assigned", "derived", "placed-filter", "placed-joint", "placed-seed", "tech-sites"]
    assert seen[0] > 0 and len(set(seen)) == 1 and max(files_of.values()) <= most


def test_the_convergence_runs_the_search_once(spark):
    sites = spark.createDataFrame(one_technician(20).astype({"anchor_tier": "int32"}))
    got = schedule.convergence(schedule.place(sites, "joint", FEW))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 1 and got.count() > 0


def test_tables_that_the_filter_variant_stores_are_few_files(spark, monkeypatch):
    files_of, most = stored_files(spark, lambda s: s.diagnosed(s.stored_placed("filter")).count(), monkeypatch)
    assert "placed-filter" in files_of and max(files_of.values()) <= most


def test_tables_that_the_joint_variant_stores_are_few_files(spark, monkeypatch):
    files_of, most = stored_files(spark, lambda s: s.diagnosed(s.stored_placed("joint")).count(), monkeypatch)
    assert "placed-joint" in files_of and max(files_of.values()) <= most


def old_collections(spark):
    """Full collections so far of the JVM, which in a local session is the executor too."""
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())


def one_pass(spark, variant, query, monkeypatch):
    """The variant's query stores neither its placement nor more than a file per core, and flags what the separate steps flag."""
    from roundsmith.plans import queries

    seen, before = {}, old_collections(spark)

    def run(s):
        monkeypatch.setattr(queries, "_schedule", lambda *_: s)
        seen["got"] = sorted(map(tuple, queries.QUERIES[query](spark, "/root/testdata/sf0.001").collect()))
        seen["collections"] = old_collections(spark) - before
        seen["names"] = list(s._stored)
        steps = s.diagnosed(s.stored_placed(variant)).select("tech", "fl_id", "week", "day", "is_outlier", "in_disconnected_zone")
        seen["want"] = sorted(map(tuple, steps.collect()))

    files_of, _ = stored_files(spark, run, monkeypatch)
    assert not seen["names"] and seen["got"] and seen["got"] == seen["want"]
    assert max(files_of.values()) <= spark.sparkContext.defaultParallelism
    # Heaps are handed back after each of the three tables, at least once.
    assert seen["collections"] >= 3


def test_the_filter_variant_is_placed_and_flagged_in_one_pass_with_small_heaps(spark, monkeypatch):
    one_pass(spark, "filter", "opt_6_variant_v1", monkeypatch)


def test_sites_of_a_split_slot_are_flagged_in_the_pass_that_places_them(spark):
    sites = one_technician(1500)
    sites.loc[0, "latitude"] += 3
    table = spark.createDataFrame(sites.astype({"anchor_tier": "int32"}))
    placed = schedule.place(table, "filter", FEW)
    want = slots.flag_disconnected(placed, slots.zones(placed)).select("tech", "fl_id", "week", "day", "is_outlier", "in_disconnected_zone")
    got = sorted(map(tuple, schedule.place_flagged(table, "filter", FEW).collect()))
    assert got == sorted(map(tuple, want.collect())) and 0 < sum(r[-1] for r in got) < len(got)


def test_the_joint_variant_is_placed_and_flagged_in_one_pass_with_small_heaps(spark, monkeypatch):
    one_pass(spark, "joint", "opt_7_variant_v2", monkeypatch)


def test_heaps_are_handed_back_before_the_files_of_a_table_are_made(spark, monkeypatch):
    from roundsmith.sources import tables

    paths, made, path_of = [], [], tables.new_path
    monkeypatch.setattr(tables, "new_path", lambda *of: paths.append(path_of(*of)) or paths[-1])
    monkeypatch.setattr(tables, "hand_back", lambda _: made.append(Path(paths[0].removeprefix("file://")).exists()))
    got = tables.stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")), "handed")
    assert made == [False, True] and sorted(map(tuple, got.collect())) == [(k, 142 + (k < 6)) for k in range(7)]


def test_indicators_are_computed_part_by_part_and_are_those_of_one_plan(spark, monkeypatch):
    from roundsmith.fixtures import Domain
    from roundsmith.plans import queries
    from roundsmith.sources import tables

    s = schedule.Schedule(Domain(spark, "/root/testdata/sf0.001"), FEW, compact=True)
    monkeypatch.setattr(queries, "_schedule", lambda *_: s)
    got = queries.QUERIES["opt_6_7_indicators"](spark, "/root/testdata/sf0.001")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "FlatMapGroupsInPandas" not in plan
    want = []
    for variant in ("seed", "filter", "joint"):
        placed = s.stored_placed(variant)
        want += queries.rounded(slots.indicators(placed, slots.apply_slots(s.assigned, placed))).withColumn("variant", F.lit(variant)).collect()
    assert got.collect() == want and want[0].fls > 0 and got.columns == list(want[0].asDict())
    empty = s.tech_sites.where("false").withColumns({"week": F.lit(1), "day": F.lit("Monday"), "is_outlier": F.lit(False)})
    parts = slots.indicator_parts(empty, slots.apply_slots(s.assigned.where("false"), empty))
    assert [v for row in tables.settled(parts) for v in row] == list(slots.indicators(empty, slots.apply_slots(s.assigned.where("false"), empty)).first())


def test_the_driver_collects_and_makes_no_folder_of_a_table_by_hadoop(spark, monkeypatch):
    from pyspark.sql import readwriter

    from roundsmith.sources import tables

    seen, write, slim = [], readwriter.DataFrameWriter.parquet, tables.slim_driver

    def parquet(self, path, *args, **more):
        seen.append((path, Path(path.removeprefix("file://"), "_temporary/0/_temporary").is_dir()))
        return write(self, path, *args, **more)

    monkeypatch.setattr(readwriter.DataFrameWriter, "parquet", parquet)
    monkeypatch.setattr(tables, "slim_driver", lambda session: seen.append("slim") or slim(session))
    got = tables.stored(spark.range(1000).withColumn("k", F.col("id") % 7), "quiet")
    path, ready = seen[1]
    assert seen == ["slim", (path, True), "slim"] and ready and got.count() == 1000
    assert not list(Path(path.removeprefix("file://")).glob("_*"))
