"""Golden recurrence and numeric cases, kernel invariants and step checks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from roundsmith.config import DAYS
from roundsmith.functions import geo, recurrence
from roundsmith.functions import workload as wl
from roundsmith.kernels import cluster, search

START = "<start>{}</start>"
#: (rule, start, services a year, label, type, dow, week, valid, drop month, drop week)
GOLDEN = [
    ("<weeks every='2'><days>1</days></weeks>", "05/19/2025", 26.0, "2 Weekly", "Weekly", "1", 1, "Valid", "N/A", 1),
    ("<weeks every='4'><days>1</days></weeks>", "05/28/2025", 13.0, "4 Weekly", "Weekly", "1", 2, "Invalid", "N/A", 3),
    ("<weeks every='1'><days>1</days><days>3</days></weeks>", "05/19/2025", 104.0, "1 Weekly", "Weekly - Multi Day", "1,3", None, "Valid", "N/A", None),
    ("<months every='3'><weekday>2</weekday><weekdef>4</weekdef></months>", "11/01/2025", 4.0, "3 Monthly", "Monthly - Week Pattern", "2", 4, "Valid", "November", 4),
    ("<months every='2'><weekday>1</weekday><weekdef>1</weekdef></months>", "09/15/2025", 6.0, "2 Monthly", "Monthly - Week Pattern", "1", 1, "Invalid", "October", 1),
    ("<months every='1'><weekday>1</weekday><weekdef>1</weekdef></months>", "09/01/2025", 12.0, "1 Monthly", "Monthly - Week Pattern", "1", 1, "Valid", "N/A", 1),
    ("<months every='6'><day>15</day></months>", "10/05/2025", 2.0, "6 Monthly", "Monthly - Fixed Date", "0", 1, "Valid", "October", 1),
    ("<years every='7'></years>", "03/20/2025", 1.0, "Yearly", "Yearly", "4", 3, "Valid", "March", 3),
    ("<period>daily</period><x every='1'/>", "03/20/2025", 365.0, "1 Daily", "Daily", "", None, "Valid", "N/A", None),
    ("<weeks every='2'><days>5</days></weeks>", "05/16/2025", 26.0, "2 Weekly", "Weekly", "5", 1, "Valid", "N/A", 1),
    ("<weeks every='2'><days>6</days></weeks>", "05/10/2025", 26.0, "2 Weekly", "Weekly", "6", 4, "Valid", "N/A", 4),
    ("<weeks every='2'><days>1</days></weeks>", "13/45/2025", 26.0, "2 Weekly", "Weekly", "1", None, "", "N/A", None),
    ("<other/>", "05/19/2025", None, None, None, "", None, "", "", None),
]


def test_golden_recurrence_rules(spark):
    rows = [(i, i, "p", 1, g[0] + START.format(g[1])) for i, g in enumerate(GOLDEN)]
    weekly = "<weeks every='1'><days>{}</days></weeks>" + START.format("05/19/2025")
    rows += [(100, 50, "q", 1, weekly.format(1)), (101, 50, "q", 1, weekly.format(4)), (102, 51, "q", 1, weekly.format(1))]
    table = spark.createDataFrame(rows, "booking_setup_id long, fl_id long, products string, status int, rule string")
    got = {r.booking_setup_id: r for r in recurrence.derive(table).collect()}
    for i, g in enumerate(GOLDEN):
        r = got[i]
        assert (r.services_per_year, r.recurrence_frequency, r.frequency_type, r.dow_number, r.week_number, r.is_valid_start_date, r.drop_month, r.drop_week) == g[2:], g[0]
    assert [got[i].frequency_type for i in (100, 101, 102)] == ["Weekly - Multi Day", "Weekly - Multi Day", "Weekly"]


def test_numeric_cases(spark):
    row = spark.range(1).select(
        geo.haversine(*map(F.lit, (-37.8136, 144.9631, -38.1499, 144.3617))).alias("a"), geo.haversine(*map(F.lit, (0.0, 0.0, 0.0, 180.0))).alias("b"),
        *(wl.run_days(F.lit(h), 8.0).alias(f"d{i}") for i, h in enumerate((8.1, 12.0, 4.0))), *(wl.frequency_tier(F.lit(s)).alias(f"t{i}") for i, s in enumerate((26.0, 12.0, 4.0, 1.5, 1.0))),
    ).first()
    assert row.a == pytest.approx(64.626854, abs=1e-6) and row.b == pytest.approx(20015.086796, abs=1e-6)
    assert (row.d0, row.d1, row.d2) == (1.5, 1.5, 0.5) and [row[f"t{i}"] for i in range(5)] == [5, 4, 3, 2, 1]
    points = np.array([(0, 0), (0, 1), (1, 0), (1, 1), (10, 10)], float)
    assert cluster.geometric_median(points, np.ones(5)) == pytest.approx([0.788711, 0.788711], abs=1e-5)
    assert cluster.mad_outliers(np.array([1, 2, 3, 4, 100.0]), 2).tolist() == [False] * 4 + [True]
    assert not cluster.mad_outliers(np.array([5, 5, 5, 5, 9.0]), 2).any()


@pytest.fixture(scope="module")
def sites():
    rng = np.random.default_rng(0)
    points = np.array([-37, 145]) + rng.normal(0, 0.2, (120, 2))
    return points, rng.gamma(1.5, 1.2, 120), rng.integers(1, 6, 120)


def test_seed_and_search_keep_their_invariants(sites):
    points, hours, tiers = sites
    days, weeks, _ = cluster.seed_slots(points, hours, tiers, np.random.default_rng(1))
    assert set(days) <= set(range(5)) and set(weeks) <= {1, 2, 3, 4}
    code = search.slot_code(weeks, [DAYS[d] for d in days])
    top = np.bincount(code, hours, 20).max()
    moved, n = search.rebalance(points, hours, code)
    assert n > 0 and np.bincount(moved, hours, 20).max() <= top
    for after in (search.majority_filter(points, hours, code)[0], search.joint_search(points, hours, code)[0]):
        assert len(after) == len(code) and np.bincount(after, hours, 20).max() <= max(8.0, top) + 1e-9


def test_rebalance_never_opens_an_empty_slot():
    slot, moves = search.rebalance(np.zeros((20, 2)), np.array([1.0] * 10 + [0.95] * 10), np.array([0] * 10 + [1] * 10))
    assert moves == 0 and set(slot) == {0, 1}


def test_vote_ties_go_to_the_slot_seen_first():
    assert search.tally(np.array([7, 3, 7, 3, 7, 3, 9]), 0)[:2] == (7, 3)
