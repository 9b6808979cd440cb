"""Domain tables derived from the test tables, as SQL text that Spark and DuckDB both accept."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

_TABLES = ("customer", "nation", "orders", "lineitem", "supplier", "region", "part")

LOCATION = """
SELECT c.c_custkey AS fl_id, c.c_name AS fl_name, n.n_name AS city, c.c_name || ' St' AS address, c.c_mktsegment AS territory,
  CASE WHEN c.c_custkey % 97 = 0 THEN NULL WHEN c.c_custkey % 101 = 0 THEN 40.7E0 ELSE -39.0E0 + ((c.c_custkey * 7919) % 4001) / 1000.0E0 END AS latitude,
  CASE WHEN c.c_custkey % 97 = 0 THEN NULL WHEN c.c_custkey % 101 = 0 THEN -74.0E0 ELSE 141.0E0 + ((c.c_custkey * 104729) % 8009) / 1000.0E0 END AS longitude
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey"""

#: Each technician's sites lie close together; for clustering and search.
COMPACT = """
SELECT c.c_custkey AS fl_id, c.c_name AS fl_name, n.n_name AS city,
  -39.0E0 + (((c.c_custkey % 40) * 37) % 41) / 10.0E0 + (((c.c_custkey * 7919) % 401) - 200) / 1000.0E0 AS latitude,
  141.0E0 + (((c.c_custkey % 40) * 53) % 81) / 10.0E0 + (((c.c_custkey * 104729) % 401) - 200) / 1000.0E0 AS longitude
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey"""

_START = """'<start>' || CASE WHEN o_orderkey % 59 = 0 THEN '13/45/2025' ELSE lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || '/' || lpad(CAST(day(o_orderdate) AS STRING), 2, '0') || '/' || CAST(year(o_orderdate) AS STRING) END || '</start>'"""

RULE = f"""
CASE o_orderkey % 10
  WHEN 0 THEN '<years every=''1''></years>'
  WHEN 1 THEN '<period>daily</period><interval every=''1''></interval>'
  WHEN 2 THEN '<weeks every=''' || CAST(1 + o_orderkey % 3 AS STRING) || '''><days>' || CAST(1 + o_custkey % 5 AS STRING) || '</days></weeks>'
  WHEN 3 THEN '<weeks every=''1''><days>1</days><days>3</days></weeks>'
  WHEN 9 THEN '<months every=''1''><day>' || CAST(1 + o_orderkey % 28 AS STRING) || '</day></months>'
  ELSE '<months every=''' || CAST(1 + o_orderkey % 6 AS STRING) || '''><weekday>' || CAST(o_orderkey % 7 AS STRING) || '</weekday><weekdef>' || CAST(1 + o_custkey % 4 AS STRING) || '</weekdef></months>'
END || {_START}"""

_SETUP = f"""
SELECT o_orderkey AS booking_setup_id, o_custkey AS fl_id, o_custkey AS agreement_id, o_orderdate AS createdon, o_orderpriority AS products,
  CASE WHEN o_orderkey % 37 = 0 THEN 2 ELSE 1 END AS status,
  CASE WHEN o_orderkey % 13 = 0 THEN '' WHEN o_orderkey % 101 = 0 THEN 'Admin Desk' WHEN o_orderkey % 17 = 0 THEN 'Tech-' || lpad(CAST((o_custkey + 1) % 40 AS STRING), 2, '0') ELSE 'Tech-' || lpad(CAST(o_custkey % 40 AS STRING), 2, '0') END AS preferred_resource,
  CASE WHEN o_orderkey % 41 = 0 THEN 0 WHEN o_orderkey % 43 = 0 THEN 600 ELSE 15 * (1 + o_orderkey % 8) END AS service_duration,
  CASE WHEN o_orderkey % 47 = 0 THEN 45 END AS new_duration,
  CASE WHEN o_orderkey % 3 = 0 THEN 0 WHEN o_orderkey % 3 = 1 THEN 1 END AS auto_generate,
  o_custkey % 7 AS branch_id, (o_custkey + CASE WHEN o_orderkey % 19 = 0 THEN 1 ELSE 0 END) % 7 AS service_branch_id,
  {RULE} AS rule
FROM orders"""

SETUP = f"""{_SETUP}
UNION ALL
SELECT booking_setup_id, fl_id, agreement_id, createdon - INTERVAL 1 DAY, products, status, preferred_resource, service_duration, new_duration, auto_generate, branch_id, service_branch_id, rule
FROM ({_SETUP}) WHERE booking_setup_id % 31 = 0"""

PRODUCT = """
SELECT l_orderkey AS booking_setup_id, l_partkey AS product_id, l_quantity AS quantity, l_extendedprice / l_quantity AS unit_amount, CASE WHEN l_linenumber = 7 THEN 1 END AS is_delete FROM lineitem"""

AGREEMENT = """
SELECT c_custkey AS agreement_id, CASE WHEN c_custkey % 29 = 0 THEN 2 ELSE 1 END AS status, c_mktsegment AS division_code, c_nationkey % 3 AS invoice_code, c_name AS billing_account FROM customer"""

OPTION_SET = """
SELECT DISTINCT c_mktsegment AS code, 'Division ' || c_mktsegment AS label FROM customer"""

INVOICE_OPTION = """
SELECT DISTINCT c_nationkey % 3 AS invoice_code, CASE c_nationkey % 3 WHEN 0 THEN 'Monthly' WHEN 1 THEN 'Quarterly' ELSE 'Per service' END AS invoice_frequency FROM customer WHERE c_nationkey % 3 <> 2"""

BRANCH = """
SELECT n_nationkey AS branch_id, 'Branch ' || CAST(n_nationkey AS STRING) AS setup_branch FROM nation WHERE n_nationkey < 6"""

PRODUCT_MINUTES = """
SELECT p_partkey AS product_id, 1.0E0 + p_size % 5 AS minutes_per_unit FROM part"""

BRANCH_TERRITORY = """
SELECT c_mktsegment AS territory, 'Division ' || c_mktsegment AS division, c_nationkey AS branch_id, 'Branch ' || CAST(c_nationkey AS STRING) AS branch_name FROM customer GROUP BY c_mktsegment, c_nationkey"""

BRANCH_TIMEZONE = """
SELECT CAST(n_nationkey AS BIGINT) AS branch_id, (n_nationkey % 4) * 150 - 60 AS utc_offset_minutes FROM nation WHERE n_nationkey < 6"""

WORK_ORDER = """
SELECT l_orderkey - l_linenumber - l_partkey - l_suppkey AS wo_id, l_orderkey AS booking_setup_id, l_shipdate AS completed_on, s_name AS tech_name,
  CASE l_returnflag WHEN 'A' THEN 'Completed' WHEN 'R' THEN 'Posted' ELSE 'Cancelled' END AS status
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"""

DOMAIN = {
    "location": LOCATION, "compact": COMPACT, "setup": SETUP, "product": PRODUCT, "agreement": AGREEMENT, "option_set": OPTION_SET, "invoice_option": INVOICE_OPTION, "branch": BRANCH, "product_minutes": PRODUCT_MINUTES,
    "branch_territory": BRANCH_TERRITORY, "branch_timezone": BRANCH_TIMEZONE, "work_order": WORK_ORDER,
}


class Domain:
    """The domain tables over one folder of test tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def table(self, name: str) -> DataFrame:
        names = "|".join(_TABLES)
        return self.spark.sql(re.sub(rf"\b(FROM|JOIN) ({names})\b", lambda m: f"{m[1]} parquet.`{self.sf_dir}/{m[2]}.parquet`", DOMAIN[name]))

    @cached_property
    def setups(self) -> DataFrame:
        return self.table("setup")

    @cached_property
    def locations(self) -> DataFrame:
        return self.table("location")
