"""Registered queries for the closing-stock source and the stock-adjusted forecast."""

from __future__ import annotations

from pyspark.sql import functions as F

from provend.operators import aggregates as agg
from provend.operators import cleaning as cl
from provend.operators import forecast as fc
from provend.plans.catalog import query, r6
from provend.session import scratch_path
from provend.sources import stock as st
from provend.sources import testdata as td

STOCK_SQL = """stock AS (
  SELECT lower(p_brand) AS item, lower(s_name) AS supplier,
         CAST(date_trunc('month', last_day(CAST(l_shipdate AS DATE))) AS DATE) AS period,
         SUM(l_quantity) % 50 AS closing_qty
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  GROUP BY lower(p_brand), lower(s_name), CAST(date_trunc('month', last_day(CAST(l_shipdate AS DATE))) AS DATE)),
latest AS (
  SELECT item, supplier, MAX(period) AS period, arg_max(closing_qty, period) AS closing_qty
  FROM stock GROUP BY item, supplier)"""

NORM_PV = """pv AS (
  SELECT CAST(l_shipdate AS DATE) AS doc_date, lower(s_name) AS supplier, lower(p_brand) AS item,
         l_quantity AS qty, l_extendedprice AS amount, l_returnflag AS unit
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""


def stock_latest(spark, d):
    path = td.write_stock_fixture(spark, d, scratch_path(spark, "stock"))
    return st.latest_stock(st.read_closing_stock(spark, path, "monthly"))


@query("closing_stock_latest", "WITH " + STOCK_SQL + "\nSELECT item, supplier, period, closing_qty FROM latest")
def q_closing_stock_latest(spark, d):
    return stock_latest(spark, d)


@query("stock_adjusted_forecast", "WITH " + NORM_PV + ",\n" + STOCK_SQL + """,
months AS (SELECT GREATEST(COUNT(DISTINCT date_trunc('month', doc_date)), 1) AS m FROM pv),
g AS (SELECT item, supplier, unit, COALESCE(SUM(qty), 0.0) AS total_qty FROM pv
      WHERE item IS NOT NULL AND supplier IS NOT NULL AND unit IS NOT NULL GROUP BY item, supplier, unit),
d AS (SELECT g.*, total_qty / m AS avg_monthly_qty, total_qty / m * 3 AS avg_quarterly_qty,
             SUM(total_qty) OVER (PARTITION BY item, supplier) AS pair_qty,
             COUNT(*) OVER (PARTITION BY item, supplier) AS pair_units FROM g, months),
a AS (SELECT d.*, COALESCE(l.closing_qty, 0.0) * CASE WHEN pair_qty > 0 THEN total_qty / pair_qty
                                                      ELSE 1.0 / pair_units END AS alloc
      FROM d LEFT JOIN latest l ON d.item = l.item AND d.supplier = l.supplier)
SELECT item, supplier, unit, ROUND(alloc, 6) AS allocated_stock,
       ROUND(GREATEST(CAST(CEIL(avg_monthly_qty * 1.3) AS DOUBLE) - alloc, 0.0), 6) AS monthly_reorder_qty,
       ROUND(GREATEST(CAST(CEIL(avg_quarterly_qty * 1.3) AS DOUBLE) - alloc, 0.0), 6) AS quarterly_reorder_qty
FROM a""")
def q_stock_adjusted_forecast(spark, d):
    pv = cl.normalise_names(td.pv_view(spark, d))
    dem = agg.demand_aggregate(pv)
    out = fc.stock_adjusted_forecast(dem, stock_latest(spark, d), 1.30)
    return out.select("item", "supplier", "unit", *[r6(c).alias(c) for c in
                                                     ["allocated_stock", "monthly_reorder_qty",
                                                      "quarterly_reorder_qty"]])
