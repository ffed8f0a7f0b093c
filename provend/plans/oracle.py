"""DuckDB SQL building blocks for the correctness oracle.

Each ``*_CTE`` is the SQL twin of a Spark builder; queries in
``provend.plans.catalog`` stitch them into ``WITH`` clauses.
"""

PV = """pv AS (
  SELECT CAST(l_shipdate AS DATE) AS doc_date, CAST(l_orderkey AS VARCHAR) AS voucher_no, s_name AS supplier,
         p_brand AS item, l_quantity AS qty, l_extendedprice / l_quantity AS price, l_extendedprice AS amount,
         l_returnflag AS unit
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""

GRN = """grn AS (
  SELECT CAST(l_shipdate AS DATE) AS doc_date, CAST(l_orderkey AS VARCHAR) AS voucher_no, s_name AS supplier,
         CAST(l_partkey AS VARCHAR) || CASE WHEN l_orderkey % 10 = 1 THEN '-x' ELSE '' END AS item, l_quantity AS qty
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""

POV = """pov AS (
  SELECT CAST(l_shipdate AS DATE) - CAST((l_orderkey * 7 + l_partkey * 3 + l_linenumber) % 21 AS INTEGER) AS doc_date,
         CAST(l_orderkey AS VARCHAR) AS voucher_no, s_name AS supplier,
         CAST(l_partkey AS VARCHAR) || CASE WHEN l_orderkey % 10 = 0 THEN '-x' ELSE '' END AS item,
         l_quantity AS qty
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""

DEMAND = """months AS (
  SELECT GREATEST(COUNT(DISTINCT date_trunc('month', doc_date)), 1) AS m FROM pv),
demand AS (
  SELECT item, supplier, unit, total_qty, total_value,
         CASE WHEN total_qty > 0 THEN total_value / total_qty ELSE 0.0 END AS avg_unit_price,
         CAST(m AS BIGINT) AS months_covered, total_qty / m AS avg_monthly_qty, total_qty / m * 3 AS avg_quarterly_qty
  FROM (SELECT item, supplier, unit, COALESCE(SUM(qty), 0.0) AS total_qty,
               CAST(COALESCE(SUM(CAST(amount AS DECIMAL(18,2))), 0) AS DOUBLE) AS total_value
        FROM pv WHERE item IS NOT NULL AND supplier IS NOT NULL AND unit IS NOT NULL
        GROUP BY item, supplier, unit) g, months)"""

ABC = """abc AS (
  SELECT *, CASE WHEN gtotal = 0 THEN 'C' WHEN cumulative_value_pct <= 70.0 THEN 'A'
                 WHEN cumulative_value_pct <= 90.0 THEN 'B' ELSE 'C' END AS abc_class
  FROM (SELECT d.*, ROW_NUMBER() OVER w AS value_rank,
               CASE WHEN SUM(CAST(total_value AS DECIMAL(38,2))) OVER () = 0 THEN 0.0
                    ELSE CAST(SUM(CAST(total_value AS DECIMAL(38,2))) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)
                         / CAST(SUM(CAST(total_value AS DECIMAL(38,2))) OVER () AS DOUBLE) * 100.0 END AS cumulative_value_pct,
               SUM(CAST(total_value AS DECIMAL(38,2))) OVER () AS gtotal
        FROM demand d
        WINDOW w AS (ORDER BY total_value DESC, item, supplier, unit)) x)"""

LINKS = """pov_b AS (SELECT doc_date AS pov_date, voucher_no AS pov_no, supplier, item, qty AS pov_qty FROM pov),
grn_b AS (SELECT doc_date AS grn_date, voucher_no AS grn_no, supplier, item, qty AS grn_qty FROM grn),
links AS (
  SELECT p.pov_date, p.pov_no, p.supplier, p.item, p.pov_qty, g.grn_date, g.grn_no, g.grn_qty,
         CAST(g.grn_date - p.pov_date AS INTEGER) AS lead_time_days
  FROM pov_b p JOIN grn_b g ON p.item = g.item AND p.supplier = g.supplier
  WHERE g.grn_date - p.pov_date BETWEEN 0 AND 14 AND g.grn_qty <= p.pov_qty * 2.0)"""

LEAD_STATS = """lead_stats AS (
  SELECT item, supplier, AVG(lead_time_days) AS avg_lead_time_days,
         CAST(MEDIAN(lead_time_days) AS DOUBLE) AS median_lead_time_days,
         MIN(lead_time_days) AS min_lead_time_days, MAX(lead_time_days) AS max_lead_time_days,
         COUNT(lead_time_days) AS observation_count, COUNT(lead_time_days) < 3 AS low_sample
  FROM links GROUP BY item, supplier)"""

SUPPLIER_MATRIX = """spend AS (
  SELECT supplier, CAST(COALESCE(SUM(CAST(amount AS DECIMAL(18,2))), 0) AS DOUBLE) AS total_spend_volume
  FROM pv WHERE supplier IS NOT NULL GROUP BY supplier),
lt_sup AS (
  SELECT supplier, CAST(MEDIAN(lead_time_days) AS DOUBLE) AS median_lead_time,
         STDDEV_SAMP(lead_time_days) AS std_lead_time, COUNT(lead_time_days) AS observation_count
  FROM links WHERE supplier IS NOT NULL GROUP BY supplier),
matrix AS (
  SELECT s.supplier, s.total_spend_volume, l.median_lead_time, l.std_lead_time, l.observation_count,
         l.observation_count >= 3 AS is_valid
  FROM spend s JOIN lt_sup l ON s.supplier = l.supplier)"""


SERIES = """ms AS (
  SELECT item, supplier, CAST(date_trunc('month', doc_date) AS DATE) AS month_start, COALESCE(SUM(qty), 0.0) AS qty
  FROM pv WHERE doc_date IS NOT NULL AND item IS NOT NULL AND supplier IS NOT NULL
  GROUP BY item, supplier, CAST(date_trunc('month', doc_date) AS DATE)),
sparse AS (
  SELECT item, supplier, month_start, qty,
         ROW_NUMBER() OVER (PARTITION BY item, supplier ORDER BY month_start) - 1 AS time_idx,
         CAST(month(month_start) AS INTEGER) AS month, CAST(quarter(month_start) AS INTEGER) AS quarter
  FROM ms),
bounds AS (SELECT item, supplier, MIN(month_start) AS lo, MAX(month_start) AS hi FROM ms GROUP BY item, supplier),
dense AS (
  SELECT b.item, b.supplier, CAST(g.m AS DATE) AS month_start, COALESCE(ms.qty, 0.0) AS qty,
         CAST(date_diff('month', b.lo, CAST(g.m AS DATE)) AS INTEGER) AS time_idx
  FROM bounds b
  CROSS JOIN LATERAL (SELECT unnest(generate_series(CAST(b.lo AS TIMESTAMP), CAST(b.hi AS TIMESTAMP),
                                                    INTERVAL 1 MONTH)) AS m) g
  LEFT JOIN ms ON ms.item = b.item AND ms.supplier = b.supplier AND ms.month_start = CAST(g.m AS DATE)),
split AS (
  SELECT s.*, COUNT(*) OVER (PARTITION BY item, supplier) AS n_points,
         CASE WHEN time_idx < floor(COUNT(*) OVER (PARTITION BY item, supplier) * 0.75) THEN 'train'
              ELSE 'test' END AS split
  FROM sparse s),
bmape AS (
  SELECT item, supplier, n_points,
         CASE WHEN n_points >= 6 THEN 'evaluated' ELSE 'skipped_sparsity' END AS status,
         CASE WHEN n_points >= 6 THEN train_mean END AS train_mean,
         CASE WHEN n_points >= 6 THEN AVG(CASE WHEN split = 'test'
              THEN abs(qty - train_mean) / GREATEST(abs(qty), 2.220446049250313e-16) END) END AS baseline_mape
  FROM (SELECT *, AVG(CASE WHEN split = 'train' THEN qty END) OVER (PARTITION BY item, supplier) AS train_mean
        FROM split) x
  GROUP BY item, supplier, n_points, train_mean),
dlen AS (SELECT item, supplier, CAST(date_diff('month', lo, hi) + 1 AS INTEGER) AS n_months FROM bounds)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


VL_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_shipdate"

VOUCHERS = """vl AS (
  SELECT l_orderkey // 10000 AS file_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
         l_returnflag, l_shipdate, p_brand, s_name, p_name,
         (l_orderkey * 7 + CAST(l_quantity AS BIGINT)) % 17 AS dirt,
         ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY """ + VL_ORDER + """) = 1 AS is_first
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
firsts AS (
  SELECT l_orderkey,
         CASE WHEN dirt = 3 THEN '31-04-2023' WHEN dirt = 6 THEN strftime(CAST(l_shipdate AS DATE), '%d/%m/%Y')
              WHEN dirt = 7 THEN strftime(CAST(l_shipdate AS DATE), '%d-%b-%Y')
              WHEN dirt = 13 THEN strftime(CAST(l_shipdate AS DATE), '%d-%b-%y')
              WHEN dirt = 14 THEN strftime(CAST(l_shipdate AS DATE), '%d/%m/%Y 00:00')
              ELSE strftime(CAST(l_shipdate AS DATE), '%d-%m-%Y') END AS vdate_text,
         CASE WHEN dirt = 3 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS vdate,
         CASE WHEN dirt = 8 THEN '  ' || upper(s_name) WHEN dirt = 12 THEN s_name || chr(10) || '(up)'
              ELSE s_name END AS vsupp_text,
         lower(CASE WHEN dirt = 12 THEN s_name || chr(10) || '(up)' ELSE s_name END) AS vsupp
  FROM vl WHERE is_first),
vfill AS (
  SELECT vl.*, f.vdate_text, f.vdate, f.vsupp_text, f.vsupp,
         CASE WHEN dirt = 0 THEN '  Freight Charge ' WHEN dirt = 4 THEN chr(9) || upper(p_brand) || chr(160)
              ELSE p_brand || tail END AS item_text,
         CASE WHEN dirt = 0 THEN 'freight charge' ELSE lower(p_brand || tail) END AS item_norm
  FROM (SELECT *, CASE WHEN dirt = 9 THEN chr(10) || 'spare part' WHEN dirt = 10 THEN ', 5" pipe'
                       WHEN dirt = 16 THEN chr(10) || '"' || chr(10) || '"x' ELSE '' END AS tail FROM vl) vl
  JOIN firsts f ON vl.l_orderkey = f.l_orderkey),
vkept AS (SELECT * FROM vfill WHERE dirt NOT IN (0, 1)),
vclean AS (
  SELECT last_value(vdate IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY """ + VL_ORDER + """
                                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS doc_date,
         vdate AS parsed_date, CAST(l_orderkey AS VARCHAR) AS voucher_no, vsupp AS supplier, item_norm AS item,
         CASE WHEN dirt IN (5, 11) THEN NULL ELSE l_quantity END AS qty, l_extendedprice / l_quantity AS price,
         CASE WHEN dirt = 2 THEN 1234.5 WHEN dirt = 15 THEN NULL ELSE l_extendedprice END AS amount, l_returnflag AS unit
  FROM vkept)"""
