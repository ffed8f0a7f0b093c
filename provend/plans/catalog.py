"""Registered queries: one Spark builder ``(spark, sf_dir) -> DataFrame`` per operator,
paired with its DuckDB oracle SQL (None for model-fitting operators, which get a
rows-only check and property tests instead).

Every query reads the driver's tables through the document views of
``provend.sources.testdata`` over whole tables; no row caps or id subsets.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provend.operators import aggregates as agg
from provend.operators import forecast as fc
from provend.functions.exprs import mape_percent
from provend.operators import linking, ranking, risk
from provend.operators import series as ser
from provend.plans import oracle as O
from provend.sources import testdata as td

Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Builder, str | None]] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def r6(c) -> F.Column:
    """Round an algorithm-dependent double to 6 places (same rule in the oracle)."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# ---------------------------------------------------------------- shared builders

def pv(spark, d):
    return td.pv_view(spark, d)


def demand(spark, d):
    return agg.demand_aggregate(pv(spark, d))


def abc(spark, d):
    return ranking.abc_classify(demand(spark, d))


def links(spark, d):
    return linking.link_orders(td.pov_view(spark, d), td.grn_view(spark, d))


def matrix(spark, d):
    return agg.supplier_matrix(pv(spark, d), links(spark, d))


DEMAND_COLS = ["item", "supplier", "unit", "total_qty", "total_value", "avg_unit_price", "months_covered",
               "avg_monthly_qty", "avg_quarterly_qty"]
ABC_COLS = DEMAND_COLS + ["cumulative_value_pct", "value_rank", "abc_class"]


# ---------------------------------------------------------------- aggregates, ranking, forecast

@query("demand_aggregate", O.with_(O.PV, O.DEMAND) + "SELECT * FROM demand")
def q_demand(spark, d):
    return demand(spark, d).select(*DEMAND_COLS)


@query("zero_demand_items", O.with_(O.PV, O.DEMAND) +
       "SELECT item, supplier, unit, avg_monthly_qty, avg_monthly_qty = 0 AS zero_demand FROM demand")
def q_zero_demand(spark, d):
    return agg.zero_demand(demand(spark, d)).select("item", "supplier", "unit", "avg_monthly_qty", "zero_demand")


@query("abc_classification", O.with_(O.PV, O.DEMAND, O.ABC) +
       "SELECT " + ", ".join(ABC_COLS) + " FROM abc")
def q_abc(spark, d):
    return abc(spark, d).select(*ABC_COLS)


@query("simple_forecast", O.with_(O.PV, O.DEMAND, O.ABC) +
       "SELECT " + ", ".join(ABC_COLS) + ", CAST(CEIL(avg_monthly_qty * 1.3) AS DOUBLE) AS monthly_reorder_qty, "
       "CAST(CEIL(avg_quarterly_qty * 1.3) AS DOUBLE) AS quarterly_reorder_qty FROM abc")
def q_simple_forecast(spark, d):
    return fc.simple_forecast(abc(spark, d), 1.30).select(*ABC_COLS, "monthly_reorder_qty", "quarterly_reorder_qty")


@query("monthly_forecast", O.with_(O.PV, O.DEMAND) +
       "SELECT item, supplier, unit, CAST(CEIL(avg_monthly_qty * 1.3) AS DOUBLE) AS monthly_reorder_qty FROM demand")
def q_monthly_forecast(spark, d):
    return fc.monthly_forecast(fc.simple_forecast(demand(spark, d), 1.30))


@query("quarterly_forecast", O.with_(O.PV, O.DEMAND) +
       "SELECT item, supplier, unit, CAST(CEIL(avg_quarterly_qty * 1.3) AS DOUBLE) AS quarterly_reorder_qty "
       "FROM demand")
def q_quarterly_forecast(spark, d):
    return fc.quarterly_forecast(fc.simple_forecast(demand(spark, d), 1.30))


@query("class_counts", O.with_(O.PV, O.DEMAND, O.ABC) +
       "SELECT abc_class, COUNT(*) AS n_items FROM abc GROUP BY abc_class")
def q_class_counts(spark, d):
    return agg.class_counts(abc(spark, d))


@query("run_summary", O.with_(O.PV, O.DEMAND, O.ABC) + """
SELECT COALESCE(strftime((SELECT MIN(doc_date) FROM pv), '%Y-%m-%d'), 'N/A') AS date_range_start,
       COALESCE(strftime((SELECT MAX(doc_date) FROM pv), '%Y-%m-%d'), 'N/A') AS date_range_end,
       COUNT(*) AS total_items_processed,
       COUNT(*) FILTER (WHERE abc_class = 'A') AS class_a_items,
       COUNT(*) FILTER (WHERE abc_class = 'B') AS class_b_items,
       COUNT(*) FILTER (WHERE abc_class = 'C') AS class_c_items
FROM abc""")
def q_run_summary(spark, d):
    return agg.run_summary(pv(spark, d), abc(spark, d))


@query("results_preview", O.with_(O.PV, O.DEMAND, O.ABC) +
       "SELECT " + ", ".join(ABC_COLS) + " FROM abc ORDER BY total_value DESC, item, supplier, unit")
def q_results_preview(spark, d):
    return ranking.results_preview(abc(spark, d)).select(*ABC_COLS)


PARETO_SQL = """pareto AS (
  SELECT item, supplier, unit, value_rank, value_rank / (SELECT COUNT(*) FROM abc) * 100 AS x_pct,
         total_value AS y_value, cumulative_value_pct AS y_pct, abc_class FROM abc)"""


@query("pareto_curve", O.with_(O.PV, O.DEMAND, O.ABC, PARETO_SQL) + "SELECT * FROM pareto")
def q_pareto_curve(spark, d):
    return ranking.pareto_curve(abc(spark, d))


@query("pareto_boundaries", O.with_(O.PV, O.DEMAND, O.ABC, PARETO_SQL) + """
SELECT COALESCE(arg_max(x_pct, value_rank) FILTER (WHERE abc_class = 'A'), 0.0) AS x_ab,
       COALESCE(arg_max(y_pct, value_rank) FILTER (WHERE abc_class = 'A'), 70.0) AS y_ab,
       COALESCE(arg_max(x_pct, value_rank) FILTER (WHERE abc_class = 'B'),
                arg_max(x_pct, value_rank) FILTER (WHERE abc_class = 'A'), 0.0) AS x_bc,
       COALESCE(arg_max(y_pct, value_rank) FILTER (WHERE abc_class = 'B'), 90.0) AS y_bc
FROM pareto""")
def q_pareto_boundaries(spark, d):
    return ranking.pareto_boundaries(ranking.pareto_curve(abc(spark, d)))


# ---------------------------------------------------------------- linking, lead times, suppliers

@query("link_orders", O.with_(O.POV, O.GRN, O.LINKS) + "SELECT * FROM links")
def q_link_orders(spark, d):
    return links(spark, d)


@query("exceptions", O.with_(O.POV, O.GRN, O.LINKS) + """
SELECT pov_date, pov_no, supplier, item, pov_qty, CAST(NULL AS DATE) AS grn_date, CAST(NULL AS VARCHAR) AS grn_no,
       CAST(NULL AS DOUBLE) AS grn_qty, 'Pending Delivery (PO missing GRN)' AS anomaly_type
FROM pov_b p WHERE NOT EXISTS (SELECT 1 FROM grn_b g WHERE g.item IS NOT DISTINCT FROM p.item
                                AND g.supplier IS NOT DISTINCT FROM p.supplier)
UNION ALL
SELECT CAST(NULL AS DATE), CAST(NULL AS VARCHAR), supplier, item, CAST(NULL AS DOUBLE), grn_date, grn_no, grn_qty,
       'Unordered Delivery (GRN missing PO)'
FROM grn_b g WHERE NOT EXISTS (SELECT 1 FROM pov_b p WHERE g.item IS NOT DISTINCT FROM p.item
                                AND g.supplier IS NOT DISTINCT FROM p.supplier)""")
def q_exceptions(spark, d):
    return linking.exceptions(td.pov_view(spark, d), td.grn_view(spark, d))


LEAD_COLS = ["item", "supplier", "avg_lead_time_days", "median_lead_time_days", "min_lead_time_days",
             "max_lead_time_days", "observation_count"]


@query("lead_time_stats", O.with_(O.POV, O.GRN, O.LINKS, O.LEAD_STATS) +
       "SELECT " + ", ".join(LEAD_COLS) + " FROM lead_stats")
def q_lead_time_stats(spark, d):
    return agg.lead_time_stats(links(spark, d)).select(*LEAD_COLS)


@query("lead_time_low_sample", O.with_(O.POV, O.GRN, O.LINKS, O.LEAD_STATS) +
       "SELECT item, supplier, observation_count, low_sample FROM lead_stats")
def q_lead_time_low_sample(spark, d):
    return agg.lead_time_stats(links(spark, d)).select("item", "supplier", "observation_count", "low_sample")


@query("supplier_matrix", O.with_(O.PV, O.POV, O.GRN, O.LINKS, O.SUPPLIER_MATRIX) + """
SELECT supplier, total_spend_volume, median_lead_time, ROUND(std_lead_time, 6) AS std_lead_time,
       observation_count, is_valid FROM matrix""")
def q_supplier_matrix(spark, d):
    m = matrix(spark, d)
    return m.select("supplier", "total_spend_volume", "median_lead_time", r6("std_lead_time").alias("std_lead_time"),
                    "observation_count", "is_valid")


@query("distinct_pairs", O.with_(O.PV) +
       "SELECT DISTINCT item, supplier FROM pv WHERE item IS NOT NULL AND supplier IS NOT NULL")
def q_distinct_pairs(spark, d):
    return agg.distinct_pairs(pv(spark, d))


@query("supplier_caps", O.with_(O.PV, O.POV, O.GRN, O.LINKS, O.SUPPLIER_MATRIX) + """
SELECT ROUND(quantile_cont(total_spend_volume, 0.95), 6) AS total_spend_volume_cap,
       ROUND(quantile_cont(median_lead_time, 0.95), 6) AS median_lead_time_cap,
       ROUND(quantile_cont(std_lead_time, 0.95), 6) AS std_lead_time_cap
FROM matrix WHERE is_valid""")
def q_supplier_caps(spark, d):
    m = matrix(spark, d).where("is_valid")
    caps = agg.quantile_caps(m, ["total_spend_volume", "median_lead_time", "std_lead_time"])
    return caps.select(*[r6(c).alias(c) for c in caps.columns])


# ---------------------------------------------------------------- supplier risk

RISK_SQL = """valid AS (SELECT supplier, total_spend_volume, median_lead_time, std_lead_time, observation_count
            FROM matrix WHERE is_valid),
rk AS (
  SELECT v.*,
    (RANK() OVER (ORDER BY total_spend_volume) - 1 + (COUNT(*) OVER (PARTITION BY total_spend_volume) + 1) / 2)
      / COUNT(*) OVER () AS spend_pct,
    (RANK() OVER (ORDER BY median_lead_time) - 1 + (COUNT(*) OVER (PARTITION BY median_lead_time) + 1) / 2)
      / COUNT(*) OVER () AS lt_med_pct,
    (RANK() OVER (ORDER BY std_f) - 1 + (COUNT(*) OVER (PARTITION BY std_f) + 1) / 2)
      / COUNT(*) OVER () AS lt_std_pct
  FROM (SELECT *, COALESCE(std_lead_time, (SELECT MEDIAN(std_lead_time) FROM valid)) AS std_f FROM valid) v),
scored AS (
  SELECT *, lt_med_pct * 0.4 + lt_std_pct * 0.4 + (1.0 - spend_pct) * 0.2 AS risk_score FROM rk),
tiers AS (
  SELECT *, CASE WHEN risk_score <= 0.33 THEN 'Low Risk' WHEN risk_score <= 0.66 THEN 'Medium Risk'
                 ELSE 'High Risk' END AS risk_tier FROM scored),
caps AS (SELECT quantile_cont(total_spend_volume, 0.95) AS cs, quantile_cont(median_lead_time, 0.95) AS cm,
                quantile_cont(std_lead_time, 0.95) AS cd FROM valid),
feat AS (
  SELECT v.*, ln(1 + GREATEST(LEAST(total_spend_volume, cs), 0.0)) AS spend_log,
         LEAST(median_lead_time, cm) AS lt_median, LEAST(std_lead_time, cd) AS lt_std
  FROM valid v, caps),
qs AS (
  SELECT quantile_cont(spend_log, [0.25, 0.5, 0.75]) AS qa, quantile_cont(lt_median, [0.25, 0.5, 0.75]) AS qb,
         quantile_cont(lt_std, [0.25, 0.5, 0.75]) AS qc FROM feat),
scaled AS (
  SELECT f.*,
    (spend_log - qa[2]) / CASE WHEN qa[3] - qa[1] = 0 THEN 1.0 ELSE qa[3] - qa[1] END AS spend_log_scaled,
    (lt_median - qb[2]) / CASE WHEN qb[3] - qb[1] = 0 THEN 1.0 ELSE qb[3] - qb[1] END AS lt_median_scaled,
    (lt_std - qc[2]) / CASE WHEN qc[3] - qc[1] = 0 THEN 1.0 ELSE qc[3] - qc[1] END AS lt_std_scaled
  FROM feat f, qs)"""

RISK_BASE = (O.PV, O.POV, O.GRN, O.LINKS, O.SUPPLIER_MATRIX, RISK_SQL)


def valid_matrix(spark, d):
    from provend.session import materialize
    return materialize(matrix(spark, d).where("is_valid").select(*risk.MATRIX_COLS))


def scaled_features(spark, d):
    return risk.robust_scale(risk.supplier_features(valid_matrix(spark, d)), risk.FEATURES)


@query("rank_pct", O.with_(O.PV) + """
SELECT doc_date, voucher_no, supplier, item, qty,
       ROUND((RANK() OVER (ORDER BY qty) - 1 + (COUNT(*) OVER (PARTITION BY qty) + 1) / 2)
             / COUNT(*) OVER (), 6) AS qty_pct
FROM pv WHERE qty IS NOT NULL""")
def q_rank_pct(spark, d):
    p = pv(spark, d).where(F.col("qty").isNotNull()).select("doc_date", "voucher_no", "supplier", "item", "qty")
    return ranking.rank_pct(p, "qty", "qty_pct").withColumn("qty_pct", r6("qty_pct"))


@query("supplier_features", O.with_(*RISK_BASE) + """
SELECT supplier, ROUND(spend_log, 6) AS spend_log, ROUND(lt_median, 6) AS lt_median, ROUND(lt_std, 6) AS lt_std
FROM feat""")
def q_supplier_features(spark, d):
    f = risk.supplier_features(valid_matrix(spark, d))
    return f.select("supplier", *[r6(c).alias(c) for c in risk.FEATURES])


@query("robust_scale", O.with_(*RISK_BASE) + """
SELECT supplier, ROUND(spend_log_scaled, 6) AS spend_log_scaled, ROUND(lt_median_scaled, 6) AS lt_median_scaled,
       ROUND(lt_std_scaled, 6) AS lt_std_scaled FROM scaled""")
def q_robust_scale(spark, d):
    f = scaled_features(spark, d)
    return f.select("supplier", *[r6(c + "_scaled").alias(c + "_scaled") for c in risk.FEATURES])


@query("supplier_risk_quantile", O.with_(*RISK_BASE) + """
SELECT supplier, ROUND(spend_pct, 6) AS spend_pct, ROUND(lt_med_pct, 6) AS lt_med_pct,
       ROUND(lt_std_pct, 6) AS lt_std_pct, ROUND(risk_score, 6) AS risk_score, risk_tier FROM tiers""")
def q_supplier_risk_quantile(spark, d):
    t = risk.quantile_tiers(valid_matrix(spark, d), checkpoint=False)
    return t.select("supplier", *[r6(c).alias(c) for c in ["spend_pct", "lt_med_pct", "lt_std_pct", "risk_score"]],
                    "risk_tier")


@query("supplier_risk_colour", O.with_(*RISK_BASE) + """
SELECT supplier, risk_tier, CASE WHEN upper(risk_tier) LIKE '%HIGH%' THEN 'red'
                                 WHEN upper(risk_tier) LIKE '%MEDIUM%' THEN 'yellow'
                                 WHEN upper(risk_tier) LIKE '%LOW%' THEN 'green' END AS risk_colour
FROM tiers""")
def q_supplier_risk_colour(spark, d):
    from provend.functions.exprs import risk_colour
    t = risk.quantile_tiers(valid_matrix(spark, d), checkpoint=False)
    return t.select("supplier", "risk_tier", risk_colour("risk_tier").alias("risk_colour"))


@query("silhouette", O.with_(*RISK_BASE) + """,
pts AS (SELECT s.supplier, CASE t.risk_tier WHEN 'Low Risk' THEN 0 WHEN 'Medium Risk' THEN 1 ELSE 2 END AS label,
               spend_log_scaled AS x1, lt_median_scaled AS x2, lt_std_scaled AS x3
        FROM scaled s JOIN tiers t ON s.supplier = t.supplier),
per AS (SELECT p.supplier, p.label, q.label AS ql,
               SUM(sqrt((p.x1 - q.x1) ^ 2 + (p.x2 - q.x2) ^ 2 + (p.x3 - q.x3) ^ 2)) AS sd
        FROM pts p JOIN pts q ON p.supplier <> q.supplier GROUP BY p.supplier, p.label, q.label),
cnt AS (SELECT label, COUNT(*) AS c FROM pts GROUP BY label),
ab AS (SELECT p.supplier, p.label, COALESCE(MAX(sd / (c.c - 1)) FILTER (WHERE ql = p.label), 0.0) AS a,
              MIN(sd / c2.c) FILTER (WHERE ql <> p.label) AS b, MAX(c.c) AS own_c
       FROM pts p LEFT JOIN per ON per.supplier = p.supplier JOIN cnt c ON c.label = p.label
            LEFT JOIN cnt c2 ON c2.label = per.ql
       GROUP BY p.supplier, p.label)
SELECT supplier, label, ROUND(a, 6) AS a, ROUND(b, 6) AS b,
       ROUND(CASE WHEN own_c = 1 THEN 0.0 ELSE (b - a) / GREATEST(a, b) END, 6) AS silhouette FROM ab""")
def q_silhouette(spark, d):
    v = valid_matrix(spark, d)
    f = risk.robust_scale(risk.supplier_features(v), risk.FEATURES)
    t = risk.quantile_tiers(v, checkpoint=False).select("supplier", "risk_tier")
    lab = F.when(F.col("risk_tier") == risk.LOW, 0).when(F.col("risk_tier") == risk.MEDIUM, 1).otherwise(2)
    pts = f.join(t, "supplier").withColumn("label", lab.cast("int"))
    s = risk.silhouette_points(pts, [c + "_scaled" for c in risk.FEATURES], "label", "supplier")
    return s.select("supplier", "label", *[r6(c).alias(c) for c in ["a", "b", "silhouette"]])


#: centres for the query below, not in the order of their tiers
FIXED_CENTRES = ((0.2, 1.0, 0.5), (-0.1, -0.6, -0.4), (0.0, 0.1, 0.0))


def _distance_sql(centre) -> str:
    cols = ("spend_log_scaled", "lt_median_scaled", "lt_std_scaled")
    return " + ".join(f"pow({c} - ({v}), 2)" for c, v in zip(cols, centre))


@query("cluster_tiers", O.with_(*RISK_BASE) + f""",
dist AS (SELECT supplier, {", ".join(f"{_distance_sql(c)} AS d{i}" for i, c in enumerate(FIXED_CENTRES))} FROM scaled)
SELECT supplier, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 'High Risk' WHEN d1 <= d2 THEN 'Low Risk'
                      ELSE 'Medium Risk' END AS risk_tier FROM dist""")
def q_cluster_tiers(spark, d):
    centres = np.array(FIXED_CENTRES)
    label = risk.nearest_centre([c + "_scaled" for c in risk.FEATURES], centres)
    return scaled_features(spark, d).select("supplier", risk.cluster_tier(label, centres).alias("risk_tier"))


@query("supplier_risk")
def q_supplier_risk(spark, d):
    return risk.segment_suppliers(matrix(spark, d))


# ---------------------------------------------------------------- monthly series and model inputs

SER = (O.PV, O.SERIES)


@query("monthly_series_sparse", O.with_(*SER) + "SELECT * FROM sparse")
def q_monthly_series_sparse(spark, d):
    return ser.sparse_series(pv(spark, d)).withColumn("time_idx", F.col("time_idx").cast("long"))


@query("monthly_series_dense", O.with_(*SER) + "SELECT * FROM dense")
def q_monthly_series_dense(spark, d):
    return ser.dense_series(pv(spark, d))


@query("train_test_split", O.with_(*SER) +
       "SELECT item, supplier, month_start, qty, time_idx, n_points, split FROM split")
def q_train_test_split(spark, d):
    s = ser.train_test_split(ser.sparse_series(pv(spark, d)))
    return s.select("item", "supplier", "month_start", "qty", F.col("time_idx").cast("long").alias("time_idx"),
                    "n_points", "split")


@query("training_baseline_mape", O.with_(*SER) + """
SELECT item, supplier, n_points, status, ROUND(train_mean, 6) AS train_mean, ROUND(baseline_mape, 6) AS baseline_mape
FROM bmape""")
def q_training_baseline_mape(spark, d):
    b = ser.baseline_mape(ser.sparse_series(pv(spark, d)))
    return b.select("item", "supplier", "n_points", "status", r6("train_mean").alias("train_mean"),
                    r6("baseline_mape").alias("baseline_mape"))


def level_mape(spark, d):
    """Positive-only in-sample MAPE of each pair's dense series against its own mean level."""
    dense = ser.dense_series(pv(spark, d))
    lvl = dense.groupBy("item", "supplier").agg(F.avg("qty").alias("_level"))
    return dense.join(lvl, ["item", "supplier"]).groupBy("item", "supplier") \
        .agg(ser.positive_mape("qty", "_level").alias("level_mape_pos"), F.count(F.lit(1)).alias("n_months"))


LEVEL_SQL = """lvl AS (
  SELECT item, supplier, AVG(CASE WHEN qty > 0 THEN abs(qty - level) / qty END) AS level_mape_pos,
         COUNT(*) AS n_months
  FROM (SELECT *, AVG(qty) OVER (PARTITION BY item, supplier) AS level FROM dense) x GROUP BY item, supplier)"""


@query("mape_metrics", O.with_(*SER, LEVEL_SQL) + """
SELECT b.item, b.supplier, ROUND(b.baseline_mape, 6) AS baseline_mape, ROUND(l.level_mape_pos, 6) AS level_mape_pos
FROM bmape b JOIN lvl l ON b.item = l.item AND b.supplier = l.supplier""")
def q_mape_metrics(spark, d):
    b = ser.baseline_mape(ser.sparse_series(pv(spark, d)))
    lv = level_mape(spark, d)
    return b.join(lv, ["item", "supplier"]).select(
        "item", "supplier", r6("baseline_mape").alias("baseline_mape"), r6("level_mape_pos").alias("level_mape_pos"))


@query("boosted_features", O.with_(O.PV, O.DEMAND) + """
SELECT item, supplier, unit, CAST(s AS INTEGER) AS step, months_covered + s AS time_idx,
       CAST((months_covered + s) % 12 + 1 AS INTEGER) AS month,
       CAST(((months_covered + s) // 3) % 4 + 1 AS INTEGER) AS quarter
FROM demand, range(3) t(s)""")
def q_boosted_features(spark, d):
    return ser.forecast_features(demand(spark, d))


@query("hw_eligibility", O.with_(O.PV, O.DEMAND, O.SERIES) + """
SELECT d.item, d.supplier, d.unit, l.n_months, COALESCE(l.n_months, 0) >= 24 AS eligible,
       CASE WHEN COALESCE(l.n_months, 0) >= 24 THEN NULL ELSE 'Baseline Average (Sparsity Fallback)' END
         AS fallback_algorithm
FROM demand d LEFT JOIN dlen l ON d.item = l.item AND d.supplier = l.supplier""")
def q_hw_eligibility(spark, d):
    dem = demand(spark, d).select("item", "supplier", "unit")
    ln = ser.dense_lengths(pv(spark, d))
    el = F.coalesce(F.col("n_months"), F.lit(0)) >= 24
    return dem.join(ln, ["item", "supplier"], "left").select(
        "item", "supplier", "unit", "n_months", el.alias("eligible"),
        F.when(~el, F.lit(fc.SPARSITY_FALLBACK)).alias("fallback_algorithm"))


@query("ensemble_select", O.with_(O.PV, O.DEMAND, O.SERIES, LEVEL_SQL) + """,
cand AS (
  SELECT d.item, d.supplier, d.unit,
         CASE WHEN b.status = 'evaluated' THEN floor(b.baseline_mape * 10000.0 + 0.5) / 100.0 END AS boost_mape,
         CASE WHEN l.n_months >= 24 THEN floor(l.level_mape_pos * 10000.0 + 0.5) / 100.0 END AS smooth_mape
  FROM demand d LEFT JOIN bmape b ON d.item = b.item AND d.supplier = b.supplier
       LEFT JOIN lvl l ON d.item = l.item AND d.supplier = l.supplier)
SELECT item, supplier, unit, boost_mape, smooth_mape,
       'Ensemble: ' || CASE WHEN boost_mape IS NOT NULL AND (smooth_mape IS NULL OR boost_mape <= smooth_mape)
                            THEN 'XGBoost' WHEN smooth_mape IS NOT NULL THEN 'Holt-Winters'
                            ELSE 'Baseline Average' END AS forecast_algorithm,
       CASE WHEN boost_mape IS NOT NULL AND (smooth_mape IS NULL OR boost_mape <= smooth_mape) THEN boost_mape
            ELSE smooth_mape END AS backtest_mape_pct
FROM cand""")
def q_ensemble_select(spark, d):
    dem = demand(spark, d).select("item", "supplier", "unit")
    b = ser.baseline_mape(ser.sparse_series(pv(spark, d)))
    lv = level_mape(spark, d)
    j = dem.join(b, ["item", "supplier"], "left").join(lv, ["item", "supplier"], "left")
    j = j.select("item", "supplier", "unit",
                 F.when(F.col("status") == "evaluated", mape_percent("baseline_mape")).alias("boost_mape"),
                 F.when(F.col("n_months") >= 24, mape_percent("level_mape_pos")).alias("smooth_mape"))
    none = F.lit(None).cast("double")
    cols = fc.select_model(none, none, none, none, F.col("boost_mape"), F.lit(fc.BOOSTED), none, none,
                           F.col("smooth_mape"), F.lit(fc.SMOOTHING))
    return j.select("item", "supplier", "unit", "boost_mape", "smooth_mape",
                    cols["forecast_algorithm"].alias("forecast_algorithm"),
                    cols["backtest_mape_pct"].alias("backtest_mape_pct"))


def _load_query_modules() -> None:
    from provend.plans import cleaning_queries, model_queries, similarity_queries, stock_queries  # noqa: F401


def queries() -> dict[str, Builder]:
    _load_query_modules()
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load_query_modules()
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}
