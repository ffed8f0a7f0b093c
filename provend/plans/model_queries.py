"""Registered queries for the fitted models (rows-only checks) and their SQL-exact inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from provend.operators import aggregates as agg
from provend.operators import boosting, leadtime, outliers, smoothing
from provend.operators import forecast as fc
from provend.operators import series as ser
from provend.plans import oracle as O
from provend.plans.catalog import demand, links, pv, query, r6
from provend.session import materialize
from provend.sources import testdata as td


def model_table(spark, d):
    return boosting.train_models(ser.sparse_series(pv(spark, d)))


def base_forecast(spark, d):
    return fc.simple_forecast(demand(spark, d), 1.30)


@query("boosted_train")
def q_boosted_train(spark, d):
    return model_table(spark, d).select("item", "supplier", "n_points", "status", "model_mape", "baseline_mape",
                                        (F.size("leaf") / boosting.N_LEAF).cast("int").alias("n_trees"))


@query("training_counts")
def q_training_counts(spark, d):
    return boosting.training_counts(model_table(spark, d))


@query("boosted_forecast")
def q_boosted_forecast(spark, d):
    out = boosting.boosted_forecast(base_forecast(spark, d), model_table(spark, d), 1.30)
    return out.select("item", "supplier", "unit", "monthly_reorder_qty", "forecast_algorithm", "backtest_mape_pct",
                      "quarterly_reorder_qty")


#: two trees: one steps by month, one by the month counter
MONTH_TREE = ([1] * boosting.N_SPLIT, [7.0, 4.0, 10.0, 2.0, 5.0, 8.0, 11.0], [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0])
COUNTER_TREE = ([0] * boosting.N_SPLIT, [40.0] + [boosting.NO_SPLIT] * (boosting.N_SPLIT - 1), [-2.5, 0.0, 0.0, 0.0, 4.5, 0.0, 0.0, 0.0])


@query("boosted_score", O.with_(O.PV, O.DEMAND) + """,
steps AS (SELECT *, months_covered + s AS t, (months_covered + s) % 12 + 1 AS mon FROM demand, range(3) r(s)),
scored AS (
  SELECT item, supplier, unit, s, 10.0
         + CASE WHEN mon < 2 THEN 1.0 WHEN mon < 4 THEN 2.0 WHEN mon < 5 THEN 3.0 WHEN mon < 7 THEN 4.0
                WHEN mon < 8 THEN 5.0 WHEN mon < 10 THEN 6.0 WHEN mon < 11 THEN 7.0 ELSE 8.0 END
         + CASE WHEN t >= 40 THEN 4.5 ELSE -2.5 END AS p
  FROM steps WHERE right(supplier, 1) IN ('0', '2', '4', '6', '8')),
sums AS (SELECT item, supplier, unit, MAX(CASE WHEN s = 0 THEN p END) AS p1, SUM(p) AS p3 FROM scored
         GROUP BY item, supplier, unit)
SELECT d.item, d.supplier, d.unit,
       CAST(ceil(CAST(COALESCE(p1, avg_monthly_qty) AS DOUBLE) * 1.3) AS DOUBLE) AS monthly_reorder_qty,
       CAST(ceil(CAST(COALESCE(p3, avg_quarterly_qty) AS DOUBLE) * 1.3) AS DOUBLE) AS quarterly_reorder_qty,
       CASE WHEN p1 IS NULL THEN 'Baseline Average' ELSE 'XGBoost' END AS forecast_algorithm,
       CASE WHEN p1 IS NOT NULL THEN CAST(25.0 AS DOUBLE) END AS backtest_mape_pct
FROM demand d LEFT JOIN sums USING (item, supplier, unit)""")
def q_boosted_score(spark, d):
    """Scoring by a given model table: fixed trees for the suppliers of even numbers."""
    base = base_forecast(spark, d)
    feat, thr, leaf = (a + b for a, b in zip(MONTH_TREE, COUNTER_TREE))
    kept = F.right("supplier", F.lit(1)).isin("0", "2", "4", "6", "8")
    models = base.select("item", "supplier").distinct().select(
        "item", "supplier", F.lit(12).cast("long").alias("n_points"), F.lit(None).cast("date").alias("last_month"),
        F.when(kept, F.lit("persisted")).otherwise(F.lit("failed_validation")).alias("status"),
        F.lit(10.0).alias("base_score"), F.array(*map(F.lit, feat)).alias("feat"),
        F.array(*map(F.lit, thr)).alias("thr"), F.array(*map(F.lit, leaf)).alias("leaf"),
        F.lit(0.25).alias("model_mape"), F.lit(None).cast("double").alias("baseline_mape"))
    out = boosting.boosted_forecast(base, models, 1.30)
    return out.select("item", "supplier", "unit", "monthly_reorder_qty", "quarterly_reorder_qty",
                      "forecast_algorithm", "backtest_mape_pct")


@query("holt_winters_forecast")
def q_holt_winters_forecast(spark, d):
    fits = smoothing.fit_pairs(ser.dense_series(pv(spark, d)))
    out = smoothing.holt_winters_forecast(base_forecast(spark, d), fits, 1.30)
    return out.select("item", "supplier", "unit", "monthly_reorder_qty", "quarterly_reorder_qty",
                      "forecast_algorithm", "backtest_mape_pct")


HW_WEIGHTS = (0.3, 0.1, 0.2)


@query("hw_recursion", O.with_(O.PV, O.SERIES).replace("WITH ", "WITH RECURSIVE ", 1) + """,
head AS (
  SELECT item, supplier, COUNT(*) AS n, AVG(qty) FILTER (WHERE time_idx < 12) AS c1,
         AVG(qty) FILTER (WHERE time_idx BETWEEN 12 AND 23) AS c2,
         list(qty ORDER BY time_idx) FILTER (WHERE time_idx < 12) AS q
  FROM dense GROUP BY item, supplier HAVING COUNT(*) >= 24),
start AS (
  SELECT item, supplier, n, (c2 - c1) / 12 AS slope, c1 - (c2 - c1) / 12 * 6.5 AS level, q FROM head),
rec AS (
  SELECT item, supplier, n, CAST(0 AS BIGINT) AS t, level, slope, CAST(0.0 AS DOUBLE) AS sse,
         list_transform(q, lambda x, i: x - (level + slope * i)) AS season FROM start
  UNION ALL
  SELECT item, supplier, n, t + 1, new, 0.1 * (new - level) + 0.9 * slope, sse + (y - base - s) * (y - base - s),
         list_transform(season, lambda x, i: CASE WHEN i = t % 12 + 1 THEN 0.2 * (y - new) + 0.8 * s ELSE x END)
  FROM (SELECT r.*, d.qty AS y, r.level + r.slope AS base, r.season[r.t % 12 + 1] AS s,
               0.3 * (d.qty - r.season[r.t % 12 + 1]) + 0.7 * (r.level + r.slope) AS new
        FROM rec r JOIN dense d ON d.item = r.item AND d.supplier = r.supplier AND d.time_idx = r.t) x)
SELECT item, supplier, n AS n_months, ROUND(sse, 4) AS sse, ROUND(level + slope + season[n % 12 + 1], 6) AS p1,
       ROUND(level + 2 * slope + season[(n + 1) % 12 + 1], 6) AS p2,
       ROUND(level + 3 * slope + season[(n + 2) % 12 + 1], 6) AS p3
FROM rec WHERE t = n""")
def q_hw_recursion(spark, d):
    """The smoothing recursion with given weights, from the start state of the first two cycles."""
    out = smoothing.smooth_pairs(ser.dense_series(pv(spark, d)), HW_WEIGHTS)
    return out.select("item", "supplier", "n_months", F.round("sse", 4).alias("sse"), *[r6(c).alias(c) for c in ("p1", "p2", "p3")])


def ensemble(spark, d):
    base = materialize(base_forecast(spark, d))
    models = model_table(spark, d)
    fits = materialize(smoothing.fit_pairs(ser.dense_series(pv(spark, d))))
    boosted = boosting.boosted_forecast(base, models, 1.30)
    hw = smoothing.holt_winters_forecast(base, fits, 1.30)
    return fc.ensemble_forecast(base, boosted, hw)


@query("ensemble_forecast")
def q_ensemble_forecast(spark, d):
    return ensemble(spark, d).select("item", "supplier", "unit", "monthly_reorder_qty", "quarterly_reorder_qty",
                                     "forecast_algorithm", "backtest_mape_pct")


@query("anomaly_features", O.with_(O.PV) + """
SELECT doc_date, voucher_no, supplier, item, qty, COALESCE(price, 0.0) AS unit_price, COALESCE(qty, 0.0) AS qty_f,
       CAST(COALESCE(month(doc_date), 1) AS DOUBLE) AS month_of_year FROM pv""")
def q_anomaly_features(spark, d):
    f = outliers.anomaly_features(pv(spark, d))
    return f.select("doc_date", "voucher_no", "supplier", "item", "qty", *outliers.FEATURES)


@query("isolation_forest")
def q_isolation_forest(spark, d):
    return outliers.detect(pv(spark, d))


@query("lead_time_training")
def q_lead_time_training(spark, d):
    lk = materialize(links(spark, d))
    summary, _ = leadtime.train_lead_time_model(lk, agg.lead_time_stats(lk))
    return summary


@query("lead_time_baseline", O.with_(O.POV, O.GRN, O.LINKS, O.LEAD_STATS) + """
SELECT p.pov_date, p.pov_no, p.supplier, p.item, p.pov_qty,
       COALESCE(s.avg_lead_time_days, 0.0) AS predicted_lead_time_days
FROM pov_b p LEFT JOIN lead_stats s ON p.item = s.item AND p.supplier = s.supplier""")
def q_lead_time_baseline(spark, d):
    rows = td.pov_view(spark, d).select(F.col("doc_date").alias("pov_date"), F.col("voucher_no").alias("pov_no"),
                                        "supplier", "item", F.col("qty").alias("pov_qty"))
    return leadtime.predict_lead_time(rows, agg.lead_time_stats(links(spark, d)))


@query("training_totals", O.with_(O.PV, O.SERIES) + """
SELECT COUNT(*) AS processed, COUNT(*) FILTER (WHERE status = 'skipped_sparsity') AS skipped_sparsity,
       COUNT(*) FILTER (WHERE status = 'evaluated') AS evaluated FROM bmape""")
def q_training_totals(spark, d):
    """The counters of a training that do not depend on the fitted trees."""
    skipped = F.col("status") == "skipped_sparsity"
    return model_table(spark, d).agg(F.count("*").alias("processed"), F.count_if(skipped).alias("skipped_sparsity"),
                                     F.count_if(~skipped).alias("evaluated"))


@query("report_manifest", O.with_(O.PV, O.POV, O.GRN, O.DEMAND, O.LINKS, O.LEAD_STATS, O.SUPPLIER_MATRIX, O.SERIES) + """
SELECT * FROM (
  SELECT CAST(1 AS INTEGER) AS position, 'summary' AS table_name, 'Summary' AS title, CAST(1 AS BIGINT) AS n_rows
  UNION ALL SELECT 2, 'abc_classification', 'ABC Classification', COUNT(*) FROM demand
  UNION ALL SELECT 3, 'monthly_forecast', 'Monthly Forecast', COUNT(*) FROM demand
  UNION ALL SELECT 4, 'quarterly_forecast', 'Quarterly Forecast', COUNT(*) FROM demand
  UNION ALL SELECT 5, 'exceptions', 'Delivery Exceptions',
    (SELECT COUNT(*) FROM pov WHERE NOT EXISTS (SELECT 1 FROM grn WHERE grn.item = pov.item AND grn.supplier = pov.supplier))
    + (SELECT COUNT(*) FROM grn WHERE NOT EXISTS (SELECT 1 FROM pov WHERE grn.item = pov.item AND grn.supplier = pov.supplier))
  UNION ALL SELECT 6, 'supplier_risk_report', 'Supplier Risk Report', COUNT(*) FROM matrix
  UNION ALL SELECT 7, 'monthly_breakdown', 'Monthly Breakdown', COUNT(*) FROM sparse
  UNION ALL SELECT 8, 'lead_times', 'Lead Times', COUNT(*) FROM lead_stats
  UNION ALL SELECT 10, 'raw_grn', 'Raw GRN', COUNT(*) FROM grn
  UNION ALL SELECT 11, 'raw_pov', 'Raw POV', COUNT(*) FROM pov
  UNION ALL SELECT 12, 'raw_pv', 'Raw PV', COUNT(*) FROM pv) t WHERE n_rows > 0""")
def q_report_manifest(spark, d):
    """The whole pipeline over the document views, written by the report sink; rows per table. The number of outlier
    transactions depends on fitted trees, so their line is left out."""
    from provend.plans import pipeline
    from provend.session import scratch_path
    from provend.sinks.report import write_report
    docs = pipeline.prepare(spark, docs=td.documents(spark, d))
    results = pipeline.run(spark, docs, models=pipeline.train(docs))
    written = write_report(spark, results, scratch_path(spark, "report"))
    return written.where("table_name <> 'anomaly_report'").drop("path", "seconds")
