import re

import __spark_entry__ as E

SURVEY_KEYS = """load_vouchers closing_stock_latest report_manifest supplier_risk_colour forward_fill forward_fill_dates
parse_dates parse_numbers drop_non_item_rows dropped_row_count normalise_names sanitise_export results_filter
link_orders exceptions supplier_matrix lead_time_baseline ensemble_forecast similar_names_tfidf
monthly_series_sparse monthly_series_dense demand_aggregate zero_demand_items lead_time_stats lead_time_low_sample
run_summary class_counts training_counts distinct_pairs supplier_caps abc_classification rank_pct train_test_split
pareto_curve pareto_boundaries results_preview simple_forecast stock_adjusted_forecast boosted_train
training_baseline_mape boosted_features boosted_forecast holt_winters_forecast hw_eligibility ensemble_select
monthly_forecast quarterly_forecast mape_metrics lead_time_training supplier_risk supplier_features robust_scale
silhouette supplier_risk_quantile anomaly_features isolation_forest branch_duplicates base_names
embedding_pairs load_pov load_grn cluster_tiers boosted_score
load_metrics training_totals hw_recursion""".split()

ROWS_ONLY = {"boosted_train", "boosted_forecast", "holt_winters_forecast", "ensemble_forecast", "supplier_risk",
             "isolation_forest", "lead_time_training", "training_counts"}


def test_entry_runs_and_registries_agree(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"abc_class", "monthly_reorder_qty", "cumulative_value_pct"} <= set(df.columns)
    own = lambda d: {k: v for k, v in d.items() if k != "pipeline" and not re.match(r"op\d+_", k)}
    qs, sqls = own(E.queries()), own(E.oracle_sql())
    assert set(qs) == set(SURVEY_KEYS)
    assert set(qs) - set(sqls) == ROWS_ONLY
