"""Pipeline jobs a user runs: prepare (load + clean), run (all analyses), train (models).

Each result is a lazy DataFrame; actions happen only where an operator needs a
statistic (quantile boundaries, cluster choice, tree samples) and at the sink.
Tables that several results read are staged once (Parquet under the shared
checkpoint folder for the large ones, ``checkpoint()`` for small ones), so a lost
executor recomputes from the staged table, not from the raw exports.
"""

from __future__ import annotations

import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from provend import files
from provend.config import Config
from provend.operators import aggregates as agg
from provend.operators import boosting, leadtime, linking, outliers, ranking, risk, similarity, smoothing
from provend.operators import forecast as fc
from provend.operators import series as ser
from provend.plans.staging import Staging
from provend.session import materialize, stage_table
from provend.sources import stock as st
from provend.sources import vouchers as vs
from provend.sources.store import Store

MODELS = "models"  # the table's name in its store
REQUIRED_INPUTS = ("pov_path", "grn_path", "pv_path")
LOAD_REPORT = "document string, " + ", ".join(f"{m} long" for m in vs.METRICS) + ", seconds double"


def prepare(spark: SparkSession, paths: dict[str, str] | None = None, docs: dict[str, DataFrame] | None = None,
            cfg: Config = Config(), staging: Staging | None = None) -> dict[str, DataFrame]:
    """Load and clean the three document kinds (or take given DataFrames); add branch-duplicate flags and,
    for loaded exports, a report of what was read, dropped and not understood."""
    staging = staging or Staging(spark)
    clean, report = {}, []
    if docs is None:
        paths = paths or {}
        for key in REQUIRED_INPUTS:
            if not paths.get(key) or not files.exists(spark, paths[key]):
                raise FileNotFoundError(f"{key}: nothing found at {paths.get(key)!r}")
        for kind in ("pov", "grn", "pv"):
            clean[kind] = load(staging, kind, paths[f"{kind}_path"], cfg)
            report.append((kind.upper(), *staging.notes[f"clean-{kind}"].values()))
        clean["load_report"] = spark.createDataFrame(report, LOAD_REPORT)
    else:
        # the cleaned documents feed every result: staged once as Parquet in the shared folder
        clean = {k: staging.table(f"clean-{k}", lambda v=v: v, "given", uuid.uuid4().hex) for k, v in docs.items()}
    clean.update(duplicates(clean, cfg))
    return clean


def duplicates(docs: dict[str, DataFrame], cfg: Config = Config()) -> dict[str, DataFrame]:
    """Branch duplicates among each document's suppliers: links between names (one for each spelling that reads
    differently), and the other spellings of these names. Both grow with the names, not with their pairs."""
    links, spellings = [], []
    for kind in ("pv", "pov", "grn"):
        found = similarity.branch_classes(docs[kind], "supplier", cfg.similarity_threshold)
        of = [F.lit(kind.upper()).alias("document"), F.lit("supplier").alias("column")]
        links.append(found.links.select(*of, F.col("c1").alias("e1"), F.col("c2").alias("e2"), "score"))
        spellings.append(found.members.where("id <> cls").select(*of, F.col("id").alias("spelling"), F.col("cls").alias("name")))
    return {"duplicates": reduce(DataFrame.unionByName, links), "duplicate_spellings": reduce(DataFrame.unionByName, spellings)}


def load(staging: Staging, kind: str, path: str, cfg: Config = Config()) -> DataFrame:
    """One kind of document, cleaned and staged; its load metrics and seconds are the table's note."""
    seen, start = Observation(), time.monotonic()

    def note() -> dict:
        return {**{m: seen.get[m] for m in vs.METRICS}, "seconds": round(time.monotonic() - start, 3)}
    return staging.table(f"clean-{kind}", lambda: vs.read_vouchers(staging.spark, path, kind, cfg.null_keys, metrics=seen),
                         staging.of_files(path), cfg.null_keys, note=note)


def train(docs: dict[str, DataFrame], cfg: Config = Config(), out_path: str | None = None) -> DataFrame:
    """Boosted-tree model table for every (item, supplier) of the invoices; a new version of the store at
    ``out_path`` if that is given. If the training fails, the store's current version stays."""
    models = boosting.train_models(ser.sparse_series(docs["pv"]), cfg.min_months, cfg.train_fraction)
    if out_path:
        store = Store(docs["pv"].sparkSession, out_path)
        with store.new_version(settings=repr(cfg)) as version:
            version.add_table(MODELS, models)
        return store.current().table(MODELS)
    return stage_table(models, MODELS)  # columns, as trees are wide and most readers need few of them


def train_lead_times(docs: dict[str, DataFrame], model_path: str, cfg: Config = Config()):
    """(summary or None, model or None): the lead-time model saved at ``model_path``, trained on the links of the
    documents where none was ever saved."""
    links = materialize(linking.link_orders(docs["pov"], docs["grn"], cfg.day_window, cfg.max_qty_ratio))
    return leadtime.load_or_train(links, agg.lead_time_stats(links, cfg.low_sample_observations), model_path,
                                  min_rows=cfg.lead_time_min_rows, n_trees=cfg.lead_time_trees, seed=cfg.seed,
                                  max_depth=cfg.lead_time_depth, max_bins=cfg.lead_time_bins)


def load_models(spark: SparkSession, path: str) -> DataFrame | None:
    """The model table last published at ``path``; None if there is none. Raises if it is damaged."""
    version = Store(spark, path).current()
    return version and version.table(MODELS)


def run(spark: SparkSession, docs: dict[str, DataFrame], cfg: Config = Config(), stock: DataFrame | None = None,
        models: DataFrame | None = None, staging: Staging | None = None) -> dict[str, DataFrame]:
    """All analyses. ``models`` is the table of a ``train`` run; without it no row gets a boosted forecast."""
    staging = staging or Staging(spark)
    pov, grn, pv = docs["pov"], docs["grn"], docs["pv"]
    links = staging.table("links", lambda: linking.link_orders(pov, grn, cfg.day_window, cfg.max_qty_ratio),
                          "clean-pov", "clean-grn", cfg.day_window, cfg.max_qty_ratio)
    lead = agg.lead_time_stats(links, cfg.low_sample_observations)
    exceptions = linking.exceptions(pov, grn)
    anomalies = outliers.detect(pv, seed=cfg.seed)

    demand = agg.demand_aggregate(pv, cfg.null_keys)
    classified = staging.table("classified", lambda: ranking.abc_classify(demand, cfg.abc_threshold_a, cfg.abc_threshold_b),
                               "clean-pv", cfg)
    if stock is not None:
        base = fc.stock_adjusted_forecast(classified, st.latest_stock(stock), cfg.growth_rate)
    else:
        base = fc.simple_forecast(classified, cfg.growth_rate)
    base = materialize(base)
    if cfg.use_models:
        fits = staging.table("fits", lambda: smoothing.fit_pairs(
            ser.dense_series(pv), cfg.seasonal_periods, cfg.hw_mape_mode, cfg.holt_winters_trend,
            cfg.holt_winters_seasonal), "clean-pv", cfg)
        boosted = fc.without_models(base) if models is None else boosting.boosted_forecast(base, models, cfg.growth_rate)
        forecast = fc.ensemble_forecast(base, boosted,
                                        smoothing.holt_winters_forecast(base, fits, cfg.growth_rate))
    else:
        forecast = base
    forecast = materialize(forecast)

    matrix = agg.supplier_matrix(pv, links, cfg.min_supplier_observations)
    risk_report = risk.segment_suppliers(matrix, seed=cfg.seed, gate=cfg.silhouette_gate, n_starts=cfg.kmeans_starts)

    summary = agg.run_summary(pv, forecast)
    return {
        "summary": summary,
        "abc_classification": forecast,
        "monthly_forecast": fc.monthly_forecast(forecast),
        "quarterly_forecast": fc.quarterly_forecast(forecast),
        "lead_times": lead,
        "exceptions": exceptions,
        "supplier_risk_report": risk_report,
        "monthly_breakdown": ser.sparse_series(pv),
        "anomaly_report": anomalies,
        "raw_grn": grn,
        "raw_pov": pov,
        "raw_pv": pv,
        **{k: docs[k] for k in ("duplicates", "duplicate_spellings", "load_report") if k in docs},
    }
