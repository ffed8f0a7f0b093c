"""Command line: ``spark-submit -m provend run ...`` / ``python -m provend train ...``.

run   : load + clean the three voucher exports, run every analysis, write the report tables.
train : fit the boosted-tree model table for every (item, supplier) of the invoices.
"""

from __future__ import annotations

import argparse
import dataclasses
import sys

from pyspark.sql import SparkSession

from provend.config import Config
from provend.operators.boosting import training_counts
from provend.plans import pipeline
from provend.plans.staging import Staging
from provend.session import get_spark, scratch_folder
from provend.sinks.report import write_report
from provend.sources.stock import read_closing_stock


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="provend")
    sub = p.add_subparsers(dest="cmd", required=True)
    for name in ("run", "train"):
        s = sub.add_parser(name)
        s.add_argument("--pov", required=True, help="purchase-order exports (file, directory or glob)")
        s.add_argument("--grn", required=True, help="goods-receipt exports")
        s.add_argument("--pv", required=True, help="purchase-invoice exports")
        s.add_argument("--models", help="model store (its current version is read by run, a new one written by train)")
        s.add_argument("--resume", help="run folder: a run that was cut short goes on from the tables finished there")
        s.add_argument("--master", help="Spark master (default: from spark-submit / environment)")
    r = sub.choices["run"]
    r.add_argument("--out", help="report folder; omitted = compute and print the summary only")
    r.add_argument("--format", choices=["parquet", "csv"], default="parquet")
    r.add_argument("--stock", help="closing stock export (enables the stock-adjusted forecast)")
    r.add_argument("--stock-freq", default="monthly", choices=["daily", "weekly", "monthly", "quarterly"])
    r.add_argument("--growth-pct", type=float, default=30.0, help="annual growth in percent")
    r.add_argument("--abc-a", type=float, default=70.0)
    r.add_argument("--abc-b", type=float, default=90.0)
    r.add_argument("--day-window", type=int, default=14)
    r.add_argument("--hw-trend", choices=["add", "mul", "none"], default="add", help="kind of the smoothing model's trend")
    r.add_argument("--hw-seasonal", choices=["add", "mul", "none"], default="add", help="kind of its season")
    r.add_argument("--no-models", action="store_true", help="base forecast only (no boosted / smoothing)")
    return p


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = get_spark(args.master)
    with scratch_folder(spark):
        staging = Staging(spark, args.resume)
        (train if args.cmd == "train" else run)(spark, args, staging)
        staging.finish()
    return 0


def _paths(args: argparse.Namespace) -> dict[str, str]:
    return {"pov_path": args.pov, "grn_path": args.grn, "pv_path": args.pv}


def _kind(name: str) -> str | None:
    return None if name == "none" else name


def train(spark: SparkSession, args: argparse.Namespace, staging: Staging) -> None:
    docs = pipeline.prepare(spark, _paths(args), staging=staging)
    training_counts(pipeline.train(docs, out_path=args.models)).show(truncate=False)


def run(spark: SparkSession, args: argparse.Namespace, staging: Staging) -> None:
    cfg = dataclasses.replace(Config(), growth_rate=Config.growth_from_percent(args.growth_pct),
                              abc_threshold_a=args.abc_a, abc_threshold_b=args.abc_b, day_window=args.day_window,
                              closing_stock_freq=args.stock_freq, use_models=not args.no_models,
                              holt_winters_trend=_kind(args.hw_trend), holt_winters_seasonal=_kind(args.hw_seasonal))
    docs = pipeline.prepare(spark, _paths(args), cfg=cfg, staging=staging)
    stock = read_closing_stock(spark, args.stock, args.stock_freq) if args.stock else None
    models = pipeline.load_models(spark, args.models) if args.models else None
    results = pipeline.run(spark, docs, cfg, stock=stock, models=models, staging=staging)
    if args.out:
        write_report(spark, results, args.out, args.format).show(truncate=False)
    else:
        results["summary"].show(truncate=False)


if __name__ == "__main__":
    sys.exit(main())
