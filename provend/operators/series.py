"""Monthly demand series per (item, supplier), their splits, errors and forecast features.

All series are built by one shuffle on the pair key from rows already summed per
month, so a pair's group holds at most one row per calendar month however many
invoice lines it has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provend.functions.exprs import ape, counter_month, counter_quarter, month_start

PAIR = ["item", "supplier"]


def monthly_sums(pv: DataFrame) -> DataFrame:
    """Quantity per (item, supplier, month start) over rows with a date and both keys."""
    rows = pv.where(F.col("doc_date").isNotNull() & F.col("item").isNotNull() & F.col("supplier").isNotNull())
    return rows.groupBy(*PAIR, month_start("doc_date").alias("month_start")) \
        .agg(F.coalesce(F.sum("qty"), F.lit(0.0)).alias("qty"))


def sparse_series(pv: DataFrame) -> DataFrame:
    """Observed months only: ``time_idx`` is the 0-based position among the pair's observed months."""
    m = monthly_sums(pv)
    w = Window.partitionBy(*PAIR).orderBy("month_start")
    return m.select(
        *PAIR, "month_start", "qty",
        (F.row_number().over(w) - 1).alias("time_idx"),
        F.month("month_start").alias("month"),
        F.quarter("month_start").alias("quarter"),
    )


def dense_series(pv: DataFrame) -> DataFrame:
    """Every month from the pair's first to its own last observed month; missing months are 0.

    The pair's month -> qty map is built in one aggregation (bounded: one entry per
    calendar month) and expanded with ``sequence``, so no join back is needed.
    """
    m = monthly_sums(pv)
    g = m.groupBy(*PAIR).agg(
        F.map_from_entries(F.collect_list(F.struct("month_start", "qty"))).alias("_m"),
        F.min("month_start").alias("_lo"), F.max("month_start").alias("_hi"))
    e = g.select(*PAIR, "_m", F.posexplode(F.sequence("_lo", "_hi", F.expr("INTERVAL 1 MONTH")))
                 .alias("time_idx", "month_start"))
    return e.select(*PAIR, "month_start",
                    F.coalesce(F.element_at("_m", F.col("month_start")), F.lit(0.0)).alias("qty"),
                    "time_idx")


def train_test_split(series: DataFrame, train_fraction: float = 0.75) -> DataFrame:
    """Chronological split: the first ``floor(fraction * n)`` points of each pair train, the rest test."""
    w = Window.partitionBy(*PAIR)
    n = F.count(F.lit(1)).over(w)
    return series.withColumn("n_points", n) \
        .withColumn("split", F.when(F.col("time_idx") < F.floor(F.col("n_points") * train_fraction), "train")
                    .otherwise("test"))


def baseline_mape(series: DataFrame, min_months: int = 6, train_fraction: float = 0.75) -> DataFrame:
    """Per pair: the train-mean forecast's MAPE on the test points, or ``skipped_sparsity`` below ``min_months``."""
    s = train_test_split(series, train_fraction)
    w = Window.partitionBy(*PAIR)
    s = s.withColumn("_train_mean", F.avg(F.when(F.col("split") == "train", F.col("qty"))).over(w))
    g = s.groupBy(*PAIR).agg(
        F.first("n_points").alias("n_points"),
        F.first("_train_mean").alias("train_mean"),
        F.avg(F.when(F.col("split") == "test", ape("qty", "_train_mean"))).alias("baseline_mape"),
    )
    ok = F.col("n_points") >= min_months
    return g.select(*PAIR, "n_points",
                    F.when(ok, F.lit("evaluated")).otherwise(F.lit("skipped_sparsity")).alias("status"),
                    F.when(ok, F.col("train_mean")).alias("train_mean"),
                    F.when(ok, F.col("baseline_mape")).alias("baseline_mape"))


def positive_mape(actual: str, pred: str) -> F.Column:
    """MAPE over points with actual > 0 (aggregate); NULL when there are none."""
    return F.avg(F.when(F.col(actual) > 0, F.abs(F.col(actual) - F.col(pred)) / F.col(actual)))


def forecast_features(demand: DataFrame, steps: int = 3) -> DataFrame:
    """Feature rows for the next ``steps`` months: the counter continues from ``months_covered``
    (12 when missing) and month / quarter are derived from the counter, not the calendar."""
    base = F.coalesce(F.col("months_covered"), F.lit(12))
    return demand.select("item", "supplier", "unit", F.posexplode(F.sequence(base, base + (steps - 1)))
                         .alias("step", "time_idx")) \
        .withColumn("month", counter_month("time_idx")).withColumn("quarter", counter_quarter("time_idx"))


def dense_lengths(pv: DataFrame) -> DataFrame:
    """Per pair: number of months in the zero-filled series (first to last observed month)."""
    m = monthly_sums(pv).groupBy(*PAIR).agg(F.min("month_start").alias("_lo"), F.max("month_start").alias("_hi"))
    return m.select(*PAIR, (F.months_between("_hi", "_lo").cast("int") + 1).alias("n_months"))
