"""Grouped aggregates over cleaned documents and links (partial + final hash aggregation)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provend.functions.exprs import money_sum, month_start
from provend.operators.prefix import exact_quantiles

DEMAND_KEYS = ["item", "supplier", "unit"]
PAIR_KEYS = ["item", "supplier"]


def keyed(df: DataFrame, keys: list[str], null_keys: str = "keep") -> DataFrame:
    """Rows usable for grouping on ``keys``.

    ``keep``: rows with a NULL key are left out. ``literal``: NULL item/supplier
    become the text 'nan' and group together; a NULL unit is always left out.
    """
    if null_keys == "literal":
        df = df.select(*[F.coalesce(F.col(c), F.lit("nan")).alias(c) if c in ("item", "supplier") else F.col(c)
                         for c in df.columns])
        return df.where(F.col("unit").isNotNull()) if "unit" in keys else df
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return df.where(cond)


def months_covered(pv: DataFrame):
    """Distinct calendar months over all invoice rows (NULL dates ignored, at least 1), as a scalar column."""
    return pv.agg(F.greatest(F.count_distinct(month_start("doc_date")), F.lit(1)).alias("m")).scalar()


def demand_aggregate(pv: DataFrame, null_keys: str = "keep", money_scale: int = 2) -> DataFrame:
    """Per (item, supplier, unit): quantities, value, unit price and monthly / quarterly averages.

    Money is summed exactly (DECIMAL at ``money_scale`` places) and reported as double.
    """
    g = keyed(pv, DEMAND_KEYS, null_keys).groupBy(*DEMAND_KEYS).agg(
        F.coalesce(F.sum("qty"), F.lit(0.0)).alias("total_qty"),
        money_sum("amount", money_scale).cast("double").alias("total_value"),
    )
    g = g.withColumn("months_covered", months_covered(pv).cast("long"))  # one scalar subquery
    return g.select(
        *DEMAND_KEYS, "total_qty", "total_value",
        F.when(F.col("total_qty") > 0, F.col("total_value") / F.col("total_qty")).otherwise(F.lit(0.0))
        .alias("avg_unit_price"),
        "months_covered",
        (F.col("total_qty") / F.col("months_covered")).alias("avg_monthly_qty"),
    ).withColumn("avg_quarterly_qty", F.col("avg_monthly_qty") * 3)


def zero_demand(demand: DataFrame) -> DataFrame:
    """Flag rows whose average monthly quantity is exactly zero."""
    return demand.withColumn("zero_demand", F.col("avg_monthly_qty") == 0)


def lead_time_stats(links: DataFrame, low_sample: int = 3) -> DataFrame:
    """Per (item, supplier): mean, exact median, min, max and count of lead times."""
    lt = F.col("lead_time_days")
    return links.where(lt.isNotNull()).groupBy(*PAIR_KEYS).agg(
        F.avg(lt).alias("avg_lead_time_days"),
        F.median(lt).cast("double").alias("median_lead_time_days"),
        F.min(lt).alias("min_lead_time_days"),
        F.max(lt).alias("max_lead_time_days"),
        F.count(lt).alias("observation_count"),
    ).withColumn("low_sample", F.col("observation_count") < low_sample)


def supplier_matrix(pv: DataFrame, links: DataFrame, min_obs: int = 3, money_scale: int = 2) -> DataFrame:
    """Supplier spend joined with lead-time spread; ``is_valid`` marks >= ``min_obs`` observations."""
    spend = pv.where(F.col("supplier").isNotNull()).groupBy("supplier").agg(
        money_sum("amount", money_scale).cast("double").alias("total_spend_volume"))
    lt = F.col("lead_time_days")
    stats = links.where(F.col("supplier").isNotNull()).groupBy("supplier").agg(
        F.median(lt).cast("double").alias("median_lead_time"),
        F.stddev_samp(lt).alias("std_lead_time"),
        F.count(lt).alias("observation_count"),
    )
    return spend.join(stats, "supplier", "inner").withColumn("is_valid", F.col("observation_count") >= min_obs)


def distinct_pairs(pv: DataFrame) -> DataFrame:
    return pv.where(F.col("item").isNotNull() & F.col("supplier").isNotNull()).select(*PAIR_KEYS).distinct()


def quantile_caps(df: DataFrame, columns: list[str], q: float = 0.95) -> DataFrame:
    """One row: the exact (linearly interpolated) ``q`` quantile of each column."""
    caps = exact_quantiles(df, columns, [q])
    return df.sparkSession.createDataFrame([tuple(caps[c][0] for c in columns)],
                                           ", ".join(f"`{c}_cap` double" for c in columns))


def class_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("abc_class").agg(F.count(F.lit(1)).alias("n_items"))


def run_summary(pv: DataFrame, forecast: DataFrame) -> DataFrame:
    """One-row summary: invoice date range (or 'N/A'), forecast rows and rows per class."""
    d0 = pv.agg(F.min("doc_date")).scalar()
    d1 = pv.agg(F.max("doc_date")).scalar()
    return forecast.agg(
        F.coalesce(F.date_format(d0, "yyyy-MM-dd"), F.lit("N/A")).alias("date_range_start"),
        F.coalesce(F.date_format(d1, "yyyy-MM-dd"), F.lit("N/A")).alias("date_range_end"),
        F.count(F.lit(1)).alias("total_items_processed"),
        F.count_if(F.col("abc_class") == "A").alias("class_a_items"),
        F.count_if(F.col("abc_class") == "B").alias("class_b_items"),
        F.count_if(F.col("abc_class") == "C").alias("class_c_items"),
    )
