"""Global running sums, positions and order statistics without a single-task window.

``Window.orderBy(...)`` with no partition moves every row to one task. Here the
rows are range-partitioned on the full sort key and staged with the number of
their range; each range is summed with a partitioned window, and the per-range
totals -- one row for each shuffle partition -- are prefixed and joined back.
Because ranges are cut on the *whole* sort key, one huge group of equal values is
still split over many ranges by its tie-breaking columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provend.session import stage_table


@dataclass(frozen=True)
class SortKey:
    name: str
    ascending: bool = True

    def order(self) -> Column:
        c = F.col(self.name)
        return c.asc_nulls_first() if self.ascending else c.desc_nulls_last()


def running_totals(df: DataFrame, keys: list[SortKey], value: str | None, *,
                   cum_col: str = "_cum", pos_col: str = "_pos", total_col: str | None = None,
                   buckets: int | None = None) -> DataFrame:
    """Add the inclusive running sum of ``value`` and the 1-based position in key order.

    ``keys`` must order the rows totally (add tie-breaking columns). ``value`` may
    be None to compute positions only. ``total_col`` adds the grand total. ``buckets``
    is the number of ranges (default: the session's shuffle partitions).
    """
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [k.order() for k in keys]
    # the staged table fixes each row's range: windows and totals below must agree on it
    b = stage_table(df.repartitionByRange(buckets, *order).withColumn("_bkt", F.spark_partition_id()), "ranges")
    val = F.col(value) if value else F.lit(0)
    zero = F.lit(0).cast(df.schema[value].dataType) if value else F.lit(0)
    w = Window.partitionBy("_bkt").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = b.withColumn("_lcum", F.sum(val).over(w)).withColumn("_lpos", F.row_number().over(w))
    # Per-range totals: at most `buckets` rows, so prefixing them in one task is bounded.
    per = b.groupBy("_bkt").agg(F.coalesce(F.sum(val), zero).alias("_bsum"), F.count(F.lit(1)).alias("_bcnt"))
    wb = Window.orderBy("_bkt")
    per = per.select(
        "_bkt",
        F.coalesce(F.sum("_bsum").over(wb.rowsBetween(Window.unboundedPreceding, -1)), zero).alias("_osum"),
        F.coalesce(F.sum("_bcnt").over(wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ocnt"),
        F.sum("_bsum").over(Window.partitionBy(F.lit(1))).alias("_gtotal"),
    )
    out = local.join(F.broadcast(per), "_bkt")
    out = out.withColumn(pos_col, (F.col("_ocnt") + F.col("_lpos")).cast("long"))
    if value:
        out = out.withColumn(cum_col, F.col("_osum") + F.col("_lcum"))
    if total_col:
        out = out.withColumn(total_col, F.col("_gtotal"))
    return out.drop("_bkt", "_lcum", "_lpos", "_osum", "_ocnt", "_gtotal")


def average_ranks(df: DataFrame, value: str, out: str, *, buckets: int | None = None) -> DataFrame:
    """Adds the mean 1-based position of each row's run of equal values, divided by the number of rows.

    Rows are range-partitioned on the value and a hash of the row, so a hot value is split over ranges. Each range
    knows its own positions; a run of equal values can only cross a range's first or last value, and the
    whole runs of these are carried to the ranges with their offsets (one row for each range). No
    join on the value takes place. ``value`` must not be null.
    """
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = df.withColumn("_tie", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    b = stage_table(hashed.repartitionByRange(buckets, value, "_tie").withColumn("_bkt", F.spark_partition_id()), "ranges")
    local = b.withColumn("_first", F.rank().over(Window.partitionBy("_bkt").orderBy(value))).withColumn(
        "_run", F.count(F.lit(1)).over(Window.partitionBy("_bkt", value)))
    runs = b.groupBy("_bkt", value).agg(F.count(F.lit(1)).alias("n"))
    per = runs.groupBy("_bkt").agg(F.sum("n").alias("n"), F.min(F.struct(value, "n")).alias("lo"),
                                   F.max(F.struct(value, "n")).alias("hi"))
    rows = per.orderBy("_bkt").collect()  # one for each range
    total, at, border = sum(r["n"] for r in rows), {}, {}
    before = 0
    for r in rows:
        at[r["_bkt"]] = before
        for v, first, last in ((r["lo"][0], before + 1, before + r["lo"]["n"]),
                               (r["hi"][0], before + r["n"] - r["hi"]["n"] + 1, before + r["n"])):
            border[v] = min(first, border.get(v, (first, last))[0]), max(last, border.get(v, (first, last))[1])
        before += r["n"]
    carried = df.sparkSession.createDataFrame(
        [(r["_bkt"], at[r["_bkt"]], sum(border[r["lo"][0]]), sum(border[r["hi"][0]])) for r in rows],
        "_bkt int, _before long, _lo long, _hi long")
    j = local.join(F.broadcast(carried), "_bkt")  # one row for each range
    # first + last position of the run; a run that ends inside its range is known there
    size = F.count(F.lit(1)).over(Window.partitionBy("_bkt"))
    inner = 2 * F.col("_before") + 2 * F.col("_first") + F.col("_run") - 1
    both = F.when(F.col("_first") == 1, F.col("_lo")).when(F.col("_first") + F.col("_run") - 1 == F.col("_size"),
                                                            F.col("_hi")).otherwise(inner)
    j = j.withColumn("_size", size)
    return j.withColumn(out, both / 2 / F.lit(float(total or 1))).drop(
        "_tie", "_bkt", "_first", "_run", "_before", "_lo", "_hi", "_size")


def exact_quantiles(df: DataFrame, columns: list[str], qs: list[float], **opts) -> dict[str, list[float | None]]:
    """The exact, linearly interpolated quantiles ``qs`` of each column; None for a column without values.

    Distinct values are counted (a hot value is one row from then on) and put in order over the cluster,
    all columns at once; only the rows next to each wanted position come to the driver.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns])
    counts = (df.select(F.explode(cells).alias("x")).select("x.*").where(F.col("v").isNotNull())
              .groupBy("name", "v").agg(F.count(F.lit(1)).alias("n")))
    placed = running_totals(counts, [SortKey("name"), SortKey("v")], "n", cum_col="upto", **opts)
    sizes = {r["name"]: r["n"] for r in placed.groupBy("name").agg(F.sum("n").alias("n")).collect()}
    before, spots = 0, {}
    for c in sorted(sizes):
        for q in qs:
            at = (sizes[c] - 1) * q
            lo = int(at)
            spots[c, q] = before + lo, before + min(lo + 1, sizes[c] - 1), at - lo
        before += sizes[c]
    wanted = sorted({p for lo, hi, _ in spots.values() for p in (lo, hi)})
    if not wanted:
        return {c: [None] * len(qs) for c in columns}
    hit = F.exists(F.array(*map(F.lit, wanted)), lambda p: (p < F.col("upto")) & (p >= F.col("upto") - F.col("n")))
    rows = placed.where(hit).select("v", "upto", "n").collect()  # at most two for each wanted quantile
    value = {p: r["v"] for r in rows for p in wanted if r["upto"] - r["n"] <= p < r["upto"]}

    def quantile(c: str, q: float) -> float | None:
        if (c, q) not in spots:
            return None
        lo, hi, rest = spots[c, q]
        return value[lo] * (1 - rest) + value[hi] * rest if rest else value[lo]
    return {c: [quantile(c, q) for q in qs] for c in columns}
