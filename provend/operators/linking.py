"""Order -> receipt linking (equi + range join) and orphan documents (two anti joins)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provend.session import materialize

PENDING = "Pending Delivery (PO missing GRN)"
UNORDERED = "Unordered Delivery (GRN missing PO)"
# Optional types (off by default): key present on both sides, but the row is in no link.
UNLINKED_ORDER = "Unlinked Order (no receipt in window)"
UNLINKED_RECEIPT = "Unlinked Receipt (no order in window)"

RANGE_ROWS = 20_000  # receipts under one join key

LINK_COLS = ["pov_date", "pov_no", "supplier", "item", "pov_qty", "grn_date", "grn_no", "grn_qty", "lead_time_days"]


def _side(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(
        F.col("doc_date").alias(f"{prefix}_date"), F.col("voucher_no").alias(f"{prefix}_no"),
        "supplier", "item", F.col("qty").alias(f"{prefix}_qty"))


def date_buckets(pov: DataFrame, grn: DataFrame, day_window: int) -> tuple[DataFrame, DataFrame]:
    """Orders and receipts that can be in a link, with their date bucket ``_bkt`` and days ``_day``: time is cut into
    buckets of ``day_window + 1`` days, a receipt sits in one, an order is copied into the (at most two) that its
    window touches."""
    width = day_window + 1
    keyed = lambda df, c: df.where(F.col(c).isNotNull() & F.col("item").isNotNull()
                                   & F.col("supplier").isNotNull()).withColumn("_day", F.unix_date(c))
    p, g = keyed(_side(pov, "pov"), "pov_date"), keyed(_side(grn, "grn"), "grn_date")
    p = p.withColumn("_bkt", F.explode(F.sequence(F.floor(F.col("_day") / width),
                                                  F.floor((F.col("_day") + day_window) / width))))
    return p, g.withColumn("_bkt", F.floor(F.col("_day") / width))


def balanced_ranges(p: DataFrame, g: DataFrame, day_window: int, range_rows: int) -> tuple[DataFrame, DataFrame]:
    """Adds the key ``_rng`` to both sides of ``date_buckets``, so that no key has more than about ``range_rows`` receipts.

    Only buckets with more receipts are cut. Their days are put into ranges by running counts; a day with more
    receipts than that is cut by a hash of the row. An order is copied into the ranges whose days its window touches.
    """
    bucket = ["item", "supplier", "_bkt"]
    plain = lambda df: df.withColumn("_rng", F.struct(F.lit(0).cast("long").alias("r"), F.lit(0).alias("s")))
    days = g.groupBy(*bucket, "_day").agg(F.count(F.lit(1)).alias("n"))
    hot = days.groupBy(*bucket).agg(F.sum("n").alias("n")).where(F.col("n") > range_rows).select(*bucket)
    hot = materialize(hot)  # at most one row for each range_rows receipts
    if hot.isEmpty():
        return plain(p), plain(g)
    # at most day_window + 1 days in a bucket, so these windows are small
    upto = Window.partitionBy(*bucket).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    cuts = days.join(hot, bucket, "left_semi").withColumn(
        "r", F.floor(F.coalesce(F.sum("n").over(upto), F.lit(0)) / range_rows)).withColumn(
        "slices", F.ceil(F.col("n") / range_rows).cast("int"))
    cuts = materialize(cuts)
    hashed = F.pmod(F.xxhash64("grn_no", "grn_qty", "_day"), F.col("slices")).cast("int")
    receipts = g.join(cuts.drop("n"), [*bucket, "_day"]).withColumn("_rng", F.struct(F.col("r"), hashed.alias("s")))
    # a day cut into slices is in ranges of its own, others share that of their running count
    ranges = cuts.withColumn("s", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).groupBy(*bucket, "r", "s").agg(
        F.min("_day").alias("lo"), F.max("_day").alias("hi"))
    lists = ranges.groupBy(*bucket).agg(F.collect_list(F.struct("r", "s", "lo", "hi")).alias("ranges"))
    touched = F.filter("ranges", lambda x: (x["hi"] >= F.col("_day")) & (x["lo"] <= F.col("_day") + day_window))
    orders = p.join(lists, bucket).withColumn("x", F.explode(touched)).withColumn(
        "_rng", F.struct(F.col("x.r").alias("r"), F.col("x.s").alias("s"))).drop("x", "ranges")
    rest = lambda df: plain(df.join(hot, bucket, "left_anti"))
    return rest(p).unionByName(orders), rest(g).unionByName(receipts.drop("r", "slices"))


def link_orders(pov: DataFrame, grn: DataFrame, day_window: int = 14, max_qty_ratio: float = 2.0,
                range_rows: int = RANGE_ROWS) -> DataFrame:
    """Every (order, receipt) pair of the same item and supplier with
    ``0 <= grn_date - pov_date <= day_window`` and ``grn_qty <= ratio * pov_qty``.

    Many-to-many by design. The range predicate becomes extra equi keys: a date bucket, and inside
    buckets with more than ``range_rows`` receipts a range balanced by counts. So neither a hot
    (item, supplier) pair nor a hot week or day of one meets in one task.
    """
    p, g = balanced_ranges(*date_buckets(pov, grn, day_window), day_window, range_rows)
    j = p.drop("_day").join(g.drop("_day"), ["item", "supplier", "_bkt", "_rng"], "inner")
    lead = F.datediff(F.col("grn_date"), F.col("pov_date"))
    return j.where(lead.between(0, day_window) & (F.col("grn_qty") <= F.col("pov_qty") * max_qty_ratio)) \
        .select(*LINK_COLS[:-1], lead.alias("lead_time_days"))


def exceptions(pov: DataFrame, grn: DataFrame, include_unlinked: bool = False, links: DataFrame | None = None,
               day_window: int = 14, max_qty_ratio: float = 2.0) -> DataFrame:
    """Orders whose (item, supplier) never appears in receipts, and the reverse.

    Only key existence is tested, not dates or quantities. Each side is checked
    against the *distinct* keys of the other (pre-aggregated before the shuffle),
    so no many-to-many outer join is formed. With ``include_unlinked`` the rows
    whose key exists on both sides but which are part of no link are added too.
    """
    # Null-safe key as plain columns (a NULL key matches a NULL key): the distinct key table is then
    # hash-partitioned exactly as the anti join needs, with no second exchange.
    keys = ["_ki", "_kin", "_ks", "_ksn"]

    def keyed(df: DataFrame) -> DataFrame:
        return df.select("*", F.coalesce("item", F.lit("")).alias("_ki"), F.col("item").isNull().alias("_kin"),
                         F.coalesce("supplier", F.lit("")).alias("_ks"), F.col("supplier").isNull().alias("_ksn"))
    p = keyed(_side(pov, "pov"))
    g = keyed(_side(grn, "grn"))
    gk = g.select(*keys).distinct()
    pk = p.select(*keys).distinct()
    pending = p.join(gk, keys, "left_anti").withColumn("anomaly_type", F.lit(PENDING))
    unordered = g.join(pk, keys, "left_anti").withColumn("anomaly_type", F.lit(UNORDERED))
    cols = ["pov_date", "pov_no", "supplier", "item", "pov_qty", "grn_date", "grn_no", "grn_qty", "anomaly_type"]
    out = pending.unionByName(unordered, allowMissingColumns=True)
    if include_unlinked:
        lk = links if links is not None else link_orders(pov, grn, day_window, max_qty_ratio)
        pcols = ["pov_date", "pov_no", "supplier", "item", "pov_qty"]
        gcols = ["grn_date", "grn_no", "supplier", "item", "grn_qty"]
        linked_p = lk.select(*pcols).distinct()
        linked_g = lk.select(*gcols).distinct()
        orders = p.join(gk, keys, "left_semi").join(linked_p, pcols, "left_anti") \
            .withColumn("anomaly_type", F.lit(UNLINKED_ORDER))
        receipts = g.join(pk, keys, "left_semi").join(linked_g, gcols, "left_anti") \
            .withColumn("anomaly_type", F.lit(UNLINKED_RECEIPT))
        out = out.unionByName(orders, allowMissingColumns=True).unionByName(receipts, allowMissingColumns=True)
    return out.select(*cols)
