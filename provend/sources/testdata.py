"""Procurement document views over the driver's star-schema tables.

There are no procurement exports in the test data, so the three document
kinds are defined as views over ``lineitem`` / ``part`` / ``supplier``:

* ``pv``  (invoices): item = brand, supplier = supplier name, unit = return flag.
* ``grn`` (receipts): orders whose key ends in 1 were never received.
* ``pov`` (orders):   receipts whose key ends in 0 were never ordered; the order
  date is the ship date minus a deterministic 0..20 day offset.

All three share the document schema
``doc_date, voucher_no, supplier, item, qty, price, amount, unit``.
The same definitions are written as SQL CTEs for the DuckDB oracle
(``provend.plans.oracle``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pv_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    j = li.join(part, li.l_partkey == part.p_partkey).join(supp, li.l_suppkey == supp.s_suppkey)
    return j.select(
        F.col("l_shipdate").cast("date").alias("doc_date"),
        F.col("l_orderkey").cast("string").alias("voucher_no"),
        F.col("s_name").alias("supplier"),
        F.col("p_brand").alias("item"),
        F.col("l_quantity").alias("qty"),
        F.try_divide("l_extendedprice", "l_quantity").alias("price"),
        F.col("l_extendedprice").alias("amount"),
        F.col("l_returnflag").alias("unit"),
    )


def _receipt_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate")
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return li.join(supp, li.l_suppkey == supp.s_suppkey)


def _item(last_digit: int):
    """Item key; orders with this last digit get one that the other side does not have."""
    key = F.col("l_partkey").cast("string")
    return F.when(F.col("l_orderkey") % 10 == last_digit, F.concat(key, F.lit("-x"))).otherwise(key).alias("item")


def grn_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _receipt_base(spark, sf_dir)
    return b.select(
        F.col("l_shipdate").cast("date").alias("doc_date"),
        F.col("l_orderkey").cast("string").alias("voucher_no"),
        F.col("s_name").alias("supplier"),
        _item(1),
        F.col("l_quantity").alias("qty"),
        F.lit(None).cast("double").alias("price"),
        F.lit(None).cast("double").alias("amount"),
        F.lit(None).cast("string").alias("unit"),
    )


def pov_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _receipt_base(spark, sf_dir)
    offset = (F.col("l_orderkey") * 7 + F.col("l_partkey") * 3 + F.col("l_linenumber")) % 21
    return b.select(
        F.date_sub(F.col("l_shipdate").cast("date"), offset.cast("int")).alias("doc_date"),
        F.col("l_orderkey").cast("string").alias("voucher_no"),
        F.col("s_name").alias("supplier"),
        _item(0),
        F.col("l_quantity").alias("qty"),
        F.lit(None).cast("double").alias("price"),
        F.lit(None).cast("double").alias("amount"),
        F.lit(None).cast("string").alias("unit"),
    )


def documents(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {"pov": pov_view(spark, sf_dir), "grn": grn_view(spark, sf_dir), "pv": pv_view(spark, sf_dir)}


# ---------------------------------------------------------------- voucher CSV fixture

ORDERS_PER_FILE = 10_000
#: columns of each kind's export, in file order
FIELDS = {"pv": ["Date", "Vch/Bill No", "Particulars", "Item Details", "Qty.", "Price", "Amount", "Unit"],
          "pov": ["Unit", "Date", "Vch/Bill No", "Particulars", "Item Details", "Amount", "Price", "Qty."],
          "grn": ["Date", "Vch/Bill No", "Particulars", "Item Details", "Qty.", "Unit"]}
METADATA = ["Provend Test Company", "1 Market Street", "Purchase Register", "Period", "", "Generated"]
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
              "l_returnflag", "l_shipdate"]


def voucher_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice lines laid out as voucher exports, with deterministic dirty rows.

    ``dirt = (l_orderkey * 7 + qty) % 17`` picks the defect of a line:
    0 charge line item, 1 unit '-', 2 amount '1,234.50', 3 unparseable date
    (on a voucher's first line), 4 padded upper-case item, 5 quantity 'abc',
    6 date as d/M/yyyy, 7 date as d-MMM-yyyy, 8 padded upper-case supplier,
    9 item with a line break, 10 item with a comma and quotes, 11 quantity 'N/A',
    12 supplier with a line break, 13 date as d-MMM-yy, 14 date with a time,
    15 amount 'n/a.', 16 item with two line breaks and quotes around one.
    Header fields are blank on all but the first line of a voucher.
    """
    from pyspark.sql import Window
    li = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / ORDERS_PER_FILE).alias("file_id"), *LINE_ORDER)
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    j = li.join(part, li.l_partkey == part.p_partkey).join(supp, li.l_suppkey == supp.s_suppkey)
    # one shuffle, by file: an order lies in one file, and so does a voucher's window
    j = j.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file_id")
    dirt = (F.col("l_orderkey") * 7 + F.col("l_quantity").cast("long")) % 17
    first = F.row_number().over(Window.partitionBy("file_id", "l_orderkey").orderBy(*LINE_ORDER)) == 1
    d = F.col("l_shipdate").cast("date")
    date_txt = (F.when(dirt == 3, F.lit("31-04-2023")).when(dirt == 6, F.date_format(d, "dd/MM/yyyy"))
                .when(dirt == 7, F.date_format(d, "dd-MMM-yyyy")).when(dirt == 13, F.date_format(d, "dd-MMM-yy"))
                .when(dirt == 14, F.date_format(d, "dd/MM/yyyy 00:00")).otherwise(F.date_format(d, "dd-MM-yyyy")))
    item = (F.when(dirt == 0, F.lit("  Freight Charge "))
            .when(dirt == 4, F.concat(F.lit("\t"), F.upper("p_brand"), F.lit("\u00a0")))
            .when(dirt == 9, F.concat("p_brand", F.lit("\nspare part")))
            .when(dirt == 10, F.concat("p_brand", F.lit(', 5" pipe')))
            .when(dirt == 16, F.concat("p_brand", F.lit('\n"\n"x'))).otherwise(F.col("p_brand")))
    supplier = (F.when(dirt == 8, F.concat(F.lit("  "), F.upper("s_name")))
                .when(dirt == 12, F.concat("s_name", F.lit("\n(up)"))).otherwise(F.col("s_name")))
    return j.select(
        "file_id", *LINE_ORDER,
        F.when(first, date_txt).alias("Date"),
        F.when(first, F.col("l_orderkey").cast("string")).alias("Vch/Bill No"),
        F.when(first, supplier).alias("Particulars"),
        item.alias("Item Details"),
        F.when(dirt == 5, F.lit("abc")).when(dirt == 11, F.lit("N/A")).otherwise(
            F.col("l_quantity").cast("string")).alias("Qty."),
        F.try_divide("l_extendedprice", "l_quantity").cast("string").alias("Price"),
        F.when(dirt == 2, F.lit("1,234.50")).when(dirt == 15, F.lit("n/a.")).otherwise(F.format_number("l_extendedprice", 2)).alias("Amount"),
        F.when(dirt == 1, F.lit("-")).otherwise(F.col("l_returnflag")).alias("Unit"),
    )


def write_voucher_fixture(spark: SparkSession, sf_dir: str, out_path: str, kind: str = "pv") -> str:
    """Write ``voucher_lines`` as one CSV export per file id (6 metadata lines, header on line 7)."""
    from pyspark.sql import Window
    lines = voucher_lines(spark, sf_dir)
    fields = FIELDS[kind]
    opts = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "quote": '"', "escape": '"'}
    body = F.to_csv(F.struct(*[F.col(f"`{c}`") for c in fields]), opts)
    # the lines above a file's first row are written with it
    top = F.when(F.row_number().over(Window.partitionBy("file_id").orderBy(*LINE_ORDER)) == 1,
                 F.lit("\n".join([*METADATA, ",".join(fields)]) + "\n")).otherwise("")
    lines.select("file_id", *LINE_ORDER, F.concat(top, body).alias("value")) \
        .sortWithinPartitions("file_id", *LINE_ORDER) \
        .select("file_id", "value") \
        .write.mode("overwrite").partitionBy("file_id").text(out_path)
    return out_path


def write_stock_fixture(spark: SparkSession, sf_dir: str, out_path: str) -> str:
    """Closing stock per (brand, supplier name, ship month): sum(qty) % 50, dated the month's last day
    (day-first text), as a CSV export with a header."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    j = li.join(part, li.l_partkey == part.p_partkey).join(supp, li.l_suppkey == supp.s_suppkey)
    g = j.groupBy("p_brand", "s_name", F.last_day(F.col("l_shipdate").cast("date")).alias("d")) \
        .agg((F.sum("l_quantity") % 50).alias("q"))
    out = g.select(F.col("p_brand").alias("Item Details"), F.col("s_name").alias("Particulars"),
                   F.date_format("d", "dd-MM-yyyy").alias("Period"), F.col("q").cast("string").alias("Closing Qty"))
    out.write.mode("overwrite").option("header", "true").csv(out_path)
    return out_path
