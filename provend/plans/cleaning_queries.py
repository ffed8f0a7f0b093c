"""Registered queries for the voucher source and the cleaning operators.

The voucher queries write the CSV fixture (``testdata.write_voucher_fixture``)
to a fresh folder under the shared checkpoint directory and read it back through
the real source, so the oracle checks writer, reader and cleaning together.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from provend.functions.exprs import sanitise_cell
from provend.operators import cleaning as cl
from provend.plans import oracle as O
from provend.plans.catalog import ABC_COLS, abc, query
from provend.session import scratch_path
from provend.sources import testdata as td
from provend.sources import vouchers as vs

DOCS = ["doc_date", "voucher_no", "supplier", "item", "qty", "price", "amount", "unit"]


def voucher_fixture(spark, d, kind: str = "pv") -> str:
    return td.write_voucher_fixture(spark, d, scratch_path(spark, "vouchers"), kind)


def raw_vouchers(spark, d):
    return vs.read_raw_vouchers(spark, voucher_fixture(spark, d))


@query("load_vouchers", O.with_(O.VOUCHERS) + "SELECT " + ", ".join(DOCS) + " FROM vclean")
def q_load_vouchers(spark, d):
    return vs.read_vouchers(spark, voucher_fixture(spark, d), kind="pv")


@query("load_pov", O.with_(O.VOUCHERS) + "SELECT " + ", ".join(DOCS) + " FROM vclean")
def q_load_pov(spark, d):
    """Order exports: the same columns in another order."""
    return vs.read_vouchers(spark, voucher_fixture(spark, d, "pov"), kind="pov")


@query("load_grn", O.with_(O.VOUCHERS) + """
SELECT doc_date, voucher_no, supplier, item, qty, CAST(NULL AS DOUBLE) AS price, CAST(NULL AS DOUBLE) AS amount, unit
FROM vclean""")
def q_load_grn(spark, d):
    """Receipt exports: no price or amount column."""
    return vs.read_vouchers(spark, voucher_fixture(spark, d, "grn"), kind="grn")


@query("load_metrics", O.with_(O.VOUCHERS) + """
SELECT document, COUNT(*) AS lines, COUNT(*) FILTER (WHERE is_first AND dirt = 3) AS unparsed_dates,
       COUNT(*) FILTER (WHERE dirt = 5 OR (dirt = 15 AND document <> 'GRN')) AS unparsed_numbers,
       COUNT(*) FILTER (WHERE dirt IN (0, 1)) AS dropped_rows, CAST(0 AS BIGINT) AS missing_suppliers,
       CAST(0 AS BIGINT) AS missing_items
FROM vfill, (SELECT unnest(['POV', 'GRN', 'PV']) AS document) GROUP BY document""")
def q_load_metrics(spark, d):
    """What the loads of the three kinds read, dropped and did not understand (receipts have no amounts)."""
    from provend.plans import pipeline
    paths = {f"{kind}_path": voucher_fixture(spark, d, kind) for kind in ("pov", "grn", "pv")}
    staging = pipeline.Staging(spark)
    for kind in ("pov", "grn", "pv"):
        pipeline.load(staging, kind, paths[f"{kind}_path"])
    rows = [(name.removeprefix("clean-").upper(), *(n[m] for m in vs.METRICS)) for name, n in staging.notes.items()]
    return spark.createDataFrame(rows, "document string, " + ", ".join(f"{m} long" for m in vs.METRICS))


@query("forward_fill", O.with_(O.VOUCHERS) + """
SELECT vdate_text AS doc_date, CAST(l_orderkey AS VARCHAR) AS voucher_no, vsupp_text AS supplier, item_text AS item
FROM vfill""")
def q_forward_fill(spark, d):
    raw = raw_vouchers(spark, d)
    filled = cl.forward_fill(raw, cl.HEADER_FIELDS, cut=cl.cut_files(raw))
    return filled.select("doc_date", "voucher_no", "supplier", "item")


@query("forward_fill_dates", O.with_(O.VOUCHERS) + "SELECT voucher_no, item, parsed_date, doc_date FROM vclean")
def q_forward_fill_dates(spark, d):
    raw = raw_vouchers(spark, d)
    cut = cl.cut_files(raw)
    df = cl.parse_numbers(cl.parse_dates(cl.forward_fill(raw, cl.HEADER_FIELDS, cut=cut)))
    df = cl.drop_non_item_rows(df).withColumn("parsed_date", F.col("doc_date"))
    df = cl.normalise_names(cl.forward_fill(df, ["doc_date"], cut=cut))
    return df.select("voucher_no", "item", "parsed_date", "doc_date")


@query("drop_non_item_rows", O.with_(O.VOUCHERS) + """
SELECT CAST(l_orderkey AS VARCHAR) AS voucher_no, item_text AS item, l_returnflag AS unit FROM vkept""")
def q_drop_non_item_rows(spark, d):
    raw = raw_vouchers(spark, d)
    df = cl.forward_fill(raw, cl.HEADER_FIELDS, cut=cl.cut_files(raw))
    return cl.drop_non_item_rows(df).select("voucher_no", "item", "unit")


@query("dropped_row_count", O.with_(O.VOUCHERS) + """
SELECT COUNT(*) FILTER (WHERE dirt IN (0, 1)) AS dropped_rows, COUNT(*) AS input_rows FROM vfill""")
def q_dropped_row_count(spark, d):
    return cl.dropped_row_count(raw_vouchers(spark, d))


@query("normalise_names", O.with_(O.VOUCHERS) + """
SELECT CAST(l_orderkey AS VARCHAR) AS voucher_no, vsupp AS supplier, item_norm AS item FROM vfill""")
def q_normalise_names(spark, d):
    raw = raw_vouchers(spark, d)
    df = cl.normalise_names(cl.forward_fill(raw, cl.HEADER_FIELDS, cut=cl.cut_files(raw)))
    return df.select("voucher_no", "supplier", "item")


@query("parse_dates", """
SELECT date_text, CASE WHEN k = 4 THEN NULL ELSE d END AS parsed_date
FROM (SELECT l_orderkey % 5 AS k, CAST(l_shipdate AS DATE) AS d,
             CASE l_orderkey % 5 WHEN 0 THEN strftime(CAST(l_shipdate AS DATE), '%d-%m-%Y')
                                 WHEN 1 THEN strftime(CAST(l_shipdate AS DATE), '%d/%m/%Y')
                                 WHEN 2 THEN strftime(CAST(l_shipdate AS DATE), '%d-%b-%Y')
                                 WHEN 3 THEN strftime(CAST(l_shipdate AS DATE), '%Y-%m-%d')
                                 ELSE '31-04-' || CAST(year(l_shipdate) AS VARCHAR) END AS date_text
      FROM lineitem) t""")
def q_parse_dates(spark, d):
    li = td.table(spark, d, "lineitem")
    dt = F.col("l_shipdate").cast("date")
    k = F.col("l_orderkey") % 5
    text = (F.when(k == 0, F.date_format(dt, "dd-MM-yyyy")).when(k == 1, F.date_format(dt, "dd/MM/yyyy"))
            .when(k == 2, F.date_format(dt, "dd-MMM-yyyy")).when(k == 3, F.date_format(dt, "yyyy-MM-dd"))
            .otherwise(F.concat(F.lit("31-04-"), F.year(dt).cast("string"))))
    return cl.parse_dates(li.select(text.alias("date_text"), text.alias("parsed_date")), "parsed_date")


@query("parse_numbers", """
SELECT number_text, CASE WHEN k = 2 THEN NULL WHEN k = 3 THEN l_quantity ELSE l_extendedprice END AS value
FROM (SELECT l_orderkey % 4 AS k, l_quantity, l_extendedprice,
             CASE l_orderkey % 4 WHEN 0 THEN format('{:,.2f}', l_extendedprice)
                                 WHEN 1 THEN CAST(l_extendedprice AS VARCHAR) WHEN 2 THEN 'n/a'
                                 ELSE CAST(l_quantity AS VARCHAR) END AS number_text FROM lineitem) t""")
def q_parse_numbers(spark, d):
    li = td.table(spark, d, "lineitem")
    k = F.col("l_orderkey") % 4
    text = (F.when(k == 0, F.format_number("l_extendedprice", 2))
            .when(k == 1, F.col("l_extendedprice").cast("string")).when(k == 2, F.lit("n/a"))
            .otherwise(F.col("l_quantity").cast("string")))
    return cl.parse_numbers(li.select(text.alias("number_text"), text.alias("value")), ["value"])


SANITISE_SQL = (
    "SELECT p_partkey, raw, CASE WHEN regexp_matches(raw, '^[=+@-]') THEN chr(39) || raw ELSE raw END AS sanitised "
    "FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '=' WHEN 1 THEN '+' WHEN 2 THEN '-' WHEN 3 THEN '@' "
    "ELSE '' END || p_name AS raw FROM part) t")


@query("sanitise_export", SANITISE_SQL)
def q_sanitise_export(spark, d):
    part = td.table(spark, d, "part")
    k = F.col("p_partkey") % 5
    pre = F.when(k == 0, "=").when(k == 1, "+").when(k == 2, "-").when(k == 3, "@").otherwise("")
    df = part.select("p_partkey", F.concat(pre, F.col("p_name")).alias("raw"))
    return df.select("p_partkey", "raw", sanitise_cell("raw").alias("sanitised"))


@query("results_filter", O.with_(O.PV, O.DEMAND, O.ABC) + "SELECT " + ", ".join(ABC_COLS) +
       " FROM abc WHERE contains(lower(item), 'brand#1') AND contains(lower(abc_class), 'b')")
def q_results_filter(spark, d):
    return cl.contains_filter(abc(spark, d).select(*ABC_COLS), {"item": "Brand#1", "abc_class": "b"})
