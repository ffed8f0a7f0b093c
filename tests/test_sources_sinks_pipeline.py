import os
import tempfile

import pytest

from provend.operators import aggregates as agg
from provend.operators import similarity
from provend.plans import pipeline
from provend.sinks.report import write_report
from provend.sources import stock as st

SCHEMA = "doc_date date, voucher_no string, supplier string, item string, qty double, price double, " \
         "amount double, unit string"


def test_missing_inputs_raise(spark):
    with pytest.raises(FileNotFoundError):
        pipeline.prepare(spark, paths={"pov_path": "/nonexistent/x.csv", "grn_path": "", "pv_path": None})


def test_null_keys_literal_mode(spark):
    pv = spark.createDataFrame([(None, "v", None, "a", 1.0, 1.0, 1.0, "u"), (None, "v", None, "a", 2.0, 1.0, 1.0, "u"),
                                (None, "v", "s", None, 1.0, 1.0, 1.0, "u")], SCHEMA)
    assert agg.demand_aggregate(pv).count() == 0
    lit = {(r.item, r.supplier): r.total_qty for r in agg.demand_aggregate(pv, null_keys="literal").collect()}
    assert lit == {("a", "nan"): 3.0, ("nan", "s"): 1.0}


def test_stock_frequency_and_latest(spark):
    with pytest.raises(ValueError):
        st.check_frequency("hourly")
    d = tempfile.mkdtemp(prefix="provend-stock-")
    with open(os.path.join(d, "stock.csv"), "w") as f:
        f.write("Item Details,Particulars,Period,Closing Qty\n Bolt ,Acme,15-01-2023,\"1,000\"\n"
                "Bolt,Acme,20-02-2023,5\nBolt,Acme,25-02-2023,7\nNut,Acme,01-01-2023,3\n")
    latest = {r.item: (r.period.isoformat(), r.closing_qty)
              for r in st.latest_stock(st.read_closing_stock(spark, d, "monthly")).collect()}
    assert latest == {"bolt": ("2023-02-01", 12.0), "nut": ("2023-01-01", 3.0)}


def test_report_sink_skips_empty_and_sanitises_csv(spark):
    results = {"summary": spark.createDataFrame([("=1+1", 2)], "a string, b int"),
               "exceptions": spark.createDataFrame([], "a string")}
    out = tempfile.mkdtemp(prefix="provend-report-")
    man = write_report(spark, results, out, fmt="csv").collect()
    assert [(r.position, r.table_name, r.n_rows) for r in man] == [(1, "summary", 1)]
    back = spark.read.option("header", "true").csv(os.path.join(out, "summary")).first()
    assert back.a == "'=1+1"


def test_similarity_missing_column_gives_empty(spark):
    df = spark.createDataFrame([("a",)], "x string")
    assert similarity.branch_duplicates(df, "supplier").count() == 0
    assert similarity.similar_names(df, "supplier").count() == 0


def test_cli_run_writes_report(spark, tmp_path):
    from provend.__main__ import main
    lines = ["m"] * 6 + ["Date,Vch/Bill No,Particulars,Item Details,Qty.,Price,Amount,Unit"]
    for v in range(40):
        lines.append(f"{1 + v % 28:02d}-{1 + v % 12:02d}-2023,V{v},Sup{v % 4} (up),Item{v % 5},{1 + v % 7},2,"
                     f"{2 * (1 + v % 7)},Pcs")
    paths = {}
    for kind in ("pov", "grn", "pv"):
        d = tmp_path / kind
        d.mkdir()
        (d / "export.csv").write_text("\n".join(lines) + "\n")
        paths[kind] = str(d)
    out = tmp_path / "report"
    assert main(["run", "--pov", paths["pov"], "--grn", paths["grn"], "--pv", paths["pv"], "--out", str(out),
                 "--no-models", "--growth-pct", "10"]) == 0
    written = {p.name for p in out.iterdir()}
    assert {"summary", "abc_classification", "lead_times", "raw_pv"} <= written
    abc = spark.read.parquet(str(out / "abc_classification"))
    assert abc.count() == 20 and abc.where("monthly_reorder_qty IS NULL").count() == 0
