import datetime as dt

from provend.operators import aggregates as agg
from provend.operators import linking

D = dt.date(2023, 1, 10)
SCHEMA = "doc_date date, voucher_no string, supplier string, item string, qty double, price double, " \
         "amount double, unit string"


def _docs(spark, rows):
    return spark.createDataFrame([(d, v, s, i, q, None, None, None) for d, v, s, i, q in rows], SCHEMA)


def test_window_and_quantity_rules(spark):
    pov = _docs(spark, [(D, "P1", "s", "a", 10.0), (D, "P2", "s", "b", 10.0), (D, "P3", "s", "c", 10.0),
                        (D, "P4", "s", "d", 10.0), (D, "P5", "s", "e", 10.0), (D, "P6", "s", "f", 10.0)])
    grn = _docs(spark, [(D, "G1", "s", "a", 10.0),                          # same day
                        (D + dt.timedelta(14), "G2", "s", "b", 10.0),       # day 14
                        (D + dt.timedelta(15), "G3", "s", "c", 10.0),       # day 15
                        (D - dt.timedelta(1), "G4", "s", "d", 10.0),        # one day early
                        (D, "G5", "s", "e", 20.0),                          # exactly 2x
                        (D, "G6", "s", "f", 20.1)])                         # 2.01x
    got = sorted((r.grn_no, r.lead_time_days) for r in linking.link_orders(pov, grn).collect())
    assert got == [("G1", 0), ("G2", 14), ("G5", 0)]
    # every key exists on both sides: no exceptions even for unlinked pairs
    assert linking.exceptions(pov, grn).count() == 0


def test_one_receipt_two_orders_and_exceptions(spark):
    pov = _docs(spark, [(D, "P1", "s", "a", 5.0), (D + dt.timedelta(2), "P2", "s", "a", 5.0), (D, "P3", "s", "z", 1.0)])
    grn = _docs(spark, [(D + dt.timedelta(3), "G1", "s", "a", 5.0), (D, "G9", "t", "q", 1.0)])
    links = linking.link_orders(pov, grn).collect()
    assert sorted(r.pov_no for r in links) == ["P1", "P2"]
    ex = {(r.pov_no, r.grn_no): r.anomaly_type for r in linking.exceptions(pov, grn).collect()}
    assert ex == {("P3", None): linking.PENDING, (None, "G9"): linking.UNORDERED}


def test_demand_edge_cases(spark):
    rows = [(None, "v", "s", "a", -1.0, 1.0, 5.0, "Nos"), (None, "v", "s", "a", 1.0, 1.0, 5.0, "Nos"),
            (None, "v", "s", "b", 2.0, 1.0, 4.0, None)]
    pv = spark.createDataFrame(rows, SCHEMA)
    out = agg.demand_aggregate(pv).collect()
    assert len(out) == 1  # NULL unit dropped
    r = out[0]
    assert r.total_qty == 0.0 and r.avg_unit_price == 0.0 and r.months_covered == 1 and r.total_value == 10.0


def test_lead_stats_and_supplier_matrix(spark):
    links = spark.createDataFrame([("a", "s", 1), ("a", "s", 3), ("a", "s", 8), ("b", "t", 2)],
                                  "item string, supplier string, lead_time_days int")
    st = {r.item: r for r in agg.lead_time_stats(links).collect()}
    assert st["a"].median_lead_time_days == 3.0 and st["a"].avg_lead_time_days == 4.0
    assert not st["a"].low_sample and st["b"].low_sample
    pv = spark.createDataFrame([(None, "v", "s", "a", 1.0, 1.0, 2.5, "u"), (None, "v", "t", "b", 1.0, 1.0, 1.0, "u")],
                               SCHEMA)
    m = {r.supplier: r for r in agg.supplier_matrix(pv, links).collect()}
    assert m["s"].is_valid and not m["t"].is_valid and m["t"].std_lead_time is None
    assert abs(m["s"].std_lead_time - 3.605551275463989) < 1e-12


def test_unlinked_rows_are_optional(spark):
    pov = _docs(spark, [(D, "P1", "s", "a", 10.0), (D, "P2", "s", "a", 10.0)])
    grn = _docs(spark, [(D + dt.timedelta(1), "G1", "s", "a", 10.0), (D + dt.timedelta(40), "G2", "s", "a", 1.0)])
    assert linking.exceptions(pov, grn).count() == 0
    extra = {(r.pov_no, r.grn_no): r.anomaly_type
             for r in linking.exceptions(pov, grn, include_unlinked=True).collect()}
    assert extra == {(None, "G2"): linking.UNLINKED_RECEIPT}
