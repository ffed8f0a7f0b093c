import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from provend.operators.prefix import SortKey, exact_quantiles, running_totals
from provend.operators.ranking import abc_classify, rank_pct


def _demand(spark, rows):
    return spark.createDataFrame(rows, "item string, supplier string, unit string, total_value double")


@pytest.mark.parametrize("buckets", [1, 7, 300])
def test_running_totals_equal_plain_window(spark, buckets):
    # many ties (values 0..4) so ties straddle bucket edges; keys break them
    rows = [(f"i{i % 13}", f"s{i % 7}", f"u{i}", float(i % 5)) for i in range(300)]
    df = _demand(spark, rows)
    keys = [SortKey("total_value", False), SortKey("item"), SortKey("supplier"), SortKey("unit")]
    got = running_totals(df, keys, "total_value", buckets=buckets) \
        .select("item", "supplier", "unit", "_cum", "_pos").toPandas()
    w = Window.orderBy(F.desc("total_value"), "item", "supplier", "unit")
    exp = df.select("item", "supplier", "unit", F.sum("total_value").over(w).alias("_cum"),
                    F.row_number().over(w).alias("_pos")).toPandas()
    m = got.merge(exp, on=["item", "supplier", "unit"], suffixes=("", "_e"))
    assert len(m) == 300
    assert (m["_pos"] == m["_pos_e"]).all()
    assert (m["_cum"] - m["_cum_e"]).abs().max() < 1e-9


def test_abc_item_holding_95_percent_is_class_c(spark):
    df = _demand(spark, [("big", "s", "u", 95.0), ("a", "s", "u", 3.0), ("b", "s", "u", 2.0)])
    out = {r.item: r for r in abc_classify(df).collect()}
    assert out["big"].abc_class == "C" and out["big"].value_rank == 1
    assert out["a"].abc_class == "C" and out["b"].abc_class == "C"
    assert abs(out["b"].cumulative_value_pct - 100.0) < 1e-9


def test_abc_all_zero_values(spark):
    df = _demand(spark, [("a", "s", "u", 0.0), ("b", "s", "u", 0.0)])
    out = abc_classify(df).collect()
    assert {r.abc_class for r in out} == {"C"}
    assert {r.cumulative_value_pct for r in out} == {0.0}


def test_abc_thresholds(spark):
    df = _demand(spark, [("a", "s", "u", 60.0), ("b", "s", "u", 20.0), ("c", "s", "u", 10.0), ("d", "s", "u", 10.0)])
    out = {r.item: r.abc_class for r in abc_classify(df).collect()}
    assert out == {"a": "A", "b": "B", "c": "B", "d": "C"}


def test_rank_pct_matches_pandas_average_rank(spark):
    vals = [3.0, 1.0, 3.0, None, 2.0, 3.0, 1.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id int, v double")
    got = {r.id: r.p for r in rank_pct(df, "v", "p", buckets=4).collect()}
    exp = pd.Series(vals).rank(pct=True)
    for i, e in enumerate(exp):
        if pd.isna(e):
            assert got[i] is None
        else:
            assert abs(got[i] - e) < 1e-12


def test_exact_quantiles_of_several_columns(spark):
    rng = np.random.default_rng(9)
    rows = [(float(a), float(b), None) for a, b in zip(rng.normal(size=301), rng.integers(0, 4, 301))] + [(None, 2.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, empty double")
    qs = [0.0, 0.25, 0.5, 0.95, 1.0]
    got = exact_quantiles(df, ["b", "a", "empty"], qs, buckets=5)
    for i, c in enumerate("ab"):
        values = [r[i] for r in rows if r[i] is not None]
        assert np.allclose(got[c], np.quantile(values, qs), rtol=0, atol=1e-12)
    assert got["empty"] == [None] * 5
    assert exact_quantiles(df.where("b > 9"), ["a"], [0.5]) == {"a": [None]}


def test_average_ranks_with_a_value_on_half_of_all_rows(spark):
    from provend.operators.ranking import rank_pct
    rng = np.random.default_rng(2)
    values = [5.0] * 300 + [float(v) for v in rng.integers(0, 12, 200)] + [float(v) for v in rng.normal(size=100)] + [None] * 20
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v double").repartition(5)
    want = pd.Series(values, dtype=float).rank(pct=True)
    for buckets in (1, 4, 40):
        out = rank_pct(df, "v", "pct", buckets=buckets)
        got = {r.id: r.pct for r in out.collect()}
        assert len(got) == len(values)
        assert all((got[i] is None) if v is None else abs(got[i] - want[i]) < 1e-12 for i, v in enumerate(values))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and "BroadcastHashJoin [v" not in plan
    assert rank_pct(df.where("v IS NULL"), "v", "pct").where("pct IS NULL").count() == 20
    assert rank_pct(df.limit(0), "v", "pct").count() == 0
