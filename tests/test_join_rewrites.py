import datetime as dt
import itertools

import numpy as np
from pyspark.sql import functions as F

from provend.operators import cells, linking

SCHEMA = "doc_date date, voucher_no string, supplier string, item string, qty double, price double, " \
         "amount double, unit string"


def test_bucketed_range_join_equals_naive_join(spark):
    rng = np.random.default_rng(11)
    base = dt.date(2022, 1, 1)

    def docs(prefix, n):
        return [(base + dt.timedelta(int(rng.integers(0, 90))), f"{prefix}{i}", f"s{rng.integers(0, 3)}",
                 f"i{rng.integers(0, 4)}", float(rng.integers(1, 20)), None, None, None) for i in range(n)]
    pov_rows, grn_rows = docs("P", 300), docs("G", 300)
    pov = spark.createDataFrame(pov_rows, SCHEMA)
    grn = spark.createDataFrame(grn_rows, SCHEMA)
    for window in (0, 3, 14, 30):
        got = sorted((r.pov_no, r.grn_no, r.lead_time_days) for r in linking.link_orders(pov, grn, window).collect())
        exp = sorted((p[1], g[1], (g[0] - p[0]).days) for p, g in itertools.product(pov_rows, grn_rows)
                     if p[2] == g[2] and p[3] == g[3] and 0 <= (g[0] - p[0]).days <= window and g[4] <= 2 * p[4])
        assert got == exp


def test_tiled_dense_join_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    X = rng.normal(size=(150, 8))
    X[1::3] = X[::3][: len(X[1::3])] + rng.normal(scale=0.3, size=(len(X[1::3]), 8))  # planted near copies
    groups = rng.integers(0, 3, len(X))
    df = spark.createDataFrame([(f"v{i:03d}", [float(x) for x in X[i]], int(groups[i])) for i in range(len(X))],
                               "id string, vec array<double>, g int")
    got = {(r.g, r.e1, r.e2): r.score for r in
           cells.dense_similarity_pairs(df, "id", "vec", 0.6, group_col="g", block_rows=7).collect()}
    Xn = X / np.linalg.norm(X, axis=1, keepdims=True)
    exp = {}
    for i in range(len(X)):
        for j in range(i + 1, len(X)):
            s = float(Xn[i] @ Xn[j])
            if groups[i] == groups[j] and s >= 0.6:
                exp[(int(groups[i]), f"v{i:03d}", f"v{j:03d}")] = s
    assert set(got) == set(exp) and len(exp) > 5
    assert all(abs(got[k] - exp[k]) < 1e-9 for k in got)


def hot_week(spark, n=3000):
    """A third of all rows on one pair and week, most of these on one day."""
    rng = np.random.default_rng(5)

    def docs(prefix):
        rows = []
        for i in range(n):
            hot = i % 3 == 0
            day = int(rng.choice([0, 1, 2, 2, 2, 2, 2, 6])) if hot else int(rng.integers(0, 120))
            rows.append((dt.date(2022, 3, 1) + dt.timedelta(day), f"{prefix}{i}", "hot" if hot else f"s{rng.integers(0, 30)}",
                         "i", float(rng.integers(1, 20)), None, None, None))
        return rows
    return docs("P"), docs("G")


def test_no_join_key_holds_a_hot_week(spark):
    pov_rows, grn_rows = hot_week(spark)
    pov, grn = spark.createDataFrame(pov_rows, SCHEMA), spark.createDataFrame(grn_rows, SCHEMA)
    p, g = linking.balanced_ranges(*linking.date_buckets(pov, grn, 14), 14, 100)
    sizes = [r["count"] for r in g.groupBy("item", "supplier", "_bkt", "_rng").count().collect()]
    assert g.count() == len(grn_rows) and max(sizes) <= 200 and len(sizes) > 20
    got = sorted((r.pov_no, r.grn_no) for r in linking.link_orders(pov, grn, 14, range_rows=100).select("pov_no", "grn_no").collect())
    exp = sorted((a[1], b[1]) for a in pov_rows for b in grn_rows
                 if a[2] == b[2] and 0 <= (b[0] - a[0]).days <= 14 and b[4] <= 2 * a[4])
    assert got == exp and len(exp) > 100_000
    # by the default bound nothing is cut, and the links are the same
    assert linking.link_orders(pov, grn, 14).count() == len(exp)


def test_tasks_of_a_hot_week_are_even(spark):
    pov_rows, grn_rows = hot_week(spark)
    pov, grn = spark.createDataFrame(pov_rows, SCHEMA), spark.createDataFrame(grn_rows, SCHEMA)
    p, g = linking.balanced_ranges(*linking.date_buckets(pov, grn, 14), 14, 20)
    keys = ["item", "supplier", "_bkt", "_rng"]
    work = p.join(g, keys).groupBy(*keys).count().where("supplier = 'hot'")
    tasks = [r["n"] for r in work.groupBy(F.pmod(F.hash(*keys), F.lit(8))).agg(F.sum("count").alias("n")).collect()]
    assert len(tasks) == 8 and max(tasks) <= 2 * np.median(tasks)
