"""Lead-time prediction: pair-average baseline (table lookup) and a random forest.

The forest uses ordinal item / supplier codes (alphabetical; unseen -> -1), the
order quantity and the order month. Rows are split 80/20 by a seeded hash (a
stable, distributed split). The model is kept only if its test MAE beats the
pair-average baseline, whose averages come from all links as in the reference.

A split search sees no more of a feature than its bin, and of the labels of rows with equal bins no
more than their number, sum and sum of squares. Rows are therefore counted by (bins, label) first, and
the bootstrap draws of a tree are summed by bins: the trees are those of the rows drawn, but they grow
on at most ``max_bins`` ** 4 cells (months have 12 bins at most), however many rows there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provend.operators.prefix import SortKey, running_totals
from provend.session import materialize, spread, stage_table
from provend.sources.store import DamagedVersion, Store

FEATURES = ["item_encoded", "supplier_encoded", "order_qty", "month_of_year"]
BINS = [f"{c}_bin" for c in FEATURES]
QUANTILE_ERROR = 0.001  # of the ranks of the bins' borders
TREES_AT_ONCE, TREE_TASKS = 8, 2


def baseline_predict(rows: DataFrame, stats: DataFrame, default: float | F.Column = 0.0) -> DataFrame:
    """``predicted_lead_time_days``: the pair's average lead time, else ``default``."""
    s = stats.select("item", "supplier", F.col("avg_lead_time_days").alias("_avg"))
    d = default if isinstance(default, F.Column) else F.lit(float(default))
    return rows.join(s, ["item", "supplier"], "left") \
        .withColumn("predicted_lead_time_days", F.coalesce(F.col("_avg"), d)).drop("_avg")


def _in_training(df: DataFrame, train_fraction: float, seed: int) -> F.Column:
    h = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns], F.lit(seed)), F.lit(1000))
    return h < int(train_fraction * 1000)


def _codes(values: DataFrame, name: str) -> DataFrame:
    """(name, code): the distinct values numbered from 0 in alphabetical order, over the cluster."""
    known = values.where(F.col(name).isNotNull()).select(name).distinct()
    placed = running_totals(known, [SortKey(name)], None)
    return placed.select(name, (F.col("_pos") - 1).cast("double").alias(f"{name}_encoded"))


@dataclass
class LeadTimeModel:
    """The forest with the code tables of items and suppliers; values outside them have code -1."""

    forest: object  # PipelineModel: bins, feature vector, trees and their mean
    items: DataFrame
    suppliers: DataFrame

    def encode(self, rows: DataFrame) -> DataFrame:
        return (rows.join(self.items, "item", "left").join(self.suppliers, "supplier", "left")
                .withColumns({c: F.coalesce(c, F.lit(-1.0)) for c in FEATURES[:2]}))

    def transform(self, rows: DataFrame) -> DataFrame:
        return self.forest.transform(self.encode(rows))

    def predict_cells(self, counts: DataFrame) -> DataFrame:
        """Predictions for rows that have their bins."""
        out = counts
        for stage in self.forest.stages[1:]:
            out = stage.transform(out)
        return out

    def save(self, path: str) -> None:
        """A new version of the model store at ``path``."""
        with Store(self.items.sparkSession, path).new_version() as version:
            self.forest.write().save(version.add_folder("forest"))
            version.add_table("items", self.items)
            version.add_table("suppliers", self.suppliers)

    @staticmethod
    def load(spark: SparkSession, path: str) -> LeadTimeModel | None:
        """The model last saved at ``path``, None if there is none; raises ``DamagedVersion`` if it cannot be read."""
        from pyspark.ml import PipelineModel
        version = Store(spark, path).current()
        if version is None:
            return None
        try:
            forest = PipelineModel.load(version.folder("forest"))
        except Exception as problem:
            raise DamagedVersion(f"{version.folder('forest')} cannot be read") from problem
        return LeadTimeModel(forest, version.table("items"), version.table("suppliers"))


def bin_borders(rows: DataFrame, max_bins: int) -> list[list[float]]:
    """For each feature at most ``max_bins`` - 1 inner borders: half-way between values where these are few, else quantiles."""
    about = rows.agg(*[F.approx_count_distinct(c).alias(c) for c in FEATURES]).first()
    out = []
    for c in FEATURES:
        values = []
        if about[c] <= 2 * max_bins:
            values = sorted(r[0] for r in rows.select(c).distinct().limit(max_bins + 1).collect())
        if 0 < len(values) <= max_bins:
            found = [x / 2 + y / 2 for x, y in zip(values, values[1:])]
        else:
            found = rows.approxQuantile(c, [i / max_bins for i in range(1, max_bins)], QUANTILE_ERROR)
        out.append(sorted({x for x in found if math.isfinite(x)}))
    return out


def bucketizer(borders: list[list[float]]):
    from pyspark.ml.feature import Bucketizer
    # without an inner border there is one bin; Bucketizer wants two
    return Bucketizer(inputCols=FEATURES, outputCols=BINS, splitsArray=[[-math.inf, *(b or [1e308]), math.inf] for b in borders])


def bagged_cells(counts: DataFrame, n_trees: int, seed: int) -> DataFrame:
    """(*BINS, w0, m0, d0, w1, ...) for ``counts`` (*BINS, label, n): how many rows of a cell the bag of each tree holds,
    and the mean and deviation of their labels. A row comes Poisson(1) times into a bag, n equal ones Poisson(n) times."""
    cells = counts.groupBy(*BINS).agg(F.array_sort(F.collect_list(F.struct("label", "n"))).alias("_l"))
    cells = cells.select(*BINS, F.col("_l.label").alias("_y"), F.col("_l.n").alias("_n"),
                         F.xxhash64(*BINS, F.lit(seed)).alias("_key"))
    names = [f"{x}{t}" for t in range(n_trees) for x in "wmd"]

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            size = pdf["_n"].str.len().to_numpy()
            first = np.concatenate([[0], size.cumsum()[:-1]])
            y, sums = np.concatenate(pdf["_y"].to_numpy())[:, None], lambda x: np.add.reduceat(x, first)  # noqa: B023
            bag = np.concatenate([np.random.Generator(np.random.Philox(key=key & (1 << 64) - 1)).poisson(n[:, None], (len(n), n_trees))
                                  for n, key in zip(pdf["_n"], pdf["_key"])])
            w = sums(bag).astype(float)
            m = sums(bag * y) / np.maximum(w, 1)
            d = np.sqrt(sums(bag * (y - np.repeat(m, size, axis=0)) ** 2) / np.maximum(w, 1))
            out = np.stack([w, m, d], axis=2).reshape(len(pdf), -1)
            yield pd.concat([pdf[BINS], pd.DataFrame(out, columns=names, index=pdf.index)], axis=1)

    schema = ", ".join(f"{c} double" for c in [*BINS, *names])
    return spread(cells, *BINS).mapInPandas(draw, schema)


def bag_rows(cells: DataFrame, t: int) -> DataFrame:
    """(features, label, w) of tree ``t``: one or two rows for each cell, of the same number, sum and sum of squares of
    labels as the rows of its bag."""
    w, m, d = F.col(f"w{t}"), F.col(f"m{t}"), F.col(f"d{t}")
    row = lambda y, n: F.struct(y.alias("label"), n.alias("w"))
    rows = F.when(d > 0, F.array(row(m - d, w / 2), row(m + d, w / 2))).otherwise(F.array(row(m, w)))
    return cells.where(w > 0).select("features", F.inline(rows))


def fit_forest(counts: DataFrame, borders: list[list[float]], n_trees: int, max_depth: int, max_bins: int, seed: int):
    """A pipeline from FEATURES to ``prediction``: bins, their vector, the trees, and the mean of these."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import SQLTransformer, VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    va = VectorAssembler(inputCols=BINS, outputCol="features")
    bags = stage_table(bagged_cells(counts, n_trees, seed), "lead-bags")

    def grow(t: int):
        rf = RandomForestRegressor(numTrees=1, bootstrap=False, featureSubsetStrategy="onethird" if n_trees > 1 else "all",
                                   maxDepth=max_depth, maxBins=max_bins, seed=seed + t, weightCol="w", predictionCol=f"_tree{t}")
        rows = bag_rows(va.transform(bags), t).coalesce(TREE_TASKS).persist()  # at most 2 * max_bins ** 4
        try:
            return rf.fit(rows)
        finally:
            rows.unpersist()

    # trees have many short jobs, so they grow side by side
    with ThreadPool(min(n_trees, TREES_AT_ONCE)) as pool:
        trees = pool.map(inheritable_thread_target(counts.sparkSession)(grow), range(n_trees), chunksize=1)
    names = [f"_tree{t}" for t in range(n_trees)]
    mean = SQLTransformer(statement=f"SELECT * EXCEPT ({', '.join(BINS + names)}), ({' + '.join(names)}) / {n_trees} "
                                    "AS prediction FROM __THIS__")
    return PipelineModel([bucketizer(borders), va, *trees, mean])


def train_lead_time_model(links: DataFrame, stats: DataFrame, min_rows: int = 30, train_fraction: float = 0.8,
                          seed: int = 42, n_trees: int = 100, max_depth: int = 10, max_bins: int = 32,
                          model_path: str | None = None):
    """Fit, evaluate and (if better than the baseline) save; returns (summary DataFrame, model or None)."""
    spark = links.sparkSession
    data = links.select("item", "supplier", F.col("pov_qty").alias("order_qty"),
                        F.month("pov_date").cast("double").alias("month_of_year"),
                        F.col("lead_time_days").cast("double").alias("label"))
    n = data.count()
    if n < min_rows:
        return spark.createDataFrame([(n, 0, 0, None, None, False, "insufficient_rows")],
                                     "n_rows long, n_train long, n_test long, rf_mae double, baseline_mae double, "
                                     "kept boolean, status string"), None
    data = data.withColumn("_train", _in_training(data, train_fraction, seed))
    train = data.where("_train")
    model = LeadTimeModel(None, _codes(train, "item"), _codes(train, "supplier"))
    model.items, model.suppliers = materialize(model.items), materialize(model.suppliers)
    encoded = stage_table(model.encode(data).select(*FEATURES, "label", "_train"), "lead-rows")
    borders = bin_borders(encoded.where("_train").drop("_train"), max_bins)
    binned = bucketizer(borders).transform(encoded)
    counts = stage_table(binned.groupBy(*BINS, "label", "_train").agg(F.count(F.lit(1)).alias("n")), "lead-counts")
    model.forest = fit_forest(counts.where("_train"), borders, n_trees, max_depth, max_bins, seed)
    totals = counts.groupBy("_train").agg(F.sum("n").alias("n"), (F.sum(F.col("label") * F.col("n")) / F.sum("n")).alias("mean"))
    totals = {r["_train"]: r for r in totals.collect()}
    n_train, n_test = (totals[x]["n"] if x in totals else 0 for x in (True, False))
    # rows with equal bins have equal predictions
    pred = model.predict_cells(counts.where("NOT _train"))
    rf_mae = pred.agg(F.sum(F.abs(F.col("label") - F.col("prediction")) * F.col("n")) / F.sum("n")).first()[0]
    base = baseline_predict(data.where("NOT _train"), stats, F.lit(totals[True]["mean"]))
    baseline_mae = base.agg(F.avg(F.abs(F.col("label") - F.col("predicted_lead_time_days")))).first()[0]
    kept = rf_mae < baseline_mae
    if kept and model_path:
        model.save(model_path)
    summary = spark.createDataFrame(
        [(n, n_train, n_test, float(rf_mae), float(baseline_mae), bool(kept), "kept" if kept else "baseline")],
        "n_rows long, n_train long, n_test long, rf_mae double, baseline_mae double, kept boolean, status string")
    return summary, (model if kept else None)


def load_or_train(links: DataFrame, stats: DataFrame, model_path: str, **kw):
    """Reuse the saved model; train (and save if kept) where none was ever saved. A damaged one raises."""
    model = LeadTimeModel.load(links.sparkSession, model_path)
    return (None, model) if model else train_lead_time_model(links, stats, model_path=model_path, **kw)


def predict_lead_time(rows: DataFrame, stats: DataFrame, model=None) -> DataFrame:
    """Model prediction when a model is given, else the pair-average baseline (0.0 when unknown)."""
    if model is None:
        return baseline_predict(rows, stats, 0.0)
    feats = rows.withColumn("order_qty", F.col("pov_qty")) \
        .withColumn("month_of_year", F.month("pov_date").cast("double"))
    out = model.transform(feats).withColumnRenamed("prediction", "predicted_lead_time_days")
    return out.drop("order_qty", "month_of_year", "item_encoded", "supplier_encoded", "features")
