"""Exact top-k search by integer inner product over a pivot-distance index.

Inner product is turned into distance by one more coordinate: with M the
largest length of any vector, c' = (c, sqrt(M^2 - |c|^2)) and q' = (q, 0) give
|q' - c'|^2 = |q|^2 + M^2 - 2 q.c, so the highest products are the nearest
points. Each vector is keyed by its nearest pivot and its distance to it; the
sorted keys are cut into blocks ("annuli"). By the triangle inequality a block
of pivot p with distances lo..hi holds nothing nearer to q than
max(d(q,p) - hi, lo - d(q,p)), so a block is skipped when that exceeds the
distance of the query's k-th best hit so far.

Spark does it in two waves over query groups x vector blocks: the nearest
annuli of each group first, which tightens every query's bound, then all others
that the bounds leave. Bounds start from a fixed-size sample that also supplies
the pivots. Both directories are joined on the pivot; a pair of blocks is one
row, scored by one matrix product in its task.

The number of pivots grows with the root of the number of blocks, and that of a
block's rows slowly with the table, so that the directory stays small beside it.

Defined cases: vectors that are null, hold a null or a non-finite component, or
have no id take no part; shorter vectors count as padded with zeros; fully equal
rows (id, vector) count once; of rows that share an id but not the vector, each
is compared with each, and the best score of two ids counts; ties go to the
smaller id; with fewer than k candidates all are returned; an empty table gives no
rows; other columns are not read, whatever their names. Vectors so long that
products would pass 2^62 raise ValueError.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provend.session import stage_table

SAMPLE_ROWS = 1024  # rows that supply pivots and first bounds; the index holds every row
PIVOTS = 16, 256  # fewest and most
BLOCK_ROWS = 1024, 8192
BLOCKS = 1 << 20  # beyond so many blocks they get more rows
GROUP_ROWS = 512
FIRST_BLOCKS = 4  # nearest annuli of a query group in the first wave
SLACK = 1e-6  # relative allowance for rounding in distances


def quantised(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Distinct rows (id long, v array<double>) of those that take part; components are floor(256 x)."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
            .where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(~bad)
            # floor() gives a long; what is too large for one is left to the length check
            .select("id", F.transform("v", lambda x: F.when(F.abs(x) < 2.0 ** 40, F.floor(x * 256.0).cast("double"))
                                      .otherwise(x * 256.0)).alias("v")).distinct())


def _matrix(vectors, dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def _lift(c: np.ndarray, m2: float) -> np.ndarray:
    """Vectors with the additional coordinate that makes all lengths M."""
    return np.hstack([c, np.sqrt(np.maximum(m2 - (c * c).sum(axis=1), 0.0))[:, None]])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d2 = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(d2, 0.0))


def _spread_pivots(lifted: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first choice: each next pivot is the sample point farthest from those taken."""
    taken = [0]
    near = _distances(lifted, lifted[:1])[:, 0]
    while len(taken) < min(n, len(lifted)) and near.max() > 0:
        taken.append(int(near.argmax()))
        near = np.minimum(near, _distances(lifted, lifted[taken[-1:]])[:, 0])
    return lifted[taken]


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products as int64."""
    if len(q) and len(c) and np.abs(q).max() * np.abs(c).max() * q.shape[1] < 2.0 ** 53:
        return (q @ c.T).astype(np.int64)
    return q.astype(np.int64) @ c.astype(np.int64).T


def _by_id(scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores with one column for each id, the best of its rows; and the ids."""
    distinct, which = np.unique(ids, return_inverse=True)
    if len(distinct) == len(ids):
        return scores, ids
    order = np.argsort(which, kind="stable")
    return np.maximum.reduceat(scores[:, order], np.flatnonzero(np.diff(which[order], prepend=-1)), axis=1), distinct


def _best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int):
    """(query row, candidate column) of each query's k best, ties to smaller ids, at or above its floor; ids differ."""
    lowest = np.iinfo(np.int64).min
    scores = np.where(ids[None, :] == own[:, None], lowest, scores)
    bound = np.maximum(floor, np.partition(scores, -k, axis=1)[:, -k]) if scores.shape[1] > k else floor
    rows, cols = np.nonzero((scores >= bound[:, None]) & (scores > lowest))
    order = np.lexsort((ids[cols], -scores[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    first = np.searchsorted(rows, rows, side="left")
    keep = np.arange(len(rows)) - first < k
    return rows[keep], cols[keep], scores


class PivotIndex:
    """The index: ``blocks`` (block, pivot, lo, hi, ids, dist, vecs) staged in the shared folder."""

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", *,
                 pivots: int | None = None, sample_rows: int = SAMPLE_ROWS, block_rows: int | None = None):
        self.spark = vectors.sparkSession
        self.rows = stage_table(quantised(vectors, id_col, vec_col), "topk-vectors")
        norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
        dim, m2, n = self.rows.agg(F.max(F.size("v")), F.max(norm2), F.count("*")).first()
        self.empty = dim is None
        self.dim, self.m2 = int(dim or 0), float(m2 or 0.0)
        if self.m2 >= 2.0 ** 62:
            raise ValueError("inner products of these vectors do not fit 64 bits")
        if self.empty:
            return
        block_rows = block_rows or min(max(BLOCK_ROWS[0], n // BLOCKS), BLOCK_ROWS[1])
        self.parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        pivots = pivots or min(max(PIVOTS[0], math.isqrt(n // block_rows)), PIVOTS[1])
        # a sample of fixed size, one row of each id: the rows with the smallest hashes
        first = {}
        for r in self.rows.orderBy(F.xxhash64("id"), "id", "v").limit(sample_rows).collect():
            first.setdefault(r["id"], r)
        sample = list(first.values())
        self.sample_ids = np.array([r["id"] for r in sample], dtype=np.int64)
        self.sample = _matrix([r["v"] for r in sample], self.dim)
        self.pivots = _spread_pivots(_lift(self.sample, self.m2), pivots)
        self.blocks = stage_table(self._packed(self.rows, block_rows, lifted=True), "topk-blocks")

    def _packed(self, rows: DataFrame, size: int, lifted: bool) -> DataFrame:
        """Rows keyed by (nearest pivot, distance), sorted by key over the cluster and packed into blocks."""
        dim, m2, pivots = self.dim, self.m2, self.pivots

        def key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                c = _matrix(pdf["v"].tolist(), dim)
                up = _lift(c, m2) if lifted else np.hstack([c, np.zeros((len(c), 1))])
                d = _distances(up, pivots)
                near = d.argmin(axis=1)
                yield pd.DataFrame({"id": pdf["id"], "pivot": near.astype(np.int32), "dist": d[np.arange(len(d)), near],
                                    "vec": [x.tobytes() for x in c.astype("<i4")]})

        def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            n = TaskContext.get().partitionId() << 32
            for pdf in batches:
                cuts = np.flatnonzero(np.diff(pdf["pivot"].to_numpy())) + 1
                out = []
                for a, b in zip([0, *cuts], [*cuts, len(pdf)]):
                    for i in range(a, b, size):
                        part = pdf.iloc[i:min(i + size, b)]
                        out.append((n, int(part["pivot"].iloc[0]), float(part["dist"].iloc[0]),
                                    float(part["dist"].iloc[-1]), part["id"].tolist(), part["dist"].tolist(),
                                    b"".join(part["vec"])))
                        n += 1
                yield pd.DataFrame(out, columns=["block", "pivot", "lo", "hi", "ids", "dist", "vecs"])

        keyed = rows.mapInPandas(key, "id long, pivot int, dist double, vec binary")
        # equal vectors differ by their ids, rows of one id by their vectors
        order = ["pivot", "dist", "id", "vec"]
        return (keyed.repartitionByRange(self.parts, *order).sortWithinPartitions(*order)
                .mapInPandas(pack, "block long, pivot int, lo double, hi double, ids array<long>, "
                                   "dist array<double>, vecs binary"))

    def _groups(self, queries: DataFrame, k: int, size: int) -> DataFrame:
        """Query groups with their range of distances to every pivot and each query's first floor."""
        dim, pivots, sample, sample_ids = self.dim, self.pivots, self.sample, self.sample_ids

        def bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            lowest = np.iinfo(np.int64).min
            for pdf in batches:
                out = []
                for r in pdf.itertuples():
                    own = np.asarray(r.ids, dtype=np.int64)
                    q = np.frombuffer(r.vecs, dtype="<i4").reshape(len(own), dim).astype(np.float64)
                    d = _distances(np.hstack([q, np.zeros((len(q), 1))]), pivots)
                    s = np.where(sample_ids[None, :] == own[:, None], lowest, _products(q, sample))
                    floor = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] >= k else np.full(len(q), lowest)
                    out.append((r.block, own.tolist(), r.vecs, d.min(axis=0).tolist(), d.max(axis=0).tolist(),
                                (q * q).sum(axis=1).tolist(), floor.tolist()))
                yield pd.DataFrame(out, columns=["grp", "qids", "qvecs", "near", "far", "norm2", "floors"])

        return self._packed(queries, size, lifted=False).mapInPandas(
            bounds, "grp long, qids array<long>, qvecs binary, near array<double>, far array<double>, "
                    "norm2 array<double>, floors array<long>")

    def _pairs(self, groups: DataFrame) -> DataFrame:
        """(grp, block, bound) of all blocks that the groups' bounds leave."""
        m2, lowest = self.m2, np.iinfo(np.int64).min
        reach = F.array_max(F.transform(F.arrays_zip("norm2", "floors"), lambda x: F.when(
            x["floors"] == lowest, F.lit(float("inf"))).otherwise(
            F.sqrt(F.greatest(F.lit(0.0), x["norm2"] + m2 - 2.0 * x["floors"])))))
        slack = SLACK * (1.0 + 2.0 * math.sqrt(m2))
        rings = (groups.select("grp", reach.alias("reach"), F.posexplode(F.arrays_zip("near", "far")).alias("pivot", "d"))
                 .select("grp", "reach", "pivot", "d.near", "d.far"))
        # a pivot's blocks are dealt into slices, so that no pivot is one key of the directory
        slices = max(1, -(-self.parts // len(self.pivots)))
        rings = rings.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
        blocks = self.blocks.select("block", "pivot", "lo", "hi", F.pmod(F.xxhash64("block"), F.lit(slices)).alias("slice"))
        return (blocks.join(rings, ["pivot", "slice"])
                .withColumn("bound", F.greatest(F.lit(0.0), F.col("near") - F.col("hi"), F.col("lo") - F.col("far")))
                .where(F.col("bound") <= F.col("reach") + slack).select("grp", "block", "bound"))

    def _scored(self, pairs: DataFrame, groups: DataFrame, k: int) -> DataFrame:
        """Each pair of a query group and a block as one row: its queries' best candidates there."""
        dim, m2, pivots = self.dim, self.m2, self.pivots
        slack, lowest = SLACK * (1.0 + 2.0 * math.sqrt(self.m2)), np.iinfo(np.int64).min

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for r in pdf.itertuples():
                    own, ids = np.asarray(r.qids, dtype=np.int64), np.asarray(r.ids, dtype=np.int64)
                    floor, dist = np.asarray(r.floors, dtype=np.int64), np.asarray(r.dist)
                    q = np.frombuffer(r.qvecs, dtype="<i4").reshape(len(own), dim).astype(np.float64)
                    to = _distances(np.hstack([q, np.zeros((len(q), 1))]), pivots[r.pivot:r.pivot + 1])[:, 0]
                    radius = np.sqrt(np.maximum((q * q).sum(axis=1) + m2 - 2.0 * floor, 0.0)) + slack
                    radius[floor == lowest] = np.inf
                    a = int(np.searchsorted(dist, (to - radius).min(), side="left"))
                    b = int(np.searchsorted(dist, (to + radius).max(), side="right"))
                    if a >= b:
                        continue
                    c = np.frombuffer(r.vecs, dtype="<i4").reshape(len(ids), dim)[a:b].astype(np.float64)
                    scores, near = _by_id(_products(q, c), ids[a:b])
                    rows, cols, s = _best(scores, near, own, floor, k)
                    yield pd.DataFrame({"query_id": own[rows], "vec_id": near[cols], "score": s[rows, cols]})

        return (pairs.select("grp", "block").join(groups.select("grp", "qids", "qvecs", "floors"), "grp")
                .join(self.blocks, "block")
                .select("qids", "qvecs", "floors", "pivot", "ids", "dist", "vecs")
                .mapInPandas(score, "query_id long, vec_id long, score long"))

    def search(self, is_query: Callable[[Column], Column], k: int = 5, *, group_rows: int = GROUP_ROWS,
               first_blocks: int = FIRST_BLOCKS) -> DataFrame:
        """The k best (query_id, rank, vec_id, score) of each indexed row that ``is_query(id)`` selects."""
        if self.empty:
            return self.spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
        groups = stage_table(self._groups(self.rows.where(is_query(F.col("id"))), k, group_rows), "topk-queries")
        near = Window.partitionBy("grp").orderBy("bound", "block")
        first = stage_table(self._pairs(groups).withColumn("n", F.row_number().over(near))
                            .where(F.col("n") <= first_blocks), "topk-first")
        hits = stage_table(_top(self._scored(first, groups, k), k), "topk-first-hits")
        floors = hits.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        tighter = (groups.select("grp", F.posexplode("qids").alias("pos", "query_id"), "floors")
                   .join(floors, "query_id", "left")
                   .select("grp", F.struct("pos", F.greatest(F.expr("floors[pos]"), "floor").alias("f")).alias("x"))
                   .groupBy("grp").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["f"]).alias("floors")))
        groups = stage_table(groups.drop("floors").join(tighter, "grp"), "topk-queries-2")
        rest = self._pairs(groups).join(first.select("grp", "block"), ["grp", "block"], "left_anti")
        return _top(hits.drop("rank").unionByName(self._scored(rest, groups, k)), k)


def _top(hits: DataFrame, k: int) -> DataFrame:
    hits = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # ids may repeat
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def query(spark, sf_dir: str) -> DataFrame:
    """op1: every row divisible by 50 against all rows, the 5 highest scores of each."""
    index = PivotIndex(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return index.search(lambda i: i % 50 == 0, k=5)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS c
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, max(CAST(list_inner_product(q.c, c.c) AS BIGINT)) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
  GROUP BY q.vec_id, c.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
