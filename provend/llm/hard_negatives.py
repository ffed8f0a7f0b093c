"""Hard-negative mining by a vertical scan of vectors (BOND).

For each anchor, its positives are the best rows of its own label; for each positive,
its hard negatives are the best rows of other labels whose score lies in a window just
below the positive's (``low`` to ``high`` percent of it). Scores are inner products of
the vectors' components as integers, floor(256 x).

Rows are sorted by (label, hash) over the cluster and packed into blocks that hold
their vectors by dimension, with each dimension's smallest and largest value. A task
reads a block's dimensions in the anchor's order of descending magnitude, a few at a
time. After each step a candidate's score is known up to what the dimensions not yet
read can add, at least and at most; candidates that can no longer matter leave the
bitmap, so that later dimensions are read for few rows. With all dimensions read the
scores are exact.

Two scans: positives first (candidates of the same label, floor: the k-th best so far),
then the windows (candidates of other labels that may still fall into one of them).
A fixed-size sample of all rows gives every anchor its first floors. Anchors are packed
into groups; each group is copied to every tile of blocks and joined on the tile, so a
pair of a group and a block is one row, read by one task.

Defined cases: rows whose label or vector or id is null, or whose vector holds a null
or a non-finite component, take no part; shorter vectors count as padded with zeros;
fully equal rows (id, label, vector) count once; rows that share an id but differ are
rows of their own, but no positives of each other; ties go to the smaller id; with too
few candidates all are returned; a positive score below zero has an empty window; an
empty table gives no rows; other columns are not read. Vectors so long that products
would pass 2^62 raise ValueError.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provend.session import stage_table

STEP = 8  # dimensions read between two looks at the bounds
BLOCK_ROWS = 1024
GROUP_ROWS = 128
SAMPLE_ROWS = 1024  # rows that give first floors; every row is scanned
BLOCKS_PER_TILE = 16
LOWEST = np.iinfo(np.int64).min

PACKED = "block long, ids binary, labels binary, vecs binary, least binary, most binary, lmin long, lmax long"
HITS = "grp long, pos int, anchor_id long, window long, id long, score long"


def quantised(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """Distinct (id long, label long, v array<double>) of the rows that take part; components are floor(256 x)."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform("v", lambda x: F.when(F.abs(x) < 2.0 ** 40, F.floor(x * 256.0).cast("double"))
                        .otherwise(x * 256.0))  # what is too large for a long is left to the length check
    return (df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                      F.col(vec_col).cast("array<double>").alias("v"))
            .where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).where(~bad)
            .select("id", "label", whole.alias("v")).distinct())


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Rows of int32, padded with zeros."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(vectors), dim), dtype="<i4")
    out[np.arange(dim) < sizes[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


def _typed(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both arrays in the smallest type whose sums of products stay exact."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[-1])
    kind = np.float32 if most < 2.0 ** 24 else np.float64 if most < 2.0 ** 53 else np.int64
    return q.astype(kind), c.astype(kind)


def scan(cols: np.ndarray, least: np.ndarray, most: np.ndarray, q: np.ndarray, rows: np.ndarray,
         settle: Callable[[np.ndarray, np.ndarray], np.ndarray], step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """(rows, exact scores) of the candidates that ``settle(lowest, highest)`` kept to the end.

    ``cols`` holds the block by dimension, ``least`` and ``most`` each dimension's range.
    """
    order = np.argsort(-np.abs(q), kind="stable")
    ends = np.sort(np.stack([q * least, q * most]), axis=0)[:, order]
    rest = np.zeros((2, len(order) + 1), dtype=ends.dtype)  # what dimensions from here on can add, at least and at most
    rest[:, :-1] = np.cumsum(ends[:, ::-1], axis=1)[:, ::-1]
    score = np.zeros(len(rows), dtype=cols.dtype)
    for at in range(0, len(order), step):
        dims = order[at:at + step]
        score = score + q[dims] @ (cols[dims] if len(rows) == cols.shape[1] else cols[dims[:, None], rows])
        end = min(at + step, len(order))
        keep = settle(score + rest[0, end], score + rest[1, end])
        if not keep.all():
            rows, score = rows[keep], score[keep]
        if not len(rows):
            break
    return rows, score.astype(np.int64)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to smaller ids."""
    return np.lexsort((ids, -scores))[:k]


def _kth(scores: np.ndarray, k: int) -> float:
    return np.partition(scores, -k)[-k] if len(scores) >= k else -np.inf


def window(positive: int, low: int, high: int) -> tuple[int, int]:
    """Smallest and largest negative score allowed: low * positive <= 100 * score <= high * positive."""
    return -(-low * positive // 100), high * positive // 100


class _Block:
    def __init__(self, row: dict, dim: int):
        self.ids = np.frombuffer(row["ids"], dtype="<i8")
        self.labels = np.frombuffer(row["labels"], dtype="<i8")
        self.cols = np.frombuffer(row["vecs"], dtype="<i4").reshape(dim, len(self.ids))
        self.least, self.most = (np.frombuffer(row[k], dtype="<i4") for k in ("least", "most"))


class Miner:
    """Rows packed by dimension and staged in the shared folder; ``mine`` scans them for a set of anchors."""

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                 label_col: str = "label", *, block_rows: int = BLOCK_ROWS, sample_rows: int = SAMPLE_ROWS):
        self.spark = vectors.sparkSession
        self.rows = stage_table(quantised(vectors, id_col, vec_col, label_col), "negatives-rows")
        norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
        dim, m2, n = self.rows.agg(F.max(F.size("v")), F.max(norm2), F.count("*")).first()
        self.empty, self.dim = not n, int(dim or 0)
        if (m2 or 0.0) >= 2.0 ** 62:
            raise ValueError("inner products of these vectors do not fit 64 bits")
        if self.empty:
            return
        # a sample of fixed size: the rows with the smallest hashes
        sample = self.rows.orderBy(F.xxhash64("id", "v"), "id", "label").limit(sample_rows).toArrow()
        self.sample = (sample["id"].to_numpy(), sample["label"].to_numpy(),
                       _matrix(sample["v"].combine_chunks(), self.dim))
        # one tile for few blocks, else tiles of BLOCKS_PER_TILE blocks, so that groups are copied less often
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        blocks = -(-n // block_rows)
        self.tiles = min(blocks, max(parts, blocks // BLOCKS_PER_TILE))
        self.blocks = stage_table(self._packed(self.rows, block_rows).withColumn(
            "tile", F.pmod(F.xxhash64("block"), F.lit(self.tiles))), "negatives-blocks")

    def _packed(self, rows: DataFrame, size: int) -> DataFrame:
        dim = self.dim

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = TaskContext.get().partitionId() << 32
            for batch in batches:
                out = []
                for at in range(0, batch.num_rows, size):
                    part = batch.slice(at, size)
                    ids, labels = (part.column(c).to_numpy().astype("<i8") for c in ("id", "label"))
                    cols = np.ascontiguousarray(_matrix(part.column("v"), dim).T)
                    out.append({"block": n, "ids": ids.tobytes(), "labels": labels.tobytes(), "vecs": cols.tobytes(),
                                "least": cols.min(axis=1).tobytes(), "most": cols.max(axis=1).tobytes(),
                                "lmin": int(labels.min()), "lmax": int(labels.max())})
                    n += 1
                if out:
                    yield pa.RecordBatch.from_pylist(out, PACKED_SCHEMA)

        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        keyed = rows.select("id", "label", "v", F.xxhash64("id", "v").alias("h"))
        return (keyed.repartitionByRange(parts, "label", "h", "id").sortWithinPartitions("label", "h", "id")
                .select("id", "label", "v").mapInArrow(pack, PACKED))

    def _scanned(self, groups: DataFrame, on: Column | None, kernel) -> DataFrame:
        """``kernel(group row, block)`` of every group with every block, as rows of hits."""
        dim = self.dim

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    hits = kernel(row, _Block(row, dim))
                    if hits:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*hits)],
                                                         schema=HIT_SCHEMA)

        copies = groups.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.tiles - 1).cast("long"))))
        # the planner takes the copies for as small as the groups; a broadcast would hold them all on the driver
        pairs = copies.hint("merge").join(self.blocks, "tile")
        if on is not None:
            pairs = pairs.where(on)
        return pairs.drop("tile", "block", "lmin", "lmax", "glmin", "glmax").mapInArrow(work, HITS)

    def _positives(self, groups: DataFrame, k: int) -> DataFrame:
        def kernel(row: dict, b: _Block) -> list:
            hits, own = [], np.frombuffer(row["gids"], dtype="<i8")
            qs, cols = _typed(np.frombuffer(row["gvecs"], dtype="<i4").reshape(self_dim, len(own)).T, b.cols)
            labels, floors = np.frombuffer(row["glabels"], dtype="<i8"), row["floors"]
            least, most = b.least.astype(cols.dtype), b.most.astype(cols.dtype)
            top = np.maximum(qs * least, qs * most).sum(axis=1)
            for i in range(len(own)):
                if top[i] < floors[i]:
                    continue
                rows = np.flatnonzero((b.labels == labels[i]) & (b.ids != own[i]))
                if not len(rows):
                    continue
                floor = floors[i]

                def settle(low, high):
                    return high >= max(floor, _kth(low, k))
                rows, score = scan(cols, least, most, qs[i], rows, settle)
                best = _best(b.ids[rows], score, k)
                hits.append(_hits(row["grp"], i, own[i], 0, b.ids[rows[best]], score[best]))
            return hits

        self_dim = self.dim
        both = (F.col("glmin") <= F.col("lmax")) & (F.col("lmin") <= F.col("glmax"))
        return _top(self._scanned(groups, both, kernel), k)

    def _negatives(self, groups: DataFrame, k: int, low: int, high: int) -> DataFrame:
        def kernel(row: dict, b: _Block) -> list:
            hits, own = [], np.frombuffer(row["gids"], dtype="<i8")
            qs, cols = _typed(np.frombuffer(row["gvecs"], dtype="<i4").reshape(self_dim, len(own)).T, b.cols)
            labels = np.frombuffer(row["glabels"], dtype="<i8")
            least, most = b.least.astype(cols.dtype), b.most.astype(cols.dtype)
            top = np.maximum(qs * least, qs * most).sum(axis=1)
            wanted: dict[int, list[tuple[int, int, int, int]]] = {}
            for w in row["windows"]:
                a, z = window(w["score"], low, high)
                if a <= z and top[w["pos"]] >= max(a, w["floor"]):
                    wanted.setdefault(w["pos"], []).append((w["score"], max(a, w["floor"]), a, z))
            for i, spans in wanted.items():
                rows = np.flatnonzero(b.labels != labels[i])
                if not len(rows):
                    continue

                def settle(lo, hi):
                    keep = np.zeros(len(lo), dtype=bool)
                    for _, floor, a, z in spans:
                        sure = lo[(lo >= a) & (hi <= z)]
                        keep |= (hi >= max(floor, _kth(sure, k))) & (lo <= z)
                    return keep
                rows, score = scan(cols, least, most, qs[i], rows, settle)
                for p, _, a, z in spans:
                    inside = np.flatnonzero((score >= a) & (score <= z))
                    best = inside[_best(b.ids[rows[inside]], score[inside], k)]
                    hits.append(_hits(row["grp"], i, own[i], p, b.ids[rows[best]], score[best]))
            return hits

        self_dim = self.dim
        return _top(self._scanned(groups, None, kernel), k)

    def _with_floors(self, groups: DataFrame, k: int) -> DataFrame:
        """Adds each anchor's k-th best score among the sampled rows of its label."""
        ids, labels, vecs, dim = *self.sample, self.dim

        def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for row in batch.select(["ids", "labels", "vecs"]).to_pylist():
                    own, mine = np.frombuffer(row["ids"], dtype="<i8"), np.frombuffer(row["labels"], dtype="<i8")
                    q, c = _typed(np.frombuffer(row["vecs"], dtype="<i4").reshape(dim, len(own)).T, vecs)
                    fits = (labels == mine[:, None]) & (ids != own[:, None])
                    score = (q @ c.T).astype(np.int64)
                    kth = [_kth(s[f], k) for s, f in zip(score, fits)]
                    out.append([LOWEST if x == -np.inf else int(x) for x in kth])
                yield batch.append_column("floors", pa.array(out, pa.list_(pa.int64())))
        return groups.mapInArrow(floors, PACKED + ", floors array<long>")

    def _with_windows(self, groups: DataFrame, positives: DataFrame, k: int, low: int, high: int) -> DataFrame:
        """Adds the anchors' windows: (pos, positive score, k-th best score in it among the sampled rows)."""
        ids, labels, vecs, dim = *self.sample, self.dim

        def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for row in batch.select(["gids", "glabels", "gvecs", "wanted"]).to_pylist():
                    own, mine = np.frombuffer(row["gids"], dtype="<i8"), np.frombuffer(row["glabels"], dtype="<i8")
                    q, c = _typed(np.frombuffer(row["gvecs"], dtype="<i4").reshape(dim, len(own)).T, vecs)
                    score, spans = (q @ c.T).astype(np.int64), []
                    for w in row["wanted"]:
                        s = score[w["pos"]][labels != mine[w["pos"]]]
                        a, z = window(w["score"], low, high)
                        kth = _kth(s[(s >= a) & (s <= z)], k)
                        spans.append({**w, "floor": LOWEST if kth == -np.inf else int(kth)})
                    out.append(spans)
                kind = pa.list_(pa.struct([("pos", pa.int32()), ("score", pa.int64()), ("floor", pa.int64())]))
                yield batch.drop_columns(["wanted"]).append_column("windows", pa.array(out, kind))

        # at most one window for each positive of an anchor, so the list is bounded by the group's size
        wanted = positives.groupBy("grp").agg(F.collect_set(F.struct("pos", "score")).alias("wanted"))
        rows = groups.drop("floors", "glmin", "glmax").join(wanted, "grp").select(
            "grp", "gids", "glabels", "gvecs", "wanted")
        return rows.mapInArrow(floors, "grp long, gids binary, glabels binary, gvecs binary, "
                                       "windows array<struct<pos:int,score:long,floor:long>>")

    def mine(self, is_anchor: Callable[[Column], Column], positives: int = 5, negatives: int = 5, *, low: int = 80,
             high: int = 100, group_rows: int = GROUP_ROWS) -> DataFrame:
        """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that
        ``is_anchor(id)`` selects: for each of an anchor's best ``positives`` its best ``negatives``."""
        if self.empty:
            return self.spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, "
                                                  "positive_score long, negative_score long")
        packed = self._packed(self.rows.where(is_anchor(F.col("id"))), group_rows)
        groups = stage_table(self._with_floors(packed, positives).select(
            F.col("block").alias("grp"), F.col("ids").alias("gids"), F.col("labels").alias("glabels"),
            F.col("vecs").alias("gvecs"), "floors", F.col("lmin").alias("glmin"), F.col("lmax").alias("glmax")),
            "negatives-groups")
        found = stage_table(self._positives(groups, positives), "negatives-positives")
        again = stage_table(self._with_windows(groups, found, negatives, low, high), "negatives-windows")
        hard = self._negatives(again, negatives, low, high)
        pairs = found.select("grp", "pos", F.col("id").alias("positive_id"), F.col("score").alias("window"))
        return hard.join(pairs, ["grp", "pos", "window"]).select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"),
            F.col("window").alias("positive_score"), F.col("score").alias("negative_score"))


PACKED_SCHEMA = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("labels", pa.binary()), ("vecs", pa.binary()),
                           ("least", pa.binary()), ("most", pa.binary()), ("lmin", pa.int64()), ("lmax", pa.int64())])
HIT_SCHEMA = pa.schema([("grp", pa.int64()), ("pos", pa.int32()), ("anchor_id", pa.int64()), ("window", pa.int64()),
                        ("id", pa.int64()), ("score", pa.int64())])


def _hits(grp: int, pos: int, anchor: int, of: int, ids: np.ndarray, scores: np.ndarray) -> tuple:
    n = len(ids)
    return (np.full(n, grp, np.int64), np.full(n, pos, np.int32), np.full(n, anchor, np.int64), np.full(n, of, np.int64),
            ids.astype(np.int64), scores.astype(np.int64))


def _top(hits: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("grp", "pos", "window").orderBy(F.col("score").desc(), "id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def query(spark, sf_dir: str) -> DataFrame:
    """op11: hard negatives of every row whose id is divisible by 100."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return Miner(rows.withColumn("label", label)).mine(lambda i: i % 100 == 0)


SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS c
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), a AS (
  SELECT vec_id, label, c, row_number() OVER (ORDER BY vec_id, label, c) AS a FROM v WHERE vec_id % 100 = 0
), s AS (
  SELECT a.a, a.vec_id AS anchor_id, a.label = v.label AS same, v.vec_id, CAST(list_inner_product(a.c, v.c) AS BIGINT) AS score
  FROM a JOIN v ON a.vec_id <> v.vec_id OR a.label <> v.label
), p AS (
  SELECT a, anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.a, positive_id, positive_score ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON p.a = s.a AND NOT s.same
   AND 80 * CAST(p.positive_score AS HUGEINT) <= 100 * CAST(s.score AS HUGEINT)
   AND 100 * CAST(s.score AS HUGEINT) <= 100 * CAST(p.positive_score AS HUGEINT)
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
