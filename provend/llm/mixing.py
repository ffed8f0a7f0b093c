"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Sizes: words of every document; each source's target is its share by weight of
   ``share`` times all words, stopped at ``cap`` times what the source holds, with the
   excess shared again by weight until none is above.
2. Documents are cut into blocks of words. The blocks of a source are permuted by a
   hash; whole passes over the source and then a head of the permutation reach the
   target to within half a block. This fixes each source's quota in blocks.
3. A binary tree over the output shards splits the quotas: at a node the left half
   draws its number of blocks without replacement from the node's quotas, source by
   source, by hypergeometric draws. Leaves hold exact, disjoint stretches of each
   source's permuted blocks.
4. Inside a shard the blocks are ordered by a second hash.

All of it is DataFrame operations. A source's permutation is never sorted in one
place: blocks fall into hash buckets of bounded size, ranks are the bucket's start
plus the rank inside it, and a stretch of ranks finds its blocks by an equi join on
rank cells. Every random choice is a hash of the seed, so reruns agree.

Defined cases: a null text has size 0; a null source is a source of its own, last in
order; documents of size 0 are never drawn and have ``taken`` 0; null and repeated
ids are rows of their own; blocks that tie in the hash are ordered by id, place and row; a very
long text is many blocks; an empty table gives no rows; other columns are not read
(the stage form returns all of them, whatever their names).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provend.session import stage_table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
BLOCK_WORDS = 256
BUCKET_BLOCKS = 4096  # blocks of a source in one hash bucket
SHARD_BLOCKS = 131_072
LEAST_SHARDS = 16  # for a mix of at least so many blocks
CELL = 4096  # ranks in one join cell
SEED = 20


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), use)[0]


def _upto(n: Column) -> Column:
    return F.when(n >= 1, F.sequence(F.lit(1).cast("long"), n)).otherwise(F.array().cast("array<long>"))


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """Number of marked among ``drawn`` of ``total`` without replacement, by inversion of the uniform ``u``.

    All arguments are doubles. Values are visited from the mode upwards and then downwards; weights
    relative to the mode follow by ratios. Eight standard deviations either way hold all but 1e-14.
    """
    K, N, n = marked, total, drawn
    lo = F.greatest(F.lit(0.0), n - (N - K))
    hi = F.least(n, K)
    mode = F.least(hi, F.greatest(lo, F.floor((n + 1) * ((K + 1) / (N + 2))).cast("double")))
    sd = F.sqrt(n * (K / F.greatest(N, F.lit(1.0))) * ((N - K) / F.greatest(N, F.lit(1.0)))
                * ((N - n) / F.greatest(N - 1, F.lit(1.0))))

    def with_mode(m: Column) -> Column:
        reach = F.ceil(8 * sd).cast("double") + 8

        def up_ratio(j):
            return (K - m - j + 1) * (n - m - j + 1) / ((m + j) * (N - K - n + m + j))

        def down_ratio(j):
            return (m - j + 1) * (N - K - n + m - j + 1) / ((K - m + j) * (n - m + j))

        def total_of(ratio, steps):
            start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"))
            step = lambda a, j: _let(a["w"] * ratio(j.cast("double")),
                                     lambda w: F.struct(w.alias("w"), (a["s"] + w).alias("s")))
            return F.aggregate(steps, start, step, lambda a: a["s"])

        def passed(ratio, steps, goal):
            """How many values lie before the one whose cumulated weight passes ``goal``."""
            start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"), F.lit(0.0).alias("k"))
            step = lambda a, j: _let(a["w"] * ratio(j.cast("double")), lambda w: F.struct(
                w.alias("w"), (a["s"] + w).alias("s"),
                (a["k"] + F.when(a["s"] + w <= goal, 1.0).otherwise(0.0)).alias("k")))
            return F.aggregate(steps, start, step, lambda a: a["k"])

        def pick(x: Column) -> Column:
            ups, downs, up, down = x["ups"], x["downs"], x["up"], x["down"]
            return _let(u * (1.0 + up + down), lambda t: F.when(t < 1.0, m).when(
                t < 1.0 + up, F.least(m + F.size(ups), m + 1 + passed(up_ratio, ups, t - 1.0))).otherwise(
                F.greatest(m - F.size(downs), m - 1 - passed(down_ratio, downs, t - 1.0 - up))))

        sums = _let(F.struct(_upto(F.least(hi - m, reach).cast("long")).alias("ups"),
                             _upto(F.least(m - lo, reach).cast("long")).alias("downs")),
                    lambda x: F.struct(x["ups"].alias("ups"), x["downs"].alias("downs"),
                                       total_of(up_ratio, x["ups"]).alias("up"),
                                       total_of(down_ratio, x["downs"]).alias("down")))
        return _let(sums, pick)

    return _let(mode, with_mode)


def _uniform(*cols: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *cols), 11).cast("double") * (2.0 ** -53)


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``sources`` (source, source_size) with src (its number in order) and target.

    In order of cap over weight, the stopped sources come first; the first source whose fair share of
    what they leave is within its cap fixes the level for itself and all after it.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    by_cap = Window.orderBy("ratio", "src")
    weight = F.array(*(F.lit(float(w)) for w in weights))
    s = (sources.withColumn("src", (F.row_number().over(order) - 1).cast("long"))
         .withColumn("w", F.element_at(weight, (F.col("src") % len(weights) + 1).cast("int")))
         .withColumn("top", F.col("source_size") * cap).withColumn("ratio", F.col("top") / F.col("w"))
         .withColumn("budget", F.sum("source_size").over(every) * share)
         .withColumn("stopped", F.coalesce(F.sum("top").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
         .withColumn("open_w", F.sum("w").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
         .withColumn("level", (F.col("budget") - F.col("stopped")) / F.col("open_w")))
    fair = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "src", "level"))).over(every)["level"]
    target = F.least(F.col("top"), F.coalesce(fair, F.lit(float("inf"))) * F.col("w"))
    return s.select("source", "source_size", "src", target.alias("target"))


def split_tree(quotas: DataFrame, shards: int) -> DataFrame:
    """(shard, src, first, last): the stretch of each source's blocks that a shard gets; quotas is (src, q)."""
    nodes = quotas.groupBy().agg(F.array_sort(F.collect_list(F.struct("src", F.col("q").cast("double").alias("q")))).alias("q"))
    nodes = nodes.select(F.lit(0).cast("long").alias("first"), F.lit(shards).cast("long").alias("n"), "q")
    total = F.aggregate("q", F.lit(0.0), lambda a, x: a + x["q"])
    for _ in range(max(0, math.ceil(math.log2(shards)))):
        half = F.floor(F.col("n") / 2)
        start = F.struct(total.alias("items"), F.floor(total * half / F.col("n")).cast("double").alias("draw"),
                         F.array().cast("array<struct<src:bigint,q:double>>").alias("out"))
        step = lambda a, x: _let(
            hypergeometric(a["items"], x["q"], a["draw"], _uniform(F.col("first"), F.col("n"), x["src"])),
            lambda k: F.struct((a["items"] - x["q"]).alias("items"), (a["draw"] - k).alias("draw"),
                               F.concat(a["out"], F.array(F.struct(x["src"].alias("src"), k.alias("q")))).alias("out")))
        left = F.when(F.col("n") > 1, F.aggregate("q", start, step, lambda a: a["out"]))
        nodes = nodes.withColumn("left", left)
        rest = F.zip_with("q", "left", lambda x, y: F.struct(x["src"].alias("src"), (x["q"] - y["q"]).alias("q")))
        part = lambda first, n, q: F.struct(first.alias("first"), n.alias("n"), q.alias("q"))
        nodes = nodes.select(F.explode(F.when(F.col("n") > 1, F.array(
            part(F.col("first"), half, F.col("left")),
            part(F.col("first") + half, F.col("n") - half, rest))).otherwise(
            F.array(part(F.col("first"), F.col("n"), F.col("q"))))).alias("x")).select("x.*")
    in_order = Window.partitionBy("src").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    leaves = nodes.select(F.col("first").alias("shard"), F.explode("q").alias("x")).select(
        "shard", "x.src", F.col("x.q").cast("long").alias("q"))
    return (leaves.withColumn("last", F.sum("q").over(in_order) - 1)
            .withColumn("first", F.col("last") - F.col("q") + 1).where(F.col("q") > 0)
            .select("shard", "src", "first", "last"))


class Mix:
    """The mix of ``docs``. ``sized`` holds (row, doc_id, source, size); ``sources`` their targets.

    ``block_words`` None makes every document one block. ``keep``: ``sized`` also holds the whole
    input row as ``doc``.
    """

    def __init__(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                 weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP,
                 block_words: int | None = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS,
                 bucket_blocks: int = BUCKET_BLOCKS, keep: bool = False):
        whole = [F.struct("*").alias("doc")] if keep else []
        # row numbers name the rows from here on; they are written once and never made again
        self.sized = stage_table(docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"),
            F.monotonically_increasing_id().alias("row"), *whole), "mix-sizes")
        blocks = (F.ceil(F.col("size") / block_words) if block_words
                  else F.when(F.col("size") > 0, 1).otherwise(0)).cast("long")
        totals = self.sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(blocks).alias("n_blocks"))
        self.sources = stage_table(targets(totals.drop("n_blocks"), weights, share, cap)
                                   .join(totals.select(F.col("source").alias("s"), "n_blocks"),
                                         F.col("source").eqNullSafe(F.col("s"))).drop("s"), "mix-targets")
        self.blocks = self._blocks(blocks, block_words, bucket_blocks)
        quotas = stage_table(self._quotas(), "mix-quotas")
        n = quotas.agg(F.sum("q")).first()[0] or 0
        self.shards = max(1, -(-n // shard_blocks), min(n, LEAST_SHARDS))
        self.ranges = stage_table(split_tree(quotas, self.shards), "mix-ranges")

    def _blocks(self, blocks: Column, block_words: int | None, bucket_blocks: int) -> DataFrame:
        """Each block with its rank and the words before it in its source's permutation, staged."""
        rows = (self.sized.where(F.col("size") > 0).select("source", "doc_id", "row", "size", blocks.alias("k"))
                .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
                .withColumn("words", F.least(F.lit(block_words), F.col("size") - F.col("piece") * block_words)
                            if block_words else F.col("size"))
                .join(self.sources.select(F.col("source").alias("s"), "src", "n_blocks", "source_size", "target"),
                      F.col("source").eqNullSafe(F.col("s")))
                .withColumn("u", _uniform(F.col("src"), F.col("doc_id"), F.col("size"), F.col("piece")))
                .withColumn("bucket", F.floor(F.col("u") * F.ceil(F.col("n_blocks") / bucket_blocks))))
        sums = rows.groupBy("src", "bucket").agg(F.count("*").alias("n"), F.sum("words").alias("w"))
        before = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        starts = sums.select("src", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"),
                             F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w0"))
        inside = Window.partitionBy("src", "bucket").orderBy("u", "doc_id", "piece", "row")
        upto = inside.rowsBetween(Window.unboundedPreceding, -1)
        passes = F.floor(F.col("target") / F.col("source_size"))
        ranked = (rows.withColumn("r", F.row_number().over(inside) - 1)
                  .withColumn("c", F.coalesce(F.sum("words").over(upto), F.lit(0)))
                  .join(starts, ["src", "bucket"])
                  .withColumn("rank", F.col("n0") + F.col("r")).withColumn("ahead", F.col("w0") + F.col("c"))
                  .withColumn("passes", passes)
                  .withColumn("again", F.col("ahead") + F.col("words") / 2
                              <= F.col("target") - F.col("passes") * F.col("source_size")))
        return stage_table(ranked.select("src", "row", "piece", "words", "rank", "n_blocks",
                                         (F.col("passes") + F.col("again").cast("long")).alias("copies")), "mix-blocks")

    def _quotas(self) -> DataFrame:
        return self.blocks.groupBy("src").agg(F.sum("copies").alias("q")).where(F.col("q") > 0)

    def drawn(self) -> DataFrame:
        """The mix itself: (shard, place, src, row, piece, words), one row for each block drawn."""
        copies = (self.blocks.where(F.col("copies") > 0)
                  .withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
                  .withColumn("at", F.col("turn") * F.col("n_blocks") + F.col("rank"))
                  .withColumn("cell", F.floor(F.col("at") / CELL)))
        ranges = self.ranges.withColumn("cell", F.explode(F.sequence(
            F.floor(F.col("first") / CELL), F.floor(F.col("last") / CELL))))
        shuffled = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(SEED + 1), "src", "at"), "src", "at")
        return (copies.join(ranges, ["src", "cell"]).where(F.col("at").between(F.col("first"), F.col("last")))
                .withColumn("place", F.row_number().over(shuffled) - 1)
                .select("shard", "place", "src", "row", "piece", "words"))

    def taken(self) -> DataFrame:
        """``sized`` with source_size, target and the words the mix takes of each row."""
        words = self.drawn().groupBy("row").agg(F.sum("words").alias("taken"))
        by_source = self.sources.select(F.col("source").alias("s"), "source_size", "target")
        return (self.sized.join(words, "row", "left").join(by_source, F.col("source").eqNullSafe(F.col("s")))
                .withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long")).drop("s"))

    def write(self, path: str) -> None:
        """The drawn blocks by shard, each shard in its shuffled order."""
        (self.drawn().repartition(self.shards, "shard").sortWithinPartitions("shard", "place")
         .write.partitionBy("shard").parquet(path))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """Whole documents as the mix takes them, each as often as it is drawn, with all their columns."""
    mix = Mix(docs, block_words=None, keep=True, **options)
    times = mix.drawn().select("row")
    return mix.sized.select("row", "doc").join(times, "row").select("doc.*")


def query(spark, sf_dir: str) -> DataFrame:
    """op5: what the mix takes of every document."""
    mix = Mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mix.taken().select("doc_id", "size", "source_size", "target", "taken")
