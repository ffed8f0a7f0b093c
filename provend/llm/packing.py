"""Best-fit-decreasing packing of documents into sequences of a fixed number of tokens.

Best fit only looks at lengths, so the plan is made on the histogram of piece
lengths, which has at most ``capacity`` entries however many pieces there are.
Lengths go in decreasing order; a segment tree over remaining capacities
(0..capacity) gives the tightest room that fits in logarithmic time. Bins of
equal content move together as one class, so the plan is exactly what best-fit
decreasing does piece by piece, in steps that do not depend on their number.

Over the cluster: a task encodes its texts, cuts those over the capacity, and
numbers its pieces within each length; the numbers of earlier tasks are added by
a window over the (task, length) counts. The global number of a piece among
those of its length selects its step of the plan, which gives sequence and
offset by arithmetic. No piece list meets in one task or the driver.

Defined cases: a null text is one piece that holds the end id alone; null and
repeated ids are pieces like any other; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provend.llm.pieces import MAX_ENTRIES, SLICE_CHARS, slices
from provend.llm.pieces import encoder as encoder_of
from provend.session import stage_table

CAPACITY = 2048
END_ID = 0
BATCH_DOCS = 2000  # documents held as strings at a time
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, nth long"
PLAN = "length long, first long, last long, per_bin long, sequence long, place long"


class RoomTree:
    """Segment tree over remaining capacities; finds the smallest open one that is large enough."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = np.zeros(2 * self.size, dtype=bool)

    def set(self, room: int, is_open: bool) -> None:
        i = room + self.size
        self.open[i] = is_open
        while i > 1:
            i >>= 1
            self.open[i] = self.open[2 * i] or self.open[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        """The smallest open room of at least ``need``."""
        i = need + self.size
        if self.open[i]:
            return need
        while i > 1:  # up to the first right sibling with an open room, then down its leftmost
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Steps (length, first, last, per_bin, sequence, place) of best-fit decreasing.

    The pieces numbered first..last among those of ``length`` go to the bins ``sequence``,
    ``sequence + 1``, ..., ``per_bin`` into each, from offset ``place`` on.
    """
    tree = RoomTree(capacity)
    classes: dict[int, list[tuple[int, int]]] = {}  # room -> [(first bin, bins)]
    plan: list[tuple[int, int, int, int, int, int]] = []
    bins = 0

    def put(room: int, first: int, n: int) -> None:
        if room > 0:
            classes.setdefault(room, []).append((first, n))
            tree.set(room, True)

    for length in sorted((x for x in counts if counts[x] > 0), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of length {length} does not fit a capacity of {capacity}")
        left, done = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, fit = capacity, capacity // length
                first, n = bins, -(-left // fit)
                bins += n
            else:
                fit = room // length  # a bin stays the tightest until no further piece of this length fits
                first, n = classes[room].pop()
                if not classes[room]:
                    del classes[room]
                    tree.set(room, False)
            full = min(n, left // fit)
            if full:
                plan.append((length, done, done + full * fit - 1, fit, first, capacity - room))
                done, left = done + full * fit, left - full * fit
                put(room - fit * length, first, full)
            if full < n:
                if left:  # the last bin gets what is left of this length
                    plan.append((length, done, done + left - 1, left, first + full, capacity - room))
                    put(room - left * length, first + full, 1)
                    full, done, left = full + 1, done + left, 0
                if full < n:
                    put(room, first + full, n - full)
    return plan


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int = END_ID, *, capacity: int = CAPACITY,
                 id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False,
                 slice_chars: int = SLICE_CHARS, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """Pieces of all documents, staged: doc_id, piece, start, length, ids_crc32, part, nth (and ids if kept).

    ``part`` is the task, ``nth`` the piece's number among those of its length in that task.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, encoder = TaskContext.get().partitionId(), {}, encoder_of(vocabulary, end_id, True, max_entries)
        for doc_ids, texts in ((c.to_pylist() for c in b.slice(i, BATCH_DOCS).columns)
                               for b in batches for i in range(0, b.num_rows, BATCH_DOCS)):
            for lo, hi in slices(texts, slice_chars):
                rows: list[tuple] = []
                flat, sizes = encoder.encode_all(texts[lo:hi])
                flat = flat.astype("<u4")
                for doc, end, size in zip(doc_ids[lo:hi], np.cumsum(sizes).tolist(), sizes.tolist()):
                    ids = flat[end - size:end]
                    for k, start in enumerate(range(0, size, capacity)):
                        x = ids[start:start + capacity]
                        nth = seen.get(len(x), 0)
                        seen[len(x)] = nth + 1
                        raw = x.tobytes()
                        rows.append((doc, k, start, len(x), zlib.crc32(raw), part, nth, raw if keep_ids else None))
                cols = list(zip(*rows))
                types = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
                arrays = [pa.array(c, t) for c, t in zip(cols, types)]
                if keep_ids:
                    arrays.append(pa.array(cols[7], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return stage_table(rows.mapInArrow(cut, PIECES + (", ids binary" if keep_ids else "")), "pieces")


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with length, part, nth) with sequence_id and offset of each; part and nth are dropped."""
    spark: SparkSession = pieces.sparkSession
    counts = stage_table(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    histogram = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most `capacity` rows
    steps = best_fit_plan({int(r["length"]): int(r["n"]) for r in histogram}, capacity)
    plan = spark.createDataFrame(steps, PLAN)
    numbered = (pieces.join(before, ["part", "length"])
                .withColumn("number", F.col("before") + F.col("nth")).drop("before", "part", "nth"))
    # the plan's size is bounded by the capacity alone, so it goes to every task
    plan = F.broadcast(plan.withColumnRenamed("length", "plan_length"))
    at = F.col("number") - F.col("first")
    return (numbered.join(plan, (F.col("length") == F.col("plan_length")) & F.col("number").between(
                F.col("first"), F.col("last")))
            .withColumn("sequence_id", F.col("sequence") + F.floor(at / F.col("per_bin")))
            .withColumn("offset", F.col("place") + at % F.col("per_bin") * F.col("length"))
            .drop("number", "plan_length", "first", "last", "per_bin", "sequence", "place"))


def pack(docs: DataFrame, vocabulary: str | None = None, *, capacity: int = CAPACITY, keep_ids: bool = False,
         id_col: str = "doc_id", text_col: str = "text", slice_chars: int = SLICE_CHARS,
         max_entries: int = MAX_ENTRIES) -> DataFrame:
    """Every piece's place: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and its ids if kept).

    ``slice_chars`` and ``max_entries`` bound the encoder's memory; the result does not depend on them.
    """
    vocabulary = vocabulary or public_tokenizers.path("word_bpe_49k.json")
    return packed(token_pieces(docs, vocabulary, capacity=capacity, keep_ids=keep_ids, id_col=id_col,
                               text_col=text_col, slice_chars=slice_chars, max_entries=max_entries), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences themselves from ``pack(..., keep_ids=True)``: sequence_id, ids, piece lengths in order.

    A sequence holds at most ``capacity`` ids, which bounds each group.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    return (placed.groupBy("sequence_id").agg(parts.alias("p"))
            .select("sequence_id", F.transform("p", lambda x: x["length"]).alias("lengths"),
                    F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids")))


def query(spark, sf_dir: str) -> DataFrame:
    """op6: every piece of every document, packed."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
