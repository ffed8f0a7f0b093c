"""SimHash near-dedup with pivot distance tables.

Fingerprints: 64 bits from the XXH64 of word shingles. Equal fingerprints form
a class first, so copies cost one row from then on. Links between classes (at
most ``max_bits`` differing bits) are found in buckets: of ``max_bits + 1`` parts
of the bits, linked fingerprints share at least one, so rows are keyed by (part,
its value). A bucket over ``max_bucket`` rows is keyed again by parts of the
bits that its key leaves open - the same argument holds there - until it is
small or no bits are left, so no group has to fit one task.

Inside a bucket a table holds each fingerprint's Hamming distances to many
reference fingerprints. By the triangle inequality a pair whose distances to any
reference differ by more than ``max_bits`` cannot be linked and is discarded;
survivors are verified on the bits. Rows are sorted by the first distance, so a
row meets only those within ``max_bits`` of it. Pairs that are already connected
are passed over: a bucket yields a spanning forest, never all its pairs.

The forest's components are found over the cluster by alternating star
contraction, cut by checkpoints.

Defined cases: null and empty texts have fingerprint zero and are linked like
any other; repeated rows are copies; rows without id belong to their component
(its id is the smallest id there, null if no member has one); an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provend.session import materialize, stage_table

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
REFERENCES = 16
MAX_BUCKET = 20_000
#: reference fingerprints: a fixed pseudo-random set
REFERENCE_BITS = np.random.default_rng(64).integers(0, 2 ** 64, REFERENCES, dtype=np.uint64)


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """A bit is 1 if it is set in over half the hashes of the text's shingles (repeats included)."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    grams = zip(*(words[i:] for i in range(shingle_words))) if len(words) >= shingle_words else [words]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes = np.array([digest(join(g), SEED) for g in grams], dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(text: Column, shingle_words: int = SHINGLE_WORDS) -> Column:
    """Column of signed 64-bit fingerprints of a text column."""
    @F.arrow_udf("bigint")
    def marks(texts: pa.Array) -> pa.Array:
        fps = np.fromiter((fingerprint(t.as_py(), shingle_words) for t in texts), dtype=np.uint64, count=len(texts))
        return pa.array(fps.view(np.int64))
    return marks(text)


def _cuts(max_bits: int):
    """Column function: an open-bits mask -> array of (part, rest), ``max_bits + 1`` parts of its bits."""
    signed = lambda bits: int(np.array(sum(1 << b for b in bits), dtype=np.uint64).view(np.int64))
    known: dict[int, list[dict]] = {}

    def cut(mask: int) -> list[dict]:
        bits = [b for b in range(64) if mask >> b & 1]
        parts = [p.tolist() for p in np.array_split(bits, max_bits + 1)]
        return [{"part": signed(p), "rest": signed(set(bits) - set(p))} for p in parts if p]

    @F.arrow_udf("array<struct<part:bigint,rest:bigint>>")
    def cuts(masks: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("part", pa.int64()), ("rest", pa.int64())]))
        return pa.array([known[m] if m in known else known.setdefault(m, cut(m)) for m in masks.to_pylist()], kind)
    return cuts


def _linked_in_bucket(fps: np.ndarray, key: np.ndarray, table: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Spanning forest of the links inside each bucket; rows are sorted by (key, first distance)."""
    n = len(fps)
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    forest, label, left, shift = [], parent.copy(), np.arange(n), 1
    while len(left):
        left = left[left + shift < n]
        to = left + shift
        # sorted: once the key or the first distance is out of reach, so it stays for larger shifts
        near = (key[left] == key[to]) & (table[to, 0] - table[left, 0] <= max_bits)
        left, to = left[near], to[near]
        open_ = label[left] != label[to]
        a, b = left[open_], to[open_]
        for j in range(1, table.shape[1]):  # discard by the largest difference of any coordinate
            ok = np.abs(table[a, j] - table[b, j]) <= max_bits
            a, b = a[ok], b[ok]
        ok = np.bitwise_count(fps[a] ^ fps[b]) <= max_bits
        joined = False
        for i, k in zip(a[ok].tolist(), b[ok].tolist()):
            x, y = root(i), root(k)
            if x != y:
                parent[max(x, y)] = min(x, y)
                forest.append((i, k))
                joined = True
        if joined:
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
            label = parent.copy()
        if shift % 256 == 0:  # rows whose bucket is one component are done
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            same = np.minimum.reduceat(label, starts) == np.maximum.reduceat(label, starts)
            left = left[~same[np.searchsorted(starts, left, side="right") - 1]]
        shift += 1
    return forest


def bucket_links(keyed: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b) links that span each bucket of ``keyed`` (key long, fp long)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key: np.ndarray, fp: np.ndarray):
            u = fp.view(np.uint64)
            table = np.bitwise_count(u[:, None] ^ REFERENCE_BITS[None, :]).astype(np.int16)
            order = np.lexsort((table[:, 0], key))
            u, key, table = u[order], key[order], table[order]
            pairs = np.array(_linked_in_bucket(u, key, table, max_bits), dtype=np.int64).reshape(-1, 2)
            s = u.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(s[pairs[:, 0]]), pa.array(s[pairs[:, 1]])], ["a", "b"])

        keys, fps = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:  # a bucket may go on in the next batch
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            fps = np.concatenate([fps, batch.column(1).to_numpy()])
            cut = int(np.searchsorted(keys == keys[-1], True)) if len(keys) else 0
            if cut:
                yield out(keys[:cut], fps[:cut].copy())
                keys, fps = keys[cut:], fps[cut:]
        if len(keys):
            yield out(keys, fps.copy())

    n = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (keyed.repartition(n, "key").sortWithinPartitions("key").select("key", "fp")
            .mapInArrow(work, "a long, b long"))


def links(classes: DataFrame, max_bits: int = MAX_BITS, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(a, b) links between the distinct fingerprints ``classes`` (fp) that have their components."""
    cuts, found = _cuts(max_bits), []
    rows = classes.select(F.lit(0).cast("long").alias("key"), F.lit(-1).cast("long").alias("open"), "fp")
    while True:
        keyed = rows.select("key", "open", "fp", F.explode(cuts("open")).alias("x")).select(
            F.xxhash64("key", "open", "x.part", F.col("fp").bitwiseAND(F.col("x.part"))).alias("key"),
            F.col("x.rest").alias("open"), "fp")
        keyed = stage_table(keyed, "simhash-keys")
        # with no more open bits than may differ, all of a bucket is linked: nothing to split
        big = materialize(keyed.where(F.bit_count("open") > max_bits).groupBy("key").count()
                          .where(F.col("count") > max_bucket).select("key"))
        if big.isEmpty():
            found.append(bucket_links(keyed, max_bits))
            break
        found.append(bucket_links(keyed.join(big, "key", "left_anti"), max_bits))
        rows = keyed.join(big, "key", "left_semi")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def components(pairs: DataFrame) -> DataFrame:
    """(node, root): each node of ``pairs`` (a, b) with the smallest node it is connected to.

    Alternates two contractions until nothing changes: every node links its larger neighbours to the
    smallest node it sees ("large star"), then its smaller ones ("small star"). Both keep components
    as they are; the number of rounds grows with the logarithm of the longest path.
    """
    def star(edges: DataFrame, large: bool) -> DataFrame:
        if large:
            sides = edges.select(F.col("u").alias("n"), F.col("v").alias("m")).unionByName(
                edges.select(F.col("v").alias("n"), F.col("u").alias("m")))
        else:
            sides = edges.select(F.greatest("u", "v").alias("n"), F.least("u", "v").alias("m"))
        low = sides.groupBy("n").agg(F.min("m").alias("low")).select("n", F.least("n", "low").alias("low"))
        joined = sides.join(low, "n")
        moved = joined.where(F.col("m") > F.col("n")) if large else joined
        out = moved.select(F.col("m").alias("u"), F.col("low").alias("v"))
        if not large:
            out = out.unionByName(low.select(F.col("n").alias("u"), F.col("low").alias("v")))
        return out.where(F.col("u") != F.col("v")).distinct()

    edges = materialize(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                        .where(F.col("u") != F.col("v")).distinct())
    seen = None
    while True:
        edges = materialize(star(star(edges, large=True), large=False))
        mark = edges.agg(F.count("*"), F.sum(F.col("u").cast("decimal(38,0)")),
                         F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    return edges.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias("root"))


def with_components(marked: DataFrame, fp: str, id_col: str, max_bits: int = MAX_BITS,
                    max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Classes (fp, class_id, root, component_id): equal fingerprints, their smallest id, their component.

    ``root`` is the smallest fingerprint of the component and names it even where no row has an id.
    """
    classes = stage_table(marked.groupBy(F.col(fp).alias("fp")).agg(F.min(id_col).alias("class_id")), "simhash-classes")
    roots = components(links(classes.select("fp"), max_bits, max_bucket))
    placed = classes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "class_id", F.coalesce("root", "fp").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("class_id").alias("component_id"))
    return placed.join(smallest, "root").select("fp", "class_id", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                    shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
                    max_bucket: int = MAX_BUCKET) -> DataFrame:
    """One row for each document: doc_id, fingerprint (16 hex digits), component_id."""
    marked = stage_table(docs.select(F.col(id_col).alias("doc_id"),
                                     fingerprints(F.col(text_col), shingle_words).alias("fp")), "simhash-marks")
    groups = with_components(marked, "fp", "doc_id", max_bits, max_bucket)
    return marked.join(groups.select("fp", "component_id"), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                 shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The documents with one of each component left: that with the smallest id, all columns as they were.

    Rows that repeat both id and fingerprint count as one; a component without any id keeps one of its
    smallest class.
    """
    marked = stage_table(docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"),
                                     fingerprints(F.col(text_col), shingle_words).alias("fp")), "simhash-rows")
    groups = with_components(marked.select("id", "fp"), "fp", "id", max_bits)
    kept = groups.groupBy("root").agg(
        F.min(F.struct(F.col("class_id").isNull().alias("unnamed"), "class_id", "fp")).alias("x")).select(
        F.col("x.class_id").alias("kept_id"), F.col("x.fp").alias("fp"))
    return (marked.join(kept, "fp").where(F.col("id").eqNullSafe(F.col("kept_id")))
            .dropDuplicates(["fp"]).select("row.*"))


def query(spark, sf_dir: str) -> DataFrame:
    """op3: fingerprint and component of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
