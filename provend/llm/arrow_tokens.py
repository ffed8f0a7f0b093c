"""Token-id output in Arrow file format with fixed-size-list batches.

The ids of all documents, in ascending document order, form one stream. It is
cut over shard files by ranges of the document id; each shard holds

* ``tokens-*.arrow``: record batches of (ids fixed_size_list<uint16 or uint32>[L],
  mask fixed_size_list<bool>[L]). Every row is a sequence of L ids; the shard's
  last is padded with zeros whose mask is false. Row i is found by arithmetic
  and read from the memory map without a copy.
* ``docs-*.arrow``: record batches of (doc_id, start, n_tokens), the place of
  each document in the shard's stream.

A task writes files under names of its own attempt and only then reports them,
so a lost or repeated task leaves no wrong file in the manifest. The manifest
(one row for each shard) also turns places in a shard into places in the stream.

Defined cases: a null text counts as empty (its ids are the end id alone); null
ids come first; rows that share an id keep a fixed order (by text); an empty
table has no shards and reads back as no rows; other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provend.llm import pieces
from provend.session import scratch_path, stage_table

SEQUENCE = 2048
BATCH_SEQUENCES = 128
END_ID = 2
MANIFEST = ("shard long, tokens_file string, docs_file string, n_docs long, n_tokens long, n_sequences long, "
            "sequence long")


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI and the path in it."""
    if urlparse(path).scheme:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def _list_array(values: pa.Array, size: int) -> pa.FixedSizeListArray:
    return pa.FixedSizeListArray.from_arrays(values, size)


class _ShardFiles:
    """Writes one shard's two files batch by batch; memory is bounded by a batch and one document."""

    def __init__(self, folder: str, shard: int, dtype: np.dtype, sequence: int):
        name = f"{shard:06d}-{uuid.uuid4().hex[:8]}.arrow"
        fs, root = _filesystem(folder)
        fs.create_dir(root, recursive=True)
        self.names = f"{folder}/tokens-{name}", f"{folder}/docs-{name}"
        self.dtype, self.sequence = dtype, sequence
        ids = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([("ids", pa.list_(ids, sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        self.docs_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sinks = [fs.open_output_stream(f"{root}/{kind}-{name}") for kind in ("tokens", "docs")]
        self.tokens = pa.ipc.new_file(self.sinks[0], self.schema)
        self.docs = pa.ipc.new_file(self.sinks[1], self.docs_schema)
        self.rest: list[np.ndarray] = []
        self.waiting = self.n_tokens = self.n_docs = self.n_sequences = 0

    def _put(self, ids: np.ndarray, mask: np.ndarray) -> None:
        step = BATCH_SEQUENCES * self.sequence
        for i in range(0, len(ids), step):
            self.tokens.write_batch(pa.record_batch([
                _list_array(pa.array(ids[i:i + step]), self.sequence),
                _list_array(pa.array(mask[i:i + step]), self.sequence)], schema=self.schema))
        self.n_sequences += len(ids) // self.sequence

    def add(self, doc_ids: list, ids: np.ndarray, sizes: np.ndarray) -> None:
        """The documents' ids one after another, and the number of ids of each."""
        starts = self.n_tokens + np.cumsum(sizes) - sizes
        self.docs.write_batch(pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(sizes)],
                                              schema=self.docs_schema))
        self.n_docs += len(doc_ids)
        self.n_tokens += len(ids)
        self.rest.append(ids)
        self.waiting += len(ids)
        step = BATCH_SEQUENCES * self.sequence
        if self.waiting >= step:  # batches of one size, so that a sequence's batch is found by arithmetic
            ids = np.concatenate(self.rest)
            whole = len(ids) // step * step
            self._put(ids[:whole], np.ones(whole, dtype=bool))
            self.rest, self.waiting = [ids[whole:].copy()], len(ids) - whole

    def close(self) -> None:
        if self.waiting:
            ids = np.concatenate(self.rest)
            size = -(-len(ids) // self.sequence) * self.sequence
            full = np.zeros(size, dtype=self.dtype)
            full[:len(ids)] = ids
            self._put(full, np.arange(size) < len(ids))
        self.tokens.close()
        self.docs.close()
        for s in self.sinks:
            s.close()


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID, *, id_col: str = "doc_id",
          text_col: str = "text", sequence: int = SEQUENCE, shards: int | None = None) -> DataFrame:
    """Encode and write all documents; returns the manifest, which is staged as a table."""
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, files, encoder = TaskContext.get().partitionId(), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if files is None:
                encoder = pieces.encoder(vocabulary, end_id, lower=False)
                files = _ShardFiles(folder, shard, encoder.dtype, sequence)
            ids, texts = (c.to_pylist() for c in batch.columns)
            for lo, hi in pieces.slices(texts):
                files.add(ids[lo:hi], *encoder.encode_all(texts[lo:hi]))
        if files is not None:
            files.close()
            yield pa.RecordBatch.from_pylist([{
                "shard": shard, "tokens_file": files.names[0], "docs_file": files.names[1], "n_docs": files.n_docs,
                "n_tokens": files.n_tokens, "n_sequences": files.n_sequences, "sequence": sequence}])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # rows that share an id (or have none) go on by a hash of their text, so that one id is no one task
    order = ["doc_id", "tie", "text"]
    manifest = (rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(shards, *order[:2])
                .sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(put, MANIFEST))
    return stage_table(manifest, "token-manifest")


class TokenFile:
    """Random access to one shard's sequences; ``ids`` and ``mask`` rows are views, not copies.

    A local file is mapped into memory. Of a file elsewhere, the batch last used is held.
    """

    def __init__(self, path: str, sequence: int):
        fs, inner = _filesystem(path)
        source = pa.memory_map(inner) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(inner)
        self.reader = pa.ipc.open_file(source)
        self.sequence = sequence
        self.n_batches = self.reader.num_record_batches
        self.held: tuple[int, pa.RecordBatch | None] = (-1, None)
        self.rows = self._batch(0).num_rows if self.n_batches else 1  # of every batch but the last

    def _batch(self, b: int) -> pa.RecordBatch:
        if self.held[0] != b:
            self.held = b, self.reader.get_batch(b)
        return self.held[1]

    def __len__(self) -> int:
        return (self.n_batches - 1) * self.rows + self._batch(self.n_batches - 1).num_rows if self.n_batches else 0

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.Array]:
        b, at = divmod(i, self.rows)
        batch = self._batch(b)
        return (batch.column(0)[at].values.to_numpy(zero_copy_only=True), batch.column(1)[at].values)

    def span(self, start: int, length: int) -> Iterator[np.ndarray]:
        """Views of the ids from place ``start`` of the shard's stream, ``length`` of them."""
        while length > 0:
            b, at = divmod(start, self.rows * self.sequence)
            part = self._batch(b).column(0).flatten().to_numpy(zero_copy_only=True)[at:at + length]
            yield part
            start, length = start + len(part), length - len(part)


def read(manifest: DataFrame) -> DataFrame:
    """Per document from the files: doc_id, start in the whole stream, n_tokens, ids_crc32."""
    # one row for each shard file; their running total is a small window
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = stage_table(manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))), "token-bases")
    n = max(1, placed.count())

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens = TokenFile(row["tokens_file"], row["sequence"])
                fs, inner = _filesystem(row["docs_file"])
                with fs.open_input_file(inner) as f:
                    docs = pa.ipc.open_file(f)
                    for i in range(docs.num_record_batches):
                        part = docs.get_batch(i)
                        sums = []
                        for start, size in zip(part["start"].to_pylist(), part["n_tokens"].to_pylist()):
                            crc = 0
                            for ids in tokens.span(start, size):
                                crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                            sums.append(crc)
                        yield pa.record_batch([part["doc_id"],
                                               pa.array(part["start"].to_numpy() + row["base"], pa.int64()),
                                               part["n_tokens"], pa.array(sums, pa.int64())],
                                              names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = placed.select("shard", "tokens_file", "docs_file", "sequence", "base").repartition(n, F.xxhash64("shard"))
    return files.mapInArrow(get, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark, sf_dir: str) -> DataFrame:
    """op4: write all documents' ids and read the files back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write(docs, scratch_path(spark, "token-files"), public_tokenizers.path("byte_bpe_50k.json"))
    return read(manifest)
