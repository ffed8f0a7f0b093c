import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from provend.llm import arrow_tokens, packing
from provend.llm.pieces import PieceEncoder
from provend.session import scratch_path

BYTES, WORDS = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
PLAIN = {p: Tokenizer.from_file(p) for p in (BYTES, WORDS)}
CACHED = {p: PieceEncoder(p, 2, lower=p == WORDS, max_entries=500) for p in (BYTES, WORDS)}


def ids(path, text, end):
    return [*PLAIN[path].encode(text or "", add_special_tokens=False).ids, end]


ALPHABET = st.characters(max_codepoint=0x24F) | st.sampled_from(" \n\t'sSdDtT.,!12é中́  İſ²½ªµ\x85\x1c<|")


@pytest.mark.parametrize("path", [BYTES, WORDS])
@settings(max_examples=600, deadline=None)
@given(text=st.text(ALPHABET, max_size=60) | st.lists(st.sampled_from(
    ["<|endoftext|>", "<|", "it's", "a.\nB", "\n", "", "c,", "\tq", "¾x", "WE'LL", "  ", "\n\n", " \n a", "don't", "été", "x1y2", "...", "'Sample"]), max_size=8).map(" ".join))
def test_cached_pieces_equal_the_library(path, text):
    assert CACHED[path].encode(text).tolist() == ids(path, text, 2)


def test_files_round_trip_and_zero_copy(spark, edge_docs, no_docs):
    folder = scratch_path(spark, "test-tokens")
    manifest = arrow_tokens.write(edge_docs, folder, BYTES, sequence=64, shards=3)
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in arrow_tokens.read(manifest).collect()))
    rows = sorted(((r["doc_id"], r["text"]) for r in edge_docs.collect()),
                  key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    start, want = 0, []
    for d, t in rows:
        x = np.array(ids(BYTES, t, 2), dtype="<u4")
        want.append((start, d, len(x), zlib.crc32(x.tobytes())))
        start += len(x)
    assert got == want
    stream, before = [], pa.total_allocated_bytes()
    for m in manifest.orderBy("shard").collect():
        f = arrow_tokens.TokenFile(m["tokens_file"], 64)
        assert len(f) == m["n_sequences"] == -(-m["n_tokens"] // 64)
        for i in (0, len(f) - 1):
            row, mask = f[i]
            assert row.dtype == np.uint16 and len(row) == 64 and not row.flags.owndata
            assert sum(mask.to_pylist()) == (64 if i < len(f) - 1 else m["n_tokens"] - 64 * (len(f) - 1))
        stream += [x for part in f.span(0, m["n_tokens"]) for x in part.tolist()]
    assert pa.total_allocated_bytes() - before < 1 << 20  # the map is read in place
    assert stream == [x for _, t in rows for x in ids(BYTES, t, 2)]
    empty = arrow_tokens.write(no_docs, scratch_path(spark, "test-none"), BYTES)
    assert empty.count() == 0 and arrow_tokens.read(empty).count() == 0


def naive_best_fit(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= x]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= x
        else:
            rooms.append(capacity - x)
    return sorted(rooms)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.integers(40, 64))
def test_plan_is_best_fit_decreasing(lengths, capacity):
    counts = defaultdict(int)
    for x in lengths:
        counts[x] += 1
    bins, seen = defaultdict(list), defaultdict(int)
    for length, first, last, per_bin, sequence, place in packing.best_fit_plan(counts, capacity):
        assert first == seen[length]
        seen[length] = last + 1
        for k in range(last - first + 1):
            bins[sequence + k // per_bin].append((place + k % per_bin * length, length))
    assert seen == counts
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(capacity - sum(x for _, x in b) for b in bins.values()) == naive_best_fit(lengths, capacity)


def test_plan_size_does_not_grow_with_the_corpus():
    rng = np.random.default_rng(1)
    counts = {int(x): int(n) for x, n in zip(*np.unique(rng.integers(1, 2049, 100_000), return_counts=True))}
    small = len(packing.best_fit_plan(counts))
    large = len(packing.best_fit_plan({k: n * 1_000_003 for k, n in counts.items()}))
    assert small < 20_000 and large < 20_000


def test_room_tree():
    tree = packing.RoomTree(100)
    for r in (3, 50, 100):
        tree.set(r, True)
    assert [tree.tightest(x) for x in (1, 3, 4, 50, 51, 100)] == [3, 3, 50, 50, 100, 100]
    tree.set(50, False)
    assert tree.tightest(4) == 100
    tree.set(100, False)
    assert tree.tightest(4) is None


def test_packed_edge_documents(spark, edge_docs, no_docs):
    out = packing.pack(edge_docs, capacity=50, keep_ids=True)
    rows = out.collect()
    want = defaultdict(int)
    for r in edge_docs.collect():
        x = np.array(ids(WORDS, r["text"], 0), dtype="<u4")
        for k, s in enumerate(range(0, len(x), 50)):
            want[(r["doc_id"], k, s, len(x[s:s + 50]), zlib.crc32(x[s:s + 50].tobytes()))] += 1
    got, bins = defaultdict(int), defaultdict(list)
    for r in rows:
        got[(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])] += 1
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
    assert got == want
    for b in bins.values():
        assert sorted(b)[0][0] == 0 and all(x[0] + x[1] == y[0] for x, y in zip(sorted(b), sorted(b)[1:]))
        assert sum(n for _, n in b) <= 50
    whole = packing.sequences(out).agg(F.sum(F.length("ids")), F.count("*")).first()
    assert tuple(whole) == (4 * sum(r["length"] for r in rows), len(bins))
    assert packing.pack(no_docs).count() == 0
