import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from provend.llm import simhash as s


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, bits=3):
    """rows of (id, fingerprint) -> component id of each row, smallest id reachable."""
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= bits:
                parent[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[root(i)] = min([x for x in (low.get(root(i)), d) if x is not None], default=None)
    return [low[root(i)] for i in range(len(rows))]


def test_fingerprints_and_components_of_documents(spark, some_docs, edge_docs):
    for docs, rows in ((spark.createDataFrame([(d, t) for d, t, _, _ in some_docs], "doc_id long, text string"),
                        [(d, t) for d, t, _, _ in some_docs]),
                       (edge_docs, [(r["doc_id"], r["text"]) for r in edge_docs.collect()])):
        prints = [(d, brute_print(t)) for d, t in rows if len(t or "") < 100_000]
        got = [(r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in
               s.near_duplicates(docs.where("text is null or length(text) < 100000")).collect()]
        want = [(d, f, c) for (d, f), c in zip(prints, brute_components(prints))]
        assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("max_bucket", [2, 5, 20_000])
def test_hot_balls_chains_and_split_buckets(spark, max_bucket):
    rng = np.random.default_rng(3)
    rows = [int(x) for x in rng.integers(0, 2 ** 64, 60, dtype=np.uint64)]
    for centre in rows[:2]:  # dense balls: all within few bits of a centre
        rows += [centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (60, 2))]
    x = rows[5]
    for i in range(0, 60, 3):  # a chain of links, three bits further each time
        x ^= 7 << i
        rows.append(x)
    rows += rows[:10]
    rng.shuffle(rows)
    named = [(i, r) for i, r in enumerate(rows)]
    df = spark.createDataFrame([(i, r - (1 << 64) if r >> 63 else r) for i, r in named], "id long, fp long").repartition(4)
    got = {r["fp"]: r["component_id"] for r in s.with_components(df, "fp", "id", 3, max_bucket).collect()}
    for (i, r), c in zip(named, brute_components(named)):
        assert got[r - (1 << 64) if r >> 63 else r] == c


def test_no_pair_explosion_inside_a_ball(spark):
    base = 0x0123456789ABCDEF
    prints = sorted({base ^ (1 << a) for a in range(64)} | {base})
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in prints], "fp long")
    assert s.links(df).count() <= 4 * len(prints)  # a spanning forest for each part, not all pairs


def test_deduplicated_keeps_one_of_each_group_and_all_columns(spark, edge_docs, no_docs):
    out = s.deduplicated(edge_docs)
    assert out.columns == edge_docs.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 4, 5, 6, 9, 10, 11, 12, 13]
    assert ids.count(None) == 1  # null text without id is a copy of 1; the other has words of its own
    assert s.deduplicated(no_docs).count() == 0 and s.near_duplicates(no_docs).count() == 0
    assert s.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_single_long_path(spark):
    n = 200
    pairs = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long")
    got = s.components(pairs).agg(F.min("root"), F.max("root"), F.count("*")).first()
    assert tuple(got) == (0, 0, n)
