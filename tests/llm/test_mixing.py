import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from provend.llm import mixing as m


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    out, budget, live = {}, share * sum(sizes.values()), set(names)
    while live:
        level = (budget - sum(out.values())) / sum(w[s] for s in live)
        over = [s for s in live if level * w[s] > cap * sizes[s]]
        if not over:
            break
        for s in over:
            out[s] = cap * sizes[s]
            live.discard(s)
    return out | {s: level * w[s] for s in live}


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 5, "d": 70, None: 3}, {"a": 0, "b": 10}, {"a": 7},
    {"é": 10, "z": 20, "Z": 30, "\U0001F600": 5, "￿": 9}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in m.targets(df).collect()}
    want = brute_targets(sizes)
    assert set(got) == set(want) and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_hypergeometric_draws_follow_the_law(spark):
    n = 20_000
    for total, marked, drawn in ((50, 20, 25), (1000, 3, 400), (10, 10, 4), (10, 0, 4), (7, 3, 7), (100_000, 60_000, 50_000)):
        u = (F.col("id") + 0.5) / n
        k = m.hypergeometric(*(F.lit(float(x)) for x in (total, marked, drawn)), u)
        mean, var, low, high = spark.range(n).select(k.alias("k")).agg(
            F.avg("k"), F.var_pop("k"), F.min("k"), F.max("k")).first()
        p = marked / total
        want = drawn * p * (1 - p) * (total - drawn) / max(total - 1, 1)
        assert low >= max(0, drawn - total + marked) and high <= min(drawn, marked)
        assert abs(mean - drawn * p) < 0.05 * max(1, np.sqrt(want)) and abs(var - want) <= 0.05 * want + 0.01


def test_tree_deals_every_quota_exactly(spark):
    quotas = spark.createDataFrame([(0, 1000), (1, 37), (2, 1), (3, 5000)], "src long, q long")
    rows = m.split_tree(quotas, 7).collect()
    by_shard = {}
    for r in rows:
        by_shard[r["shard"]] = by_shard.get(r["shard"], 0) + r["last"] - r["first"] + 1
    assert sorted(by_shard) == list(range(7)) and max(by_shard.values()) - min(by_shard.values()) <= 7
    for src, q in ((0, 1000), (1, 37), (2, 1), (3, 5000)):
        parts = sorted((r["first"], r["last"]) for r in rows if r["src"] == src)
        assert parts[0][0] == 0 and parts[-1][1] == q - 1 and all(a[1] + 1 == b[0] for a, b in zip(parts, parts[1:]))
    assert {tuple(r) for r in m.split_tree(quotas, 7).collect()} == {tuple(r) for r in rows}


@pytest.mark.parametrize("block_words", [16, None])
def test_mix_meets_targets_with_many_buckets_and_shards(spark, some_docs, block_words):
    rows = [(d, t, s if d % 3 else "hot") for d, t, _, s in some_docs]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = m.Mix(df, block_words=block_words, shard_blocks=100, bucket_blocks=20)
    got = {r["doc_id"]: r for r in mix.taken().collect()}
    sizes = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for d, t, _ in rows}
    source = {d: s for d, _, s in rows}
    totals, taken = {}, {}
    for d, n in sizes.items():
        totals[source[d]] = totals.get(source[d], 0) + n
        taken[source[d]] = taken.get(source[d], 0) + got[d]["taken"]
    want = brute_targets(totals)
    for d, r in got.items():
        assert (r["size"], r["source_size"]) == (sizes[d], totals[source[d]]) and r["taken"] <= 2 * r["size"]
        assert abs(r["target"] - want[source[d]]) < 1e-6
    for s in totals:
        most = block_words or max(n for d, n in sizes.items() if source[d] == s)
        assert abs(taken[s] - want[s]) <= most / 2 + 1e-6
    drawn = mix.drawn().collect()
    assert len({(r["shard"], r["place"]) for r in drawn}) == len(drawn)
    counts = {}
    for r in drawn:
        counts[r["shard"]] = counts.get(r["shard"], 0) + 1
    assert len(counts) == mix.shards > 1 and max(counts.values()) - min(counts.values()) <= 10
    again = m.Mix(df.repartition(5), block_words=block_words, shard_blocks=100, bucket_blocks=20).taken()
    assert {(r["doc_id"], r["taken"]) for r in again.collect()} == {(d, r["taken"]) for d, r in got.items()}


def test_edge_documents(spark, edge_docs, no_docs):
    rows = m.Mix(edge_docs).taken().collect()
    assert len(rows) == edge_docs.count()
    assert all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert all(r["taken"] <= 2 * r["size"] for r in rows)
    out = m.mixed_documents(edge_docs)
    assert out.columns == edge_docs.columns and out.count() > 0
    assert m.Mix(no_docs).taken().count() == 0 and m.mixed_documents(no_docs).count() == 0


def test_written_shards_hold_the_mix(spark, some_docs, tmp_path):
    df = spark.createDataFrame([(d, t, s) for d, t, _, s in some_docs], "doc_id long, text string, source string")
    mix = m.Mix(df, shard_blocks=200)
    mix.write(str(tmp_path / "mix"))
    back = spark.read.parquet(str(tmp_path / "mix"))
    assert back.count() == mix.drawn().count() and back.select("shard").distinct().count() == mix.shards
