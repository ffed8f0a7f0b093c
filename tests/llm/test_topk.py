import numpy as np
import pytest

from provend.llm.topk import PivotIndex

SCHEMA = "vec_id long, embedding array<float>, pivot int, dist double, ids string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2.0, "x") for i, v in rows], SCHEMA)


def brute(rows, is_query, k):
    ok = set()
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        ok.add((i, tuple(float(np.floor(256 * float(np.float32(x)))) for x in v)))
    out = set()
    for i in {i for i, _ in ok if is_query(i)}:
        best = {}
        for q in (v for j, v in ok if j == i):
            for j, c in ok:
                if j != i:
                    best[j] = max(best.get(j, -2 ** 62), int(sum(a * b for a, b in zip(q, c))))
        out |= {(i, r + 1, j, s) for r, (s, j) in enumerate((s, j) for s, j in sorted(
            ((s, j) for j, s in best.items()), key=lambda x: (-x[0], x[1]))[:k])}
    return out


@pytest.mark.parametrize("copies", [0, 120])
def test_matches_brute_force_with_many_blocks_and_ties(spark, copies):
    rng = np.random.default_rng(copies)
    centres = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in centres[i % 6] + 0.05 * rng.normal(size=8)]) for i in range(400)]
    rows += [(1000 + i, [0.5] * 8) for i in range(copies)]  # a third of the rows are one vector
    index = PivotIndex(frame(spark, rows), pivots=5, sample_rows=32, block_rows=16)
    got = index.search(lambda i: i % 10 == 0, k=5, group_rows=7, first_blocks=1)
    assert {tuple(r) for r in got.collect()} == brute(rows, lambda i: i % 10 == 0, 5)


def test_rows_that_take_no_part_and_few_candidates(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]),
            (None, [1.0, 1.0]), (5, [-0.3, 0.001]), (5, [9.0, 9.0]), (6, [1.0]), (7, [])]
    got = PivotIndex(frame(spark, rows)).search(lambda i: i % 5 == 0, k=5)
    assert {tuple(r) for r in got.collect()} == brute(rows, lambda i: i % 5 == 0, 5)


def test_empty_table_and_vectors_too_long(spark):
    assert PivotIndex(frame(spark, [])).search(lambda i: i % 2 == 0).count() == 0
    with pytest.raises(ValueError):
        PivotIndex(frame(spark, [(1, [1e30])]))


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2 ** 20 + i), float(-i)]) for i in range(20)]
    got = PivotIndex(frame(spark, rows), block_rows=4).search(lambda i: i % 5 == 0, k=3)
    assert {tuple(r) for r in got.collect()} == brute(rows, lambda i: i % 5 == 0, 3)


def test_rows_that_share_an_id_all_count(spark):
    rows = [(1, [1.0, 0.0]), (1, [5.0, 5.0]), (50, [1.0, 1.0]), (2, [2.0, 2.0])]
    got = {tuple(r) for r in PivotIndex(frame(spark, rows)).search(lambda i: i % 50 == 0, k=5).collect()}
    assert got == {(50, 1, 1, 655_360), (50, 2, 2, 262_144)}
    rng = np.random.default_rng(9)
    rows = [(int(rng.integers(0, 40)), [float(x) for x in rng.normal(size=4)]) for _ in range(500)]
    rows += [(7, [float(x) for x in rng.normal(size=4) * 3]) for _ in range(250)] + rows[:30]  # a third under one id
    for opts in ({}, {"pivots": 4, "block_rows": 16, "sample_rows": 64}):
        got = PivotIndex(frame(spark, rows), **opts).search(lambda i: i % 10 == 0, k=5, group_rows=6, first_blocks=1)
        assert {tuple(r) for r in got.collect()} == brute(rows, lambda i: i % 10 == 0, 5)


def test_clashing_columns(spark):
    rows = [(i, [float(i), 1.0], 3, 4.0, 5, 6) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, grp int, floors double, slice int, qids int")
    got = PivotIndex(df, block_rows=4).search(lambda i: i % 5 == 0, k=3)
    assert {tuple(r) for r in got.collect()} == brute([r[:2] for r in rows], lambda i: i % 5 == 0, 3)
