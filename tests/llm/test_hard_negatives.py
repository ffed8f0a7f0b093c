import numpy as np
import pytest

from provend.llm.hard_negatives import Miner, scan, window

SCHEMA = "vec_id long, embedding array<float>, label int, block int, grp string, score long, id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, x, 1, "g", 5, "i") for i, v, x in rows], SCHEMA)


def brute(rows, is_anchor, low=80, high=100, k=5):
    ok = set()
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        ok.add((i, label, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)))
    out = []
    for i, label, q in ok:
        if not is_anchor(i):
            continue
        score = lambda c: sum(a * b for a, b in zip(q, c))
        near = sorted((-score(c), j) for j, x, c in ok if x == label and j != i)[:k]
        far = sorted((-score(c), j) for j, x, c in ok if x != label)
        for p, pid in near:
            p = -p
            hard = [(-s, j) for s, j in far if low * p <= -100 * s <= high * p][:k]
            out += [(i, pid, r + 1, j, p, s) for r, (s, j) in enumerate(hard)]
    return sorted(out)


def mined(spark, rows, is_anchor, group_rows=7, **opts):
    miner = Miner(frame(spark, rows), **{"block_rows": 16, "sample_rows": 32, **opts})
    return sorted(tuple(r) for r in miner.mine(is_anchor, group_rows=group_rows).collect())


@pytest.mark.parametrize("copies", [0, 150])
def test_matches_brute_force_with_ties_and_a_hot_vector(spark, copies):
    rng = np.random.default_rng(copies)
    centres = rng.normal(size=(5, 12))
    rows = [(i, [float(x) for x in centres[i % 5] + 0.3 * rng.normal(size=12)], int(rng.integers(0, 4)))
            for i in range(400)]
    rows += [(1000 + i, [0.5] * 12, i % 3) for i in range(copies)]  # a third of the rows are one vector
    want = brute(rows, lambda i: i % 10 == 0)
    assert want and mined(spark, rows, lambda i: i % 10 == 0) == want


def test_rows_that_take_no_part_repeats_and_few_candidates(spark):
    rows = [(0, [1.0, 2.0], 1), (1, None, 1), (2, [None, 1.0], 2), (3, [float("nan"), 1.0], 1), (4, [float("inf"), 0.0], 1),
            (None, [1.0, 1.0], 1), (5, [-0.3, 0.001], 1), (5, [1.0, 1.9], 2), (5, [1.0, 1.9], 2), (6, [1.0], 1), (7, [], 1),
            (8, [1.0, 1.5], None), (9, [1.0, 1.8], 2), (10, [1.0, 1.95], 1), (10, [0.9, 1.7], 2), (11, [0.4, 0.2], 3),
            (15, [0.0, 0.0], 4), (16, [0.0, 0.0], 4)]
    want = brute(rows, lambda i: i % 5 == 0)
    assert len(want) > 5 and mined(spark, rows, lambda i: i % 5 == 0) == want


def test_empty_table_no_anchors_and_vectors_too_long(spark):
    assert mined(spark, [], lambda i: i % 2 == 0) == []
    assert mined(spark, [(1, [1.0], 1), (3, [2.0], 2)], lambda i: i % 2 == 0) == []
    with pytest.raises(ValueError):
        Miner(frame(spark, [(1, [1e30], 1)]))


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2 ** 20 + 1000 * i), float(-i)], i % 2) for i in range(30)]
    assert mined(spark, rows, lambda i: i % 5 == 0) == brute(rows, lambda i: i % 5 == 0)


def test_a_vertical_scan_drops_candidates_before_all_dimensions_are_read():
    rng = np.random.default_rng(3)
    cols = rng.integers(-9, 9, size=(32, 200)).astype(np.float32)
    q = np.array([100.0] * 4 + [1.0] * 28, dtype=np.float32)
    left = []

    def settle(low, high):
        keep = high >= np.partition(low, -3)[-3] if len(low) >= 3 else np.ones(len(low), bool)
        left.append(int(keep.sum()))
        return keep
    rows, score = scan(cols, cols.min(axis=1), cols.max(axis=1), q, np.arange(200), settle, step=4)
    exact = (q @ cols).astype(int)
    assert left[0] < 100 and set(np.argsort(-exact)[:3]) <= set(rows.tolist()) and (exact[rows] == score).all()


def test_windows_are_exact_integers():
    for p in (-7, 0, 1, 99, 2 ** 61 + 3):
        a, z = window(p, 80, 100)
        assert 80 * p <= 100 * a and 80 * p > 100 * (a - 1) and 100 * z <= 100 * p < 100 * (z + 1)


def test_copies_of_groups_are_not_broadcast(spark):
    """They grow with groups x tiles, and a broadcast is collected on the driver."""
    rows = [(i, [float(i % 7), 1.0], i % 3) for i in range(100)]
    miner = Miner(frame(spark, rows), block_rows=16)
    assert miner.tiles > 1
    plan = miner.mine(lambda i: i % 10 == 0)._jdf.queryExecution().executedPlan().toString().splitlines()
    joins = [x for x in plan if "Join [tile#" in x]
    assert len(joins) == 1 and "SortMergeJoin" in joins[0]
