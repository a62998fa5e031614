"""Hard negatives against all rows compared with all anchors."""

import math
import random

import numpy as np
import pytest

from textloom.llm import vp_tree


def brute(rows, every=100, positives=5, k=5):
    kept = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        if i % 7 == 0:
            label = (label + 1) % 10
        kept[(i, label, tuple(math.floor(256 * c) for c in v))] = None
    out = []
    for i, label, x in kept:
        if i % every:
            continue
        score = lambda y: sum(a * b for a, b in zip(x, y, strict=False))  # noqa: E731, B023
        same = sorted((-score(y), j) for j, m, y in kept if m == label and j != i)[:positives]
        other = sorted((-score(y), j) for j, m, y in kept if m != label)
        for p, pid in same:
            fits = [(s, j) for s, j in other if 80 * -p <= 100 * -s <= 100 * -p][:k]
            out += [(i, pid, n, j, -p, -s) for n, (s, j) in enumerate(fits, 1)]
    return sorted(out)


def table(n, d, seed, kinds=4):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((6, d))
    rows = []
    for i in range(n):
        v = centres[i % 6] * 0.6 + r.standard_normal(d) * 0.5
        rows.append((i, [float(np.float32(c)) for c in v], int(r.integers(kinds))))
    return rows


@pytest.mark.parametrize(("n", "d", "block_rows", "sample_rows", "query_block"), [(900, 8, 100, 64, 3), (900, 8, 5000, 8192, 2048), (400, 3, 70, 10, 2)])
def test_equal_to_brute_force(spark, n, d, block_rows, sample_rows, query_block):
    rows = table(n, d, n + d)
    rows += [(n + i, rows[100][1], i % 2) for i in range(150)]  # a vector that many rows share
    rows += [(5000 + i, [round(c, 1) for c in rows[i][1]], 1) for i in range(60)]
    rows += [(7, None, 1), (8, rows[0][1], None), (None, rows[0][1], 1), (9000, [0.0] * d, 2), (9100, [float("nan")] * d, 2), (9200, rows[3][1][:-1], 0), rows[100], rows[200], (300, rows[5][1], 3)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<float>, label int, x int, leaf int, q int").repartition(5)
    got = [tuple(r) for r in vp_tree.hard_negatives(df, block_rows=block_rows, sample_rows=sample_rows, query_block=query_block).collect()]
    want = brute(rows)
    assert len(want) > 40
    assert sorted(got) == want


def test_walks_visit_few_buckets():
    r = np.random.default_rng(4)
    x = np.floor(256 * (r.standard_normal((40, 6))[np.arange(4000) % 40] * 3 + r.standard_normal((4000, 6)) * 0.05)).astype(np.int64)
    m2 = int((x * x).sum(axis=1).max())
    block = vp_tree.Block.read(vp_tree.Block.build([[i] for i in range(4000)], np.arange(4000) % 3, x, m2).row())
    points, firsts = vp_tree.augmented(block.x, m2), np.searchsorted(block.owner, np.arange(4001))
    far = int((x * x).sum(axis=1).argmax())
    walk = vp_tree.Walk(block, points, firsts, x[far], m2)
    top = walk.nearest(5, 1, True, far, -np.inf, np.inf, -np.inf)
    score = x @ x[far]
    assert top == sorted(((int(score[i]), i) for i in range(4000) if i % 3 == 1 and i != far), key=lambda t: (-t[0], t[1]))[:5]
    buckets = (block.nodes[:, 3] < 0).sum()
    assert len(walk.scores) < buckets / 2


def test_windows_of_zero_and_negative_scores(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [-1.0, 0.0], 2), (2, [-0.9, 0.0], 3), (100, [0.0, 1.0], 5), (3, [1.0, 0.0], 5), (4, [2.0, 0.0], 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert sorted(tuple(r) for r in vp_tree.hard_negatives(df).collect()) == brute(rows)


def test_empty(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vp_tree.hard_negatives(spark.createDataFrame([], schema)).collect() == []
    assert vp_tree.hard_negatives(spark.createDataFrame([(1, None, 1)], schema)).collect() == []
    assert vp_tree.hard_negatives(spark.createDataFrame([(1, [1.0], 1)], schema)).collect() == []
