"""Operator 11 against plain Python over all pairs, in one block and in many, with every odd row."""

import math
import os
import random

import numpy as np
import pytest

from termweave.llm import hardnegatives


@pytest.fixture(scope="module", autouse=True)
def workers_find_the_package():
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [os.getcwd(), os.environ.get("PYTHONPATH")]))


DDL = "vec_id long, label int, embedding array<double>, rank string, nth string, score string, key string, low string, anchor_id string"


def table(spark, rows):
    return spark.createDataFrame([(*r, *"abcdef") for r in rows], DDL)


def plain(rows, anchors, positives=5, negatives=3, low=50, high=95):
    fine = lambda r: r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])
    whole = lambda v: [int(x) * 256 if abs(x) >= 2.0**53 else math.floor(256 * x) for x in v]
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    own = [(i, y, whole(v)) for i, y, v in filter(fine, rows)]
    first = {}
    for r in sorted(filter(fine, anchors)):
        first.setdefault(r[0], (r[1], whole(r[2])))
    out = []
    for key, (label, q) in first.items():
        scored = sorted((-score(v, q), i, y) for i, y, v in own)
        for s, i, _ in [r for r in scored if r[2] == label and r[1] != key][:positives]:
            some = [r for r in scored if r[2] != label and low * -s <= 100 * -r[0] <= high * -s][:negatives]
            out += [(key, i, n + 1, j, -s, -t) for n, (t, j, _) in enumerate(some)]
    return sorted(out)


def run(spark, rows, anchors, **how):
    got = hardnegatives.mined(table(spark, rows), table(spark, anchors), **how)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def vectors(n, d, seed, labels=4):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(labels, d))
    y = np.where(rng.random(n) < 0.34, 0, rng.integers(0, labels, n))  # one label in a third of all rows and more
    x = (centre[y] * 0.4 + rng.normal(size=(n, d))).astype(np.float32).astype(float)
    return [(i, int(y[i]), x[i].tolist()) for i in range(n)]


def test_blocks_and_trees_find_what_all_pairs_do(spark):
    rows = vectors(1500, 8, 1)
    rows += [(3000 + i, 0, rows[0][2]) for i in range(700)]  # one large group of equal vectors: every distance ties
    rows += [(4000 + i, 100 + i, rows[i][2]) for i in range(90)]  # rare labels
    anchors = [r for r in rows if r[0] % 50 == 0]
    expected = plain(rows, anchors)
    assert len(expected) > 100
    assert run(spark, rows, anchors) == expected
    assert run(spark, rows, anchors, most=8 * 300) == expected  # blocks of 300 rows


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 0, [1.0, 0.5]), (2, 0, [1.0, 0.5]), (2, 0, [1.0, 0.5]), (3, 1, [0.7, 0.2]), (3, 1, [0.7, 0.2]), (4, 1, [0.0, 0.0]), (5, 1, []), (6, 1, [0.8]), (7, 1, [0.5, 0.5, 9.0])]
    rows += [(None, 0, [1.0, 1.0]), (8, None, [1.0, 1.0]), (9, 0, None), (10, 1, [nan, 1.0]), (11, 1, [inf, 1.0]), (12, 1, [None, 1.0]), (13, 0, [-1.0, -1.0]), (1, 1, [0.9, 0.1]), (14, 2, [0.9, 0.3])]
    assert run(spark, rows, rows) == plain(rows, rows)
    assert run(spark, rows, [(99, 0, [0.0, 0.0]), (98, 7, [1.0, 1.0])]) == plain(rows, [(99, 0, [0.0, 0.0]), (98, 7, [1.0, 1.0])])  # zero scores; no positives
    assert run(spark, [], []) == [] and run(spark, rows, []) == [] and run(spark, [], rows) == []


def test_large_components(spark):
    rng = random.Random(3)
    rows = [(i, i % 2, [rng.uniform(0.5, 1) * 2.0**20, rng.uniform(-1, 1) * 2.0**19]) for i in range(400)]
    assert run(spark, rows, rows[:20]) == plain(rows, rows[:20])
    huge = [(i, i % 2, [1e308 * (1 + i / 40), -1e300]) for i in range(8)]  # scores beyond 64 bits
    got = run(spark, huge, huge[:1])
    assert all(r[4] == r[5] == 2**63 - 1 for r in got)


def test_a_search_looks_at_a_part_of_a_tree():
    """Rows on a line: the annulus leaves few leaves, and the k rows end the search."""
    x = np.arange(20_000)[:, None] * np.ones((1, 1), np.int64)
    ids, labels = np.arange(20_000), np.zeros(20_000, np.int64)
    forest = hardnegatives.Forest(ids, labels, x, leaf=64)
    looked = set()
    nodes = forest.nodes

    class Counting(list):
        def __getitem__(self, at):
            looked.add(at)
            return super().__getitem__(at)

    forest.nodes = Counting(nodes)
    assert forest.search(np.array([3]), 1, -1, False, [(3 * 5000, 3 * 9000)], 3) == [[(27000, 9000), (26997, 8999), (26994, 8998)]]
    assert len(looked) < len(nodes) / 5
