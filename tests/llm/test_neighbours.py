"""Operator 6 on lengths that mix, components of any size, ids that repeat and one row that every query finds."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from termweave.llm import neighbours


@pytest.fixture(scope="module", autouse=True)
def workers_find_the_package():
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [os.getcwd(), os.environ.get("PYTHONPATH")]))


def plain(x, ids, query, k):
    d = np.sqrt(((x - query[1]) ** 2).sum(1))
    order = sorted((float(a), int(i)) for a, i in zip(d, ids, strict=True) if i != query[0])
    return [i for _, i in order[:k]]


def test_length_is_that_of_the_table(spark):
    """Most queries have another length than the table: they take no part, and the others are answered."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows[0], rows[100] = (0, [1.0] * 4), (100, [2.0] * 4)
    vec = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(vec, vec.filter("vec_id % 100 = 0"), 5).toPandas()
    assert got["query_id"].unique().tolist() == [200]
    ids = [i for i in range(300) if i not in (0, 100)]
    assert got.sort_values("rank")["vec_id"].tolist() == plain(x[ids], ids, (200, x[200]), 5)


@pytest.mark.parametrize("scale", [1e-120, 1.0, 1e150])
def test_components_of_any_size(spark, scale):
    x = np.random.default_rng(2).normal(size=(400, 6)) * scale
    vec = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(vec, vec.filter("vec_id % 100 = 0"), 5)
    hits = sum(len(set(rows["vec_id"]) & set(plain(x / scale, range(400), (q, x[q] / scale), 5))) for q, rows in got.toPandas().groupby("query_id"))
    assert hits >= 19  # recall of at least 0.95 at every scale


def test_a_row_that_every_query_finds(spark, monkeypatch):
    """20,000 pairs of one row are dealt out among its copies; every pair is measured once."""
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (2, [0.0, 3.0])], "vec_id long, embedding array<double>")
    asked = spark.range(10, 20_010).select(F.col("id").alias("vec_id"), F.array(F.lit(0.0), F.lit(0.0)).alias("embedding"))
    found = asked.select(F.col("vec_id").alias("query_id"), F.lit(1).cast("long").alias("vec_id")).unionByName(asked.limit(5).select(F.col("vec_id").alias("query_id"), F.lit(2).cast("long").alias("vec_id")))
    got = neighbours.exact(found, rows, asked)
    assert sorted(map(tuple, got.groupBy("vec_id", "score").count().collect())) == [(1, 1.0, 20_000), (2, 2.0, 5), (2, 3.0, 5)]


def test_repeated_query_ids_are_the_least_vector(spark):
    vec = spark.createDataFrame([(0, [2.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [2.0, 1.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in neighbours.nearest(vec, vec.filter("vec_id = 0"), 5).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, pytest.approx(2**0.5))]


@pytest.mark.parametrize("kind", ["tight clusters", "far from the origin", "many sizes"])
@pytest.mark.parametrize("most", [None, 20_000])
def test_nearest_whatever_the_vectors_are_like(spark, kind, most):
    """Differences far below what codewords tell apart: all of the nearest are found, in one block of the index or in many."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 12))
    if kind == "tight clusters":
        x = rng.normal(size=(3, 12))[rng.integers(0, 3, 1500)] + 1e-9 * x
    elif kind == "far from the origin":
        x = 1e6 + x
    else:
        x = x * 10.0 ** rng.uniform(-6, 6, (1500, 1))
    vec = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(vec, vec.filter("vec_id % 100 = 0"), 10, most=most).toPandas().sort_values("rank")
    assert {q: rows["vec_id"].tolist() for q, rows in got.groupby("query_id")} == {q: plain(x, range(1500), (q, x[q]), 10) for q in range(0, 1500, 100)}
