"""The sweep over interval ends against sets of characters, over tile borders, with repeats and one key that has most intervals."""

import random

from pyspark.sql import functions as F

from termweave.operators import spans

DDL = "record_id string, code string, s int, e int"


def characters(rows, key):
    return {x for r in rows if r[:2] == key for x in range(r[2], r[3])}


def test_sweep_equals_sets(spark, monkeypatch):
    rng = random.Random(8)
    mk = lambda n: [(str(rng.randint(0, 12)), rng.choice("AB"), a := rng.randint(0, 60), a + rng.randint(-2, 25)) for _ in range(n)]
    a, b = mk(300), mk(260)
    a += a[:40] + [("long", "A", 0, 30_000), ("only", "A", 5, 9), ("touch", "A", 0, 5), ("touch", "A", 5, 8)]
    b += [("long", "A", 4000, 4100), ("long", "A", 4090, 9000), ("empty", "B", 7, 7), ("touch", "A", 5, 6)]
    keys = {r[:2] for r in a + b}
    want = {k: (len(x), len(y), len(x & y)) for k in keys if (x := characters(a, k)) | (y := characters(b, k))}
    for tile in (4096, 7, 1):
        if tile < 4096:
            a2, b2 = [r for r in a if r[0] != "long"], [r for r in b if r[0] != "long"]
        else:
            a2, b2 = a, b
        monkeypatch.setattr(spans, "TILE", tile)
        got = {(r.record_id, r.code): (r.covered_a, r.covered_b, r.overlap) for r in spans.covered(spark.createDataFrame(a2, DDL), spark.createDataFrame(b2, DDL), "record_id", "code").collect()}
        assert got == {k: v for k, v in want.items() if tile == 4096 or k[0] != "long"}


def test_one_key_with_many_intervals(spark):
    """30,000 intervals a side under one key: rows stay in proportion to them, where pairs of overlapping ones would be 10^8."""
    base = spark.range(30_000).select(F.lit("hot").alias("record_id"), F.lit("A").alias("code"))
    a = spark.range(30_000).select(F.lit("hot").alias("record_id"), F.lit("A").alias("code"), (F.col("id") % 1000).cast("int").alias("s"), F.lit(20_000).alias("e"))
    b = spark.range(30_000).select(F.lit("hot").alias("record_id"), F.lit("A").alias("code"), F.lit(500).alias("s"), (10_000 + F.col("id") % 5000).cast("int").alias("e"))
    r = spans.covered(a, b, "record_id", "code").first()
    assert (r.covered_a, r.covered_b, r.overlap) == (20_000, 14_999 - 500, 14_999 - 500)
    m = spans.rationale_agreement(a, b).first()
    assert (m.char_recall, m.any_overlap, base.count()) == (1.0, True, 30_000)
    assert spans.covered(a.limit(0), b.limit(0), "record_id", "code").count() == 0
