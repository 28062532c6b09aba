"""Bootstrap, calibration, coder agreement, hierarchies and label conflicts against values worked out by hand or in plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from termweave.operators import agreement, reliability

# ---- bootstrap


def weight(key: int, replicate: int) -> int:
    """The mixed hash and the Poisson quantile, one step at a time."""
    m = (1 << 64) - 1
    x = (key + replicate * reliability.GOLDEN) & m
    x = ((x ^ x >> 30) * reliability.MIX1) & m
    x = ((x ^ x >> 27) * reliability.MIX2) & m
    u = ((x ^ x >> 31) >> 11) / 2**53
    k, p, total = 0, math.exp(-1), math.exp(-1)
    while u >= total and k < 18:
        k += 1
        p /= k
        total += p
    return k


def test_weights_are_poisson_and_equal_the_model():
    keys = np.array([0, 1, 12345, 2**59 + 7])
    w = reliability.poisson_weights(keys, 50)
    assert [[weight(int(k), b) for b in range(1, 51)] for k in keys] == w.tolist()
    many = reliability.poisson_weights(np.arange(20_000), 10)
    assert abs(many.mean() - 1) < 0.01 and abs(many.var() - 1) < 0.02


def test_intervals_over_documents(spark):
    """All rows of a document are drawn together: few documents of many rows have a wide interval."""
    rng = random.Random(1)
    rows = [(f"d{i % 20}", int(i % 20 < 10), rng.random() < 0.5) for i in range(2000)] + [(None, 1, True)]
    df = spark.createDataFrame(rows, "record_id string, correct int, even boolean").repartition(5)
    got = reliability.bootstrap_intervals(df, {"acc": (F.col("correct"), F.lit(1)), "none": (F.col("correct"), F.lit(None).cast("int"))}, replicates=300)
    r = {x.metric: x for x in got.collect()}
    key = lambda u: int(hashlib.sha256(f"42:{u or ''}".encode()).hexdigest()[:15], 16)
    docs = {u: (sum(c for v, c, _ in rows if v == u), sum(v == u for v, _, _ in rows)) for u in {v for v, _, _ in rows}}
    values = [sum(weight(key(u), b) * n for u, (n, _) in docs.items()) / sum(weight(key(u), b) * d for u, (_, d) in docs.items()) for b in range(1, 301)]
    assert r["acc"].estimate == pytest.approx(1001 / 2001)
    assert (r["acc"].low, r["acc"].high, r["acc"].spread) == (pytest.approx(np.quantile(values, 0.025)), pytest.approx(np.quantile(values, 0.975)), pytest.approx(np.std(values, ddof=1)))
    assert (r["none"].estimate, r["none"].low, r["none"].n_replicates) == (None, None, 0)
    # Rows drawn one by one would give an interval some ten times narrower
    single = reliability.bootstrap_intervals(df.withColumn("record_id", F.monotonically_increasing_id()), {"acc": (F.col("correct"), F.lit(1))}, replicates=300).first()
    assert (r["acc"].high - r["acc"].low) > 5 * (single.high - single.low)
    groups = reliability.bootstrap_intervals(df, {"acc": (F.col("correct"), F.lit(1))}, by="even", replicates=50).collect()
    assert sorted(x.group for x in groups) == ["false", "true"] and all(x.low <= x.estimate <= x.high for x in groups)
    assert reliability.bootstrap_intervals(df.limit(0), {"acc": (F.col("correct"), F.lit(1))}).count() == 0


# ---- calibration


PRED = "confidence double, correct int"


def test_calibration_by_hand(spark):
    rows = [(0.1, 0), (0.1, 1), (0.4, 0), (0.6, 1), (0.6, 1), (0.9, 1), (None, 1), (float("nan"), 0), (0.9, None)]
    df = spark.createDataFrame(rows, PRED)
    c = reliability.calibration(df, 2).first()
    assert (c.n, c.n_bins) == (7, 2)
    assert c.brier == pytest.approx((0.01 + 0.81 + 0.16 + 0.16 + 0.16 + 0.01 + 0.81) / 7)
    # Bins by the first record's place: 0.1 0.1 0.4 0.6 0.6 (places 0 to 4, the tie of 0.6 begins at 3 of 7) and 0.9 0.9
    bins = {r.bin: (r.n, r.ok, round(r.mean_confidence, 9)) for r in reliability.equal_mass_bins(df, 2).collect()}
    assert bins == {0: (5, 3, 0.36), 1: (2, 1, 0.9)}
    assert c.expected_calibration_error == pytest.approx((5 * abs(0.6 - 0.36) + 2 * abs(0.5 - 0.9)) / 7) and c.largest_calibration_error == pytest.approx(0.4)
    none = reliability.calibration(df.limit(0)).first()
    assert none.n == 0 and none.brier is None and none.expected_calibration_error is None


def test_ties_share_a_bin_and_a_hot_confidence_is_one(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0.5).otherwise((F.col("id") % 97) / 97.0).alias("confidence"), (F.col("id") % 2).cast("int").alias("correct"))
    rows = reliability.equal_mass_bins(df, 10).orderBy("bin").collect()
    assert sum(r.n for r in rows) == 3000
    assert all(a.greatest < b.least for a, b in zip(rows, rows[1:], strict=False))  # no confidence in two bins
    assert max(r.n for r in rows) >= 1000


def test_isotonic_equals_the_formula(spark):
    rng = random.Random(2)
    rows = [(round(rng.random(), 2), 0) for _ in range(150)]
    rows = [(c, int(rng.random() < c * c)) for c, _ in rows]
    df = spark.createDataFrame(rows, PRED)
    steps = reliability.isotonic(df, 10_000).orderBy("step").collect()
    per = sorted({c for c, _ in rows})
    n, ok = [sum(x == c for x, _ in rows) for c in per], [sum(y for x, y in rows if x == c) for c in per]
    fit = [max(min(sum(ok[a : b + 1]) / sum(n[a : b + 1]) for b in range(i, len(per))) for a in range(i + 1)) for i in range(len(per))]
    got = [next(s.calibrated for s in steps if s.least <= c <= s.greatest) for c in per]
    assert got == pytest.approx(fit) and all(a.calibrated < b.calibrated for a, b in zip(steps, steps[1:], strict=False))
    more = spark.createDataFrame([(0.5, 1), (-1.0, 0), (2.0, 1), (None, 1)], PRED)
    values = {r.confidence: r.calibrated for r in reliability.calibrated(more, reliability.isotonic(df, 10_000)).collect()}
    assert values[0.5] == pytest.approx(fit[max(i for i, c in enumerate(per) if c <= 0.5)]) and values[-1.0] == steps[0].calibrated and values[2.0] == steps[-1].calibrated and values[None] is None
    assert reliability.isotonic(df.limit(0)).count() == 0 and reliability.calibrated(more, reliability.isotonic(df.limit(0))).filter("calibrated is not null").count() == 0


# ---- double coding


RATE = "item string, rater string, code string"


def test_kappa_by_hand(spark):
    """The textbook table 20 5 / 10 15: observed 0.7, expected 0.5, kappa 0.4."""
    table = {("y", "y"): 20, ("y", "n"): 5, ("n", "y"): 10, ("n", "n"): 15}
    rows, i = [], 0
    for (a, b), k in table.items():
        for _ in range(k):
            rows += [(f"i{i}", "A", a), (f"i{i}", "B", b), (f"i{i}", "C", "z")]
            i += 1
    rows += [("x1", "A", "y"), ("x2", "B", None), (None, "A", "y"), ("i0", "A", "zz")]  # alone, missing, no item, a second rating (the smaller counts)
    df = spark.createDataFrame(rows, RATE)
    k = agreement.kappa(df, "A", "B").first()
    assert (k.n, k.observed, k.expected, k.kappa) == (50, pytest.approx(0.7), pytest.approx(0.5), pytest.approx(0.4))
    one = agreement.kappa(spark.createDataFrame([("i", "A", "y"), ("i", "B", "y")], RATE), "A", "B").first()
    assert (one.n, one.kappa) == (1, 1.0)
    none = agreement.kappa(df.limit(0), "A", "B").first()
    assert (none.n, none.kappa) == (0, None)


def test_alpha_by_the_published_example(spark):
    """Four observers, twelve units, missing values: nominal alpha 0.743 (Krippendorff, Computing alpha-reliability, example C)."""
    a = ["1 2 3 3 2 1 4 1 2 . . .", "1 2 3 3 2 2 4 1 2 5 . 3", ". 3 3 3 2 3 4 2 2 5 1 .", "1 2 3 3 2 4 4 1 2 5 1 ."]
    rows = [(str(u), str(r), v) for r, line in enumerate(a) for u, v in enumerate(line.split()) if v != "."]
    got = agreement.alpha(spark.createDataFrame(rows, RATE)).first()
    assert (got.n_items, got.n_ratings, round(got.alpha, 3)) == (11, 40, 0.743)
    same = agreement.alpha(spark.createDataFrame([("1", "a", "x"), ("1", "b", "x"), ("2", "a", "x")], RATE)).first()
    assert (same.n_items, same.alpha) == (1, 1.0)
    assert agreement.alpha(spark.createDataFrame([("1", "a", "x")], RATE)).first().alpha is None


def test_adjudication(spark):
    rows = [("1", "a", "x"), ("1", "b", "x"), ("1", "c", "y"), ("2", "a", "x"), ("2", "b", "y"), ("3", "a", "x"), ("3", "b", "x"), ("4", "a", "x")]
    got = {r.item: (r.n_ratings, r.n_codes, r.majority, round(r.share, 3), [tuple(c) for c in r.codes]) for r in agreement.adjudication(spark.createDataFrame(rows, RATE)).collect()}
    assert got == {"1": (3, 2, "x", 0.667, [("x", 2), ("y", 1)]), "2": (2, 2, None, 0.5, [("x", 1), ("y", 1)])}


def test_one_item_with_a_third_of_all_ratings(spark):
    """20,000 ratings of one item are counted by code, never paired."""
    df = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("item"), F.col("id").cast("string").alias("rater"), F.when(F.col("id") % 6 == 0, "x").otherwise("y").alias("code"))
    r = agreement.alpha(df).first()
    assert (r.n_items, r.n_ratings) == (1, 20_000)
    assert agreement.adjudication(df).first().codes[0].n == 10_000


# ---- hierarchies


def test_hierarchy_by_hand(spark):
    """root > a > a1, a2; root > b > b1 > b11, and c outside."""
    terms = spark.createDataFrame([("a1", "root > a > a1"), ("a2", "root > a"), ("b11", "root > b > b1 > b11"), ("root", ""), ("c", None)], "code string, hierarchy string")
    edges = agreement.path_edges(terms)
    assert sorted(map(tuple, edges.collect())) == sorted([("a", "root"), ("a1", "a"), ("a2", "a"), ("b", "root"), ("b1", "b"), ("b11", "b1")])
    up = {(r.code, r.ancestor): r.up for r in agreement.ancestors(edges).collect()}
    assert up["b11", "root"] == 3 and up["b11", "b11"] == 0 and up["a1", "root"] == 2 and ("a1", "b") not in up
    pairs = [("a1", "a1"), ("a1", "a2"), ("a1", "b11"), ("b11", "b"), ("c", "c"), ("c", "a1"), ("a1", None)]
    pred = spark.createDataFrame(pairs + [("a1", "a2")], "gold_code string, predicted_code string")
    got = {(r.gold_code, r.predicted_code): (r.common, r.common_depth, r.gold_depth, r.predicted_depth) for r in agreement.common_ancestors(pred, edges).collect()}
    assert got == {("a1", "a1"): ("a1", 2, 2, 2), ("a1", "a2"): ("a", 1, 2, 2), ("a1", "b11"): ("root", 0, 2, 3), ("b11", "b"): ("b", 1, 3, 1), ("c", "c"): ("c", 0, 0, 0), ("c", "a1"): (None, None, 0, 2)}
    levels = {r.level: (r.n, r.n_agree) for r in agreement.agreement_by_level(pred, edges).collect()}
    assert levels == {-1: (8, 2), 0: (8, 6), 1: (6, 4), 2: (6, 1), 3: (1, 0)}
    s = agreement.hierarchy_similarity(pred, edges).first()
    assert s.n == 8 and s.similarity == pytest.approx((1 + 2 * 2 * 2 / 6 + 2 * 1 / 7 + 2 * 2 / 6 + 1 + 0 + 0) / 8)


def test_cycles_and_depths(spark):
    edge = "code string, parent string"
    with pytest.raises(ValueError, match="cycle"):
        agreement.ancestors(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], edge))
    with pytest.raises(ValueError, match="cycle"):
        agreement.ancestors(spark.createDataFrame([("a", "a")], edge))
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(20)], edge)
    assert agreement.ancestors(chain).count() == 21 * 22 // 2
    with pytest.raises(ValueError, match="deeper"):
        agreement.ancestors(chain, 4)
    two = {(r.code, r.ancestor): r.up for r in agreement.ancestors(spark.createDataFrame([("x", "p"), ("x", "q"), ("q", "p"), (None, "p")], edge)).collect()}
    assert two["x", "p"] == 1  # the shortest way


# ---- label conflicts


def groups_of(rows):
    by = {}
    for s, c in rows:
        if s and s.strip(" ") and c is not None:
            by.setdefault(s.strip(" ").lower(), set()).add(c)
    codes = {c for cs in by.values() for c in cs}
    name = {c: c for c in codes}
    changed = True
    while changed:
        changed = False
        for cs in by.values():
            least = min(name[c] for c in cs)
            for c in cs:
                if name[c] != least:
                    name[c], changed = least, True
    return by, name


def test_conflicts_equal_brute_force(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["Pain", " pain ", "rash"]) + str(rng.randint(0, 90)), f"C{rng.randint(0, 60):02d}") for _ in range(220)]
    rows += [(f"link{i}", f"D{j:02d}") for i in range(30) for j in (i, i + 1)]  # a long chain
    rows += [("hot", "H1")] * 500 + [("hot", "H2")] * 499 + [(None, "X"), ("  ", "Y"), ("lone", None)]
    df = spark.createDataFrame(rows, "surface string, code string")
    by, name = groups_of(rows)
    assert {r.code: r.group for r in agreement.code_groups(df).collect()} == name
    got = {r.surface: (r.n_codes, r.majority) for r in agreement.conflicts(df).collect()}
    assert {s: n for s, (n, _) in got.items()} == {s: len(cs) for s, cs in by.items() if len(cs) > 1} and got["hot"] == (2, "H1")
    want = {}
    for s, cs in by.items():
        g = want.setdefault(name[min(cs)], [set(), 0, 0])
        g[0] |= cs
        g[1] += 1
        g[2] += len(cs) > 1
    assert {r.group: (r.n_codes, r.n_surfaces, r.n_conflicts) for r in agreement.conflict_groups(df).collect()} == {g: (len(c), s, k) for g, (c, s, k) in want.items() if len(c) > 1}
    assert agreement.code_groups(df.limit(0)).count() == 0


def test_wordings_of_a_code(spark):
    df = spark.createDataFrame([("Pain ", "A"), ("pain", "A"), ("ache", "A"), ("rash", "B"), ("", "B"), (None, "C")], "surface string, code string")
    got = {r.code: (r.n, r.n_surfaces, r.most_frequent, round(r.share, 3)) for r in agreement.wordings(df).collect()}
    assert got == {"A": (3, 2, "pain", 0.667), "B": (1, 1, "rash", 1.0)}


def test_coding_plan(spark):
    items = spark.range(3000).select(F.col("id").cast("string").alias("item")).union(spark.createDataFrame([("7",), (None,)], "item string"))
    plan = agreement.coding_plan(items, ["a", "b", "c", "d"], each=3)
    per = plan.groupBy("item").agg(F.count_distinct("rater").alias("k"), F.count(F.lit(1)).alias("n"))
    assert per.count() == 3000 and per.filter("k <> 3 or n <> 3").isEmpty()
    assert all(2000 < r["count"] < 2500 for r in plan.groupBy("rater").count().collect())
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(plan) == key(agreement.coding_plan(items.repartition(7), ["a", "b", "c", "d"], each=3))
    assert agreement.coding_plan(items, ["a", "b"], 50).select("item").distinct().count() == 50
    for bad in ((["a"], 2), (["a", "a"], 2), ([], 1)):
        with pytest.raises(ValueError):
            agreement.coding_plan(items, bad[0], each=bad[1])


def test_sensitivity_to_seen_subjects(spark):
    from termweave.operators import temporal

    ddl = "subject string, correct int"
    test = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1), (None, 1), (None, None)], ddl)
    got = {r.part: (r.n, r.n_subjects, r.accuracy) for r in temporal.sensitivity(test, spark.createDataFrame([("a", 1), (None, 1)], ddl), "subject").collect()}
    assert got == {"all": (5, 2, 0.6), "seen_subjects": (2, 1, 0.5), "unseen_subjects": (3, 1, pytest.approx(2 / 3))}
