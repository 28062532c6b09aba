"""Metrics, thresholds, the binomial bound, uncertainty and routing against known values and plain models."""

import math
import random

import pytest
from pyspark.sql import functions as F

from termweave.operators import evaluation, policy


def preds(spark, rows):
    return spark.createDataFrame(rows, "confidence double, correct int")


def test_threshold_goldens(spark):
    p = preds(spark, [(0.9, 1), (0.8, 1), (0.7, 0)])
    assert evaluation.threshold_max_coverage(p, 1.0).first().threshold == 0.8
    assert evaluation.threshold_max_coverage(preds(spark, [(0.9, 0)]), 0.5).count() == 0
    val, test = preds(spark, [(0.95, 1), (0.85, 1), (0.60, 0)]), preds(spark, [(0.90, 1), (0.80, 0), (0.70, 1)])
    row = evaluation.policy_stress(val, test, (0.95,)).first()
    assert (row.threshold, row.test_n_auto, row.test_accuracy, row.target_met) == (0.85, 1, 1.0, True)


def test_curve_equals_a_scan(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, float("nan"), round(rng.random(), 2), rng.random() * 3 - 1]), rng.choice([0, 1, None])) for _ in range(400)]
    got = {r.threshold: (r.n_auto, r.n_correct) for r in evaluation.coverage_curve(preds(spark, rows)).collect()}
    known = [(c, k or 0) for c, k in rows if c is not None and not math.isnan(c)]
    assert got == {t: (sum(c >= t for c, _ in known), sum(k for c, k in known if c >= t)) for t, _ in known}


def test_diagnostics_golden(spark):
    rows = [("A", "A", ["A", "B"]), ("C", "B", ["B", "C"]), ("D", "B", ["B", "C"])]
    p = spark.createDataFrame(rows, "gold_code string, predicted_code string, codes array<string>")
    d = evaluation.diagnostics(p, spark.createDataFrame([("A",), ("C",)], "code string"))
    assert {r.gold_code: (r.error_type, r.gold_candidate_rank, r.code_novelty) for r in d.collect()} == {"A": ("correct", 1, "seen_code"), "C": ("ranking_failure", 2, "seen_code"), "D": ("candidate_generation_failure", None, "unseen_code")}
    s = {r.subgroup: r for r in evaluation.subgroup_metrics(d.filter("code_novelty = 'seen_code'")).collect()}
    assert s["unseen_code"].n == 0 and s["unseen_code"].acc_at_1 is None and s["all"].n == 2
    f = {(r.subgroup, r.error_type): (r.n, r.rate) for r in evaluation.failure_summary(d).collect()}
    assert len(f) == 9 and f["unseen_code", "correct"] == (0, 0.0)


def test_multilabel_golden(spark):
    s = "record_id string, gold array<string>, candidates array<struct<code:string,score:double>>"
    p = spark.createDataFrame([("1", ["A", "B"], [("A", 0.9), ("X", 0.8), ("B", 0.7)]), ("2", ["C"], [("C", 0.85), ("Y", 0.6)])], s)
    t = evaluation.threshold_max_recall(p, 0.95).first()
    assert t.threshold == 0.85 and t.n_proposals == 2 and t.precision == 1.0
    m = evaluation.threshold_metrics(p, 0.85).first()
    assert (m.micro_precision, m.n_proposals) == (1.0, 2)
    e = evaluation.threshold_metrics(spark.createDataFrame([("1", [], [])], s), 0.5).first()
    assert (e.exact_match, e.macro_f1) == (1.0, 0.0)
    dup = spark.createDataFrame([("1", ["A"], [("A", 0.9), ("A", 0.8)])], s)
    assert evaluation.threshold_metrics(dup, 0.5).first().n_proposals == 1


def test_json_is_read_with_tolerance(spark):
    df = spark.createDataFrame([('[{"code":"A"},{"code":"B"}]',), ('["A"]',), ("nonsense",), (None,)], "j string")
    assert [r[0] for r in df.select(evaluation.candidate_codes("j")).collect()] == [["A", "B"], ["A"], [], []]


def test_lower_bound_goldens():
    assert policy.lower_bound(0, 20) == 0 and policy.lower_bound(100, 100) > 0.95 and policy.lower_bound(95, 100) < 0.95
    assert policy.lower_bound(1, 0) is None
    for s, n, b in ((733, 760, 0.95134), (466, 482, 0.95002), (379, 381, 0.98357), (474, 475, 0.99005)):
        assert policy.lower_bound(s, n) == pytest.approx(b, abs=1e-5)


def test_tail_and_policy(spark):
    df = spark.createDataFrame([(95200, 100000), (20, 20), (0, 5)], "s long, n long")
    got = [r[0] for r in df.select(policy.binomial_tail(F.col("s"), F.col("n"), 0.95)).collect()]
    assert got[0] == pytest.approx(0.0018013236699, abs=1e-10) and got[1] == pytest.approx(0.95**20) and got[2] == 1.0
    p = preds(spark, [(1 - i / 1000, 1 if i < 90 else i % 2) for i in range(200)])
    row = policy.threshold_by_lower_bound(p, 0.95, 0.05, 20).first()
    assert row.lower_bound >= 0.95 - 1e-9 and row.n_auto >= 90
    n = max(k for k in range(20, 201) if policy.lower_bound(min(k, 90) + sum(i % 2 for i in range(90, k)), k) >= 0.95)
    assert row.n_auto == n
    assert policy.threshold_by_lower_bound(preds(spark, [(0.5, 1)] * 5), 0.95).count() == 0
    assert policy.apply_threshold(p, None).first().n_auto == 0


def test_uncertainty_and_routes(spark):
    df = spark.createDataFrame([([0.9, 0.3],), ([0.5],), ([],), ([0.4, 0.4],)], "s array<double>")
    a, b, c, d = (r.u for r in df.select(policy.uncertainty("s").alias("u")).collect())
    assert a.score_margin == pytest.approx(0.6) and 0 < a.normalised_entropy < 1
    assert (b.score_margin, b.normalised_entropy) == (0.5, 0.0)
    assert c.top_score is None and c.score_margin is None and c.normalised_entropy is None
    assert d.normalised_entropy == pytest.approx(1.0)
    r = spark.createDataFrame([(0.9, "PASS", False), (0.6, "", False), (0.2, "", False), (0.9, "FAIL", False), (0.9, "", True)], "c double, g string, o boolean")
    routes = [x[0] for x in r.select(policy.route(F.col("c"), F.lit(0.2), F.lit(0.6), F.col("g"), F.col("o"))).collect()]
    assert routes == ["AUTO_CANDIDATE", "TOP_K_HUMAN_CHOICE", "FULL_EXPERT_REVIEW", "FULL_EXPERT_REVIEW", "FULL_EXPERT_REVIEW"]
    assert r.limit(1).select(policy.route(F.lit(0.9), F.lit(0.9), F.lit(0.6), max_entropy=0.5)).first()[0] == "TOP_K_HUMAN_CHOICE"
    assert [x[0] for x in df.select(policy.ood_flag(F.array_max("s"), F.lit(0.0), F.lit(0.0))).collect()] == [True] * 4
