"""The benchmark drivers end to end on small inputs."""

import json

from pyspark.sql import functions as F

from termweave import __main__ as cli
from termweave.plans import benchmark, frames
from termweave.operators import retrieval

SF = "/root/testdata/sf0.001"


def test_single_label(spark, tmp_path):
    rec, terms = frames.part_records(spark, SF), frames.part_terms(spark, SF)
    r = benchmark.single_label(rec, terms, str(tmp_path / "out"), target=0.5, weights=(0.0, 0.5))
    assert r["leaks"] == {"train-val": 0, "train-test": 0, "val-test": 0}
    assert r["selection"][0]["accuracy_at_1"] >= r["selection"][1]["accuracy_at_1"]
    assert r["contract"]["status"] == "reportable" and r["test"]["recall_at_10"] >= r["test"]["acc_at_1"] > 0.5
    assert json.loads((tmp_path / "out/frozen_policy.json").read_text())["history_weight"] in (0.0, 0.5)
    p = benchmark.predict_uncoded(rec.filter("split = 'train'"), terms, rec.filter("split = 'test'").limit(3), r["policy"])
    assert p.count() == 3


def test_confirmed_policy_uses_fresh_rows(spark):
    rec, terms = frames.part_records(spark, SF).cache(), frames.part_terms(spark, SF)
    c = retrieval.HistoricalCoder(0.25, 5).fit(rec.filter("split = 'train'"), terms)
    r = benchmark.confirmed_policy(c, rec, rec.filter("split = 'train'"), 25, target=0.3, k=5, min_auto=5)
    assert r["release_eligible"] == (r["confirmation"]["accuracy"] >= 0.3) and r["confirmation"]["total_n"] == 25


def test_multi_label(spark):
    rows = [(str(i), str(i), f"red rash {i % 3} fever" if i % 2 else f"blue cough {i % 3} cold", ["A", "C"] if i % 2 else ["B"], "train" if i < 20 else "val" if i < 30 else "test") for i in range(40)]
    rec = spark.createDataFrame(rows, "record_id string, subject_id string, text string, gold_codes array<string>, split string")
    terms = spark.createDataFrame([("A", "x", 0), ("B", "y", 1), ("C", "z", 2)], "code string, term string, row_seq long")
    r = benchmark.multi_label(rec, terms, k=2, weights=(0.0, 1.0))
    assert r["policy"]["history_weight"] == 1.0 and r["test"]["recall_at_10"] == 1.0
    assert r["proposals"]["micro_precision"] >= 0.9


def test_cli(spark, tmp_path):
    (tmp_path / "r.csv").write_text("record_id,text,gold_code,annotation_id,offset_match,is_discontinuous\n" + "".join(f"{i},pain {i},A,T1,True,False\n" for i in range(9)))
    (tmp_path / "t.csv").write_text("code,term\nA,pain\nB,rash\n")
    assert cli.main(["split", "--records", str(tmp_path / "r.csv"), "--out", str(tmp_path / "s")]) == 0
    assert spark.read.parquet(str(tmp_path / "s")).count() == 9
    assert cli.main(["audit", "--records", str(tmp_path / "r.csv"), "--terminology", str(tmp_path / "t.csv")]) == 0
    (tmp_path / "p.json").write_text('{"history_weight": 0.5, "decision_threshold": 0.2}')
    assert cli.main(["predict", "--history", str(tmp_path / "r.csv"), "--terminology", str(tmp_path / "t.csv"), "--new", str(tmp_path / "r.csv"), "--policy", str(tmp_path / "p.json"), "--out", str(tmp_path / "p")]) == 0
    assert spark.read.parquet(str(tmp_path / "p")).filter(F.col("predicted_code") == "A").count() == 9
