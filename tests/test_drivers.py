"""Drivers around a run: notes explained in full, bundles over tables, the registry, fetched tables, frozen configurations, charts."""

import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from termweave import __main__ as cli
from termweave.operators import contracts, evaluation, review
from termweave.plans import benchmark, jobs
from termweave.sources import records

KNOWN = "code string, term string, synonyms string, row_seq long"


def notes(spark):
    rows = [
        ("tr1", "s1", "NSTEMI myocardial infarction and coronary atherosclerosis", ["I214", "I251"], "train"), ("tr2", "s2", "pneumonia treated with antibiotics", ["J189"], "train"), ("tr3", "s3", "heart failure with dyspnea", ["I509"], "train"),
        ("v1", "s5", "non ST elevation myocardial infarction", ["I214"], "val"), ("v2", "s6", "pneumonia and heart failure", ["J189", "I509"], "val"),
        ("te1", "s7", "NSTEMI with coronary atherosclerotic disease. Stays in care.", ["I214", "I251"], "test"), ("te2", "s8", "No pneumonia was seen", ["I509"], "test"),
    ]
    rec = spark.createDataFrame(rows, "record_id string, subject_id string, text string, gold_codes array<string>, split string")
    terms = spark.createDataFrame([("I214", "Myocardial infarction", "NSTEMI|myocardial infarction", 0), ("I251", "Atherosclerotic heart disease", "coronary atherosclerosis|coronary disease", 1), ("J189", "Pneumonia", "pneumonia", 2), ("I509", "Heart failure", "heart failure", 3)], KNOWN)
    return rec, records.terminology(terms.withColumn("system", F.lit("ICD-10")))


def test_notes_are_explained_with_context_model_gate_and_manifest(spark, tmp_path):
    rec, terms = notes(spark)
    out = str(tmp_path / "run")
    benchmark.multi_label(rec, terms, out, target=0.8, real_data=False)

    def model(row):
        return {"code": row["predicted_code"], "rationale": f"Words for {row['predicted_code']}.", "evidence_quotes": json.loads(row["evidence_quotes"])[:1]}

    m = jobs.explain_multilabel(rec, terms, out, fallback=2, model=model, allow=True, classification="public")
    rows = {(r.record_id, r.predicted_code): r for r in spark.read.parquet(f"{out}/explainability/explanations.parquet").collect()}
    assert m["n"] == len(rows) == m["n_code_proposals_explained"] and m["explanation_unit"] == "record_code_pair"
    bad = rows["te2", "J189"]  # "No pneumonia was seen" supports nothing
    assert (bad.quality_gate, bad.decision, bad.decision_before_gate, bad.context_review_required, bad.explanation_source) == ("FAIL", "HUMAN_REVIEW", "HUMAN_REVIEW", True, "grounded_deterministic")
    good = rows["te1", "I251"]
    assert (good.quality_gate, good.decision, good.explanation_source, good.why) == ("WARN", "CODE_PROPOSAL", "llm_validated", "Words for I251.")
    assert [x.case_text for x in good.historical_support] == ["NSTEMI myocardial infarction and coronary atherosclerosis"]
    q = m["quality_gate"]
    assert q["n"] == len(rows) and q["fail_rate"] > 0 and contracts.read_json(spark, f"{out}/explainability/explanation_quality.json") == q
    manifest = contracts.read_json(spark, f"{out}/explainability/explainability_manifest.json")
    assert manifest["external_model_requested"] and manifest["explanation_quality_gate"] == "conservative_downgrade_only" and manifest["data_classification"] == "public"
    assert spark.read.option("header", True).csv(f"{out}/explainability/explanation_quality_cases.csv").count() == len(rows)
    rec.write.parquet(str(tmp_path / "notes"))
    (tmp_path / "terms.csv").write_text("code,term,synonyms,system\nI214,Myocardial infarction,NSTEMI|myocardial infarction,ICD-10\nJ189,Pneumonia,pneumonia,ICD-10\n")
    assert cli.main(["explain-notes", "--notes", str(tmp_path / "notes"), "--terminology", str(tmp_path / "terms.csv"), "--run", out]) == 0


def test_a_bundle_covers_the_predictions(spark, tmp_path):
    run = str(tmp_path / "run")
    for n in ("metrics", "frozen_policy", "results_contract", "experiment_manifest"):
        contracts.write_json(spark, f"{run}/{n}.json", {"n": n})
    assert jobs.audit_bundle(spark, run, "1") == ["missing_artifact:predictions"]
    spark.range(50).repartition(3).write.parquet(f"{run}/predictions.parquet")
    assert jobs.audit_bundle(spark, run, "1") == []
    bundle = contracts.read_json(spark, f"{run}/audit_bundle.json")
    assert bundle["files"]["predictions"]["sha256"] and review.bundle_errors(spark, bundle) == []
    spark.range(51).write.mode("overwrite").parquet(f"{run}/predictions.parquet")
    assert review.bundle_errors(spark, bundle) == ["artifact_hash_mismatch:predictions"]


def test_runs_that_register_at_once_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "registry")
    with ThreadPoolExecutor(8) as pool:
        ids = list(pool.map(lambda i: contracts.register(spark, path, {"x": i % 5}, f"t{i:02d}"), range(40)))
    assert contracts.registered(spark, path).count() == 40 and len(set(ids)) == 5


def test_fetched_tables(spark, tmp_path):
    asked = []

    def fetch(name):
        asked.append(name)
        return b"instance_id\tphrase\n007\tred rash\n"

    names = ["readme.md", "data/other.csv.gz", "data/corpus.tsv"]
    for _ in range(2):
        rows = records.fetched_table(spark, names, "corpus", fetch, str(tmp_path)).collect()
        assert [(r.instance_id, r.phrase) for r in rows] == [("007", "red rash")]
    assert asked == ["data/corpus.tsv"]
    with pytest.raises(ValueError):
        records.fetched_table(spark, ["readme.md"], "corpus", fetch, str(tmp_path))


def test_frozen_configurations(spark, tmp_path):
    contracts.write_json(spark, str(tmp_path / "a.json"), {"selected_v2": {"history_weight": "0.25", "word_weight": 0.15, "more": 1}})
    assert benchmark.frozen_config(spark, str(tmp_path / "a.json")) == {"history_weight": 0.25, "word_weight": 0.15}
    contracts.write_json(spark, str(tmp_path / "b.json"), {"history_weight": 0.5})
    for name in ("b", "none"):
        with pytest.raises(KeyError):
            benchmark.frozen_config(spark, str(tmp_path / f"{name}.json"))


def test_uncoded_records_by_the_model_that_the_policy_names(spark):
    terms = spark.createDataFrame([("A", "muscle pain", 0), ("B", "skin rash", 1)], "code string, term string, row_seq long")
    history = spark.createDataFrame([("ache", "ache", "A", 0)], "text string, mention string, gold_code string, row_seq long")
    new = spark.createDataFrame([("1", "rash", "")], "record_id string, text string, mention string")
    encode = lambda texts: [[1.0, 0.0] if "muscle" in t or "rash" == t else [0.0, 1.0] for t in texts]
    frozen = {"model_type": "advanced_singlelabel", "history_weight": 0.0, "dense_weight": 1.0, "dense_model_name": "enc", "decision_threshold": 0.9}
    r = benchmark.predict_uncoded(history, terms, new, frozen, trained={"enc": encode}).first()
    assert (r.predicted_code, r.decision) == ("A", "AUTO_CANDIDATE")  # the vectors say A, the words B
    assert benchmark.predict_uncoded(history, terms, new, {"history_weight": 0.0}).first().predicted_code == "B"
    with pytest.raises(KeyError):
        benchmark.predict_uncoded(history, terms, new, frozen)


def test_charts_and_lookups(spark):
    df = spark.createDataFrame([(i / 500, int(i > 250)) for i in range(500)], "confidence double, correct int")
    points = evaluation.curve_points(evaluation.coverage_curve(df), 20)
    assert len(points) <= 21 and points[-1] == (1.0, pytest.approx(249 / 500)) and points[0][1] == 1.0
    page = contracts.html_report("T", {}, {"Curve <x>": points})
    assert page.count("<svg") == 1 and "Curve &lt;x&gt;" in page and "polyline" in page
    table = spark.createDataFrame([("all", 0.5), ("none", None)], "subgroup string, acc double")
    assert [evaluation.metric_for(table, s, m) for s, m in (("all", "acc"), ("none", "acc"), ("gone", "acc"), ("all", "other"))] == [0.5, None, None, None]


def test_evaluation_with_one_term_for_each_code(spark, tmp_path):
    words = {"A": "muscle pain ache legs", "B": "red skin rash itchy", "C": "nausea sick stomach vomit"}
    rows = [(str(i), f"{words['ABC'[i % 3]].split()[i % 4]} {words['ABC'[i % 3]].split()[(i + 1) % 4]}", "", "ABC"[i % 3], i, "train" if i < 30 else "val" if i < 45 else "test") for i in range(60)]
    rec = spark.createDataFrame([(a, b, b, d, e, f) for a, b, _, d, e, f in rows], "record_id string, text string, mention string, gold_code string, row_seq long, split string")
    r = jobs.real_evaluation(rec, out=str(tmp_path), target=0.5, weights=(0.0, 0.5), k=3)
    assert r["retrieval"]["n"] == 15 and "word_weight" not in r["frozen"] and r["frozen"]["history_weight"] == r["selection"][0]["history_weight"]
    assert contracts.read_json(spark, f"{tmp_path}/end_to_end_results.json")["selection"] == r["selection"]
