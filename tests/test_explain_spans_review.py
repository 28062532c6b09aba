"""Spans and sentences against plain Python, assertion and gates, review and feedback, sources, contracts, streaming."""

import random
import re

import pytest
from pyspark.sql import functions as F

from termweave.functions import hashing, text
from termweave.operators import audits, contracts, explain, models, review
from termweave.operators import spans as intervals
from termweave.sources import records
from termweave.streaming import review as stream


def test_sentences_equal_the_model(spark):
    rng = random.Random(2)
    texts = ["abc\ndef.", "One. Two!? three", "a\r\nb.", "", "...", "no end\n", "  lead. é tail  "] + ["".join(rng.choice("ab .!?\n é") for _ in range(rng.randint(0, 60))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "record_id int, text string")
    got = sorted((r.record_id, r.start, r.end, r.quote) for r in explain.sentences(df).collect())
    want = []
    for i, t in enumerate(texts):
        for m in re.finditer(r"[^.!?\n]+(?:[.!?]+|$)", t):
            q = m.group().strip()
            if q:
                s = m.start() + len(m.group()) - len(m.group().lstrip())
                want.append((i, s, s + len(q), q))
    assert got == sorted(want)
    assert all(texts[i][s:e] == q for i, s, e, q in got)


def test_mention_span_and_scores(spark):
    rows = [("1", "I had Severe Muscle Pain today. The muscle hurt. Nothing else.", "severe muscle pain", "myalgia", "muscle|ache"), ("2", "Nothing here.", "", "fever", "")]
    df = spark.createDataFrame(rows, "record_id string, text string, mention string, term string, synonyms string")
    got = {r.record_id: r.spans for r in explain.evidence_spans(df).collect()}
    assert [(s.source, s.quote) for s in got["1"]] == [("explicit_mention", "Severe Muscle Pain"), ("supporting_sentence", "The muscle hurt.")]
    assert got["2"] == []


def test_assertions_and_context(spark):
    rows = [("No rash was reported.", "negated"), ("Possible pneumonia.", "uncertain"), ("Mother had no asthma", "family_history"), ("history of gout", "historical_or_resolved"), ("Pain in note", "affirmed"), (None, "affirmed")]
    df = spark.createDataFrame(rows, "t string, want string").withColumn("got", text.assertion("t"))
    assert all(r.got == r.want for r in df.collect())
    t = "First one. No rash here, said he\nnext line. end"
    got = spark.createDataFrame([(t, t.index("rash"), t.index("rash") + 4)], "t string, s int, e int").select(text.local_context("t", "s", "e")).first()[0]
    assert got == "No rash here, said he"


def test_context_audit_and_gate(spark):
    df = spark.createDataFrame([("1", "No rash. Fever is high.", "rash", "rash", ""), ("2", "Fever is high.", "fever", "fever", "")], "record_id string, text string, mention string, term string, synonyms string")
    e = df.join(explain.evidence_spans(df), "record_id").withColumn("decision", F.lit("AUTO_CANDIDATE")).withColumn("explanation_status", F.lit("grounded")).withColumn("why", F.lit("w.")).withColumn("comprehensiveness_drop", F.lit(0.5))
    rows = {r.record_id: r for r in explain.apply_quality_gate(explain.quality(explain.audit_context(e))).collect()}
    assert rows["1"].quality_gate == "FAIL" and rows["1"].decision == "HUMAN_REVIEW" and rows["1"].explanation_status == "insufficient_affirmed_evidence"
    assert rows["2"].quality_gate == "PASS" and rows["2"].decision == "AUTO_CANDIDATE"
    human = e.withColumn("decision", F.lit("HUMAN_REVIEW"))
    assert {r.decision for r in explain.apply_quality_gate(explain.quality(explain.audit_context(human))).collect()} == {"HUMAN_REVIEW"}  # never promoted


def test_interval_golden_and_random(spark):
    pred, ref = [("r", "A", 10, 20)], [("r", "A", 15, 25)]
    s = "record_id string, code string, s int, e int"
    row = intervals.rationale_agreement(spark.createDataFrame(pred, s), spark.createDataFrame(ref, s)).first()
    assert (row.char_precision, row.char_recall, row.char_f1) == (0.5, 0.5, 0.5)
    rng = random.Random(3)
    mk = lambda: [(str(rng.randint(0, 30)), "A", a := rng.randint(0, 60), a + rng.randint(-2, 9)) for _ in range(300)]
    a, b = mk(), mk()
    chars = lambda rows, k: {x for r in rows if r[0] == k for x in range(r[2], r[3])}
    m = lambda rows: intervals.merged(spark.createDataFrame(rows, s), "record_id")
    got = {r.record_id: r.overlap for r in intervals.overlap(m(a), m(b), "record_id").collect()}
    assert got == {k: n for k in map(str, range(31)) if (n := len(chars(a, k) & chars(b, k)))}


def test_masking_and_highlighting(spark):
    df = spark.createDataFrame([("a<b cd", [(2, 3), (4, 6)])], "t string, s array<struct<start:int,end:int>>")
    assert df.select(text.without_spans("t", "s"), explain.highlighted("t", "s")).first()[:] == ("a<    ", "a&lt;<mark>b</mark> <mark>cd</mark>")


def test_split_is_the_published_hash(spark):
    import hashlib

    df = spark.range(300).withColumn("u", hashing.unit(F.col("id"), 42)).withColumn("v", hashing.unit_unsalted(F.col("id")))
    for r in df.collect():
        assert r.u == int.from_bytes(hashlib.sha256(f"42:{r.id}".encode()).digest()[:8], "big") / 2**64
        assert r.v == int(hashlib.sha256(str(r.id).encode()).hexdigest()[:8], 16) / 0xFFFFFFFF
    with pytest.raises(ValueError):
        hashing.split_by_hash(F.col("id"), train=0.9, val=0.2)


def test_terminology_rules(spark):
    t = spark.createDataFrame([("A", "pain", "ache|sore", "X"), ("A", "other", "", "X"), ("B", "rash", "", "x")], "code string, term string, synonyms string, system string")
    got = {r.code: r.search_text for r in records.terminology(t, "x").collect()}
    assert got == {"A": "pain ache sore", "B": "rash"}
    with pytest.raises(ValueError):
        records.terminology(t, "nothing")
    with pytest.raises(ValueError):
        records.terminology(t.withColumn("system", F.col("code")))
    with pytest.raises(ValueError):
        records.records(t)
    with pytest.raises(ValueError):
        records.assert_group_disjoint(spark.createDataFrame([("s", "train"), ("s", "test")], "g string, split string"), "g")


def test_csv_keeps_zeros_and_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text('record_id,text,gold_code\n1,"x, y",007\n2,,008\n')
    rows = records.records(records.read_strings(spark, str(tmp_path / "a.csv"))).orderBy("row_seq").collect()
    assert [(r.text, r.mention, r.gold_code) for r in rows] == [("x, y", "", "007"), ("", "", "008")]


def test_standoff_annotations(spark, tmp_path):
    for d in ("text", "original", "meddra"):
        (tmp_path / d).mkdir()
    (tmp_path / "text/d1.txt").write_text("I had pain in both legs.")
    (tmp_path / "original/d1.ann").write_text("T2\tADE 6 10;19 23\tpain legs\n")
    (tmp_path / "meddra/d1.ann").write_text("N1\tReference T2 MedDRA:10000001\tpain\n")
    r = records.standoff_annotations(spark, str(tmp_path)).first()
    assert ([tuple(s) for s in r.spans], r.is_discontinuous, r.offset_match, r.gold_code) == ([(6, 10), (19, 23)], True, True, "10000001")
    assert records.parse_stats(spark, str(tmp_path)).first().unique_documents == 1


def test_standoff_lines_that_are_not_valid(spark, tmp_path):
    """A line without a valid span is dropped and replaces nothing; the first code of a line counts; repeats count once."""
    for d in ("text", "original", "meddra"):
        (tmp_path / d).mkdir()
    (tmp_path / "text/d1.txt").write_text("I had pain in both legs.")
    (tmp_path / "text/d2.txt").write_text("no annotations here")
    (tmp_path / "original/d1.ann").write_text("T1\tADE 6 10\tpain\nT2\tADE 600 700\tnowhere\nT3\tADE\tno spans\nT4\tADE 10 6;19 23\tlegs\n#1\tnote\n")
    (tmp_path / "meddra/d1.ann").write_text("T1\tADE 90 95\tgone\nN1\tReference T1 MedDRA:10000001 10000002\tpain\nN2\tReference T1 MedDRA:10000001\tpain\nN3\tReference T2 MedDRA:10000003\tx\nN4\tReference T4 meddra 10000004\tlegs\n")
    (tmp_path / "meddra/d9.ann").write_text("N1\tReference T1 MedDRA:10000001\tno text\n")
    got = {(r.annotation_id, r.gold_code): (r.mention, r.spans_json, r.start, r.end, r.offset_match, r.normalization_id) for r in records.standoff_annotations(spark, str(tmp_path)).collect()}
    assert got == {("T1", "10000001"): ("pain", "[[6,10]]", 6, 10, True, "N1"), ("T4", "10000004"): ("legs", "[[19,23]]", 19, 23, True, "N4")}
    s = records.parse_stats(spark, str(tmp_path)).first()
    assert (s.documents_seen, s.invalid_textbound, s.normalizations_seen, s.normalizations_matched, s.missing_target, s.duplicate_rows_removed, s.rows) == (2, 3, 4, 3, 1, 1, 2)
    assert s.match_rate == 0.75 and s.offset_match_rate == 1.0


def test_multilabel_preparation(spark):
    notes = spark.createDataFrame([("s1", "h1", "n1", "old", "1"), ("s1", "h1", "n2", "new", "2"), ("s2", "", "n3", "x", "1")], "subject_id string, hadm_id string, note_id string, text string, charttime string")
    dx = spark.createDataFrame([("h1", " B ", "10", 2), ("h1", "A", "10", 1), ("h1", "Z", "9", 3), ("h1", "A", "10", 4)], "hadm_id string, icd_code string, icd_version string, seq_num int")
    names = spark.createDataFrame([("A", "10", "a title"), ("B", "10", "b title")], "icd_code string, icd_version string, long_title string")
    r = records.multilabel_records(notes, dx, names).collect()
    assert len(r) == 1 and (r[0].text, r[0].gold_codes, r[0].gold_terms) == ("new", ["A", "B"], ["a title", "b title"])
    with pytest.raises(ValueError):
        records.multilabel_records(notes, dx, names.unionByName(names.withColumn("long_title", F.lit("another"))))
    d = records.dictionary_terminology(spark.createDataFrame([(" A ", "10", " a title "), ("A", "10", "second"), ("", "10", "blank"), ("Z", "9", "old")], "icd_code string, icd_version string, long_title string")).collect()
    assert [(x.code, x.term, x.system) for x in d] == [("A", "a title", "ICD-10")]
    assert records.terminology_plain(spark.createDataFrame([("A", "pain", "ache|sore", 0), ("A", "x", "", 1)], "code string, term string, synonyms string, row_seq int")).first().term == "pain ache sore"


def test_pages_of_a_service(spark):
    fetch = lambda offset, n: [(i, f"r{i}") for i in range(offset, min(offset + n, 25))]
    rows = records.paged_source(spark, fetch, 25, 10, "id long, name string")
    assert rows.rdd.getNumPartitions() == 3 and sorted(r.id for r in rows.collect()) == list(range(25))
    assert records.paged_source(spark, fetch, 0, 10, "id long, name string").count() == 0
    assert records.choose_tabular(["x/readme.md", "b.tsv", "corpus_full.csv.gz", "corpus.csv"], "corpus") == "corpus.csv"


def test_casebook_places(spark):
    rows = [("1", 0.9, 0, "AUTO_CANDIDATE", "seen_code", "grounded"), ("2", 0.5, 0, "HUMAN", "unseen_code", "grounded"), ("3", 0.8, 1, "HUMAN", "seen_code", "grounded")]
    p = spark.createDataFrame(rows, "record_id string, confidence double, correct int, decision string, code_novelty string, explanation_status string")
    got = [(r.casebook_id, r.record_id, r.review_reason) for r in audits.casebook(p, 10).orderBy("casebook_id").collect()]
    assert got == [("CASE-001", "1", "auto_candidate_error"), ("CASE-002", "2", "unseen_code_error"), ("CASE-003", "3", "correct_control")]


def test_queue_feedback_and_trace(spark, tmp_path):
    now = F.lit("2024-01-01").cast("timestamp")
    e = review.enqueue(spark.createDataFrame([("r1",), ("r2",), ("",)], "record_id string"), 1, now)
    assert review.queue_state(e).filter("status = 'PENDING'").count() == 2
    with pytest.raises(ValueError):
        review.decide(e, "r1", "NOPE")
    with pytest.raises(KeyError):
        review.decide(e, "zz", "ESCALATE")
    e2 = e.unionByName(review.decide(e, "r1", "ESCALATE", reviewer=" bob ")).cache()
    assert {r.record_id: r.status for r in review.queue_state(e2).collect()} == {"r1": "ESCALATED", "r2": "PENDING"}
    e3 = e2.unionByName(review.enqueue(spark.createDataFrame([("r1",)], "record_id string"), 2, F.lit("2999-01-01").cast("timestamp")))
    assert review.queue_state(e3).filter("record_id = 'r1'").first().status == "PENDING"  # enqueued again
    review.append(e2, str(tmp_path / "log"))
    s = stream.events(spark, str(tmp_path / "log"))
    q = stream.keep_state(s, str(tmp_path / "state"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert {r.record_id: r.status for r in stream.state_table(spark, str(tmp_path / "state")).collect()} == {"r1": "ESCALATED", "r2": "PENDING"}
    trace = review.decision_trace(spark.createDataFrame([("r1", "A", "TOP_K_HUMAN_CHOICE"), ("r2", "B", "AUTO_CANDIDATE")], "record_id string, predicted_code string, route_before_review string"), e2)
    assert {r.record_id: (r.final_code, r.final_status) for r in trace.collect()} == {"r1": ("A", "ESCALATED"), "r2": ("B", "AUTO_CANDIDATE")}
    assert [r.record_id for r in review.pending(review.queue_state(e2)).collect()] == ["r2"]
    assert review.audit_trail(e2, "r1").count() == 2
    rates = stream.action_rates(spark.readStream.schema(review.EVENT).json(str(tmp_path / "log")))
    q = rates.writeStream.outputMode("complete").format("memory").queryName("rates").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.action, r.n) for r in spark.table("rates").collect()] == [("ESCALATE", 1)]


def test_what_a_reviewer_decides_stands(spark):
    e = spark.createDataFrame([(i, f"r{i}", "DECIDE", a, c, "", "", None) for i, (a, c) in enumerate([("ACCEPT_TOP1", "A"), ("SELECT_ALTERNATIVE", "B"), ("NO_CODE", ""), ("RECODE_OUTSIDE_TOPK", "")])], review.EVENT)
    p = spark.createDataFrame([(f"r{i}", "A", "TOP_K_HUMAN_CHOICE") for i in range(5)], "record_id string, predicted_code string, route_before_review string")
    got = {r.record_id: (r.final_code, r.final_status) for r in review.decision_trace(p, e).collect()}
    assert got == {"r0": ("A", "HUMAN_ADJUDICATED"), "r1": ("B", "HUMAN_ADJUDICATED"), "r2": ("", "HUMAN_ADJUDICATED_NO_CODE"), "r3": ("A", "TOP_K_HUMAN_CHOICE"), "r4": ("A", "TOP_K_HUMAN_CHOICE")}


def test_feedback_rules(spark, tmp_path):
    s = "record_id string, model_release string, original_candidate_codes array<string>, human_selected_code string, human_action string"
    f = spark.createDataFrame([("r", "1", ["A"], "A", "ACCEPT_TOP1"), ("", "", ["A"], "B", "SELECT_ALTERNATIVE"), ("r", "1", ["A"], "A", "RECODE_OUTSIDE_TOPK"), ("r", "1", None, "", "X")], s)
    got = [r[0] for r in f.select(review.feedback_errors()).collect()]
    assert got == [[], ["missing_record_id", "missing_model_release", "selected_code_not_in_original_topk"], ["outside_topk_action_inconsistent"], ["invalid_human_action"]]
    with pytest.raises(ValueError):
        review.append_feedback(f, str(tmp_path / "fb"))
    review.append_feedback(f.limit(1), str(tmp_path / "fb"))
    rec = spark.createDataFrame([("r", "old", "", 0), ("r", "text", "m", 1)], "record_id string, text string, mention string, row_seq long")
    assert review.training_memory(f.limit(1), rec).first().text == "text"
    assert review.feedback_summary(f.limit(0)).first().top1_accept_rate == 0.0


def test_audit_files(spark, tmp_path):
    p = tmp_path / "x.json"
    p.write_text("1")
    bundle = spark.createDataFrame(review.file_fingerprints(spark, [str(p)]).collect())
    assert review.changed_files(review.file_fingerprints(spark, [str(p)]), bundle).count() == 0
    p.write_text("2")
    assert review.changed_files(review.file_fingerprints(spark, [str(p)]), bundle).first().problem == "changed"
    made = review.audit_bundle(spark, "0.1.0", {"a": str(p), "b": str(tmp_path / "none")}, {})
    assert review.bundle_errors(spark, made) == ["missing_artifact:b"]
    p.write_text("3")
    assert review.bundle_errors(spark, made | {"artifact_schema_version": "9"}) == ["unsupported_artifact_schema_version", "artifact_hash_mismatch:a", "missing_artifact:b"]
    p.unlink()
    assert "artifact_no_longer_exists:a" in review.bundle_errors(spark, made)


def test_model_boundary(spark):
    cases = spark.createDataFrame([("1", "red rash", [("A", "a", 0.5), ("B", "b", 0.4)]), ("2", "cough", [("C", "c", 0.5)])], "record_id string, phrase string, candidates array<struct<code:string,term:string,score:double>>")

    def model(row):
        if row["record_id"] == "2":
            raise TimeoutError
        return {"ranked_codes": ["B", "A"], "overall_uncertainty": "", "candidate_rationales": [{"code": c, "rationale": "x", "evidence_quotes": ["red rash"]} for c in "AB"]}

    with pytest.raises(models.ExternalModelPolicyError):
        models.reranked(cases, model, False, "public")
    with pytest.raises(models.ExternalModelPolicyError):
        models.reranked(cases, model, True, "restricted")
    got = {r.record_id: r for r in models.reranked(cases, model, True, "public").collect()}
    assert [c.code for c in got["1"].candidates] == ["B", "A"] and got["1"].accepted
    assert got["2"].errors == ["model_error:TimeoutError"] and [c.code for c in got["2"].candidates] == ["C"]


def test_contracts(spark, tmp_path):
    c = contracts.contract("external", True, {"train-test": 0, "val-test": 0}, False)
    assert c.reportable and c.status == "reportable"
    assert contracts.contract("all_gold_oracle", True, {}, False).status == "oracle_diagnostic"
    assert contracts.contract("dataset_derived_all_labels", True, {}, False).status == "oracle_diagnostic"
    assert contracts.contract("external", False, {}, False).status == "synthetic_smoke_test"
    assert contracts.contract("external", True, {"a": 1}, False).status == "non_reportable"
    assert contracts.contract("external", True, {}, True).status == "non_reportable"
    r = contracts.release_readiness({"reportable": True}, {"ready_for_benchmark": False}, {"fail_rate": 0.2}, {"b": False, "a": False, "c": True})
    assert r == {"release_ready": False, "failures": ["dataset_audit_failed", "explanation_fail_rate_above_release_limit", "missing_required_artifacts:a,b"], "warnings": []}
    assert contracts.release_readiness({"reportable": True}) == {"release_ready": True, "failures": [], "warnings": ["explanation_quality_not_evaluated"]}
    whole = contracts.release_manifest("0.1.0", dict.fromkeys(contracts.CAPABILITIES, True))
    assert whole["software_release_complete"] and contracts.manifest_errors(whole) == []
    part = contracts.release_manifest("0.2.0", {c: c != "audit_replay" for c in contracts.CAPABILITIES})
    assert contracts.manifest_errors(part) == ["unexpected_release_version", "required_capabilities_missing", "missing:audit_replay"]
    a = contracts.register(spark, str(tmp_path / "registry"), {"x": 1}, "t1")
    assert a == contracts.register(spark, str(tmp_path / "registry"), {"x": 1}, "t2") and len(a) == 16
    assert [(r.experiment_id, r.created_at_utc, r.x) for r in contracts.registered(spark, str(tmp_path / "registry")).collect()] == [(a, "t1", 1), (a, "t2", 1)]
    run = str(tmp_path / "run")
    contracts.write_json(spark, f"{run}/metrics.json", {"accuracy_at_1": 0.5})
    contracts.write_json(spark, f"{run}/results_contract.json", {"reportable": True})
    contracts.readiness_gate(spark, run, False)
    assert contracts.read_json(spark, f"{run}/results_contract.json")["status"] == "non_reportable" and not contracts.read_json(spark, f"{run}/metrics.json")["results_reportable"]
    assert contracts.artifact_errors(spark, run) == ["leakage_audit.json", "experiment_manifest.json", "data_fingerprints.json", "frozen_policy.json"]
    both = contracts.dual_summary(spark, run, str(tmp_path / "none"))
    assert both["pooled_score"] is None and both["benchmarks"][0]["coding_primary_value"] == 0.5 and both["benchmarks"][1]["reportable"] is None
    assert contracts.profile("cadec_meddra_normalization").primary_metrics == ("accuracy_at_1", "accuracy_at_5", "candidate_recall_at_10")
    with pytest.raises(ValueError):
        contracts.profile("none")
    assert "&lt;" in contracts.html_report("t", {"a": [{"x": "<"}]})
    assert "- b" in contracts.data_card("n", "s", "l", "t", "u", "g", ["b"]) and "## Components" in contracts.model_card("1", "use", ["a"], [], {})


def test_quality_names_each_failure_once(spark):
    """Rows without quotes are not called non-verbatim as well; names and order are those of the contract."""
    s = "text string, evidence_quotes array<string>, explanation_status string, context_review_required boolean, term string, comprehensiveness_drop double, decision string"
    rows = [
        ("a b", [], "insufficient_grounding", False, "t", 0.1, "AUTO_CANDIDATE"), ("a b", ["a", "c"], "grounded", None, " ", None, "CODE_PROPOSAL"), ("a b", ["a"], "grounded", True, "t", 0.0, "HUMAN_REVIEW"),
        ("a b", ["a b"], "grounded", False, "t", 0.2, "AUTO_CANDIDATE"), (None, None, "grounded", False, "t", 0.2, "AUTO_CANDIDATE"), ("a b", ["b"], "grounded", False, "t", -0.1, "AUTO_CANDIDATE"),
    ]
    df = explain.apply_quality_gate(explain.quality(spark.createDataFrame(rows, s).coalesce(1)))
    got = [(r.failures, r.warnings, r.quality_gate, r.decision) for r in df.collect()]
    assert got == [
        (["no_evidence_quotes", "insufficient_grounding"], [], "FAIL", "HUMAN_REVIEW"), (["non_verbatim_evidence"], ["missing_terminology_knowledge", "faithfulness_not_available"], "FAIL", "HUMAN_REVIEW"),
        (["clinical_context_requires_review"], ["evidence_removal_did_not_reduce_score"], "FAIL", "HUMAN_REVIEW"), ([], [], "PASS", "AUTO_CANDIDATE"), (["no_evidence_quotes"], [], "FAIL", "HUMAN_REVIEW"), ([], ["evidence_removal_did_not_reduce_score"], "WARN", "AUTO_CANDIDATE"),
    ]
    q = explain.quality_summary(df).first()
    assert (q.n, q.n_decisions_downgraded, q.automatic_or_proposal_rate_before_quality_gate, q.automatic_or_proposal_rate_after_quality_gate) == (6, 3, 5 / 6, 2 / 6)
    assert q.additional_review_rate_due_to_explanation_gate == 3 / 6 and explain.quality_cases(df.withColumn("record_id", F.lit("r")).withColumn("predicted_code", F.lit("A"))).filter("decision_downgraded").count() == 3


def test_annotation_audit(spark):
    s = "record_id string, annotation_id string, text string, mention string, gold_code string, offset_match string, is_discontinuous string"
    rows = [("1", "T1", "", "", "A", "True", "no"), ("1", "T1", "", "", "A", "yes", "1"), ("1", "T1", "", "", "B", "Y", "0"), ("2", "T1", "", "", " ", "false", "0")]
    terms = spark.createDataFrame([("A",)], "code string")
    r = audits.audit_annotations(spark.createDataFrame(rows, s), terms).first()
    assert (r.n_rows, r.n_duplicates, r.n_multi_code, r.n_discontinuous, r.offset_match_rate) == (4, 1, 1, 1, 0.75)
    assert r.missing_terminology_codes == [" ", "B"] and abs(r.terminology_coverage - 1 / 3) < 1e-12 and not r.ready
    assert r.hard_failures == ["blank_gold_code", "offset_match_rate_below_threshold", "terminology_coverage_below_threshold"] and r.warnings == ["duplicate_rows_present", "same_annotation_has_multiple_codes"]
    plain = spark.createDataFrame([("1", "t", "m", "A"), ("1", "t", "m", "A")], "record_id string, text string, mention string, gold_code string")
    r = audits.audit_annotations(plain).first()
    assert (r.offset_match_rate, r.n_discontinuous, r.terminology_coverage, r.n_duplicates, r.ready, r.warnings) == (None, None, None, 1, True, ["duplicate_rows_present"])
    first = audits.review_sample(spark.createDataFrame(rows, s), 2).collect()
    assert {x.priority for x in first} == {0} and first[0].review_comments == ""


def test_note_audit_and_samples(spark):
    rows = [("1", "s1", "abc", ["A"], "train"), ("2", "s1", " ", ["A", "B"], "test"), ("3", "s2", "abcde", [], "val"), ("4", "s3", "x" * 50, ["A", "C", "D"], "train")]
    notes = spark.createDataFrame(rows, "record_id string, subject_id string, text string, gold_codes array<string>, split string")
    r = audits.audit_notes(notes, spark.createDataFrame([("A",), ("B",), ("C",)], "code string")).first()
    assert r.length_quantiles == [1.0, 2.5, 4.0, 16.25, pytest.approx(43.25), pytest.approx(48.65), 50.0] and r.codes_quantiles[2] == 1.5
    assert (r.train_test_overlap, r.n_missing_codes, r.missing_terminology_codes, r.warnings) == (1, 1, ["D"], ["very_small_code_vocabulary"])
    assert r.hard_failures == ["subject_id_leakage_across_splits", "empty_clinical_text", "records_without_icd10_labels", "terminology_coverage_below_threshold"]
    assert [x.record_id for x in audits.note_sample(notes, 1, extremes=1).collect()] == ["4"]
    import numpy as np

    v = [random.Random(4).random() * 3000 - 500 for _ in range(301)]
    got = audits.exact_quantiles(spark.createDataFrame([(x,) for x in v + v[:50]], "v double"), F.col("v")).first().quantiles
    assert got == pytest.approx(np.quantile(v + v[:50], audits.QUANTILES).tolist(), rel=1e-12)


def test_sent_only_when_grounded(spark, tmp_path):
    """No quotes, no call; a context to review, no call; an answer that changes the code or quotes anew is not taken."""
    rows = [("1", "A", "a", "w1", ["red rash"], False), ("2", "B", "b", "w2", [], False), ("3", "C", "c", "w3", ["cough"], True), ("4", "D", "d", "w4", ["fever"], False), ("5", "E", "e", "w5", ["ache"], False)]
    expl = spark.createDataFrame(rows, "record_id string, predicted_code string, term string, why string, evidence_quotes array<string>, context_review_required boolean")
    log = str(tmp_path)

    def model(row):
        open(f"{log}/{row['record_id']}", "w").close()
        if row["record_id"] == "5":
            raise OSError
        return {"code": "A" if row["record_id"] == "4" else row["predicted_code"], "rationale": "better", "evidence_quotes": ["red rash"]}

    with pytest.raises(models.ExternalModelPolicyError):
        models.rewritten(expl, model, True, "restricted")
    got = {r.record_id: (r.why, r.explanation_source, r.rationale_errors) for r in models.rewritten(expl, model, True, "public").collect()}
    plain = "grounded_deterministic"
    assert got == {"1": ("better", "llm_validated", []), "2": ("w2", plain, []), "3": ("w3", plain, []), "4": ("w4", plain, ["code_changed", "quote_not_allowed"]), "5": ("w5", plain, ["model_error:OSError"])}
    assert {p.name for p in tmp_path.iterdir()} == {"1", "4", "5"}


def test_task_spans_alignment_and_artifacts(spark, tmp_path):
    e = spark.createDataFrame([("1", 1, "abc def", [])], f"record_id string, occurrence int, text string, spans {explain.SPAN}")
    src = spark.createDataFrame([("1", 1, "[[4, 7], [5, 90], [3]]")], "record_id string, occurrence int, spans_json string")
    assert [(s.quote, s.source, s.score) for s in explain.task_input_spans(e, src).first().spans] == [("def", "task_input_span", 3.0)]
    assert explain.task_input_spans(e, src.withColumn("spans_json", F.lit("no json"))).first().spans == []
    rec = explain.with_occurrence(spark.createDataFrame([("1", "first", "m", 0), ("1", "second", "m", 1)], "record_id string, text string, mention string, row_seq int"))
    pred = spark.createDataFrame([("1", 2)], "record_id string, occurrence int")
    assert explain.aligned(pred, rec).first().text == "second"
    with pytest.raises(ValueError):
        explain.aligned(pred.withColumn("occurrence", F.lit(3)), rec)
    p = spark.createDataFrame([("1", "Red rash <here>. x", "red rash", "A", 0.9, "AUTO_CANDIDATE")], "record_id string, text string, mention string, predicted_code string, confidence double, decision string")
    terms = records.with_blank(spark.createDataFrame([("A", "rash", "red rash")], "code string, term string, synonyms string"), "definition", "hierarchy", "system", "knowledge_source")
    x = explain.with_provenance(explain.explanations(p, terms))
    r = x.first()
    assert r.evidence_verbatim and r.external_knowledge.term == "rash" and "red rash" in r.matched_terminology_phrases
    m = explain.write_explanations(x, str(tmp_path))
    assert m == {"n": 1, "grounded_rate": 1.0, "verbatim_evidence_rate": 1.0, "mean_sufficiency_gap": None, "mean_comprehensiveness_drop": None}
    page = spark.read.text(str(tmp_path / "explanations.html")).first().value
    assert "<mark>Red rash</mark> &lt;here&gt;" in page
    assert spark.read.option("header", True).csv(str(tmp_path / "rationale_review_template.csv")).columns[-4:] == ["expert_code_supported", "expert_evidence_complete", "expert_rationale_correct", "expert_comments"]


def test_fingerprint_is_a_chain_of_hashes(spark):
    import xxhash

    rows = [(i, f"t{i}" if i % 3 else None, i * 7) for i in range(40)]

    def h(row):
        seed = 42
        for v in row:
            if v is not None:
                seed = xxhash.xxh64_intdigest(v.to_bytes(8, "little", signed=True) if isinstance(v, int) else v.encode(), seed)
        return seed - (1 << 64) if seed >> 63 else seed

    df = spark.createDataFrame(rows, "a long, b string, c long")
    got, hashes = hashing.fingerprint(df.repartition(5)).first(), [h(r) for r in rows]
    x = 0
    for v in hashes:
        x ^= v
    assert (got.n_rows, got.rows_xor, got.rows_sum) == (40, x, str(sum(hashes)))
    with pytest.raises(ValueError):
        hashing.assert_all_splits(spark.createDataFrame([("train",), ("val",)], "split string"))
