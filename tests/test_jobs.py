"""The published demo figures, the benchmark drivers and the jobs over their runs, on small inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from termweave import __main__ as cli
from termweave.operators import advanced, contracts, evaluation, explain, policy, products, retrieval
from termweave.plans import benchmark, jobs
from termweave.sources import records

KNOWN = "code string, term string, synonyms string, definition string, system string, knowledge_source string"


def knowledge(spark, rows):
    df = spark.createDataFrame([(*r[:3], r[3] if len(r) > 3 else "", "DEMO", "demo") for r in rows], KNOWN).withColumn("row_seq", F.monotonically_increasing_id())
    return records.terminology(df.coalesce(1))


def test_explainable_demo_goldens(spark):
    history = spark.createDataFrame([("I developed aching muscles in both legs", "aching muscles", "M1", 0), ("My legs felt weak when walking", "legs felt weak", "M2", 1), ("I felt sick after taking the tablets", "felt sick", "G1", 2)], "text string, mention string, gold_code string, row_seq long")
    terms = knowledge(spark, [("M1", "Myalgia", "muscle pain|aching muscles", "Synthetic demo definition for muscle pain."), ("M2", "Muscular weakness", "weak muscles|muscle weakness", "Synthetic demo definition for muscular weakness."), ("G1", "Nausea", "feeling sick|felt sick", "Synthetic demo definition for nausea.")])
    new = spark.createDataFrame([("N1", "At follow-up, the patient reported persistent severe muscle pain in both thighs after treatment.", "severe muscle pain")], "record_id string, text string, mention string")
    pred, metrics = jobs.predict_and_explain(history, terms, new, {"history_weight": 0.25}, k=3)
    row = pred.first()
    assert (row.predicted_code, row.final_decision, row.quality_gate) == ("M1", "HUMAN_REVIEW", "PASS")
    assert row.confidence == pytest.approx(0.5998390620687064, abs=1e-12)
    assert (metrics["n"], metrics["grounded_rate"], metrics["verbatim_evidence_rate"]) == (1, 1.0, 1.0)
    assert metrics["mean_sufficiency_gap"] == pytest.approx(0.0, abs=1e-12) and metrics["mean_comprehensiveness_drop"] == pytest.approx(0.7026036064713568, abs=1e-12)


def test_multilabel_demo_goldens(spark, tmp_path):
    rows = [
        ("tr1", "s1", "NSTEMI myocardial infarction and coronary atherosclerosis", ["I214", "I251"], "train"), ("tr2", "s2", "pneumonia treated with antibiotics", ["J189"], "train"),
        ("tr3", "s3", "heart failure with dyspnea", ["I509"], "train"), ("tr4", "s4", "coronary disease after myocardial infarction", ["I251", "I214"], "train"),
        ("v1", "s5", "non ST elevation myocardial infarction", ["I214"], "val"), ("v2", "s6", "pneumonia and heart failure", ["J189", "I509"], "val"),
        ("te1", "s7", "NSTEMI with coronary atherosclerotic disease", ["I214", "I251"], "test"), ("te2", "s8", "community pneumonia with chronic heart failure", ["J189", "I509"], "test"),
    ]
    rec = spark.createDataFrame(rows, "record_id string, subject_id string, text string, gold_codes array<string>, split string")
    terms = knowledge(spark, [("I214", "Non-ST elevation myocardial infarction", "NSTEMI|myocardial infarction"), ("I251", "Atherosclerotic heart disease", "coronary atherosclerosis|coronary disease"), ("J189", "Pneumonia, unspecified organism", "pneumonia"), ("I509", "Heart failure, unspecified", "heart failure")])
    out = str(tmp_path / "run")
    r = benchmark.multi_label(rec, terms, out, target=0.80, real_data=False)
    assert (r["precision_at_5"], r["recall_at_10"], r["policy"]["history_weight"]) == (0.5, 1.0, 0.0)
    assert r["policy"]["code_proposal_threshold"] == pytest.approx(0.5555707375400218, abs=1e-12)
    assert r["selective_micro_f1"] == pytest.approx(2 / 3) and (r["selective_micro_precision"], r["selective_micro_recall"], r["selective_n_proposals"], r["selective_mean_proposals"]) == (1.0, 0.5, 2, 1.0)
    assert (r["results_status"], r["results_reportable"]) == ("synthetic_smoke_test", False)
    assert [s["target_precision"] for s in r["stress"]] == [0.90, 0.95, 0.98, 0.99] and all(s["test_micro_precision"] == 1.0 and s["target_met_on_test"] for s in r["stress"])
    assert contracts.artifact_errors(spark, out) == []
    notes = rec.filter("split = 'test'")
    ranked = retrieval.MultiLabelCoder(0.0, 4).fit(rec.filter("split = 'train'"), terms).rank(notes)
    m = jobs.explain_notes(ranked, notes.select("record_id", "text", "gold_codes"), terms, r["policy"]["code_proposal_threshold"], str(tmp_path / "x"))
    assert m["n"] >= 2 and m["grounded_rate"] == 1.0
    with pytest.raises(ValueError):
        benchmark.multi_label(rec.withColumn("subject_id", F.lit("one")), terms)


def small_run(spark, n=60):
    """Records of three codes whose wordings overlap; the last third of the sources is TEST."""
    rng = random.Random(5)
    words = {"A": "muscle pain ache legs sore", "B": "red skin rash itchy eruption", "C": "nausea sick stomach vomit"}
    rows = []
    for i in range(n):
        code = "ABC"[i % 3]
        mention = " ".join(rng.sample(words[code].split(), 3))
        rows.append((str(i), f"The patient had {mention} today.", mention, code, i, "train" if i < n // 2 else "val" if i < 3 * n // 4 else "test"))
    rows += [("x1", "odd thing here", "odd thing here", "Z", n, "test"), ("x2", "quite new wording", "quite new wording", "A", n + 1, "test")]
    rec = spark.createDataFrame(rows, "record_id string, text string, mention string, gold_code string, row_seq long, split string")
    return rec, knowledge(spark, [("A", "muscle pain", "sore muscles"), ("B", "skin rash", "itchy rash"), ("C", "nausea", "feeling sick")])


def test_advanced_benchmark_and_its_policy(spark, tmp_path):
    rec, terms = small_run(spark)
    out = str(tmp_path / "run")

    def encode(texts):
        """A stand-in for an encoder: which of three vocabularies a text uses."""
        kinds = ("muscle pain ache legs sore muscles", "red skin rash itchy eruption", "nausea sick stomach vomit feeling")
        return [[float(sum(w in k.split() for w in t.lower().split())) + 0.01 for k in kinds] for t in texts]

    score = lambda pdf: [float(len(set(q.split()) & set(c.split()))) for q, c in zip(pdf["query_text"], pdf["candidate_text"], strict=True)]
    r = benchmark.advanced_benchmark(rec, terms, out, 0.9, encoders={"enc": encode}, rerankers={"pairs": score}, k=3)
    stages = [s["stage"] for s in r["selection"]]
    assert stages == ["lexical_history"] * 5 + ["dense_fusion"] * 4 + ["cross_encoder_fusion"] * 3
    best = max((s["val_accuracy_at_1"], s["val_accuracy_at_5"]) for s in r["selection"])
    frozen = contracts.read_json(spark, f"{out}/frozen_policy.json")
    chosen = [s for s in r["selection"] if all(s[k] == frozen[k] for k in ("history_weight", "dense_weight", "reranker_weight"))]
    assert (chosen[0]["val_accuracy_at_1"], chosen[0]["val_accuracy_at_5"]) == best and frozen["model_type"] == "advanced_singlelabel"
    # Of equal models the simplest was taken: if a lexical one is best, nothing else is
    if any((s["val_accuracy_at_1"], s["val_accuracy_at_5"]) == best for s in r["selection"][:5]):
        assert frozen["dense_weight"] == frozen["reranker_weight"] == 0
    assert contracts.artifact_errors(spark, out) == [] and jobs.validated(spark, out)["status"] == "reportable"
    assert jobs.audit_bundle(spark, out, "0.1.0") == []
    again = advanced.from_policy(frozen | {"dense_weight": 0.5, "reranker_weight": 0.25, "dense_model_name": "enc", "cross_encoder_model_name": "pairs"}, {"enc": encode, "pairs": score}, 3).fit(rec.filter("split = 'train'"), terms)
    top = again.predict(rec.filter("split = 'test' and gold_code <> 'Z'")).filter("rank = 1").join(rec.select("record_id", "gold_code"), "record_id")
    assert top.filter("code = gold_code").count() >= 14
    pairs = spark.createDataFrame([(1, "muscle ache", "A"), (2, "muscle ache", "none")], "key int, text string, code string")
    s = {x.key: x.score for x in again.score_code(pairs).collect()}
    assert s[1] > 0.5 and s[2] == 0.0
    for bad in ({"dense_weight": 0.5}, {"reranker_weight": 0.5}):
        with pytest.raises(ValueError):
            advanced.from_policy({"model_type": "advanced_singlelabel", "history_weight": 0.5} | bad)
    assert isinstance(advanced.from_policy({"history_weight": 0.25}), retrieval.HistoricalCoder)
    configs = [advanced.Config(0.5, 0.5, 0.0), advanced.Config(0.0, 0.0, 0.25), advanced.Config(1.0), advanced.Config(0.25)]
    assert [c.history_weight for c in sorted(configs, key=lambda c: c.complexity())] == [0.25, 1.0, 0.5, 0.0]
    m = jobs.explain_benchmark(rec, terms, out, trained={"enc": encode, "pairs": score})
    assert m["n"] == rec.filter("split = 'test'").count() and m["quality_gate"]["n"] == m["n"]
    assert jobs.casebook(out, spark, 10).filter("review_reason <> 'correct_control'").count() >= 1
    assert spark.read.option("header", True).csv(f"{out}/review_casebook.csv").columns[-1] == "expert_comments"


def test_candidate_generation_and_end_to_end(spark, tmp_path):
    rec, _ = small_run(spark)
    out = str(tmp_path / "run")
    r = benchmark.candidate_generation(rec, out, k=3, weights=(0.25, 0.5), word_weights=(0.15,))
    h = r["hybrid"]
    assert (h["all"]["n"], h["unseen_code"]["n"], h["seen_code"]["n"]) == (17, 1, 16) and h["unseen_code"]["acc_at_1"] == 0.0
    assert h["exact_gold_alias_seen_in_train"]["n"] + h["novel_gold_wording"]["n"] == 17
    aliases = {(x.code, x.alias) for x in advanced.train_alias_map(rec.filter("split = 'train'")).collect()}
    test = rec.filter("split = 'test'").collect()
    assert h["exact_gold_alias_seen_in_train"]["n"] == sum((x.gold_code, x.mention.lower()) in aliases for x in test)
    assert r["delta"]["acc_at_1_delta"] == h["all"]["acc_at_1"] - r["baseline"]["all"]["acc_at_1"]
    best = min((s for s in r["selection"] if s["model"] == "alias_aware_hybrid"), key=lambda s: (-s["val_recall_at_5"], -s["val_recall_at_20"], -s["val_accuracy_at_1"], s["history_weight"]))
    assert r["selected_v2"] == {k: best[k] for k in ("history_weight", "word_weight")}
    failures = spark.read.json(f"{out}/candidate_failure_examples.jsonl")
    assert "x1" in {x.record_id for x in failures.collect()} and failures.count() <= 100

    def model(row):
        import json

        codes = [c["code"] for c in json.loads(row["candidates"])]
        if row["record_id"] == "45":
            raise TimeoutError
        ranked = codes[:1] if row["record_id"] == "46" else codes[::-1]
        return {"ranked_codes": ranked, "overall_uncertainty": "", "candidate_rationales": [{"code": c, "rationale": "x", "evidence_quotes": [row["phrase"]]} for c in codes]}

    run = str(tmp_path / "e2e")
    e = jobs.end_to_end(rec, r["selected_v2"], model, run, allow=True, target=0.9, top_k=2, k=3)
    p = e["paired"]
    assert (p["n"], p["n_valid_responses"]) == (17, 15) and p["net"] == p["corrected"] - p["harmed"] and p["harmed"] > 0
    assert sum(x["n"] for x in e["retrieval"]["routes"].values()) == 17
    assert "| valid answers | 15 of 17 |" in jobs.published(spark, run, str(tmp_path / "pub"))
    rows = {x.record_id: x for x in spark.read.parquet(f"{run}/paired_predictions.parquet").collect()}
    assert rows["45"].after == rows["45"].before and rows["46"].errors == ["candidate_set_changed"]
    cases = {x.record_id: x.options for x in spark.read.json(f"{run}/cases.jsonl").collect()}
    assert [(o.baseline_rank, o.reranked_rank, o.rationale_source, o.display_rationale) for o in cases["47"]] == [(1, 2, "llm_validated", "x"), (2, 1, "llm_validated", "x")]
    assert all(o.reranked_rank is None and o.rationale_source == "deterministic_grounded" and o.display_rationale for o in cases["45"])


def test_review_packets(spark, tmp_path):
    rec, terms = small_run(spark)
    train, test = rec.filter("split = 'train'"), rec.filter("split = 'test'")
    p = retrieval.predictions(retrieval.HistoricalCoder(0.5, 3).fit(train, terms).predict(test)).join(test.select("record_id", "text", "mention"), "record_id")
    packets, counts = jobs.review_packets(p, terms, str(tmp_path), top_k=2, auto=0.6, choice=0.3)
    assert sum(counts.values()) == test.count() and set(counts) <= {"AUTO_CANDIDATE", "TOP_K_HUMAN_CHOICE", "FULL_EXPERT_REVIEW"}
    row = packets.filter("record_id = '45'").first()
    assert [o.rank for o in row.candidate_options] == [1, 2] and row.human_selected_code == "" and row.uncertainty.top_score == pytest.approx(max(o.score for o in row.candidate_options))
    flat = spark.read.option("header", True).csv(str(tmp_path / "candidate_options.csv"))
    assert flat.count() == 2 * test.count() and contracts.read_json(spark, str(tmp_path / "routing_summary.json"))["route_counts"] == counts


def test_rationale_job(spark, tmp_path):
    rec = spark.createDataFrame([("r", "abcdefghijklmnopqrstuvwxyz", 0)], "record_id string, text string, row_seq int")
    ref = spark.createDataFrame([("r", "A", 15, 25, "pqrstuvwxy")], "record_id string, code string, start int, end int, quote string")
    own = spark.createDataFrame([("r", "A", 10, 20)], "record_id string, code string, s int, e int")
    r = jobs.evaluate_rationales(own, ref, rec, str(tmp_path))
    assert (r["macro_char_f1"], r["macro_char_precision"], r["any_overlap_rate"]) == (0.5, 0.5, 1.0)
    with pytest.raises(ValueError):
        jobs.evaluate_rationales(own, ref.withColumn("quote", F.lit("other")), rec)


def test_blocks_give_what_one_block_gives(spark, monkeypatch):
    rec, terms = small_run(spark)
    train, test = rec.filter("split = 'train'"), rec.filter("split = 'test'")

    def all_of():
        a = retrieval.HistoricalCoder(0.5, 3).fit(train, terms)
        b = retrieval.AliasCoder(0.5, 0.2, 3).fit(train, terms)
        q = spark.createDataFrame([(i, v) for i, v in enumerate(np.random.default_rng(1).normal(size=(9, 4)).tolist())], "query long, vector array<double>")
        d = retrieval.dense_scores(q, q.select((F.col("query") % 3).cast("string").alias("code"), "vector"))
        r = lambda df, *c: sorted((*(x[k] for k in c[:-1]), round(x[c[-1]], 9)) for x in df.collect())
        return r(a.predict(test), "record_id", "rank", "code", "score"), r(a.cases(test, 2), "record_id", "rank", "case_text", "similarity"), r(b.predict(test), "record_id", "rank", "code", "score"), r(d, "query", "code", "dense_score")

    whole = all_of()
    monkeypatch.setattr(products, "MOST", 40)
    monkeypatch.setattr(products, "QUERIES", 7)
    assert all_of() == whole


def test_tail_equals_the_sum():
    import math

    for n in (1, 5, 40, 300):
        for t in (0.02, 0.5, 0.95, 0.999):
            p = [math.comb(n, k) * t**k * (1 - t) ** (n - k) for k in range(n + 1)]
            got = policy.tail_of(np.arange(n + 1), np.full(n + 1, n), t)
            assert got == pytest.approx([math.fsum(p[s:]) for s in range(n + 1)], abs=1e-11)
    assert policy.tail_of(np.array([0, 3, 4]), np.array([3, 3, 3]), 0.5) == pytest.approx([1.0, 0.125, 0.0])
    assert policy.tail_of(np.array([9_510_000]), np.array([10_000_000]), 0.951)[0] == pytest.approx(0.5, abs=1e-3)


def test_bounds_hold_the_tail(spark):
    rng = random.Random(9)
    rows = [(rng.randint(0, n), n) for n in [rng.randint(1, 4000) for _ in range(400)]]
    rows += [(min(n, round(n * (0.95 + rng.uniform(-0.02, 0.05)))), n) for n in [rng.randint(20, 4000) for _ in range(400)]]
    low, high = policy.tail_bounds(F.col("s"), F.col("n"), 0.95)
    for r in spark.createDataFrame(rows, "s long, n long").select("*", low.alias("low"), high.alias("high"), policy.binomial_tail(F.col("s"), F.col("n"), 0.95).alias("tail")).collect():
        assert r.tail >= np.exp(r.low) - 1e-12 and r.tail <= np.exp(r.high) + 1e-12, r


def test_uncertainty_goes_by_position(spark):
    df = spark.createDataFrame([([0.2, 0.9, None],)], "s array<double>")
    u = df.select(policy.uncertainty("s").alias("u")).first().u
    e = [np.exp(-0.7), 1.0, np.exp(-0.9)]
    assert (u.top_score, u.score_margin) == (0.2, pytest.approx(-0.7)) and u.top_softmax_share == pytest.approx(e[0] / sum(e))


def test_score_code_and_sharing_of_texts(spark):
    rec, terms = small_run(spark)
    c = retrieval.HistoricalCoder(0.5, 3).fit(rec.filter("split = 'train'"), terms)
    test = rec.filter("split = 'test'").limit(5)
    top = {(r.record_id, r.code): r.score for r in c.predict(test).collect()}
    pairs = test.crossJoin(terms.select("code")).select(F.struct("record_id", "code").alias("key"), F.col("mention").alias("text"), "code")
    for r in c.score_code(pairs.unionByName(test.limit(1).select(F.struct("record_id", F.lit("no").alias("code")).alias("key"), F.lit(" ").alias("text"), F.lit("A").alias("code")))).collect():
        assert r.score == pytest.approx(top.get((r.key.record_id, r.key.code), 0.0), abs=1e-12)


def test_faithfulness_by_the_formula(spark):
    """Scores of the whole input, of its evidence and of what is left, each by score_code on texts cut in plain Python."""
    rec, terms = small_run(spark)
    c = retrieval.HistoricalCoder(0.5, 3).fit(rec.filter("split = 'train'"), terms)
    p = c.predict(rec.filter("split = 'test' and row_seq < 52").withColumn("mention", F.when(F.col("row_seq") % 2 == 0, F.col("mention")).otherwise(""))).filter("rank = 1").join(rec.select("record_id", "text", F.when(F.col("row_seq") % 2 == 0, F.col("mention")).otherwise("").alias("mention")), "record_id")
    e = explain.explanations(p.select("record_id", "text", "mention", F.col("code").alias("predicted_code"), F.col("score").alias("confidence"), F.lit("").alias("decision")), records.with_blank(terms, "hierarchy"))
    got = {r.record_id: r for r in explain.faithfulness(e, c).collect()}
    body_of = lambda r: r.mention.strip() or r.text
    own = spark.createDataFrame([(r.record_id, body_of(r), r.mention, r.term, r.synonyms) for r in got.values()], "record_id string, text string, mention string, term string, synonyms string")
    found, texts = {r.record_id: r.spans for r in explain.evidence_spans(own).collect()}, []
    for r in got.values():
        body, spans = body_of(r), found[r.record_id]
        rest = list(body)
        for s in spans:
            rest[s.start : s.end] = " " * (s.end - s.start)
        texts += [(f"{r.record_id}|{k}", t, r.predicted_code) for k, t in (("whole", body), ("only", " ".join(s.quote for s in spans)), ("removed", "".join(rest)))]
    s = {r.key: r.score for r in c.score_code(spark.createDataFrame(texts, "key string, text string, code string")).collect()}
    for k, r in got.items():
        want = [s[f"{k}|{x}"] for x in ("whole", "only", "removed")]
        assert [r.original_score, r.evidence_only_score, r.evidence_removed_score] == pytest.approx(want, abs=1e-12)
        assert (r.sufficiency_gap, r.comprehensiveness_drop) == pytest.approx((want[0] - want[1], want[0] - want[2]), abs=1e-12)


def test_casebook_of_many_ties_and_cli(spark, tmp_path):
    rec, terms = small_run(spark)
    rec.drop("row_seq").coalesce(1).write.option("header", True).csv(str(tmp_path / "rec"))
    terms.select("code", "term", "synonyms").coalesce(1).write.option("header", True).csv(str(tmp_path / "terms"))
    run = str(tmp_path / "run")
    r, t = str(tmp_path / "rec"), str(tmp_path / "terms")
    assert cli.main(["benchmark", "--records", r, "--terminology", t, "--out", run, "--target", "0.8"]) == 0
    for c in (["validate", "--run", run], ["explain", "--records", r, "--terminology", t, "--run", run], ["casebook", "--run", run], ["packets", "--records", r, "--terminology", t, "--run", run, "--out", str(tmp_path / "p")], ["bundle", "--run", run, "--release", "0.1.0"], ["compare", "--single", run, "--multi", run, "--out", str(tmp_path / "c")]):
        assert cli.main(c) == 0, c
    assert contracts.exists(spark, str(tmp_path / "c/dual_benchmark_summary.html"))
    assert evaluation.candidate_failures(evaluation.merged_predictions(*[spark.createDataFrame([("1", "p", "G", "A", 0, ["A"])], "record_id string, phrase string, gold_code string, predicted_code string, correct int, codes array<string>")] * 2)).count() == 1
