"""Records whose ids repeat (several mentions of one document): a row each in predictions, explanations, packets and casebooks, told apart by row_id."""

import json
import random

import pytest
from pyspark.sql import functions as F

from termweave.operators import contracts, evaluation, explain, retrieval
from termweave.plans import benchmark, jobs
from termweave.sources import records

WORDS = {"A": "muscle pain ache legs sore", "B": "red skin rash itchy eruption", "C": "nausea sick stomach vomit"}
DDL = "record_id string, text string, mention string, gold_code string, row_seq long, split string"


def documents(spark, n=24):
    """Each document has three mentions, of three codes, all in one text."""
    rng, rows = random.Random(7), []
    for i in range(n):
        own = {c: " ".join(rng.sample(w.split(), 3)) for c, w in WORDS.items()}
        text = " ".join(f"Then came {m} again." for m in own.values())
        rows += [(f"d{i}", text, m, c, len(rows) + j, "train" if i < n // 2 else "val" if i < 3 * n // 4 else "test") for j, (c, m) in enumerate(own.items())]
    terms = spark.createDataFrame([("A", "muscle pain", "sore muscles", "DEMO", 0), ("B", "skin rash", "itchy rash", "DEMO", 1), ("C", "nausea", "feeling sick", "DEMO", 2)], "code string, term string, synonyms string, system string, row_seq long")
    return spark.createDataFrame(rows, DDL), records.terminology(terms)


def test_three_mentions_of_one_record_by_hand(spark):
    """Each coded right: three predictions and accuracy 1, where a join by record_id gave nine rows and 0.333."""
    rec, terms = documents(spark)
    coder = retrieval.HistoricalCoder(0.5, 3).fit(rec.filter("split = 'train'"), terms)
    one = rec.filter("record_id = 'd23'")
    p = retrieval.predictions(coder.predict(one))
    assert p.count() == 3 and p.select("row_id").distinct().count() == 3 and all(len(r.candidates) == 3 for r in p.collect())
    named, parts = benchmark.scored(coder, records.with_row_id(one))
    got = benchmark.predicted(coder, named, parts, 0.5, 3)
    assert got.count() == 3 and evaluation.accuracy_at_k(got, (1,)).first().accuracy_at_1 == 1.0
    assert {(r.phrase, r.predicted_code) for r in got.collect()} == {(r.mention, r.gold_code) for r in one.collect()}
    assert coder.cases(one, 2).groupBy("row_id").count().filter("count <> 2").count() == 0
    x, _ = jobs.predict_and_explain(rec.filter("split = 'train'"), terms, one, {"history_weight": 0.5}, k=3)
    assert sorted((r.mention, r.predicted_code) for r in x.collect()) == sorted((r.mention, r.gold_code) for r in one.collect())


def test_single_label_run_its_explanations_and_casebook(spark, tmp_path):
    rec, terms = documents(spark)
    out = str(tmp_path / "run")
    r = benchmark.single_label(rec, terms, out, 0.5, weights=(0.0, 0.5), k=3)
    assert r["test"]["n"] == 18 and r["accuracy_at_1"] == 1.0 and r["selection"][0]["n"] == 18
    pred = spark.read.parquet(f"{out}/predictions.parquet")
    assert pred.count() == 18 and pred.select("row_id").distinct().count() == 18
    m = jobs.explain_benchmark(rec, terms, out)
    assert m["n"] == 18 == m["quality_gate"]["n"]
    mention = {f"{x.record_id}#{x.row_seq}": x.mention for x in rec.collect()}
    expl = spark.read.parquet(f"{out}/explanations.parquet").collect()
    # Each mention is explained by its own words, not by those of another mention of its record
    assert len(expl) == 18 and all(x.mention == mention[x.row_id] and mention[x.row_id] in x.all_extracted_evidence_quotes for x in expl)
    assert spark.read.option("header", True).csv(f"{out}/explanation_quality_cases.csv").count() == 18
    cases = jobs.casebook(out, spark, 40)
    assert cases.count() == 18 and cases.select("row_id").distinct().count() == 18
    book = {c.row_id: c.mention for c in cases.collect()}
    assert book == {k: v for k, v in mention.items() if k in book}
    packets, counts = jobs.review_packets(pred.select("record_id", "row_id", "confidence", "candidates").join(records.with_row_id(rec).select("row_id", "text", "mention"), "row_id"), terms, str(tmp_path / "p"))
    assert packets.count() == 18 == sum(counts.values()) and all(len(x.candidate_options) == 3 for x in packets.collect())


def test_spans_of_the_task_belong_to_their_mention(spark, tmp_path):
    rec, terms = documents(spark)
    at = F.expr("instr(text, mention) - 1")
    rec = rec.withColumn("spans_json", F.to_json(F.array(F.array(at, at + 4))))
    out = str(tmp_path / "run")
    benchmark.single_label(rec, terms, out, 0.5, weights=(0.5,), k=3)
    jobs.explain_benchmark(rec, terms, out)
    for x in spark.read.parquet(f"{out}/explanations.parquet").collect():
        assert x.all_extracted_evidence_quotes == [x.mention[:4]] and x.spans[0].source == "task_input_span"


def test_other_drivers(spark, tmp_path):
    rec, terms = documents(spark)
    a = benchmark.advanced_benchmark(rec, terms, None, 0.5, k=3)
    assert a["test"]["n"] == 18 and a["accuracy_at_1"] == 1.0
    out = str(tmp_path / "c")
    c = benchmark.candidate_generation(rec, out, k=3, weights=(0.25,), word_weights=(0.15,))
    assert c["hybrid"]["all"]["n"] == c["baseline"]["all"]["n"] == 18 == spark.read.parquet(f"{out}/candidate_generation_predictions.parquet").count()
    coder = retrieval.HistoricalCoder(0.5, 3).fit(rec.filter("split = 'train'"), terms)
    f = benchmark.confirmed_policy(coder, records.with_row_id(rec), rec.filter("split = 'train'"), 9, target=0.3, k=3, min_auto=1)
    assert f["confirmation"]["total_n"] == 9
    p = benchmark.predict_uncoded(rec.filter("split = 'train'"), terms, rec.filter("split = 'test'"), {"history_weight": 0.5})
    assert p.count() == 18

    def model(row):
        codes = [x["code"] for x in json.loads(row["candidates"])]
        if row["phrase"].startswith("x"):
            raise TimeoutError
        return {"ranked_codes": codes, "overall_uncertainty": "", "candidate_rationales": [{"code": x, "rationale": "x", "evidence_quotes": [row["phrase"]]} for x in codes]}

    run = str(tmp_path / "e")
    e = jobs.end_to_end(rec, {"history_weight": 0.5, "word_weight": 0.15}, model, run, allow=True, target=0.5, top_k=2, k=3)
    assert e["retrieval"]["n"] == 18 == e["paired"]["n"] == e["paired"]["n_valid_responses"] and e["paired"]["acc_before"] == e["paired"]["acc_after"]
    assert spark.read.json(f"{run}/cases.jsonl").count() == 18


def test_row_ids(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", 0), ("a", "y", 1), ("b", "x", 0), ("a", "x", 1), ("a", "x", 1), (None, "z", None)], "record_id string, text string, row_seq long")
    got = [r.row_id for r in records.with_row_id(rows).collect()]
    assert sorted(got) == sorted(["a#0", "a#1", "a#1.2", "a#1.3", "b#0", "#"])
    assert sorted(got) == sorted(r.row_id for r in records.with_row_id(rows.repartition(5)).collect())
    assert records.with_row_id(rows.withColumn("row_id", F.lit("own"))).select("row_id").distinct().count() == 1
    assert records.with_row_id(rows.drop("row_seq")).select("row_id").distinct().count() == 6
    (tmp_path / "a.csv").write_text("record_id,text\n1,x\n1,y\n")
    read = records.records(records.read_strings(spark, str(tmp_path / "a.csv")))
    assert [r.row_id for r in read.orderBy("row_seq").collect()] == ["1#0", "1#1"]


# ---- evidence, by values taken by hand from its rules

EVIDENCE = "record_id string, text string, mention string, term string, synonyms string"


def test_phrases_inside_the_mention(spark):
    text = "At follow-up the patient reported severe muscle pain in both thighs. No rash was reported."
    rows = [("1", text, "severe muscle pain", "Myalgia", "muscle pain|pain|aching muscles"), ("2", "Pain. MUSCLE pain here! And muscle", "", "muscle pain", "Pain;muscle PAIN"), ("3", "SORE legs", "sore legs", "x", "")]
    got = {r.record_id: [(s.start, s.end, s.quote, s.source, round(s.score, 6), s.matched_phrases) for s in r.spans] for r in explain.evidence_spans(spark.createDataFrame(rows, EVIDENCE)).collect()}
    assert got["1"] == [(34, 52, "severe muscle pain", "explicit_mention", 2.0, ["muscle pain", "pain"])]
    assert got["2"] == [(0, 5, "Pain.", "supporting_sentence", 1.0, ["Pain"]), (6, 23, "MUSCLE pain here!", "supporting_sentence", 2.0, ["muscle pain", "Pain"]), (24, 34, "And muscle", "supporting_sentence", 0.5, [])]
    assert got["3"] == [(0, 9, "SORE legs", "explicit_mention", 2.0, [])]
    terms = records.with_blank(spark.createDataFrame([("A", "Myalgia", "muscle pain|pain")], "code string, term string, synonyms string"), "definition", "hierarchy", "system", "knowledge_source")
    p = spark.createDataFrame([("1", text, "severe muscle pain", "A", 0.9, "AUTO_CANDIDATE")], "record_id string, text string, mention string, predicted_code string, confidence double, decision string")
    assert explain.with_provenance(explain.explanations(p, terms)).first().matched_terminology_phrases == ["muscle pain", "pain"]


def test_context_is_reviewed_only_without_affirmed_words(spark):
    """A negated sentence beside an affirmed one is left out as evidence and blocks nothing; a context runs to the next full stop after its span."""
    rows = [("1", "Fever is high. It stays. No fever at night.", "", "fever", ""), ("2", "At follow-up, no rash was reported.", "rash", "rash", ""), ("3", "Fever is high.", "", "fever", "")]
    df = spark.createDataFrame(rows, EVIDENCE)
    e = df.join(explain.evidence_spans(df), "record_id").withColumn("decision", F.lit("AUTO_CANDIDATE")).withColumn("explanation_status", F.lit("grounded")).withColumn("why", F.lit("w.")).withColumn("comprehensiveness_drop", F.lit(0.5))
    got = {r.record_id: r for r in explain.apply_quality_gate(explain.quality(explain.audit_context(e))).collect()}
    one = got["1"]
    assert (one.evidence_quotes, one.all_extracted_evidence_quotes, one.context_review_required, one.quality_gate, one.decision) == (["Fever is high."], ["Fever is high.", "No fever at night."], False, "PASS", "AUTO_CANDIDATE")
    assert [tuple(x) for x in one.excluded_evidence_context] == [("No fever at night.", "negated", "No fever at night.")] and one.why != "w."
    two = got["2"]
    assert (two.evidence_quotes, two.all_extracted_evidence_quotes, two.context_review_required, two.explanation_status, two.decision, two.quality_gate) == ([], ["rash"], True, "insufficient_affirmed_evidence", "HUMAN_REVIEW", "FAIL")
    assert (got["3"].excluded_evidence_context, got["3"].why, got["3"].decision) == ([], "w.", "AUTO_CANDIDATE")


def test_a_line_of_a_million_characters_is_read_once(spark):
    import time

    text = "word " * 200_000
    began = time.time()
    assert [m.group() for m in explain.SENTENCE.finditer(text + "\nend.") if not m.group().endswith("\n")] == ["end."]
    assert time.time() - began < 1
    df = spark.createDataFrame([("1", text + "\nend."), ("2", text), ("3", "a\n"), ("4", "a\nb")], "record_id string, text string")
    assert sorted((r.record_id, r.start, r.quote[:4]) for r in explain.sentences(df).collect()) == [("1", 1_000_001, "end."), ("2", 0, "word"), ("3", 0, "a"), ("4", 2, "b")]


def test_controls_are_drawn_by_the_seed(spark):
    from termweave.operators import audits

    p = spark.range(400).selectExpr("cast(id as string) AS record_id", "id / 400 AS confidence", "1 AS correct", "'HUMAN' AS decision", "'seen_code' AS code_novelty", "'grounded' AS explanation_status")
    draw = lambda seed: [r.record_id for r in audits.casebook(p, 10, seed).orderBy("casebook_id").collect()]
    assert draw(1) == draw(1) != draw(2) and draw(1) != [str(i) for i in range(399, 389, -1)]


@pytest.mark.parametrize("scale", [1e-9, 1.0, 1e12])
def test_quantiles_at_any_scale(spark, scale):
    import numpy as np

    from termweave.operators import audits

    v = (np.random.default_rng(3).normal(size=2000) * scale).tolist() + [0.5 * scale] * 300
    df = spark.createDataFrame([(x,) for x in v], "v double")
    assert audits.exact_quantiles(df, F.col("v")).first().quantiles == pytest.approx(np.quantile(v, audits.QUANTILES).tolist(), rel=1e-12)
    assert audits.exact_quantiles(df.filter("v = 1e300").union(spark.createDataFrame([(7.0,)], "v double")), F.col("v"), (0.5,)).first().quantiles == [7.0]
