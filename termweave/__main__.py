"""python -m termweave COMMAND ...; inputs are CSV files with headers, runs are folders that a benchmark wrote."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from termweave.functions.hashing import cross_source_split, split_by_hash
from termweave.operators import audits, contracts, retrieval, review
from termweave.operators import spans as intervals
from termweave.plans import benchmark, jobs
from termweave.sources import records as source

#: Each command, the arguments that it needs and those that it may have.
COMMANDS = {
    "split": (("records", "out"), ("seed",)),
    "adapt": (("corpus", "test-source", "out"), ()),
    "parse": (("root", "out"), ()),
    "notes": (("notes", "diagnoses", "dictionary", "out"), ("seed", "min-frequency", "limit")),
    "terminology": (("dictionary", "out"), ()),
    "audit": (("records", "terminology"), ("out",)),
    "audit-notes": (("notes", "terminology"), ("out",)),
    "benchmark": (("records", "terminology", "out"), ("seed", "target")),
    "candidates": (("records", "out"), ("seed",)),
    "end-to-end": (("records", "policy", "out"), ("seed", "target")),
    "confirm": (("records", "policy", "out"), ("seed", "target", "limit")),
    "multilabel": (("notes", "terminology", "out"), ("seed", "target")),
    "predict": (("history", "terminology", "new", "policy", "out"), ()),
    "predict-explain": (("history", "terminology", "new", "policy", "out"), ()),
    "explain": (("records", "terminology", "run"), ("seed",)),
    "explain-notes": (("notes", "terminology", "run"), ()),
    "real": (("records", "out"), ("seed", "target")),
    "packets": (("records", "terminology", "run", "out"), ("seed",)),
    "casebook": (("run",), ("limit",)),
    "rationales": (("explanations", "reference", "records", "out"), ()),
    "ratings": (("reviewed", "questions"), ()),
    "feedback": (("feedback",), ()),
    "bundle": (("run", "release"), ()),
    "compare": (("single", "multi", "out"), ()),
    "publish": (("run", "out"), ()),
    "validate": (("run",), ()),
}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="termweave")
    sub = p.add_subparsers(dest="command", required=True)
    for name, (needed, more) in COMMANDS.items():
        s = sub.add_parser(name)
        for n in needed:
            s.add_argument(f"--{n}", required=True)
        for n in more:
            s.add_argument(f"--{n}", type={"seed": int, "limit": int, "min-frequency": int, "target": float}.get(n, str), default={"seed": 42, "target": 0.95, "min-frequency": 1}.get(n))
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    strings = lambda path: source.read_strings(spark, path)
    read = lambda path: source.records(strings(path))
    terms = lambda path: source.terminology(strings(path))
    notes = lambda path: spark.read.parquet(path)
    policy = lambda: contracts.read_json(spark, a.policy)
    selected = lambda: benchmark.frozen_config(spark, a.policy)
    say = lambda value: print(json.dumps(value, default=str))
    put = lambda df, path: df.write.mode("overwrite").parquet(path)
    match a.command:
        case "split":
            read(a.records).withColumn("split", split_by_hash(F.col("record_id"), a.seed)).write.mode("overwrite").partitionBy("split").parquet(a.out)
        case "adapt":
            rows = source.single_code_corpus(strings(a.corpus))
            put(rows.withColumn("split", cross_source_split(F.col("source_dataset"), F.col("record_id"), getattr(a, "test_source"))), a.out)
        case "parse":
            put(source.standoff_annotations(spark, a.root), a.out)
            say(source.parse_stats(spark, a.root).first().asDict())
        case "notes":
            rows = source.multilabel_records(strings(a.notes), strings(a.diagnoses), strings(a.dictionary), a.min_frequency, max_notes=a.limit)
            put(rows.withColumn("split", split_by_hash(F.col("subject_id"), a.seed)), a.out)
        case "terminology":
            put(source.dictionary_terminology(strings(a.dictionary)), a.out)
        case "audit":
            rows = strings(a.records)
            audit = audits.audit_annotations(source.with_blank(rows, "mention", "gold_code"), terms(a.terminology))
            if a.out:
                audits.write_audit(audit, audits.review_sample(rows), a.out)
            row = audit.first()
            say(row.asDict())
            return 0 if row.ready else 2
        case "audit-notes":
            audit = audits.audit_notes(notes(a.notes), terms(a.terminology))
            if a.out:
                audits.write_audit(audit, audits.note_sample(notes(a.notes)), a.out)
            row = audit.first()
            say(row.asDict())
            return 0 if row.ready else 2
        case "benchmark":
            say(benchmark.single_label(read(a.records), terms(a.terminology), a.out, a.target, a.seed)["test"])
        case "candidates":
            say(benchmark.candidate_generation(read(a.records), a.out, a.seed)["delta"])
        case "end-to-end":
            say(jobs.end_to_end(read(a.records), selected(), out=a.out, target=a.target, seed=a.seed)["retrieval"])
        case "confirm":
            rows, frozen = read(a.records), selected()
            train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
            coder = retrieval.AliasCoder(frozen["history_weight"], frozen["word_weight"]).fit(train, source.train_terminology(train))
            result = benchmark.confirmed_policy(coder, test, train, a.limit or 1000, a.target, seed=a.seed, out=a.out)
            say({k: result[k] for k in ("confirmation", "release_eligible")})
            return 0 if result["release_eligible"] else 2
        case "multilabel":
            say(benchmark.multi_label(notes(a.notes), terms(a.terminology), a.out, a.target, seed=a.seed)["test"])
        case "predict":
            put(benchmark.predict_uncoded(read(a.history), terms(a.terminology), read(a.new), policy()), a.out)
        case "predict-explain":
            say(jobs.predict_and_explain(read(a.history), terms(a.terminology), read(a.new), policy(), a.out)[1])
        case "explain":
            say(jobs.explain_benchmark(read(a.records), terms(a.terminology), a.run, a.seed))
        case "explain-notes":
            say(jobs.explain_multilabel(notes(a.notes), terms(a.terminology), a.run))
        case "real":
            say(jobs.real_evaluation(read(a.records), out=a.out, target=a.target, seed=a.seed)["retrieval"])
        case "packets":
            pred = spark.read.parquet(f"{a.run}/predictions.parquet").select("record_id", "row_id", "confidence", "candidates")
            say(jobs.review_packets(pred.join(read(a.records).select("row_id", "text", "mention"), "row_id"), terms(a.terminology), a.out)[1])
        case "casebook":
            say({"cases": jobs.casebook(a.run, spark, a.limit or 40).count()})
        case "rationales":
            own = spark.read.parquet(a.explanations).select("record_id", F.col("predicted_code").alias("code"), F.explode("spans").alias("s")).select("record_id", "code", F.col("s.start").alias("s"), F.col("s.end").alias("e"))
            reference = source.with_blank(strings(a.reference), "quote").select("record_id", "code", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "quote")
            say(jobs.evaluate_rationales(own, reference, read(a.records), a.out))
        case "ratings":
            say({r["question"]: {"n": r["n_rated"], "positive_rate": r["positive_rate"]} for r in intervals.binary_ratings(strings(a.reviewed), *a.questions.split(",")).collect()})
        case "feedback":
            say(review.feedback_summary(spark.read.json(a.feedback)).first().asDict())
        case "bundle":
            if errors := jobs.audit_bundle(spark, a.run, a.release):
                say(errors)
                return 2
        case "compare":
            summary = contracts.dual_summary(spark, a.single, a.multi)
            contracts.write_json(spark, f"{a.out}/dual_benchmark_summary.json", summary)
            contracts.write_text(spark, f"{a.out}/dual_benchmark_summary.html", contracts.html_report("Two benchmarks, not pooled", {"benchmarks": summary["benchmarks"]}))
        case "publish":
            jobs.published(spark, a.run, a.out)
        case "validate":
            say(jobs.validated(spark, a.run))
    return 0


if __name__ == "__main__":
    sys.exit(main())
