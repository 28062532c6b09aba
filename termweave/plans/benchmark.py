"""Benchmark drivers: choose weights on VAL, freeze, measure once on TEST, and write the artifacts.

Component scores are computed once for each part and reused for every weight. All choices are made from small grouped
results; records never come to the driver. Tables are written by Spark, small artifacts through Hadoop's file systems.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.functions.hashing import fingerprint, sample, split_by_hash
from termweave.operators import advanced, contracts, evaluation, policy, retrieval
from termweave.sources.records import assert_group_disjoint, group_leaks, require_columns, row_keys, train_terminology, with_row_id

WEIGHTS = (0.0, 0.25, 0.5, 0.75, 1.0)
VERSION = "0.2"


def scored(coder, part: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with their query, component scores of the distinct query texts), both kept for reuse. A row of the part stays one row, however often its id repeats."""
    phrase = F.when(F.length("mention") > 0, F.col("mention")).otherwise(F.col("text"))
    named = retrieval.kept(part.select(*row_keys(part), "gold_code", phrase.alias("phrase")).withColumn("query", retrieval.text_key("phrase")))
    return named, retrieval.kept(coder.components(texts_of(named)))


def texts_of(named: DataFrame) -> DataFrame:
    return named.groupBy("query").agg(F.min("phrase").alias("text"))


def with_codes(named: DataFrame, top: DataFrame) -> DataFrame:
    """A row per row of `named`: phrase, gold_code, predicted_code, confidence, correct, candidates, codes. top: (query, rank, code, score)."""
    p = retrieval.predictions(top, "query").withColumn("codes", F.transform("candidates", lambda c: c["code"]))
    return named.select(*row_keys(named), "phrase", "gold_code", "query").join(p, "query").drop("query").withColumn("correct", (F.col("predicted_code") == F.col("gold_code")).cast("int"))


def predicted(coder, named: DataFrame, parts: DataFrame, weight: float, k: int) -> DataFrame:
    order = [F.desc(F.round("score", 12)), F.desc(F.round("terminology_score", 12)), F.col("row_seq")] if isinstance(coder, retrieval.AliasCoder) else None
    return with_codes(named, retrieval.ranked(coder.fused(parts, weight), coder.codes, named, k, order))


def split_into(records: DataFrame, seed: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(all, train, val, test), with row_ids; ValueError if one of them is empty or a record id lies in two."""
    records = with_row_id(records)
    if "split" not in records.columns:
        records = records.withColumn("split", split_by_hash(F.col("record_id"), seed))
    records = retrieval.kept(records)
    assert_group_disjoint(records, "record_id")
    parts = tuple(records.filter(F.col("split") == s) for s in ("train", "val", "test"))
    there = {r["split"] for r in records.select("split").distinct().collect()}
    if not {"train", "val", "test"} <= there:
        raise ValueError("train, val and test must all have records")
    return records, *parts


def grid(coder, part: DataFrame, weights=WEIGHTS, ks=(1, 5)) -> list[dict]:
    """Accuracy of every weight, best first: accuracy@1, then the wider ones, then the smaller weight."""
    named, parts = scored(coder, part)
    rows = [{"history_weight": w} | evaluation.accuracy_at_k(predicted(coder, named, parts, w, max(ks)), ks).first().asDict() for w in weights]
    return sorted(rows, key=lambda r: (*(-(r[f"accuracy_at_{k}"] or 0) for k in ks), r["history_weight"]))


def leaks(rows: DataFrame, group: str = "record_id") -> dict[str, int]:
    """How many groups each pair of splits shares, measured for all pairs."""
    by = group_leaks(rows, group).select(group).join(rows.select(group, "split").distinct(), group).groupBy(group).agg(F.collect_set("split").alias("s"))
    pairs = (("train", "val"), ("train", "test"), ("val", "test"))
    return by.agg(*[F.count_if(F.array_contains("s", a) & F.array_contains("s", b)).alias(f"{a}-{b}") for a, b in pairs]).first().asDict()


def reported(spark, out: str | None, result: dict, tables: dict[str, DataFrame], frozen: dict, contract, shared: dict, records: DataFrame, terms: DataFrame, seed: int, extra: dict | None = None, charts: dict | None = None) -> dict:
    """Add the contract to the metrics and write a run's artifacts."""
    result["results_status"], result["results_reportable"] = contract.status, contract.reportable
    if out:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{out}/{name}.parquet")
        prints = {f"{n}_fingerprint": {k: v if isinstance(v, str) else int(v) for k, v in fingerprint(df).first().asDict().items()} for n, df in (("records", records), ("terminology", terms))}
        small = {
            "metrics": result, "frozen_policy": {"version": VERSION} | frozen, "results_contract": contract.to_dict(), "leakage_audit": shared, "data_fingerprints": prints,
            "experiment_manifest": {"version": VERSION, "seed": seed, "selection_protocol": "validation_only", "test_used_for_selection_or_tuning": False}, **(extra or {}),
        }
        for name, value in small.items():
            contracts.write_json(spark, f"{out}/{name}.json", value)
        contracts.write_text(spark, f"{out}/report.html", contracts.html_report("Benchmark", {"selection": result.get("selection", []), "test": [result["test"]]}, charts))
        contracts.write_text(spark, f"{out}/card.md", contracts.card("Benchmark", {"policy": frozen, "leaks": shared}))
    return result


def single_label(records: DataFrame, terms: DataFrame, out: str | None = None, target: float = 0.95, seed: int = 42, k: int = 10, weights=WEIGHTS, dictionary_source: str = "external", real_data: bool = True) -> dict:
    """The single-label benchmark. Records: record_id, text, mention, gold_code, row_seq and optionally split."""
    require_columns(records, {"record_id", "text", "mention", "gold_code", "row_seq"})
    records, train, val, test = split_into(records, seed)
    coder = retrieval.HistoricalCoder(0.5, k).fit(train, terms)
    table = grid(coder, val, weights, (1, 5))
    weight = table[0]["history_weight"]
    return measured(coder, lambda named, parts, w=weight: predicted(coder, named, parts, w, k), table, {"model_type": "lexical_historical", "history_weight": weight}, records, (train, val, test), terms, out, target, seed, k, dictionary_source, real_data)


def measured(coder, of: Callable, table: list[dict], frozen: dict, records: DataFrame, split: tuple, terms: DataFrame, out: str | None, target: float, seed: int, k: int, dictionary_source: str, real_data: bool) -> dict:
    """Threshold on VAL, then everything that is measured on TEST. of(named, parts): the chosen model's predictions."""
    train, val, test = split
    on_val = retrieval.kept(of(*scored(coder, val)))
    chosen = evaluation.threshold_max_coverage(on_val, target).first()
    threshold = chosen.threshold if chosen else None
    named, parts = scored(coder, test)
    decision = F.when(F.col("confidence") >= threshold, "AUTO_CANDIDATE").otherwise("HUMAN_REVIEW") if threshold is not None else F.lit("HUMAN_REVIEW")
    on_test = retrieval.kept(of(named, parts).withColumn("decision", decision))
    base = predicted(coder, named, parts, 0.0, k)
    diag = evaluation.diagnostics(on_test, train.select(F.col("gold_code").alias("code")), k)
    shared = leaks(records)
    frozen = frozen | {"decision_threshold": threshold, "target_auto_accuracy": target, "threshold_selection_rule": "max_validation_coverage_subject_to_target_accuracy"}
    c = contracts.contract(dictionary_source, real_data, shared, False)
    first, plain = (evaluation.metric_block(p, ks=(5, k)).first().asDict() for p in (on_test, base))
    auto = policy.apply_threshold(on_test, threshold).first().asDict()
    result = {
        "selection": table, "policy": frozen, "leaks": shared, "contract": c.to_dict(), "test": first, "terminology_only": plain, "accuracy_at_1": first["acc_at_1"], "accuracy_at_5": first["recall_at_5"], "automatic": auto,
        "auto_candidate_rate": auto["coverage"], "auto_candidate_accuracy": auto["accuracy"], "accuracy_delta": (first["acc_at_1"] or 0) - (plain["acc_at_1"] or 0), "subgroups": [r.asDict() for r in evaluation.subgroup_metrics(diag).collect()],
        "failures": [r.asDict() for r in evaluation.failure_summary(diag).collect()], "stress": [r.asDict() for r in evaluation.policy_stress(on_val, on_test).collect()],
    }
    tables = {"predictions": diag, "validation_predictions": on_val, "terminology_only_test_predictions": base, "coverage_curve": evaluation.coverage_curve(on_test), "error_analysis": diag.filter("correct = 0")}
    extra = {"historical_memory_value": {"terminology_only_test_accuracy_at_1": plain["acc_at_1"], "selected_test_accuracy_at_1": first["acc_at_1"], "accuracy_at_1_delta": result["accuracy_delta"]}}
    charts = {"Accuracy of what is automatic, by coverage": evaluation.curve_points(tables["coverage_curve"])} if out else None
    return reported(records.sparkSession, out, result, tables, frozen, c, shared, records, terms, seed, extra, charts)


def advanced_benchmark(records: DataFrame, terms: DataFrame, out: str | None = None, target: float = 0.95, seed: int = 42, encoders: dict[str, Callable] | None = None, rerankers: dict[str, Callable] | None = None, k: int = 10, real_data: bool = True) -> dict:
    """The single-label benchmark with models chosen in stages on VAL: history weight, then dense weight, then reranker weight.

    encoders and rerankers: at most one callable each, by its name. Within a stage accuracy@1 decides, then
    accuracy@5, then the simpler model. One lexical index and one dense index serve all stages.
    """
    require_columns(records, {"record_id", "text", "mention", "gold_code", "row_seq"})
    records, train, val, test = split_into(records, seed)
    lexical = retrieval.HistoricalCoder(0.5, 50).fit(train, terms)
    named, parts = scored(lexical, val)
    (encoder, encode), (scorer, score) = (next(iter((m or {}).items()), (None, None)) for m in (encoders, rerankers))
    dense = advanced.DenseIndex(encode).fit(train, terms) if encode else None
    rows: list[dict] = []

    def model(c: advanced.Config) -> advanced.AdvancedCoder:
        return advanced.AdvancedCoder(c, k, dense=dense, reranker=score).fit(train, terms, lexical)

    def of(c: advanced.Config, named: DataFrame, parts: DataFrame) -> DataFrame:
        if not c.dense_weight and not c.reranker_weight:
            return predicted(lexical, named, parts, c.history_weight, k)
        return with_codes(named, model(c).ranked(texts_of(named), parts))

    def best(stage: str, configs: list[advanced.Config], known: list[tuple] = ()) -> advanced.Config:
        tried = list(known)
        for c in configs:
            m = evaluation.accuracy_at_k(of(c, named, parts), (1, 5)).first()
            tried.append((c, m.accuracy_at_1 or 0.0, m.accuracy_at_5 or 0.0))
            rows.append({"stage": stage, "history_weight": c.history_weight, "dense_weight": c.dense_weight, "reranker_weight": c.reranker_weight, "val_accuracy_at_1": m.accuracy_at_1, "val_accuracy_at_5": m.accuracy_at_5, "complexity_rank": 2 if c.reranker_weight else int(c.dense_weight > 0)})
        tried.sort(key=lambda x: (-x[1], -x[2], x[0].complexity()))
        last.append(tried[0])
        return tried[0][0]

    last: list[tuple] = []
    config = best("lexical_history", [advanced.Config(w) for w in WEIGHTS])
    if encode:
        config = best("dense_fusion", [advanced.Config(config.history_weight, w) for w in (0.25, 0.5, 0.75, 1.0)], last[-1:])
    if score:
        config = best("cross_encoder_fusion", [advanced.Config(config.history_weight, config.dense_weight, w) for w in (0.25, 0.5, 0.75)], last[-1:])
    frozen = {
        "model_type": "advanced_singlelabel", "history_weight": config.history_weight, "dense_weight": config.dense_weight, "reranker_weight": config.reranker_weight, "dense_model_name": encoder, "cross_encoder_model_name": scorer,
    }
    return measured(lexical, lambda named, parts: with_codes(named, model(config).ranked(texts_of(named), parts)), rows, frozen, records, (train, val, test), terms, out, target, seed, k, "external", real_data)


def candidate_generation(records: DataFrame, out: str | None = None, seed: int = 20260723, train_limit: int | None = None, val_limit: int | None = None, test_limit: int | None = None, k: int = 50, baseline_weights=(0.0, 0.5, 1.0), weights=(0.25, 0.5, 0.75), word_weights=(0.15, 0.35)) -> dict:
    """Single-term retrieval against alias-aware hybrids over a dictionary out of the training part alone.

    Records: record_id, text, mention, gold_code, row_seq, split. The baseline's weight goes by accuracy@1, then
    recall@5, then the smaller weight; the hybrid's by recall@5, recall@20, accuracy@1, then the smaller weights, all on
    VAL. TEST is measured once, with codes and wordings that training has or not as subgroups.
    """
    records, train_full, val_full, test_full = split_into(require_columns(records, {"record_id", "text", "mention", "gold_code", "row_seq"}), seed)
    some = lambda df, n, shift: df if not n else retrieval.kept(sample(df, n, F.col("record_id"), seed + shift))
    train, val, test = some(train_full, train_limit, 0), some(val_full, val_limit, 1), some(test_full, test_limit, 2)
    terms = retrieval.kept(train_terminology(train_full, 50))
    base, hybrid = retrieval.HistoricalCoder(0.5, k).fit(train, terms), retrieval.AliasCoder(0.5, 0.2, k).fit(train, terms)
    named, parts = scored(base, val)
    rows = []
    for w in baseline_weights:
        m = evaluation.metric_block(predicted(base, named, parts, w, k), ks=(5, 20, 50)).first()
        rows.append({"model": "single_term", "history_weight": w, "word_weight": None, "val_accuracy_at_1": m.acc_at_1, "val_recall_at_5": m.recall_at_5, "val_recall_at_20": m.recall_at_20})
    first = min(rows, key=lambda r: (-r["val_accuracy_at_1"], -r["val_recall_at_5"], r["history_weight"]))
    hybrids = []
    for ww in word_weights:  # a product for each word weight, as it decides which alias stands for a code
        hybrid.ww = ww
        parts = retrieval.kept(hybrid.components(texts_of(named)))
        for w in weights:
            m = evaluation.metric_block(predicted(hybrid, named, parts, w, k), ks=(5, 20, 50)).first()
            hybrids.append({"model": "alias_aware_hybrid", "history_weight": w, "word_weight": ww, "val_accuracy_at_1": m.acc_at_1, "val_recall_at_5": m.recall_at_5, "val_recall_at_20": m.recall_at_20})
    second = min(hybrids, key=lambda r: (-r["val_recall_at_5"], -r["val_recall_at_20"], -r["val_accuracy_at_1"], r["history_weight"], r["word_weight"]))
    hybrid.hw, hybrid.ww = second["history_weight"], second["word_weight"]
    seen, aliases = train_full.select(F.col("gold_code").alias("code")), advanced.train_alias_map(train_full)
    a = retrieval.kept(predicted(base, *scored(base, test), first["history_weight"], k))
    b = retrieval.kept(predicted(hybrid, *scored(hybrid, test), second["history_weight"], k))
    blocks = {n: {r["subgroup"]: r.asDict() for r in evaluation.candidate_blocks(p, seen, aliases).collect()} for n, p in (("baseline", a), ("hybrid", b))}
    keys = [c for c in blocks["baseline"]["all"] if c.startswith(("acc_", "recall_", "mrr"))]
    result = {
        "selection": rows + hybrids, "selected_baseline": {"history_weight": first["history_weight"]}, "selected_v2": {"history_weight": second["history_weight"], "word_weight": second["word_weight"]}, "baseline": blocks["baseline"], "hybrid": blocks["hybrid"],
        "test": blocks["hybrid"]["all"], "delta": {f"{c}_delta": (blocks["hybrid"]["all"][c] or 0) - (blocks["baseline"]["all"][c] or 0) for c in keys}, "n": {n: df.count() for n, df in (("train", train), ("val", val), ("test", test))},
        "candidate_space": "TRAIN-derived code aliases; closed-code diagnostic",
    }
    if out:
        spark, merged = records.sparkSession, evaluation.merged_predictions(a, b)
        merged.write.mode("overwrite").parquet(f"{out}/candidate_generation_predictions.parquet")
        evaluation.candidate_failures(merged).coalesce(1).write.mode("overwrite").json(f"{out}/candidate_failure_examples.jsonl")
        contracts.write_json(spark, f"{out}/candidate_generation_results.json", result)
        contracts.write_text(spark, f"{out}/report.html", contracts.html_report("Candidate generation", {"selection": result["selection"], "test": list(blocks["hybrid"].values())}))
    return result


def multi_label(records: DataFrame, terms: DataFrame, out: str | None = None, target: float = 0.95, k: int = 100, weights=WEIGHTS, real_data: bool = True, seed: int = 42) -> dict:
    """The benchmark of several labels. Records: record_id, subject_id, text, gold_codes, split; no subject may lie in two splits.

    The threshold decides about single code proposals, not about whole notes.
    """
    records = retrieval.kept(require_columns(records, {"record_id", "subject_id", "text", "gold_codes", "split"}))
    assert_group_disjoint(records, "subject_id")
    train, val, test = (records.filter(F.col("split") == s) for s in ("train", "val", "test"))
    coder = retrieval.MultiLabelCoder(0.5, k).fit(train, terms)

    def ranked(part: DataFrame, w: float) -> DataFrame:
        coder.weight = w
        item = F.array_sort(F.collect_list(F.struct("rank", "code", "score")))
        lists = coder.rank(part).groupBy("record_id").agg(F.transform(item, lambda x: F.struct(x["code"].alias("code"), x["score"].alias("score"))).alias("candidates"))
        return retrieval.kept(part.select("record_id", F.col("gold_codes").alias("gold")).join(lists, "record_id"))

    table = [{"history_weight": w} | evaluation.ranking_metrics(ranked(val, w)).first().asDict() for w in weights]
    weight = min(table, key=lambda r: (-(r["recall_at_10"] or 0), -(r["precision_at_10"] or 0), r["history_weight"]))["history_weight"]
    on_val, on_test, base = ranked(val, weight), ranked(test, weight), ranked(test, 0.0)
    chosen = evaluation.threshold_max_recall(on_val, target).first()
    threshold = chosen.threshold if chosen else None
    first, plain = (evaluation.ranking_metrics(p).first().asDict() for p in (on_test, base))
    proposals = evaluation.threshold_metrics(on_test, threshold).first().asDict() if chosen else None
    shared = leaks(records, "subject_id")
    c = contracts.contract("authorised_icd_dictionary", real_data, shared, False)
    frozen = {"task_type": contracts.MULTIPLE.task_type, "history_weight": weight, "code_proposal_threshold": threshold, "target_code_proposal_precision": target, "policy_unit": "individual_code_proposal", "full_note_automation_claim_allowed": False}
    none = {"micro_precision": None, "micro_recall": 0.0, "micro_f1": 0.0, "macro_f1": 0.0, "exact_match": 0.0, "n_proposals": 0, "mean_proposals": 0.0}
    result = first | {f"selective_{n}": v for n, v in (proposals or none).items()} | {
        "selection": table, "policy": frozen, "leaks": shared, "test": first, "proposals": proposals, "terminology_only_recall_at_10": plain["recall_at_10"], "historical_memory_recall_at_10_delta": (first["recall_at_10"] or 0) - (plain["recall_at_10"] or 0),
        "novelty": [r.asDict() for r in evaluation.novelty_recall(on_test, train.select(F.explode("gold_codes").alias("code"))).collect()], "stress": evaluation.multilabel_stress(on_val, on_test),
    }
    tables = {"predictions": on_test, "validation_predictions": on_val, "terminology_only_test_predictions": base}
    return reported(records.sparkSession, out, result, tables, frozen, c, shared, records, terms, seed, {"benchmark_profile": contracts.asdict(contracts.MULTIPLE), "code_proposal_policy_stress": result["stress"]})


def confirmed_policy(coder, pool: DataFrame, used: DataFrame, n: int, target: float = 0.95, alpha: float = 0.05, seed: int = 42, k: int = 50, min_auto: int = 20, targets=(0.90, 0.95, 0.98, 0.99), out: str | None = None) -> dict:
    """Calibrate a threshold on n rows that nothing was chosen on, and confirm it on n others; only a confirmed policy may be released.

    For each of `targets` the same is done under stress: a threshold on the first rows, and what it gives on the second.
    """
    fresh = pool.join(used.select("record_id"), "record_id", "left_anti")
    first = retrieval.kept(sample(fresh, n, F.col("record_id"), seed))
    second = retrieval.kept(sample(fresh.join(first.select("record_id"), "record_id", "left_anti"), n, F.col("record_id"), seed + 1))
    overlap = {name: x.join(y.select("record_id"), "record_id", "left_semi").count() for name, x, y in (("prior_vs_calibration", first, used), ("prior_vs_confirmatory", second, used), ("calibration_vs_confirmatory", first, second))}
    if any(overlap.values()):
        raise RuntimeError(f"The parts overlap: {overlap}")
    weight = coder.hw if isinstance(coder, retrieval.AliasCoder) else coder.weight
    a, b = (retrieval.kept(predicted(coder, *scored(coder, part), weight, k)) for part in (first, second))

    def at(t: float) -> dict:
        chosen = policy.threshold_by_lower_bound(a, t, alpha, min_auto).first()
        got = policy.apply_threshold(b, chosen.threshold if chosen else None).first().asDict()
        met = chosen is not None and got["accuracy"] is not None and got["accuracy"] + evaluation.SLACK >= t
        return {"target": t, "calibration": chosen.asDict() if chosen else None, "confirmation": got, "target_met": met}

    result = at(target)
    result = result | {"release_eligible": result["target_met"], "partition_overlap": overlap, "stress": [at(t) for t in targets]}
    if out:
        contracts.write_json(pool.sparkSession, f"{out}/target_domain_policy_results.json", result)
    return result


def frozen_config(spark, path: str) -> dict[str, float]:
    """history_weight and word_weight that an earlier run has frozen: of a result's selected hybrid, or of a policy itself. KeyError where one is missing."""
    value = contracts.read_json(spark, path)
    own = value.get("selected_v2", value)
    return {n: float(own[n]) for n in ("history_weight", "word_weight")}


def predict_uncoded(history: DataFrame, terms: DataFrame, new: DataFrame, frozen: dict, k: int = 10, trained: dict[str, Callable] | None = None) -> DataFrame:
    """Predictions of uncoded records under a frozen policy, one for each row: AUTO_CANDIDATE from its threshold on, else HUMAN_REVIEW.

    The model is the one that the policy names; `trained` has the encoders and rerankers by their names.
    """
    coder = advanced.from_policy(frozen, trained, k).fit(history, terms)
    p = retrieval.predictions(coder.predict(new))
    t = frozen.get("decision_threshold")
    return p.withColumn("decision", F.when(F.col("confidence") >= t, "AUTO_CANDIDATE").otherwise("HUMAN_REVIEW") if t is not None else F.lit("HUMAN_REVIEW"))
