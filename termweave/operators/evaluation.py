"""Evaluation of ranked candidates, as grouped sums and windows over small keys.

Predictions are a row per record: gold_code, predicted_code, confidence, and `codes`, the candidates in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termweave.sources.records import row_keys

ERRORS = ("correct", "candidate_generation_failure", "ranking_failure")
SLACK = 1e-12


def candidate_codes(json: Column | str) -> Column:
    """Codes out of JSON: an array of objects with `code`, or of strings; anything else gives none."""
    c = F.col(json) if isinstance(json, str) else json
    objects = F.from_json(c, "array<struct<code:string>>")
    return F.coalesce(F.transform(objects, lambda x: x["code"]), F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def parsed_scores(json: Column | str) -> Column:
    """(code, score) structs out of JSON, a missing score as 0; anything malformed gives none."""
    c = F.col(json) if isinstance(json, str) else json
    rows = F.from_json(c, "array<struct<code:string,score:double>>")
    return F.coalesce(F.transform(rows, lambda x: F.struct(x["code"].alias("code"), F.coalesce(x["score"], F.lit(0.0)).alias("score"))), F.array().cast("array<struct<code:string,score:double>>"))


def found_at(k: int) -> Column:
    """Whether the gold code is among the first k."""
    return F.array_contains(F.slice("codes", 1, k), F.col("gold_code")).cast("int")


def gold_rank(k: int) -> Column:
    return F.nullif(F.array_position(F.slice("codes", 1, k), F.col("gold_code")), F.lit(0))


def accuracy_at_k(pred: DataFrame, ks=(1, 3, 5, 10)) -> DataFrame:
    """Share of records whose gold code is among the first k; null without records."""
    return pred.agg(F.count(F.lit(1)).alias("n"), *[F.avg(found_at(k)).alias(f"accuracy_at_{k}") for k in ks])


def metric_block(pred: DataFrame, group: str | None = None, ks=(5, 20, 50)) -> DataFrame:
    """accuracy@1, recall@k, candidate failures@k and the mean reciprocal rank within the first 50."""
    rr = F.coalesce(1.0 / gold_rank(max(ks)), F.lit(0.0))
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(found_at(1)).alias("acc_at_1"), *[F.avg(found_at(k)).alias(f"recall_at_{k}") for k in ks], *[F.sum(1 - found_at(k)).alias(f"failures_at_{k}") for k in ks], F.avg(rr).alias("mrr")]
    return (pred.groupBy(group) if group else pred).agg(*aggs)


def candidate_blocks(pred: DataFrame, seen: DataFrame, aliases: DataFrame, ks=(5, 20, 50)) -> DataFrame:
    """metric_block for all records and for four subgroups: codes seen in training or not, and wordings that training has for the code or not.

    pred: gold_code, codes, phrase; seen: code; aliases: (code, alias) of train_alias_map. An empty group has n = 0.
    """
    known = seen.select(F.col("code").alias("gold_code")).distinct().withColumn("_seen", F.lit(True))
    worded = aliases.select(F.col("code").alias("gold_code"), F.col("alias").alias("_alias")).distinct().withColumn("_exact", F.lit(True))
    rows = pred.withColumn("_alias", F.lower(F.trim("phrase"))).join(known, "gold_code", "left").join(worded, ["gold_code", "_alias"], "left")
    # The names of the subgroups.
    names = ("all", "seen_code", "unseen_code", "exact_gold_alias_seen_in_train", "novel_gold_wording")
    groups = F.array(F.lit(names[0]), F.when(F.col("_seen").isNotNull(), names[1]).otherwise(names[2]), F.when(F.col("_exact").isNotNull(), names[3]).otherwise(names[4]))
    got = metric_block(rows.withColumn("subgroup", F.explode(groups)), "subgroup", ks)
    return labels(pred.sparkSession, "subgroup", names).join(got, "subgroup", "left").fillna(0, ["n"])


def merged_predictions(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two systems' predictions of the same records side by side. Both: record_id, phrase, gold_code, predicted_code, correct, codes."""
    keys = row_keys(first)
    side = lambda df, name: df.select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in ("predicted_code", "correct", "codes")])
    return first.select(*keys, "phrase", "gold_code").join(side(first, "baseline"), keys).join(side(second, "v2"), keys)


def candidate_failures(merged: DataFrame, k: int = 5, most: int | None = 100) -> DataFrame:
    """Records whose gold code is not among the first k of one system or the other; the first `most` in the order of their ids."""
    tops = [F.slice(f"{n}_codes", 1, k).alias(f"{n}_top{k}") for n in ("baseline", "v2")]
    inside = [F.array_contains(F.slice(f"{n}_codes", 1, k), F.col("gold_code")).alias(f"{n}_gold_in_top{k}") for n in ("baseline", "v2")]
    rows = merged.select(*row_keys(merged), "phrase", "gold_code", *inside, *tops).filter(f"not baseline_gold_in_top{k} or not v2_gold_in_top{k}")
    return rows if most is None else rows.orderBy(*row_keys(rows)).limit(most)


def multilabel_stress(val: DataFrame, test: DataFrame, targets=(0.90, 0.95, 0.98, 0.99)) -> list[dict]:
    """For each target precision the threshold chosen on VAL and what it gives on TEST; without a threshold nothing is proposed."""
    out = []
    for target in targets:
        chosen = threshold_max_recall(val, target).first()
        m = threshold_metrics(test, chosen.threshold).first() if chosen else None
        out.append({
            "target_precision": target, "validation_threshold": chosen.threshold if chosen else None, "test_micro_precision": m.micro_precision if m else None, "test_micro_recall": m.micro_recall if m else 0.0,
            "test_micro_f1": m.micro_f1 if m else 0.0, "test_mean_code_proposals_per_note": m.mean_proposals if m else 0.0, "target_met_on_test": bool(m) and m.micro_precision + SLACK >= target,
        })
    return out


def coverage_accuracy(pred: DataFrame, threshold: float) -> DataFrame:
    auto = F.col("confidence") >= threshold
    return pred.agg(F.count_if(auto).alias("n_auto"), F.avg(auto.cast("int")).alias("coverage"), F.avg(F.when(auto, F.col("correct"))).alias("accuracy"))


def diagnostics(pred: DataFrame, seen: DataFrame, k: int = 10) -> DataFrame:
    """gold_candidate_rank (null outside the first k), code_novelty and error_type; seen: the codes of the training part."""
    known = seen.select("code").distinct().withColumn("_seen", F.lit(1))
    rows = pred.join(known, F.col("gold_code") == F.col("code"), "left").drop("code")
    rank = gold_rank(k)
    error = F.when(F.col("predicted_code") == F.col("gold_code"), ERRORS[0]).when(rank.isNull(), ERRORS[1]).otherwise(ERRORS[2])
    return rows.withColumn("gold_candidate_rank", rank).withColumn("code_novelty", F.when(F.col("_seen").isNull(), "unseen_code").otherwise("seen_code")).withColumn("error_type", error).drop("_seen")


def labels(spark, name: str, values) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def subgroup_metrics(diag: DataFrame) -> DataFrame:
    """all, seen_code and unseen_code: n, accuracy@1, recall@5 and recall@10; an empty group has n = 0 and nulls."""
    named = diag.select(F.explode(F.array(F.lit("all"), "code_novelty")).alias("subgroup"), found_at(5).alias("r5"), found_at(10).alias("r10"), (F.col("predicted_code") == F.col("gold_code")).cast("int").alias("ok"))
    got = named.groupBy("subgroup").agg(F.count(F.lit(1)).alias("n"), F.avg("ok").alias("acc_at_1"), F.avg("r5").alias("recall_at_5"), F.avg("r10").alias("recall_at_10"))
    return labels(diag.sparkSession, "subgroup", ("all", "seen_code", "unseen_code")).join(got, "subgroup", "left").fillna(0, ["n"])


def failure_summary(diag: DataFrame) -> DataFrame:
    """n and rate of each error type in each subgroup, zeros kept."""
    spark = diag.sparkSession
    named = diag.select(F.explode(F.array(F.lit("all"), "code_novelty")).alias("subgroup"), "error_type")
    got = named.groupBy("subgroup", "error_type").agg(F.count(F.lit(1)).alias("n"))
    total = got.groupBy("subgroup").agg(F.sum("n").alias("total"))
    grid = labels(spark, "subgroup", ("all", "seen_code", "unseen_code")).crossJoin(labels(spark, "error_type", ERRORS))
    rows = grid.join(got, ["subgroup", "error_type"], "left").join(total, "subgroup", "left").fillna(0, ["n", "total"])
    return rows.select("subgroup", "error_type", "n", F.when(F.col("total") > 0, F.col("n") / F.nullif("total", F.lit(0))).otherwise(0.0).alias("rate"))


def coverage_curve(pred: DataFrame) -> DataFrame:
    """Per distinct confidence, from the highest: how many records reach it, their share and accuracy.

    Rows without a confidence are left out; a missing `correct` counts as 0. Counts are made per confidence first, so
    the running sums go over distinct confidences alone, in blocks: a sum inside each block and one over the blocks.
    """
    rows = pred.filter(F.col("confidence").isNotNull() & ~F.isnan("confidence"))
    per = rows.groupBy(F.col("confidence").alias("threshold")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("correct", F.lit(0))).alias("ok"))
    # Confidences lie between 0 and 1; others fall into the first or last block
    per = per.withColumn("block", F.least(F.greatest(F.floor(F.col("threshold") * 1024), F.lit(-1)), F.lit(1025)))
    sums = per.groupBy("block").agg(F.sum("n").alias("bn"), F.sum("ok").alias("bok"))
    down = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, W.currentRow)  # 1027 rows at most
    sums = sums.select("block", (F.sum("bn").over(down) - F.col("bn")).alias("bn"), (F.sum("bok").over(down) - F.col("bok")).alias("bok"))
    total = per.agg(F.sum("n").alias("total"))
    inside = W.partitionBy("block").orderBy(F.desc("threshold")).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = per.join(F.broadcast(sums), "block").select("threshold", (F.col("bn") + F.sum("n").over(inside)).alias("n_auto"), (F.col("bok") + F.sum("ok").over(inside)).alias("n_correct"))
    return out.crossJoin(F.broadcast(total)).select("threshold", "n_auto", "n_correct", (F.col("n_auto") / F.col("total")).alias("coverage"), (F.col("n_correct") / F.col("n_auto")).alias("accuracy"))


def curve_points(curve: DataFrame, n: int = 100) -> list[tuple[float, float]]:
    """(coverage, accuracy) of a coverage curve for a chart: of each hundredth of coverage the last point, so `n` + 1 at most."""
    rows = curve.groupBy(F.floor(F.col("coverage") * n).alias("b")).agg(F.max(F.struct("coverage", "accuracy")).alias("p")).orderBy("b")
    return [(r["p"]["coverage"], r["p"]["accuracy"]) for r in rows.collect()]


def metric_for(table: DataFrame, subgroup: str, metric: str) -> float | None:
    """A metric of a subgroup, None where the group, its row or the value is missing."""
    if metric not in table.columns:
        return None
    row = table.filter(F.col("subgroup") == subgroup).select(F.col(metric).cast("double").alias("v")).first()
    return None if row is None else row["v"]


def threshold_max_coverage(pred: DataFrame, target: float) -> DataFrame:
    """The threshold of most records whose accuracy reaches the target; no row where none does."""
    return coverage_curve(pred).filter(F.col("accuracy") + SLACK >= target).orderBy(F.desc("n_auto"), F.desc("accuracy"), "threshold").limit(1)


def policy_stress(val: DataFrame, test: DataFrame, targets=(0.90, 0.95, 0.98, 0.99)) -> DataFrame:
    """For each target the threshold chosen on VAL and what it gives on TEST; coverage counts all rows of TEST."""
    spark = val.sparkSession
    wanted = spark.createDataFrame([(float(t),) for t in targets], "target double")
    curve = coverage_curve(val).join(F.broadcast(wanted), F.col("accuracy") + SLACK >= F.col("target"))
    best = curve.groupBy("target").agg(F.max_by(F.struct("threshold", "n_auto", "accuracy"), F.struct("n_auto", "accuracy", -F.col("threshold"))).alias("b"))
    chosen = wanted.join(best, "target", "left").select("target", F.col("b.threshold").alias("threshold"), F.col("b.n_auto").alias("val_n_auto"))
    auto = F.col("confidence") >= F.col("threshold")
    got = test.join(F.broadcast(chosen)).groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.count_if(auto).alias("test_n_auto"), F.avg(F.when(auto, F.coalesce("correct", F.lit(0)))).alias("test_accuracy"))
    rows = chosen.join(got, "target", "left")
    return rows.select("target", "threshold", "val_n_auto", F.coalesce("test_n_auto", F.lit(0)).alias("test_n_auto"), (F.coalesce("test_n_auto", F.lit(0)) / F.nullif("n", F.lit(0))).alias("test_coverage"), "test_accuracy", F.coalesce(F.col("test_accuracy") + SLACK >= F.col("target"), F.lit(False)).alias("target_met"))


# Several labels: rows of record_id, gold (array of codes) and candidates (array of code and score, in order)


def ranking_metrics(pred: DataFrame, ks=(5, 10, 20)) -> DataFrame:
    """Mean precision@k (over what is there, not k) and recall@k, and the number of notes."""
    gold = F.array_distinct("gold")
    aggs = [F.count(F.lit(1)).alias("n_notes")]
    for k in ks:
        first = F.array_distinct(F.slice(F.transform("candidates", lambda c: c["code"]), 1, k))
        hits = F.size(F.array_intersect(first, gold))
        aggs += [F.avg(hits / F.greatest(F.size(F.slice("candidates", 1, k)), F.lit(1))).alias(f"precision_at_{k}"), F.avg(hits / F.greatest(F.size(gold), F.lit(1))).alias(f"recall_at_{k}")]
    return pred.agg(*aggs)


def threshold_metrics(pred: DataFrame, threshold: float) -> DataFrame:
    """Micro precision, recall and F1, mean F1 of the notes, exact match and proposals at a threshold."""
    gold = F.array_remove(F.array_distinct("gold"), "")
    own = F.array_remove(F.array_distinct(F.transform(F.filter("candidates", lambda c: F.coalesce(c["score"], F.lit(0.0)) >= threshold), lambda c: c["code"])), "")
    rows = pred.select(F.size(gold).alias("g"), F.size(own).alias("p"), F.size(F.array_intersect(gold, own)).alias("tp"))
    f1 = F.when(F.col("g") + F.col("p") > 0, 2.0 * F.col("tp") / F.nullif(F.col("g") + F.col("p"), F.lit(0))).otherwise(0.0)
    out = rows.agg(F.count(F.lit(1)).alias("n_notes"), F.sum("tp").alias("tp"), F.sum("p").alias("n_proposals"), F.sum("g").alias("n_gold"), F.avg(f1).alias("macro_f1"), F.avg(((F.col("tp") == F.col("g")) & (F.col("tp") == F.col("p"))).cast("int")).alias("exact_match"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.nullif(b, F.lit(0))).otherwise(0.0)
    p, r = share("tp", "n_proposals"), share("tp", "n_gold")
    both = F.col("n_proposals") + F.col("n_gold")
    return out.select("n_notes", p.alias("micro_precision"), r.alias("micro_recall"), F.when(both > 0, 2.0 * F.col("tp") / F.nullif(both, F.lit(0))).otherwise(0.0).alias("micro_f1"), "macro_f1", "exact_match", "n_proposals", (F.col("n_proposals") / F.nullif("n_notes", F.lit(0))).alias("mean_proposals"))


def threshold_max_recall(pred: DataFrame, target_precision: float = 0.95) -> DataFrame:
    """The score threshold of the highest recall whose micro precision reaches the target; ties: precision, then the higher threshold."""
    pairs = pred.select("record_id", "gold", F.explode("candidates").alias("c")).filter("c.code <> ''").groupBy("record_id", F.col("c.code").alias("code")).agg(F.max(F.coalesce("c.score", F.lit(0.0))).alias("confidence"), F.max(F.array_contains("gold", F.col("c.code")).cast("int")).alias("correct"))
    n_gold = pred.agg(F.sum(F.size(F.array_remove(F.array_distinct("gold"), ""))).alias("n_gold"))
    rows = coverage_curve(pairs).filter(F.col("accuracy") + SLACK >= target_precision).crossJoin(F.broadcast(n_gold))
    rows = rows.select("threshold", F.col("n_auto").alias("n_proposals"), F.col("accuracy").alias("precision"), (F.col("n_correct") / F.nullif("n_gold", F.lit(0))).alias("recall"))
    return rows.orderBy(F.desc("recall"), F.desc("n_proposals"), F.desc("precision"), F.desc("threshold")).limit(1)


def novelty_recall(pred: DataFrame, seen: DataFrame, k: int = 10) -> DataFrame:
    """Recall@k of gold codes that were seen in training and of those that were not."""
    first = F.slice(F.transform("candidates", lambda c: c["code"]), 1, k)
    gold = pred.select(F.explode(F.array_distinct("gold")).alias("code"), first.alias("first")).select("code", F.array_contains("first", F.col("code")).cast("int").alias("hit"))
    known = seen.select("code").distinct().withColumn("_s", F.lit(1))
    novelty = F.when(F.col("_s").isNull(), "unseen_code").otherwise("seen_code")
    return gold.join(known, "code", "left").groupBy(novelty.alias("code_novelty")).agg(F.count(F.lit(1)).alias("n_gold"), F.avg("hit").alias(f"recall_at_{k}"))


def route_metrics(pred: DataFrame) -> DataFrame:
    """Per route: n, share of all, accuracy@1 and recall@5."""
    total = pred.agg(F.count(F.lit(1)).alias("total"))
    got = pred.groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.avg(found_at(1)).alias("acc_at_1"), F.avg(found_at(5)).alias("recall_at_5"))
    return got.crossJoin(F.broadcast(total)).select("route", "n", (F.col("n") / F.col("total")).alias("coverage"), "acc_at_1", "recall_at_5")


def paired_comparison(pairs: DataFrame) -> DataFrame:
    """Two systems on the same records: (gold_code, before, after, accepted). Corrected, harmed, and accuracies."""
    b, a = (F.col("before") == F.col("gold_code")).cast("int"), (F.col("after") == F.col("gold_code")).cast("int")
    ok = F.col("accepted")
    return pairs.agg(F.count(F.lit(1)).alias("n"), F.avg(b).alias("acc_before"), F.avg(a).alias("acc_after"), F.sum(a * (1 - b)).alias("corrected"), F.sum(b * (1 - a)).alias("harmed"), F.sum(a - b).alias("net"), F.avg(F.when(ok, a)).alias("acc_accepted"), F.avg(F.when(~ok, a)).alias("acc_fallback"), (F.avg(a) - F.avg(b)).alias("delta"))
