"""Audits of datasets, review samples and casebooks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termweave.functions.hashing import sample
from termweave.sources.records import require_columns, row_key

# The quantiles that are reported.
QUANTILES = (0.0, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0)
# The words that count as true.
TRUE_WORDS = ("1", "true", "yes", "y")


def truth(column: str):
    return F.lower(F.trim(F.col(column).cast("string"))).isin(*TRUE_WORDS)


def missing_codes(codes: DataFrame, terms: DataFrame, blank: bool = False) -> DataFrame:
    """The distinct gold codes that the terminology does not have; with `blank` the blank one is a code too."""
    return codes.select(F.col("gold_code").alias("code")).filter(F.lit(blank) | (F.col("code") != "")).distinct().join(terms.select("code"), "code", "left_anti")


def named(*pairs) -> Column:
    """The names whose conditions hold, in order."""
    return F.array_compact(F.array(*[F.when(bad, name) for name, bad in pairs]))


def first_codes(missing: DataFrame, most: int) -> DataFrame:
    """One row: how many codes are missing, and the first `most` in order."""
    few = missing.orderBy("code").limit(most).agg(F.array_sort(F.collect_list("code")).alias("missing_terminology_codes"))
    return missing.agg(F.count(F.lit(1)).alias("n_missing_codes")).crossJoin(few)


def audit_annotations(records: DataFrame, terms: DataFrame | None = None, min_offset: float = 0.99, min_coverage: float = 0.95) -> DataFrame:
    """One row: counts, the share of matching offsets, the terminology's coverage of distinct codes, hard failures, warnings and readiness.

    Records: record_id, text, mention, gold_code; without annotation_id, rows of one mention and code repeat each
    other. What has no column (offset_match, is_discontinuous, annotation_id) or no terminology is not judged.
    """
    require_columns(records, {"record_id", "text", "mention", "gold_code"})
    has = set(records.columns)
    key = ["record_id", "annotation_id" if "annotation_id" in has else "mention", "gold_code"]
    rows = records.select("record_id", F.coalesce(F.col("gold_code").cast("string"), F.lit("")).alias("gold_code"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("annotation_id", "mention", "offset_match", "is_discontinuous") if c in has])
    n = rows.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("record_id").alias("n_documents"), F.count_distinct("gold_code").alias("n_codes"), F.count_if(F.trim("gold_code") == "").alias("n_blank_codes"),
        (F.avg(truth("offset_match").cast("int")) if "offset_match" in has else F.lit(None).cast("double")).alias("offset_match_rate"),
        (F.count_if(truth("is_discontinuous")) if "is_discontinuous" in has else F.lit(None).cast("long")).alias("n_discontinuous"), (F.count(F.lit(1)) - F.count_distinct(*key)).alias("n_duplicates"),
    )
    several = rows.groupBy("record_id", "annotation_id").agg(F.count_distinct("gold_code").alias("c")).agg(F.count_if(F.col("c") > 1).alias("n_multi_code")) if "annotation_id" in has else n.select(F.lit(0).cast("long").alias("n_multi_code"))
    row = n.crossJoin(several)
    if terms is None or terms.isEmpty():
        row = row.withColumn("n_missing_codes", F.lit(0).cast("long")).withColumn("missing_terminology_codes", F.array().cast("array<string>")).withColumn("terminology_coverage", F.lit(None).cast("double"))
    else:
        row = row.crossJoin(first_codes(missing_codes(rows, terms, blank=True), 100)).withColumn("terminology_coverage", 1.0 - F.col("n_missing_codes") / F.greatest("n_codes", F.lit(1)))
    # The names of failures and warnings.
    failures = named(("blank_gold_code", F.col("n_blank_codes") > 0), ("offset_match_rate_below_threshold", F.col("offset_match_rate") < min_offset), ("terminology_coverage_below_threshold", F.col("terminology_coverage") < min_coverage))
    warnings = named(("duplicate_rows_present", F.col("n_duplicates") > 0), ("same_annotation_has_multiple_codes", F.col("n_multi_code") > 0))
    return row.withColumn("hard_failures", failures).withColumn("warnings", warnings).withColumn("ready", F.size("hard_failures") == 0)


#: Parts of a value's range, each summed by itself; a row for each of them is broadcast.
BLOCKS = 4096


def exact_quantiles(df: DataFrame, value: Column, points=QUANTILES) -> DataFrame:
    """One row with `quantiles`: exact, interpolated, as an array of doubles for `points`; null without rows.

    Equal values are counted first, and running sums go over distinct values in BLOCKS equal parts of their range, so no
    task holds all rows whatever the values' scale.
    """
    per = df.select(value.cast("double").alias("v")).filter("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    ends = per.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    block = F.floor((F.col("v") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(5e-324)) * BLOCKS)
    per = per.crossJoin(F.broadcast(ends)).select("v", "c", F.when(F.col("lo") == F.col("hi"), F.lit(0).cast("long")).otherwise(block).alias("block"))
    sums = per.groupBy("block").agg(F.sum("c").alias("bc"))
    sums = sums.select("block", (F.sum("bc").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, 0)) - F.col("bc")).alias("before"), F.sum("bc").over(W.partitionBy()).alias("n"))
    upto = F.col("before") + F.sum("c").over(W.partitionBy("block").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    ranked = per.join(F.broadcast(sums), "block").select("v", "n", upto.alias("upto"), (upto - F.col("c")).alias("from"))
    wanted = df.sparkSession.createDataFrame(list(enumerate(map(float, points))), "i int, q double")
    at = ranked.join(F.broadcast(wanted), F.lit(True)).withColumn("place", F.col("q") * (F.col("n") - 1))
    holds = lambda p: (F.col("from") <= p) & (p < F.col("upto"))
    low, high = F.floor("place"), F.ceil("place")
    got = at.groupBy("i").agg(F.max(F.when(holds(low), F.col("v"))).alias("a"), F.max(F.when(holds(high), F.col("v"))).alias("b"), F.max(F.col("place") - low).alias("part"))
    value = F.col("a") + (F.col("b") - F.col("a")) * F.col("part")
    return got.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", value.alias("v")))), lambda x: x["v"]).alias("quantiles"))


def audit_notes(notes: DataFrame, terms: DataFrame, min_coverage: float = 0.99) -> DataFrame:
    """One row: overlaps of subjects between splits, empty texts and labels, coverage, quantiles of lengths and of codes per note, hard failures and warnings.

    Notes: record_id, subject_id, text, gold_codes, split.
    """
    require_columns(notes, {"record_id", "subject_id", "text", "gold_codes", "split"})
    text, own = F.coalesce("text", F.lit("")), F.coalesce("gold_codes", F.array().cast("array<string>"))
    n = notes.agg(
        F.count(F.lit(1)).alias("n_notes"), F.count_distinct("subject_id").alias("n_subjects"), F.count_if(F.trim(text) == "").alias("n_empty_text"), F.count_if(F.size(own) == 0).alias("n_empty_labels"),
        *[F.count_if(F.col("split") == s).alias(f"n_{s}") for s in ("train", "val", "test")],
    )
    lengths = exact_quantiles(notes, F.length(text)).withColumnRenamed("quantiles", "length_quantiles")
    counts = exact_quantiles(notes, F.size(own)).withColumnRenamed("quantiles", "codes_quantiles")
    by = notes.groupBy("subject_id").agg(F.collect_set("split").alias("s"))  # three names at most
    both = lambda a, b: F.count_if(F.array_contains("s", a) & F.array_contains("s", b)).alias(f"{a}_{b}_overlap")
    leaks = by.agg(both("train", "val"), both("train", "test"), both("val", "test"))
    codes = notes.select(F.explode(own).alias("gold_code"))
    cover = codes.distinct().agg(F.count(F.lit(1)).alias("n_codes")).crossJoin(first_codes(missing_codes(codes, terms), 200))
    row = n.crossJoin(lengths).crossJoin(counts).crossJoin(leaks).crossJoin(cover).withColumn("terminology_coverage", 1.0 - F.col("n_missing_codes") / F.greatest("n_codes", F.lit(1)))
    # The names of failures and warnings.
    failures = named(
        ("subject_id_leakage_across_splits", F.col("train_val_overlap") + F.col("train_test_overlap") + F.col("val_test_overlap") > 0), ("empty_clinical_text", F.col("n_empty_text") > 0),
        ("records_without_icd10_labels", F.col("n_empty_labels") > 0), ("terminology_coverage_below_threshold", F.col("terminology_coverage") < min_coverage),
    )
    return row.withColumn("hard_failures", failures).withColumn("warnings", named(("very_small_code_vocabulary", F.col("n_codes") < 10))).withColumn("ready", F.size("hard_failures") == 0)


def review_sample(records: DataFrame, n: int = 50, seed: int = 42) -> DataFrame:
    """Rows with a mismatch or several spans first, then others, each in the order of a seeded hash."""
    first = F.when(~truth("offset_match") | truth("is_discontinuous"), 0).otherwise(1)
    h = F.sha2(F.concat(F.lit(f"{seed}:"), "record_id", F.lit(":"), "annotation_id"), 256)
    blank = [F.lit("").alias(c) for c in ("review_span_correct", "review_code_link_correct", "review_comments")]
    return records.withColumn("priority", first).orderBy("priority", h).limit(n).select("*", *blank)


def note_sample(notes: DataFrame, n: int = 30, seed: int = 42, extremes: int = 5) -> DataFrame:
    """The longest notes, those of most codes, and others by a seeded hash, up to n."""
    longest = notes.orderBy(F.desc(F.length("text")), "record_id").limit(extremes)
    most = notes.orderBy(F.desc(F.size("gold_codes")), "record_id").limit(extremes)
    some = longest.unionByName(most).dropDuplicates(["record_id"]).withColumn("_p", F.lit(0))
    others = sample(notes.join(some.select("record_id"), "record_id", "left_anti"), n, F.col("record_id"), seed).withColumn("_p", F.lit(1))
    return some.unionByName(others).orderBy("_p", F.sha2(F.concat(F.lit(f"{seed}:"), "record_id"), 256)).limit(n).drop("_p").select("*", *[F.lit("").alias(c) for c in ("review_note_alignment", "review_label_set_plausible", "review_comments")])


def write_audit(audit: DataFrame, sample_: DataFrame, path: str) -> None:
    """The audit as one JSON line and the sample for review as CSV, through Spark's writers."""
    audit.coalesce(1).write.mode("overwrite").json(f"{path}/dataset_audit.json")
    sample_.select(*[F.to_json(c).alias(c) if kind.startswith(("array", "struct", "map")) else F.col(c) for c, kind in sample_.dtypes]).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/manual_review_sample.csv")


# The reasons for review, in order of priority.
REASONS = ("auto_candidate_error", "high_confidence_error", "unseen_code_error", "insufficient_evidence", "other_error")


def casebook(pred: DataFrame, max_cases: int = 40, seed: int = 42) -> DataFrame:
    """Cases for review: errors by reason, each reason with an equal share of places, then correct controls.

    pred: record_id (and row_id), confidence, correct, decision, code_novelty, explanation_status. Places that a reason
    leaves unused go to controls alone. Within a reason the highest confidence comes first, ties by id; controls are a
    sample in the order of a seeded hash of their ids.
    """
    key = row_key(pred)
    cut = exact_quantiles(pred, F.col("confidence"), (0.75,)).select(F.get("quantiles", F.lit(0)).alias("p75"))
    wrong = F.coalesce("correct", F.lit(0)) == 0
    reason = (
        F.when((F.col("decision") == "AUTO_CANDIDATE") & wrong, REASONS[0]).when(wrong & (F.col("confidence") >= F.col("p75")), REASONS[1]).when(wrong & (F.col("code_novelty") == "unseen_code"), REASONS[2])
        .when(F.col("explanation_status").isin("insufficient_grounding", "insufficient_affirmed_evidence"), REASONS[3]).when(wrong, REASONS[4]).otherwise("correct_control")
    )
    rows = pred.crossJoin(F.broadcast(cut)).withColumn("review_reason", reason).drop("p75")
    share = max(1, max_cases // len(REASONS))
    control = F.col("review_reason") == "correct_control"
    drawn = F.when(control, F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256))
    place = F.row_number().over(W.partitionBy("review_reason").orderBy(F.desc(F.when(~control, F.col("confidence"))), drawn, key))
    rows = rows.withColumn("place", place).filter((F.col("place") <= share) | ((F.col("review_reason") == "correct_control") & (F.col("place") <= max_cases)))
    order = F.array_position(F.array(*map(F.lit, REASONS)), F.col("review_reason"))
    rows = rows.withColumn("order", F.when(order == 0, len(REASONS) + 1).otherwise(order)).orderBy("order", "place").limit(max_cases)
    number = F.row_number().over(W.orderBy("order", "place"))  # max_cases rows
    return rows.withColumn("casebook_id", F.format_string("CASE-%03d", number)).drop("order", "place")


def write_casebook(cases: DataFrame, path: str) -> None:
    """The casebook with blank columns for the expert as CSV, and a card in HTML for each case; arrays become JSON."""
    blank = [F.lit("").alias(c) for c in ("expert_code_correct", "expert_evidence_complete", "expert_rationale_correct", "expert_action", "expert_comments")]
    flat = cases.select(*[F.to_json(c).alias(c) if kind.startswith(("array", "struct", "map")) else F.col(c) for c, kind in cases.dtypes], *blank)
    flat.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/review_casebook.csv")
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    shown = [c for c in ("record_id", "gold_code", "predicted_code", "confidence", "decision", "mention", "text", "why", "evidence_quotes", "candidates") if c in flat.columns]
    rows = [F.concat(F.lit(f"<p><b>{c}</b> "), safe(c), F.lit("</p>")) for c in shown]
    card = F.concat(F.lit("<section><h2>"), safe("casebook_id"), F.lit(" "), safe("review_reason"), F.lit("</h2>"), *rows, F.lit("</section>"))
    flat.orderBy("casebook_id").select(card).coalesce(1).write.mode("overwrite").text(f"{path}/review_casebook.html")
