"""Human review as an append-only log of events: the queue's state, feedback and audit trails are derived from it.

An event has event_id, record_id, kind (ENQUEUE or DECIDE), action, selected_code, reviewer_hash, reason and ts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a reviewer can do.
ACTIONS = ("ACCEPT_TOP1", "SELECT_ALTERNATIVE", "RECODE_OUTSIDE_TOPK", "ESCALATE", "NO_CODE")
EVENT = "event_id long, record_id string, kind string, action string, selected_code string, reviewer_hash string, reason string, ts timestamp"


def reviewer_hash(value: Column | str) -> Column:
    v = F.trim(F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit("")).cast("string"))
    return F.when(v == "", "").otherwise(F.substring(F.sha2(v, 256), 1, 16))


def append(events: DataFrame, path: str) -> None:
    events.select(*[c.split()[0] for c in EVENT.split(", ")]).write.mode("append").json(path)


def enqueue(packets: DataFrame, batch: int, at: Column) -> DataFrame:
    """ENQUEUE events; a record that is enqueued again is pending again. Blank ids are skipped."""
    rows = packets.filter(F.trim("record_id") != "").select("record_id").distinct()
    return rows.select(F.xxhash64("record_id", F.lit(batch)).alias("event_id"), "record_id", F.lit("ENQUEUE").alias("kind"), *[F.lit("").alias(c) for c in ("action", "selected_code", "reviewer_hash", "reason")], at.alias("ts"))


def decide(events: DataFrame, record_id: str, action: str, selected_code: str = "", reviewer: str = "", reason: str = "", event_id: int = 0) -> DataFrame:
    """One DECIDE event. ValueError for an unknown action, KeyError for a record that was never enqueued."""
    if action not in ACTIONS:
        raise ValueError(f"Unknown action {action}")
    if events.filter(F.col("record_id") == record_id).isEmpty():
        raise KeyError(record_id)
    row = events.sparkSession.createDataFrame([(event_id, record_id, "DECIDE", action, selected_code, reviewer, reason)], "event_id long, record_id string, kind string, action string, selected_code string, reviewer string, reason string")
    return row.withColumn("reviewer_hash", reviewer_hash("reviewer")).withColumn("ts", F.current_timestamp()).select(*[c.split()[0] for c in EVENT.split(", ")])


def status(kind: Column, action: Column) -> Column:
    return F.when(kind == "ENQUEUE", "PENDING").when(action == "ESCALATE", "ESCALATED").otherwise("RESOLVED")


def queue_state(events: DataFrame) -> DataFrame:
    """The latest state of every record: status, action, selected code, and when it was enqueued and last changed."""
    last = events.groupBy("record_id").agg(
        F.max_by(F.struct("kind", "action", "selected_code", "reviewer_hash"), F.struct("ts", "event_id")).alias("l"), F.max("ts").alias("updated_at"),
        F.max(F.when(F.col("kind") == "ENQUEUE", F.col("ts"))).alias("created_at"), F.count_if(F.col("kind") == "DECIDE").alias("n_decisions"),
    )
    return last.select("record_id", status(F.col("l.kind"), F.col("l.action")).alias("status"), F.col("l.action").alias("action"), F.col("l.selected_code").alias("selected_code"), "created_at", "updated_at", "n_decisions")


def pending(state: DataFrame, limit: int = 50) -> DataFrame:
    return state.filter("status = 'PENDING'").orderBy("created_at", "record_id").limit(limit)


def audit_trail(events: DataFrame, record_id: str | None = None) -> DataFrame:
    return (events if record_id is None else events.filter(F.col("record_id") == record_id)).orderBy("ts", "event_id")


def summary(state: DataFrame, events: DataFrame) -> DataFrame:
    """Counts by status and by action."""
    a = state.groupBy(F.lit("status").alias("what"), F.col("status").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(events.filter("kind = 'DECIDE'").groupBy(F.lit("action").alias("what"), F.col("action").alias("name")).agg(F.count(F.lit(1)).alias("n")))


def feedback_errors(candidates: Column | str = "original_candidate_codes") -> Column:
    """What is wrong with a feedback row, in a fixed order."""
    c = F.coalesce(F.col(candidates) if isinstance(candidates, str) else candidates, F.array().cast("array<string>"))
    blank = lambda n: F.coalesce(F.col(n), F.lit("")) == ""
    action, code = F.coalesce("human_action", F.lit("")), F.coalesce("human_selected_code", F.lit(""))
    inside = F.array_contains(c, code)
    return F.array_compact(F.array(
        F.when(blank("record_id"), "missing_record_id"), F.when(blank("model_release"), "missing_model_release"), F.when(~action.isin(*ACTIONS), "invalid_human_action"),
        F.when(action.isin(*ACTIONS[:2]) & ~inside, "selected_code_not_in_original_topk"), F.when((action == ACTIONS[2]) & ((code == "") | inside), "outside_topk_action_inconsistent"),
    ))


def append_feedback(rows: DataFrame, path: str) -> None:
    """Append valid feedback as JSON lines; ValueError if a row is not valid."""
    if bad := rows.withColumn("errors", feedback_errors()).filter(F.size("errors") > 0).select("errors").first():
        raise ValueError(f"Invalid feedback: {bad['errors']}")
    rows.write.mode("append").json(path)


def training_memory(feedback: DataFrame, records: DataFrame) -> DataFrame:
    """Memory rows of a later release out of feedback: no escalations, no blanks, known records; the last row of a record id is its text."""
    last = records.groupBy("record_id").agg(F.max_by(F.struct("text", "mention"), "row_seq").alias("r"))
    rows = feedback.filter(~F.col("human_action").isin("ESCALATE", "NO_CODE") & (F.coalesce("human_selected_code", F.lit("")) != ""))
    return rows.join(last, "record_id").select("record_id", "r.text", "r.mention", F.col("human_selected_code").alias("gold_code"), F.lit("").alias("gold_term"), F.col("model_release").alias("feedback_source_release"), F.col("human_action").alias("feedback_human_action"), F.lit("expert_feedback_future_release_only").alias("provenance"))


def feedback_summary(feedback: DataFrame) -> DataFrame:
    share = lambda a: F.coalesce(F.avg((F.col("human_action") == a).cast("int")), F.lit(0.0))
    return feedback.agg(F.count(F.lit(1)).alias("n_feedback"), *[F.count_if(F.col("human_action") == a).alias(f"n_{a.lower()}") for a in ACTIONS], share(ACTIONS[0]).alias("top1_accept_rate"), share(ACTIONS[1]).alias("topk_rescue_rate"), share(ACTIONS[2]).alias("outside_topk_rate"))


# The version of audit artifacts, and the states that a decision can end in.
ARTIFACT_SCHEMA_VERSION = "1.0"
ADJUDICATED, ADJUDICATED_NO_CODE, ESCALATED = "HUMAN_ADJUDICATED", "HUMAN_ADJUDICATED_NO_CODE", "ESCALATED"


def decision_trace(pred: DataFrame, events: DataFrame) -> DataFrame:
    """The final code and status of every prediction (record_id, predicted_code, route_before_review; other columns come along).

    A reviewer's code stands if one was selected; NO_CODE empties it. An escalated record keeps the prediction, as does
    one that nobody decided, whose status is its route.
    """
    last = events.filter("kind = 'DECIDE'").groupBy("record_id").agg(F.max_by(F.struct("action", "selected_code"), F.struct("ts", "event_id")).alias("l"))
    a, code = F.coalesce("l.action", F.lit("")), F.coalesce("l.selected_code", F.lit(""))
    rows = pred.join(last, "record_id", "left")
    chosen = a.isin(*ACTIONS[:3]) & (code != "")
    final = F.when(chosen, code).when(a == "NO_CODE", "").otherwise(F.col("predicted_code"))
    state = F.when(chosen, ADJUDICATED).when(a == "NO_CODE", ADJUDICATED_NO_CODE).when(a == "ESCALATE", ESCALATED).otherwise(F.col("route_before_review"))
    return rows.select(*pred.columns, F.lit(ARTIFACT_SCHEMA_VERSION).alias("artifact_schema_version"), a.alias("human_action"), code.alias("human_selected_code"), final.alias("final_code"), state.alias("final_status"))


def file_fingerprints(spark, paths: list[str]) -> DataFrame:
    """(path, bytes, sha256) of files, read by the executors."""
    return spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def changed_files(now: DataFrame, bundle: DataFrame) -> DataFrame:
    """Files of a bundle that are gone or differ."""
    both = bundle.join(now.select("path", F.col("sha256").alias("now")), "path", "left")
    return both.filter(~F.col("sha256").eqNullSafe(F.col("now"))).select("path", F.when(F.col("now").isNull(), "missing").otherwise("changed").alias("problem"))


def audit_bundle(spark, release: str, files: dict[str, str], decision_semantics: dict) -> dict:
    """A manifest of named files and tables, with the SHA-256 of those that are there; the executors read them."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = lambda p: fs.Path(p)
    there = {n: path(p).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path(p)) for n, p in files.items()}
    # A folder's sum is that over its files' names and sums, in order
    one = F.concat_ws(":", F.regexp_extract("path", r"([^/]+)$", 1), "sha256")
    folder = lambda p: path(p).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path(p)).isDirectory()
    whole = lambda rows: rows.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(one)), "\n"), 256).alias("sha256"))
    sums = {n: (whole(file_fingerprints(spark, [p])) if folder(p) else file_fingerprints(spark, [p])).first()["sha256"] for n, p in files.items() if there[n]}
    return {"artifact_schema_version": ARTIFACT_SCHEMA_VERSION, "release": release, "files": {n: {"path": p, "exists": there[n], "sha256": sums.get(n)} for n, p in files.items()}, "decision_semantics": dict(decision_semantics)}


def bundle_errors(spark, bundle: dict) -> list[str]:
    """What is wrong with a manifest: its version, files that it did not find, and files that are gone or changed since."""
    out = [] if bundle.get("artifact_schema_version") == ARTIFACT_SCHEMA_VERSION else ["unsupported_artifact_schema_version"]
    files = bundle.get("files") or {}
    now = audit_bundle(spark, "", {n: i["path"] for n, i in files.items() if i.get("exists")}, {})["files"]
    for n, i in files.items():
        if not i.get("exists"):
            out.append(f"missing_artifact:{n}")
        elif not now[n]["exists"]:
            out.append(f"artifact_no_longer_exists:{n}")
        elif i.get("sha256") and now[n]["sha256"] != i["sha256"]:
            out.append(f"artifact_hash_mismatch:{n}")
    return out
