"""The boundary to external models: policy, validation of what they return, and its application.

A model is a plain callable that is handed rows in Arrow batches. What it returns is checked with native expressions
against what it was allowed to use; whatever fails falls back to the deterministic result.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.operators.ledger import Caller, Ledger, acceptance, called  # noqa: F401
from termweave.sources.records import row_key, row_keys

PAYLOAD = "struct<ranked_codes:array<string>,overall_uncertainty:string,candidate_rationales:array<struct<code:string,rationale:string,evidence_quotes:array<string>>>>"


class ExternalModelPolicyError(RuntimeError):
    """Raised on the driver, before any plan is built, where an external model may not be called."""


def require_consent(allow: bool, classification: str, allowed=("public", "synthetic")) -> None:
    if not allow:
        raise ExternalModelPolicyError("External models need explicit consent")
    if classification.lower() not in allowed:
        raise ExternalModelPolicyError(f"Data of class {classification} may not leave")


def rationale_errors(code: Column, quotes: Column, rationale: Column, locked: Column, allowed: Column) -> Column:
    """A rationale must keep the code, say something, and quote only what is allowed."""
    return F.array_compact(F.array(
        F.when(~code.eqNullSafe(locked), "code_changed"), F.when(F.trim(F.coalesce(rationale, F.lit(""))) == "", "empty_rationale"), F.when(F.size(allowed) == 0, "no_allowed_evidence"),
        F.when(F.size(F.array_except(F.coalesce(quotes, F.array().cast("array<string>")), allowed)) > 0, "quote_not_allowed"),
    ))


def ranking_errors(ranked: Column, allowed: Column) -> Column:
    """A ranking must be a list, without repeats, of exactly the codes that were given."""
    r = F.coalesce(ranked, F.array().cast("array<string>"))
    same = F.array_sort(F.array_distinct(r)) == F.array_sort(F.array_distinct(allowed))
    return F.array_compact(F.array(F.when(ranked.isNull(), "ranked_codes_not_list"), F.when(F.size(F.array_distinct(r)) != F.size(r), "duplicate_ranked_codes"), F.when(~same, "candidate_set_changed")))


def payload_errors(payload: Column, allowed: Column, quotes: Column) -> Column:
    """The ranking's errors, and those of the rationales: one for each code, each with an exact quote. Sorted, each once."""
    own = F.coalesce(payload["candidate_rationales"], F.array().cast("array<struct<code:string,rationale:string,evidence_quotes:array<string>>>"))
    codes = F.transform(own, lambda x: x["code"])
    # The names of the errors.
    none = F.array().cast("array<string>")
    empty = F.exists(own, lambda x: F.trim(F.coalesce(x["rationale"], F.lit(""))) == "")
    unquoted = F.exists(own, lambda x: F.size(F.coalesce(x["evidence_quotes"], none)) == 0)
    foreign = F.exists(own, lambda x: F.size(F.array_except(F.coalesce(x["evidence_quotes"], none), quotes)) > 0)
    more = F.array_compact(F.array(
        F.when(F.array_sort(F.array_distinct(codes)) != F.array_sort(F.array_distinct(allowed)), "rationale_candidate_set_changed"), F.when(F.size(F.array_distinct(codes)) != F.size(codes), "duplicate_rationale_codes"),
        F.when(F.coalesce(empty, F.lit(False)), "missing_candidate_rationale"), F.when(F.coalesce(unquoted, F.lit(False)), "candidate_rationale_missing_real_evidence"), F.when(F.coalesce(foreign, F.lit(False)), "non_verbatim_or_unapproved_evidence"),
    ))
    missing = F.array_compact(F.array(F.when(payload["candidate_rationales"].isNull(), "candidate_rationales_not_list")))
    return F.array_sort(F.array_distinct(F.concat(ranking_errors(payload["ranked_codes"], allowed), missing, more)))


def reordered(candidates: Column | str, ranked: Column | str, accepted: Column) -> Column:
    """The candidates in the order of the ranking where it was accepted, else as they were."""
    c, r = (F.col(x) if isinstance(x, str) else x for x in (candidates, ranked))
    return F.when(accepted, F.transform(r, lambda code: F.get(F.filter(c, lambda x: x["code"] == code), F.lit(0)))).otherwise(c)


def call(rows: DataFrame, model: Callable[[dict], object], key: str, max_attempts: int = 2) -> DataFrame:
    """(key, payload_json, error): the model's answer for each row, as JSON; after `max_attempts` failures the last error's name."""
    names = rows.columns

    def run(batches):
        for pdf in batches:
            out, bad = [], []
            for values in pdf.itertuples(index=False, name=None):
                answer, error = None, "no_attempt"
                for _ in range(max(1, max_attempts)):
                    try:
                        answer, error = json.dumps(model(dict(zip(names, values, strict=True))), ensure_ascii=False), None
                        break
                    except Exception as e:  # whatever a model raises means: no answer
                        error = type(e).__name__
                out.append(answer)
                bad.append(error)
            yield pdf[[key]].assign(payload_json=out, error=bad)

    return rows.mapInPandas(run, f"{key} string, payload_json string, error string")


def rewritten(expl: DataFrame, model: Callable[[dict], object], allow: bool, classification: str, allowed=("public", "synthetic"), max_attempts: int = 2) -> DataFrame:
    """Explanations whose `why` a model may put into other words; the code is locked.

    Only rows with evidence and without a context to review are sent: no quotes, no call. An answer stands if it keeps
    the code and quotes nothing but the row's evidence; else the deterministic sentence stays. Adds explanation_source
    and rationale_errors. expl: record_id, predicted_code, term, why, evidence_quotes, context_review_required.
    """
    require_consent(allow, classification, allowed)
    eligible = (F.size("evidence_quotes") > 0) & ~F.coalesce("context_review_required", F.lit(False))
    key = F.to_json(F.struct(*row_keys(expl), "predicted_code"))
    sent = expl.filter(eligible).select(key.alias("pair"), *row_keys(expl), "predicted_code", "term", F.to_json("evidence_quotes").alias("evidence_quotes")).dropDuplicates(["pair"])
    answer = F.from_json("payload_json", "struct<code:string,rationale:string,evidence_quotes:array<string>>").alias("answer")
    got = call(sent, model, "pair", max_attempts).select("pair", answer, "error")
    rows = expl.withColumn("pair", key).join(got, "pair", "left")
    wrong = rationale_errors(F.col("answer.code"), F.col("answer.evidence_quotes"), F.col("answer.rationale"), F.col("predicted_code"), F.col("evidence_quotes"))
    none = F.array().cast("array<string>")
    errors = F.when(~eligible, none).when(F.col("error").isNotNull(), F.array(F.concat(F.lit("model_error:"), "error"))).when(F.col("answer").isNull(), F.array(F.lit("invalid_payload"))).otherwise(wrong)
    rows = rows.withColumn("rationale_errors", errors)
    fine = eligible & (F.size("rationale_errors") == 0)
    return rows.withColumn("why", F.when(fine, F.col("answer.rationale")).otherwise(F.col("why"))).withColumn("explanation_source", F.when(fine, "llm_validated").otherwise("grounded_deterministic")).drop("pair", "answer", "error")


def reranked(cases: DataFrame, model: Callable[[dict], object] | Caller, allow: bool, classification: str, ledger: Ledger | None = None) -> DataFrame:
    """cases: record_id (and row_id), phrase, candidates (array of code, term, score). Adds accepted, errors, from_ledger and the candidates in their final order.

    With a ledger the model is a Caller, and each request (phrase and candidates) is asked once.
    """
    require_consent(allow, classification, ("public",))
    key = row_key(cases)
    if ledger is None:
        answers = call(cases.select(*row_keys(cases), "phrase", F.to_json("candidates").alias("candidates")), model, key).withColumn("from_ledger", F.lit(False))
    else:
        answers = called(cases.select(key, "phrase", F.to_json("candidates").alias("candidates")), model, ledger, key).select(key, "payload_json", "error", "from_ledger")
    rows = cases.join(answers, key, "left").withColumn("payload", F.from_json("payload_json", PAYLOAD))
    allowed = F.transform("candidates", lambda x: x["code"])
    rows = rows.withColumn("errors", F.when(F.col("error").isNotNull(), F.array(F.concat(F.lit("model_error:"), "error"))).when(F.col("payload").isNull(), F.array(F.lit("invalid_payload"))).otherwise(payload_errors(F.col("payload"), allowed, F.array("phrase"))))
    rows = rows.withColumn("accepted", F.size("errors") == 0)
    rows = rows.withColumn("answer", F.when(F.col("accepted"), F.col("payload"))).withColumn("baseline", F.col("candidates"))
    return rows.withColumn("candidates", reordered("candidates", F.col("payload.ranked_codes"), F.col("accepted"))).drop("payload_json", "error", "payload")


def case_options(answered: DataFrame, grounding: DataFrame) -> DataFrame:
    """(record_id, row_id where there is one, options): every candidate of a case with its rank before and, where the answer stands, after; the model's rationale then, else the deterministic one.

    answered: what reranked() gives; grounding: (record_id, row_id, code, rationale, evidence_quotes).
    """
    keys = row_keys(answered)
    flat = answered.select(*keys, "answer", F.posexplode("baseline").alias("at", "c")).select(*keys, "answer", "at", "c.*")
    flat = flat.join(grounding.select(*keys, "code", "rationale", "evidence_quotes"), [*keys, "code"], "left")
    own = F.get(F.filter("answer.candidate_rationales", lambda x: x["code"] == F.col("code")), F.lit(0))
    known = own.isNotNull()
    option = F.struct(
        (F.col("at") + 1).alias("baseline_rank"), "code", "term", F.col("score").alias("model_score"), F.when(F.col("answer").isNotNull(), F.array_position(F.col("answer.ranked_codes"), F.col("code")).cast("int")).alias("reranked_rank"),
        F.when(known, own["rationale"]).otherwise(F.col("rationale")).alias("display_rationale"), F.when(known, "llm_validated").otherwise("deterministic_grounded").alias("rationale_source"), "evidence_quotes",
        F.when(known, own["evidence_quotes"]).otherwise(F.array().cast("array<string>")).alias("model_evidence_quotes"),
    )
    return flat.groupBy(*keys).agg(F.array_sort(F.collect_list(option)).alias("options"))
