"""Evidence spans, assertion audit, quality gate, rationales and faithfulness, all verbatim from the text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from termweave.functions.text import assertion, local_context, trimmed, without_spans
from termweave.operators.products import kind_of, made
from termweave.operators.retrieval import kept
from termweave.sources.records import row_key, row_keys

SPAN = "array<struct<start:int,end:int,quote:string,source:string,score:double,matched_phrases:array<string>>>"
NO_SUPPORT = ("insufficient_grounding", "insufficient_affirmed_evidence")


# Fixed value: a sentence has no mark or line feed inside; marks stand at its end, or the text ends. A line that ends
# without a mark is matched with its line feed, so that it is read once, and is none.
SENTENCE = re.compile(r"[^.!?\n]+(?:[.!?]+|$|\n)")
#: Sentences that are handed on at once.
AT_ONCE = 50_000
WORD = re.compile("[A-Za-z0-9]+")
#: Terms with their synonyms whose phrases a task keeps, and rows whose spans it hands on at once.
KNOWN = 1024
ROWS_AT_ONCE = 1024


def cut_sentences(text: str | None) -> Iterator[tuple[int, int, str]]:
    """(start, end, quote) of a text's sentences, trimmed."""
    for m in SENTENCE.finditer(text or ""):
        words = m.group()
        if words[-1] != "\n" and (own := words.strip()):
            at = m.start() + len(words) - len(words.lstrip())
            yield at, at + len(own), own


def sentences(df: DataFrame, key: str = "record_id", text: str = "text") -> DataFrame:
    """(key, start, end, quote) of the sentences, trimmed, with offsets in characters. A line without an end mark before a line feed is none.

    One pass over each text where it lies: nothing is shuffled, and no task holds more than one text's sentences and
    AT_ONCE others. A null text has none.
    """
    kind, schema = kind_of(f"{key} {dict(df.dtypes)[key]}, start int, end int, quote string")

    def run(batches):
        for batch in batches:
            which, start, end, quote = [], [], [], []
            for i, body in enumerate(batch.column(text)):
                for at, to, own in cut_sentences(body.as_py()):
                    which.append(i)
                    start.append(at)
                    end.append(to)
                    quote.append(own)
                if len(which) >= AT_ONCE:
                    yield made(schema, [batch.column(key).take(pa.array(which, pa.int64())), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(quote, pa.string())])
                    which, start, end, quote = [], [], [], []
            yield made(schema, [batch.column(key).take(pa.array(which, pa.int64())), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(quote, pa.string())])

    return df.select(key, text).mapInArrow(run, kind)


def known_phrases(term: str | None, synonyms: str | None) -> tuple[list[str], list[str], frozenset[str]]:
    """The phrases of a term and its synonyms (between | ; or line feeds), each once whatever its case; the same lower-cased; their words."""
    first = {}
    for phrase in [term or "", *re.split(r"[|;\n]", synonyms or "")]:
        if own := phrase.strip():
            first.setdefault(own.lower(), own)
    return list(first.values()), list(first), words_of(" ".join(first.values()))


def words_of(text: str) -> frozenset[str]:
    """Lower-cased runs of at least two letters or digits of ASCII."""
    return frozenset(w.lower() for w in WORD.findall(text) if len(w) > 1)


def spans_of(text: str | None, cut: list[tuple[int, int, str, str]], mention: str | None, known: tuple, max_spans: int) -> list[tuple]:
    """A row's spans in the order of the text, out of its sentences (start, end, quote, lower-cased quote)."""
    phrases, low_phrases, words = known
    held = lambda low: [p for p, l in zip(phrases, low_phrases, strict=True) if l in low]
    m = (mention or "").strip(" ")
    low_m, target = m.lower(), words | words_of(mention or "")
    found, at = [], (text or "").lower().find(low_m) if m else -1
    for start, end, quote, low in cut:
        if at < 0 or end <= at or start >= at + len(m):
            hits = held(low)
            # A word of the target is a part of the quote; most quotes have none, and are not cut into words
            share = len(words_of(quote) & target) if any(t in low for t in target) else 0
            score = share / max(len(target), 1) + 0.5 * len(hits) + (1.0 if m and low_m in low else 0.0)
            if score > 0:
                found.append((-score, start, end, quote, hits))
    best = [(start, end, quote, "supporting_sentence", -minus, hits) for minus, start, end, quote, hits in sorted(found)[: max_spans - (at >= 0)]]
    if at >= 0:
        quote = text[at : at + len(m)]
        best.append((at, at + len(m), quote, "explicit_mention", 2.0, held(quote.lower())))
    return sorted(best)


def with_spans(df: DataFrame, max_spans: int = 3) -> DataFrame:
    """The rows of (text, mention, term, synonyms, ...) with `spans`: their evidence, in the order of the text.

    The explicit mention comes first; then sentences that do not overlap it, scored by the share of target words they
    hold, half a point for each phrase and one for the mention; the best `max_spans` stay. Rows get their spans where
    they lie: nothing is shuffled. Candidates of a text that follow one another share its sentences, and rows of equal
    term and synonyms their phrases.
    """
    kind = StructType([*df.schema.fields, *StructType.fromDDL(f"spans {SPAN}").fields])
    field = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("quote", pa.string()), ("source", pa.string()), ("score", pa.float64()), ("matched_phrases", pa.list_(pa.string()))]))
    names, columns = [f.name for f in field.value_type], [*df.columns, "spans"]

    def run(batches):
        last, cut, known = None, [], lru_cache(KNOWN)(known_phrases)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part, spans = batch.slice(at, ROWS_AT_ONCE), []
                for text, mention, term, synonyms in zip(*(part.column(c) for c in ("text", "mention", "term", "synonyms")), strict=True):
                    text = text.as_py()
                    if text != last:
                        last, cut = text, [(start, end, quote, quote.lower()) for start, end, quote in cut_sentences(text)]
                    own = spans_of(text, cut, mention.as_py(), known(term.as_py(), synonyms.as_py()), max_spans)
                    spans.append([dict(zip(names, s, strict=True)) for s in own])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(spans, field)], names=columns)

    return df.mapInArrow(run, kind)


def evidence_spans(df: DataFrame, key: str | None = None, max_spans: int = 3) -> DataFrame:
    """(key, spans): with_spans() of rows of (key, text, mention, term, synonyms); the key is row_id where there is one, else record_id."""
    key = key or row_key(df)
    return with_spans(df.select(key, "text", "mention", "term", "synonyms"), max_spans).select(key, "spans")


def audited_spans(text: Column | str, spans: Column | str) -> Column:
    """The spans with the context around each and its assertion class."""
    c = F.col(spans) if isinstance(spans, str) else spans

    # The context becomes a field before it is judged, so that it is made once
    near = F.transform(c, lambda s: s.withField("assertion_context", local_context(text, s["start"], s["end"])))
    return F.transform(near, lambda s: s.withField("clinical_assertion", assertion(s["assertion_context"])))


def audit_context(expl: DataFrame) -> DataFrame:
    """Keep as evidence only what is affirmed; without any, the context needs review, the status is insufficient and the decision HUMAN_REVIEW.

    Spans that are not affirmed beside some that are only leave the evidence. all_extracted_evidence_quotes has the
    quotes of all spans, excluded_evidence_context the others with their class and context. expl: text, spans,
    decision, explanation_status, why.
    """
    rows = expl.withColumn("spans", audited_spans("text", "spans"))
    fine = F.transform(F.filter("spans", lambda s: (s["clinical_assertion"] == "affirmed") & (s["quote"] != "")), lambda s: s["quote"])
    other = F.filter("spans", lambda s: s["clinical_assertion"] != "affirmed")
    excluded = F.transform(other, lambda s: F.struct(s["quote"].alias("quote"), s["clinical_assertion"].alias("clinical_assertion"), s["assertion_context"].alias("context")))
    rows = rows.withColumn("all_extracted_evidence_quotes", F.transform("spans", lambda s: s["quote"])).withColumn("evidence_quotes", fine).withColumn("excluded_evidence_context", excluded)
    lost, some = F.size("evidence_quotes") == 0, F.size("excluded_evidence_context") > 0
    rows = rows.withColumn("context_review_required", lost)
    note = F.when(lost, F.concat("why", F.lit(" No affirmed evidence is left; expert review is recommended."))).when(some, F.concat("why", F.lit(" Spans that are not affirmed were left out as evidence."))).otherwise(F.col("why"))
    return rows.withColumn("why", note).withColumn("explanation_status", F.when(lost, NO_SUPPORT[1]).otherwise(F.col("explanation_status"))).withColumn("decision", F.when(lost, "HUMAN_REVIEW").otherwise(F.col("decision")))


def quality(expl: DataFrame) -> DataFrame:
    """Adds failures, warnings, quality_gate and what they rest on. expl: text, evidence_quotes, explanation_status, context_review_required, term, comprehensiveness_drop."""
    q, drop = F.coalesce("evidence_quotes", F.array().cast("array<string>")), F.col("comprehensiveness_drop")
    text = F.coalesce("text", F.lit(""))
    verbatim = (F.size(q) > 0) & F.forall(q, lambda x: F.contains(text, x))
    knowledge = trimmed(F.coalesce("term", F.lit(""))) != ""
    # The names of failures and warnings, in the order in which they are listed.
    failures = F.array_compact(F.array(
        F.when(F.size(q) == 0, "no_evidence_quotes"), F.when((F.size(q) > 0) & ~verbatim, "non_verbatim_evidence"), F.when(F.coalesce("context_review_required", F.lit(False)), "clinical_context_requires_review"),
        F.when(F.col("explanation_status").isin(*NO_SUPPORT), F.col("explanation_status")),
    ))
    warnings = F.array_compact(F.array(F.when(~knowledge, "missing_terminology_knowledge"), F.when(drop <= 0, "evidence_removal_did_not_reduce_score"), F.when(drop.isNull(), "faithfulness_not_available")))
    rows = expl.withColumn("failures", failures).withColumn("warnings", warnings).withColumn("verbatim_evidence", verbatim).withColumn("knowledge_present", knowledge).withColumn("comprehensiveness_positive", drop > 0)
    return rows.withColumn("quality_gate", F.when(F.size("failures") > 0, "FAIL").when(F.size("warnings") > 0, "WARN").otherwise("PASS"))


def apply_quality_gate(rows: DataFrame) -> DataFrame:
    """A failed gate turns an automatic decision into HUMAN_REVIEW; nothing is ever promoted."""
    auto = F.col("decision").isin("AUTO_CANDIDATE", "CODE_PROPOSAL")
    return rows.withColumn("decision_before_gate", F.col("decision")).withColumn("decision", F.when((F.col("quality_gate") == "FAIL") & auto, "HUMAN_REVIEW").otherwise(F.col("decision")))


def quality_summary(rows: DataFrame) -> DataFrame:
    """One row: the shares of each gate's outcome, and what the gate did to automatic decisions; zeros without rows."""
    auto = lambda c: F.col(c).isin("AUTO_CANDIDATE", "CODE_PROPOSAL").cast("int")
    share = lambda c: F.coalesce(F.avg(c.cast("int")), F.lit(0.0))
    before, after = share(auto("decision_before_gate")), share(auto("decision"))
    rates = [share(F.col("quality_gate") == g).alias(f"{g.lower()}_rate") for g in ("PASS", "WARN", "FAIL")]
    # The names of the summary.
    return rows.agg(
        F.count(F.lit(1)).alias("n"), *rates, F.count_if(F.col("decision") != F.col("decision_before_gate")).alias("n_decisions_downgraded"), before.alias("automatic_or_proposal_rate_before_quality_gate"),
        after.alias("automatic_or_proposal_rate_after_quality_gate"), (before - after).alias("additional_review_rate_due_to_explanation_gate"),
    )


def quality_cases(rows: DataFrame) -> DataFrame:
    """The gate's findings of every explanation, flat."""
    return rows.select(
        *row_keys(rows), "predicted_code", F.col("term").alias("predicted_term"), "quality_gate", F.to_json("failures").alias("quality_failures_json"), F.to_json("warnings").alias("quality_warnings_json"), "verbatim_evidence", "knowledge_present",
        "comprehensiveness_positive", "decision_before_gate", F.col("decision").alias("decision_after_gate"), (F.col("decision") != F.col("decision_before_gate")).alias("decision_downgraded"),
    )


def task_input_spans(expl: DataFrame, source: DataFrame) -> DataFrame:
    """Spans given with the task replace the evidence where they are valid. source: record_id, spans_json ([[start, end], ...]) and row_id or occurrence."""
    given = F.coalesce(F.from_json("spans_json", "array<array<int>>"), F.array().cast("array<array<int>>"))
    keys = ["row_id"] if "row_id" in expl.columns and "row_id" in source.columns else ["record_id", "occurrence"]
    rows = expl.join(source.select(*keys, "spans_json"), keys, "left")
    valid = F.filter(given, lambda p: (F.size(p) == 2) & (F.get(p, F.lit(0)) >= 0) & (F.get(p, F.lit(1)) > F.get(p, F.lit(0))) & (F.get(p, F.lit(1)) <= F.length("text")))
    made = F.transform(valid, lambda p: F.struct(F.get(p, F.lit(0)).alias("start"), F.get(p, F.lit(1)).alias("end"), F.substring(F.col("text"), F.get(p, F.lit(0)) + 1, F.get(p, F.lit(1)) - F.get(p, F.lit(0))).alias("quote"), F.lit("task_input_span").alias("source"), F.lit(3.0).alias("score"), F.array().cast("array<string>").alias("matched_phrases"))).cast(SPAN)
    return rows.withColumn("spans", F.when(F.size(made) > 0, made).otherwise(F.col("spans"))).drop("spans_json")


def aligned(pred: DataFrame, source: DataFrame) -> DataFrame:
    """Predictions with text and mention of their rows of the source: by row_id, or, where a side has none, by record_id and occurrence.

    ValueError if a prediction has no record.
    """
    if "row_id" in pred.columns and "row_id" in source.columns:
        rows = pred.join(source.drop("gold_code", *(c for c in pred.columns if c != "row_id")), "row_id", "left")
    else:
        rows = pred.join(source.drop("gold_code"), ["record_id", "occurrence"], "left")
    if not rows.filter("text is null").isEmpty():
        raise ValueError("Not every prediction has its record")
    return rows


def with_occurrence(df: DataFrame, key: str = "record_id", order: str = "row_seq") -> DataFrame:
    """The number of each row among those of its record, for joins by position."""
    return df.withColumn("occurrence", F.row_number().over(W.partitionBy(key).orderBy(order)))


def explanations(pred: DataFrame, terms: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """A row per prediction: spans, quotes, status, a fixed sentence `why`, and up to two cases of the same code.

    pred: record_id, text, mention, predicted_code, confidence, decision, and row_id where ids repeat; cases: record_id
    (and row_id), rank, code, case_text.
    """
    key = row_key(pred)
    t = terms.select(F.col("code").alias("predicted_code"), "term", "synonyms", "definition", "hierarchy", "system", "knowledge_source")
    rows = pred.join(t, "predicted_code", "left").fillna("", ["term", "synonyms", "definition", "hierarchy", "knowledge_source"]).fillna("unspecified", ["system"])
    rows = with_spans(rows)
    if cases is not None:
        same = cases.join(pred.select(key, F.col("predicted_code").alias("code")), [key, "code"])
        same = same.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy("rank"))).filter("_n <= 2")
        rows = rows.join(same.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_n", "case_text"))).alias("historical_support")), key, "left")
    quotes = F.transform("spans", lambda s: s["quote"])
    rows = rows.withColumn("evidence_quotes", quotes).withColumn("explanation_status", F.when(F.size(quotes) > 0, "grounded").otherwise(NO_SUPPORT[0]))
    shown = F.array_join(F.transform(F.slice("evidence_quotes", 1, 2), lambda q: F.concat(F.lit("“"), q, F.lit("”"))), "; ")
    good = F.concat(F.lit("Code "), "predicted_code", F.lit(" ("), "term", F.lit(") of "), "system", F.lit(" rests on the words "), shown, F.lit("."))
    bad = F.concat(F.lit("Code "), "predicted_code", F.lit(" ("), "term", F.lit(") was proposed, but no words of the text support it; expert review is recommended."))
    return rows.withColumn("why", F.when(F.col("explanation_status") == "grounded", good).otherwise(bad))


def with_provenance(expl: DataFrame) -> DataFrame:
    """Adds the knowledge that an explanation rests on, and the terminology phrases that its spans hold."""
    phrases_ = F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda s: s["matched_phrases"]))))
    knowledge = F.struct("term", "synonyms", "definition", "hierarchy", F.col("system").alias("coding_system"), "knowledge_source")
    verbatim = (F.size("evidence_quotes") > 0) & F.forall("evidence_quotes", lambda q: F.contains(F.col("text"), q))
    return expl.withColumn("external_knowledge", knowledge).withColumn("matched_terminology_phrases", phrases_).withColumn("evidence_verbatim", verbatim)


def faithfulness(expl: DataFrame, coder) -> DataFrame:
    """Adds the code's score on the model's input, on the evidence alone and on the input without it, and their differences.

    The three texts of every row are scored in one batch.
    """
    body = F.when(F.trim(F.coalesce("mention", F.lit(""))) != "", F.trim("mention")).otherwise(F.col("text"))
    expl, key = kept(expl), row_key(expl)
    rows = expl.withColumn("input", body)
    spans = evidence_spans(rows.select(key, F.col("input").alias("text"), "mention", "term", "synonyms")).withColumnRenamed("spans", "model_spans")
    rows = kept(rows.join(spans, key).select(key, "predicted_code", "input", "model_spans"))
    variants = F.array(F.struct(F.lit("whole").alias("kind"), F.col("input").alias("text")), F.struct(F.lit("only").alias("kind"), F.array_join(F.transform("model_spans", lambda s: s["quote"]), " ").alias("text")), F.struct(F.lit("removed").alias("kind"), without_spans("input", "model_spans").alias("text")))
    flat = rows.select(key, F.col("predicted_code").alias("code"), F.explode(variants).alias("v")).select(F.struct(F.col(key).alias("row"), "v.kind").alias("key"), "code", "v.text")
    s = coder.score_code(flat).select(F.col("key.row").alias(key), "key.kind", "score").groupBy(key).pivot("kind", ["whole", "only", "removed"]).agg(F.first("score"))
    out = expl.join(s, key, "left")
    return out.select(*expl.columns, F.col("whole").alias("original_score"), F.col("only").alias("evidence_only_score"), F.col("removed").alias("evidence_removed_score"), (F.col("whole") - F.col("only")).alias("sufficiency_gap"), (F.col("whole") - F.col("removed")).alias("comprehensiveness_drop"))


def candidate_rationales(candidates: DataFrame, terms: DataFrame, cases: DataFrame | None = None, top_k: int = 5) -> DataFrame:
    """A row per displayed candidate with its own evidence. candidates: record_id (and row_id), text, mention, rank, code, score."""
    key = row_key(candidates)
    rows = candidates.filter(F.col("rank") <= top_k).join(terms.select("code", "term", "synonyms", "definition"), "code", "left").fillna("", ["term", "synonyms", "definition"])
    rows = with_spans(rows)
    if cases is not None:
        near = cases.withColumn("_n", F.row_number().over(W.partitionBy(key, "code").orderBy("rank"))).filter("_n <= 2")
        rows = rows.join(near.groupBy(key, "code").agg(F.array_sort(F.collect_list(F.struct("_n", "case_text"))).alias("historical_support")), [key, "code"], "left")
    quotes = F.transform("spans", lambda s: s["quote"])
    why = F.when(F.size(quotes) > 0, F.concat(F.lit("Supported by: "), F.array_join(quotes, "; "))).otherwise("No words of the text support this candidate.")
    return rows.withColumn("evidence_quotes", quotes).withColumn("rationale", why)


def review_packets(rationales: DataFrame, routed: DataFrame) -> DataFrame:
    """A nested row per record, or per row_id: its route and uncertainty, and its candidates in order, with blank fields for the reviewer."""
    keys = row_keys(routed)
    option = F.struct("rank", "code", "term", "score", "evidence_quotes", "rationale")
    nested = rationales.groupBy(*keys).agg(F.array_sort(F.collect_list(option)).alias("candidate_options"))
    blank = [F.lit("").alias(c) for c in ("human_action", "human_selected_code", "reviewer_reason")]
    return routed.select(*keys, "route", "uncertainty").join(nested, keys).select("*", *blank)


def multilabel_explanations(ranked: DataFrame, notes: DataFrame, terms: DataFrame, threshold: float, fallback: int = 5, cases: DataFrame | None = None) -> DataFrame:
    """Proposals at or above the threshold (else the best `fallback`), each explained; decision CODE_PROPOSAL. notes: record_id, text, gold_codes.

    A row_id names the pair of note and code; cases: row_id, rank, code, case_text.
    """
    any_ = F.max((F.col("score") >= threshold).cast("int")).over(W.partitionBy("record_id"))
    kept = ranked.withColumn("_any", any_).filter(((F.col("_any") == 1) & (F.col("score") >= threshold)) | ((F.col("_any") == 0) & (F.col("rank") <= fallback)))
    rows = kept.join(notes, "record_id").select("record_id", F.concat_ws("#", "record_id", "code").alias("row_id"), "text", F.lit("").alias("mention"), F.col("code").alias("predicted_code"), F.col("score").alias("confidence"), F.lit("CODE_PROPOSAL").alias("decision"), F.array_contains("gold_codes", F.col("code")).alias("gold_code_present"))
    return explanations(rows, terms, cases)


def explainability_metrics(expl: DataFrame) -> DataFrame:
    """One row: n, the rates of grounded and of verbatim explanations, and the mean gaps where they were measured."""
    verbatim = (F.size("evidence_quotes") > 0) & F.forall("evidence_quotes", lambda q: F.contains(F.col("text"), q))
    rate = lambda c: F.coalesce(F.avg(c.cast("int")), F.lit(0.0))
    mean = lambda c: F.avg(c) if c in expl.columns else F.lit(None).cast("double")
    return expl.agg(F.count(F.lit(1)).alias("n"), rate(F.col("explanation_status") == "grounded").alias("grounded_rate"), rate(verbatim).alias("verbatim_evidence_rate"), mean("sufficiency_gap").alias("mean_sufficiency_gap"), mean("comprehensiveness_drop").alias("mean_comprehensiveness_drop"))


def as_html(expl: DataFrame) -> DataFrame:
    """(record_id, row_id where there is one, html): a card for each explanation, with its evidence marked in the text."""
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    parts = [F.lit("<section><h2>"), safe("predicted_code"), F.lit(" "), safe("term"), F.lit("</h2><p>"), safe("decision"), F.lit(" "), safe("confidence"), F.lit("</p><p>"), safe("why"), F.lit("</p><div>"), highlighted("text", "spans"), F.lit("</div></section>")]
    return expl.select(*row_keys(expl), F.concat(*parts).alias("html"))


def write_explanations(expl: DataFrame, path: str) -> dict:
    """Write Parquet, JSON lines, cards in HTML and a table for experts to fill in, and return the rates over all rows."""
    expl.write.mode("overwrite").parquet(f"{path}/explanations.parquet")
    expl.write.mode("overwrite").json(f"{path}/explanations.jsonl")
    as_html(expl).select("html").write.mode("overwrite").text(f"{path}/explanations.html")
    blank = [F.lit("").alias(c) for c in ("expert_code_supported", "expert_evidence_complete", "expert_rationale_correct", "expert_comments")]
    expl.select(*row_keys(expl), F.col("system").alias("coding_system"), "predicted_code", F.col("term").alias("predicted_term"), "why", F.to_json("evidence_quotes").alias("evidence_quotes_json"), *blank).write.mode("overwrite").option("header", True).csv(f"{path}/rationale_review_template.csv")
    return explainability_metrics(expl).first().asDict()


def highlighted(text: Column | str, spans: Column | str) -> Column:
    """HTML of a text with its (sorted, disjoint) spans marked."""
    t, c = (F.col(x) if isinstance(x, str) else x for x in (text, spans))
    safe = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("html"))
    done = F.aggregate(c, start, lambda a, s: F.struct(s["end"].alias("at"), F.concat(a["html"], safe(F.substring(t, a["at"] + 1, s["start"] - a["at"])), F.lit("<mark>"), safe(F.substring(t, s["start"] + 1, s["end"] - s["start"])), F.lit("</mark>")).alias("html")))
    return F.concat(done["html"], safe(F.substring(t, done["at"] + 1, F.length(t))))
