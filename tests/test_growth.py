"""What keeps the work of a query from growing faster than its input."""

from pyspark.sql import functions as F

import __spark_entry__
from termweave.operators import explain, retrieval, temporal
from termweave.plans import frames

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    most = "spark.sql.maxPlanStringLength"
    was = df.sparkSession.conf.get(most)
    df.sparkSession.conf.set(most, "1000000")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        df.sparkSession.conf.set(most, was)


def test_the_audit_shuffles_no_text(spark):
    assert "Exchange" not in plan(__spark_entry__.queries()["explanation_audit"](spark, SF))


def test_spans_where_the_rows_lie(spark):
    rows = [
        (1, "A red Rash here. No fever; red spots.\nheader\nRASH again", "rash", "Red  spots", " RED spots |red|; \x1f"), (1, "A red Rash here. No fever; red spots.\nheader\nRASH again", " ", "zz", None),
        (2, None, "rash", "rash", "red"), (3, "", "", "", ""), (4, "No mark \t but red", "RED", None, "red\nRed"),
    ]
    df = spark.createDataFrame(rows, "record_id long, text string, mention string, term string, synonyms string")
    got = explain.with_spans(df)
    assert "Exchange" not in plan(got) and got.columns == [*df.columns, "spans"]
    spans = [[(s.start, s.end, s.quote, s.source, s.score, s.matched_phrases) for s in r.spans] for r in got.collect()]
    # The target's words are red, spots and rash
    assert spans == [
        [(6, 10, "Rash", "explicit_mention", 2.0, []), (17, 37, "No fever; red spots.", "supporting_sentence", 2 / 3 + 1.0, ["RED spots", "red"]), (45, 55, "RASH again", "supporting_sentence", 1 / 3 + 1.0, [])],
        [], [], [], [(14, 17, "red", "explicit_mention", 2.0, ["red"])],
    ]
    assert [len(r.spans) for r in explain.evidence_spans(df, max_spans=1).collect()] == [1, 0, 0, 0, 1]


def test_fused_pools_are_dealt_once_and_by_their_rows(spark, monkeypatch):
    monkeypatch.setattr(frames, "ROWS", 500)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    df = __spark_entry__.queries()["pooled_fusion"](spark, SF)
    assert plan(df).count("Exchange hashpartitioning") == plan(df).count("REPARTITION_BY_NUM") > 0
    assert df.rdd.getNumPartitions() == -(-lines // 500) > 4


def test_queries_of_records_in_time_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "TEXTS", 10)
    coder = temporal.AsOfCoder()
    coder.before = "2000-01-01"
    records = spark.range(95).selectExpr("cast(id as string) AS record_id", "concat('text ', id) AS text", "'' AS mention", "timestamp'2001-01-01' AS at")
    named, queries = coder.asked(records)
    assert queries.rdd.getNumPartitions() == 10 and queries.count() == named.count() == 95


def test_rationales_join_no_evidence(spark):
    rows = [(1, "red rash", "", 1, "A", 0.5), (1, "red rash", "", 2, "B", 0.4), (1, "red rash", "", 2, "B", 0.4)]
    terms = spark.createDataFrame([("A", "Rash", "red|blue", ""), ("B", "cough", "", "")], "code string, term string, synonyms string, definition string")
    df = explain.candidate_rationales(spark.createDataFrame(rows, "record_id long, text string, mention string, rank int, code string, score double"), F.broadcast(terms))
    assert "Exchange hashpartitioning" not in plan(df)
    # A candidate that is there twice stays two rows
    assert sorted((r.code, r.evidence_quotes) for r in df.collect()) == [("A", ["red rash"]), ("B", []), ("B", [])]


def test_no_row_for_a_gram_of_a_note_is_shuffled(spark):
    docs = spark.createDataFrame([(str(i), f"red rash {i % 3}x and red fever", ["A"]) for i in range(60)], "record_id string, text string, gold_codes array<string>")
    coder = retrieval.MultiLabelCoder(1.0, 3).fit(docs, spark.createDataFrame([("A", "x", 0)], "code string, term string, row_seq long"))
    for df in (coder.notes.idf, coder.centroids.postings):
        assert "MapInArrow" in plan(df) and "Generate explode" not in plan(df)
