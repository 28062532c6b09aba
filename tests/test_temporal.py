"""As-of retrieval: no later history in any score or case, equal to a coder fitted on what was known, in one block and in many."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from termweave.operators import retrieval, temporal

DAY0 = datetime(2020, 1, 1)


def data(spark, n=160, seed=5):
    rng = random.Random(seed)
    words = ["muscle", "pain", "ache", "rash", "skin", "red", "itchy", "nausea", "sick", "vomit", "cough", "fever"]
    phrase = lambda: " ".join(rng.sample(words, rng.randint(1, 4)))
    codes = [f"C{i}" for i in range(12)]
    terms = spark.createDataFrame([(c, phrase(), i) for i, c in enumerate(codes)], "code string, term string, row_seq long")
    rows = [(f"r{i}", phrase(), "", codes[2] if rng.random() < 0.4 else rng.choice(codes), i, DAY0 + timedelta(days=rng.randint(0, 100))) for i in range(n)]
    rows += [(f"x{i}", rows[i][1], "", rows[i][3], n + i, DAY0 + timedelta(days=200)) for i in range(10)]  # repeats count from their first day
    return spark.createDataFrame(rows, "record_id string, text string, mention string, gold_code string, row_seq long, at timestamp"), terms, rows


def test_nothing_later_enters(spark):
    rows, terms, plain = data(spark)
    before = DAY0 + timedelta(days=50)
    asked = rows.filter(F.col("at") >= F.lit(before))
    c = temporal.AsOfCoder(0.5, 4).fit(rows, terms, before)
    cases = c.cases(asked, 6).join(asked.select("record_id", "at"), "record_id").select("*", F.unix_micros("at").alias("now")).collect()
    assert cases and all(r.case_at < r.now for r in cases)
    # Changing and dropping everything later changes no score of a day's records
    day = DAY0 + timedelta(days=70)
    some = asked.filter(F.col("at") == F.lit(day))
    if some.isEmpty():
        day = asked.filter(F.col("at") > F.lit(before)).agg(F.min("at")).first()[0]
        some = asked.filter(F.col("at") == F.lit(day))
    later = rows.withColumn("gold_code", F.when(F.col("at") >= F.lit(day), "C9").otherwise(F.col("gold_code"))).withColumn("text", F.when(F.col("at") >= F.lit(day), F.lit("muscle rash fever")).otherwise(F.col("text")))
    key = lambda df: sorted((r.record_id, r["rank"], r.code, round(r.score, 9), round(r.history_score, 9)) for r in df.collect())
    base = key(c.predict(some))
    assert base == key(temporal.AsOfCoder(0.5, 4).fit(later, terms, before).predict(some)) == key(temporal.AsOfCoder(0.5, 4).fit(rows.filter(F.col("at") < F.lit(day)), terms, before).predict(some))


def test_scores_are_those_of_the_history_before(spark):
    """Each record against brute force over all pairs, in one block and in blocks that cut the largest code."""
    rows, terms, plain = data(spark)
    before = DAY0 + timedelta(days=60)
    asked = rows.filter(F.col("at") >= F.lit(before))
    c = temporal.AsOfCoder(0.5, 12).fit(rows, terms, before)
    _, queries = c.asked(asked)
    sims = retrieval.similarities(queries.select("query", "text"), c.memory).join(c.history.select("item", "gold_code", "at"), "item").join(queries.select("query", F.col("at").alias("now")), "query")
    want = {(bytes(r.query), r.gold_code): r.s for r in sims.filter("at < now").groupBy("query", "gold_code").agg(F.max("sim").alias("s")).collect()}
    for most in (None, 150):
        got = {(bytes(r.query), r.code): r.history_score for r in c.top(queries, most).collect() if r.history_score}
        assert set(got) == {k for k, v in want.items() if v > 0} and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_times_are_checked(spark):
    rows, terms, _ = data(spark)
    c = temporal.AsOfCoder().fit(rows, terms, "2020-03-01")
    for bad in (rows.limit(1).withColumn("at", F.lit("2020-02-01").cast("timestamp")), rows.limit(1).withColumn("at", F.lit(None).cast("timestamp"))):
        with pytest.raises(ValueError):
            c.predict(bad)
    with pytest.raises(ValueError):
        temporal.AsOfCoder(2)
    # Several mentions of a record at several times: a row each
    two = spark.createDataFrame([("r", "red rash", "", 0, datetime(2020, 3, 5)), ("r", "red rash", "", 1, datetime(2021, 3, 5))], "record_id string, text string, mention string, row_seq long, at timestamp")
    assert sorted(r["count"] for r in c.predict(two).groupBy("row_id").count().collect()) == [10, 10]


def test_periods_and_their_subjects(spark):
    rows = spark.createDataFrame([("a", datetime(2020, 1, 1)), ("a", datetime(2021, 1, 1)), ("b", datetime(2021, 6, 1)), ("c", datetime(2022, 1, 1)), ("b", None), (None, datetime(2022, 1, 1))], "subject string, at timestamp")
    own = rows.withColumn("split", temporal.period("at", "2021-01-01", "2022-01-01"))
    assert sorted(str(r.split) for r in own.collect()) == ["None", "test", "test", "train", "val", "val"]
    leaks = temporal.period_leaks(own, "subject").collect()
    assert [(r.subject, r.n_splits, r.first_at, r.last_at) for r in leaks] == [("a", 2, datetime(2020, 1, 1), datetime(2021, 1, 1))]
    test = temporal.without_seen_subjects(own.filter("split = 'test'"), own.filter("split <> 'test'"), "subject")
    assert sorted(str(r.subject) for r in test.collect()) == ["None", "c"]
    with pytest.raises(ValueError):
        temporal.period("at", "2022-01-01", "2021-01-01")
