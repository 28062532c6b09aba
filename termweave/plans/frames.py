"""The engine's inputs out of the driver's tables, and the same as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.functions.hashing import split_by_hash
from termweave.operators.retrieval import confidence

SEED = 42
#: Rows of a partition of dealt().
ROWS = 250_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str, rows: int) -> DataFrame:
    """Dealt by a key into partitions of about ROWS rows at most, of `rows` in all.

    Partitions that Spark makes by itself are merged by their bytes, and narrow rows take many times these once they
    are sorted and grouped.
    """
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS)), key)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to 6 decimals: sums come in another order in other engines."""
    return df.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def part_terms(spark, sf_dir) -> DataFrame:
    """A terminology: each part name is a term, its code the smallest key, its synonyms the names with their types."""
    p = read(spark, sf_dir, "part")
    names = F.array_join(F.array_sort(F.collect_set(F.concat_ws(" ", "p_type", "p_name"))), "|")
    return p.groupBy("p_name").agg(F.min("p_partkey").alias("row_seq"), names.alias("synonyms")).select(F.col("row_seq").cast("string").alias("code"), F.col("p_name").alias("term"), "synonyms", "row_seq")


def part_records(spark, sf_dir) -> DataFrame:
    """Coded records: type, name and brand of a part as the text, the name's code as gold."""
    p = read(spark, sf_dir, "part")
    t = part_terms(spark, sf_dir).select(F.col("code").alias("gold_code"), F.col("term").alias("p_name"))
    rows = p.join(F.broadcast(t), "p_name")  # 64 names
    return rows.select(F.col("p_partkey").cast("string").alias("record_id"), F.concat_ws(" ", "p_type", "p_name", "p_brand").alias("text"), F.lit("").alias("mention"), "gold_code", split_by_hash(F.col("p_partkey"), SEED).alias("split"), F.col("p_partkey").alias("row_seq"))


def split_sql(key: str, seed: int = SEED) -> str:
    u = f"(('0x' || substr(sha256('{seed}:' || {key}), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0)"
    return f"CASE WHEN {u} < 0.70 THEN 'train' WHEN {u} < 0.70 + 0.15 THEN 'val' ELSE 'test' END"


PARTS = f"""
terms AS (SELECT min(p_partkey)::VARCHAR AS code, p_name AS term, string_agg(DISTINCT p_type || ' ' || p_name, '|' ORDER BY p_type || ' ' || p_name) AS synonyms, min(p_partkey) AS row_seq FROM part GROUP BY p_name),
recs AS (SELECT p_partkey::VARCHAR AS record_id, p_type || ' ' || p_name || ' ' || p_brand AS text, t.code AS gold_code, {split_sql('p_partkey')} AS split, p_partkey AS row_seq FROM part JOIN terms t ON t.term = p_name)"""


def code_of(c):
    return F.concat(F.lit("C"), F.lpad((c % 50).cast("string"), 2, "0"))


def candidates(spark, sf_dir) -> DataFrame:
    """(record_id, code, score): an order's candidates are its parts' groups, scored by price. Dealt by record_id."""
    li = read(spark, sf_dir, "lineitem")
    li = dealt(li.select("l_orderkey", "l_partkey", "l_extendedprice"), "l_orderkey", li.count())
    return li.groupBy(F.col("l_orderkey").alias("record_id"), code_of(F.col("l_partkey")).alias("code")).agg(F.round(F.max("l_extendedprice") / 110003.0, 5).alias("score"))


def predictions(spark, sf_dir) -> DataFrame:
    """Predictions of the orders that have lines: codes in order, predicted_code, confidence, correct, split."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "code")))
    got = candidates(spark, sf_dir).groupBy("record_id").agg(ordered.alias("c"))
    at = lambda i: -F.get("c", F.lit(i))["minus"]
    rows = read(spark, sf_dir, "orders").join(got, F.col("o_orderkey") == F.col("record_id"))
    rows = rows.select("record_id", F.col("o_custkey").alias("subject_id"), code_of(F.col("o_custkey")).alias("gold_code"), F.transform("c", lambda x: x["code"]).alias("codes"), F.transform("c", lambda x: -x["minus"]).alias("scores"), F.round(confidence(at(0), at(1)), 6).alias("confidence"), split_by_hash(F.col("o_orderkey"), SEED).alias("split"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    return rows.withColumn("predicted_code", F.get("codes", F.lit(0))).withColumn("correct", (F.col("predicted_code") == F.col("gold_code")).cast("int"))


def seen_codes(spark, sf_dir) -> DataFrame:
    """Codes of the training part: those of open orders of large price, so that some codes stay unseen."""
    o = read(spark, sf_dir, "orders")
    return o.filter((split_by_hash(F.col("o_orderkey"), SEED) == "train") & (F.col("o_orderstatus") == "O") & (F.col("o_custkey") % 3 == 0) & (F.col("o_custkey") % 50 < 40)).select(code_of(F.col("o_custkey")).alias("code")).distinct()


PREDICTIONS = f"""
cand AS (SELECT l_orderkey AS record_id, 'C' || lpad((l_partkey % 50)::VARCHAR, 2, '0') AS code, round(max(l_extendedprice) / 110003.0, 5) AS score FROM lineitem GROUP BY ALL),
lists AS (SELECT record_id, list(code ORDER BY score DESC, code) AS codes, list(score ORDER BY score DESC, code) AS scores FROM cand GROUP BY record_id),
pred0 AS (SELECT record_id, o_custkey AS subject_id, 'C' || lpad((o_custkey % 50)::VARCHAR, 2, '0') AS gold_code, codes, scores,
  round(least(greatest(0.5 * scores[1] + 0.5 * greatest(scores[1] - coalesce(scores[2], 0.0), 0.0), 0.0), 1.0), 6) AS confidence, {split_sql('o_orderkey')} AS split, o_orderstatus AS status, o_totalprice AS price,
  codes[1] AS predicted_code FROM orders JOIN lists ON o_orderkey = record_id),
pred AS (SELECT *, (predicted_code = gold_code)::INT AS correct FROM pred0),
seen AS (SELECT DISTINCT 'C' || lpad((o_custkey % 50)::VARCHAR, 2, '0') AS code FROM orders WHERE {split_sql('o_orderkey')} = 'train' AND o_orderstatus = 'O' AND o_custkey % 3 = 0 AND o_custkey % 50 < 40)"""


def multilabel(spark, sf_dir) -> DataFrame:
    """Notes of several labels: gold are the returned lines' parts, candidates all lines' parts scored by price."""
    li = read(spark, sf_dir, "lineitem").withColumn("code", code_of(F.col("l_partkey")))
    per = li.groupBy(F.col("l_orderkey").alias("record_id"), "code").agg(F.round(F.max("l_extendedprice") / 110003.0, 5).alias("score"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("gold"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "code")))
    gold = F.array_compact(F.collect_list(F.when(F.col("gold") == 1, F.col("code"))))
    return per.groupBy("record_id").agg(gold.alias("gold"), F.transform(ordered, lambda x: F.struct(x["code"].alias("code"), (-x["minus"]).alias("score"))).alias("candidates"))


MULTILABEL = """
ml AS (SELECT l_orderkey AS record_id, 'C' || lpad((l_partkey % 50)::VARCHAR, 2, '0') AS code, round(max(l_extendedprice) / 110003.0, 5) AS score, max((l_returnflag = 'R')::INT) AS gold FROM lineitem GROUP BY ALL),
mlr AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY score DESC, code) AS rank FROM ml)"""


def review_events(spark, sf_dir) -> DataFrame:
    """The events table as a review log: each user is a record, each type an action, the first event of a user its enqueueing."""
    e = read(spark, sf_dir, "events")
    first = e.groupBy("user_id").agg(F.min("event_id").alias("first"))
    kinds = F.create_map(*[F.lit(x) for pair in zip(("view", "click", "purchase", "signup", "error"), ("ACCEPT_TOP1", "SELECT_ALTERNATIVE", "RECODE_OUTSIDE_TOPK", "NO_CODE", "ESCALATE"), strict=True) for x in pair])
    rows = e.join(first, "user_id")
    opening = F.col("event_id") == F.col("first")
    return rows.select("event_id", F.col("user_id").cast("string").alias("record_id"), F.when(opening, "ENQUEUE").otherwise("DECIDE").alias("kind"), F.when(opening, "").otherwise(kinds[F.col("event_type")]).alias("action"), F.concat(F.lit("C"), F.get_json_object("props", "$.k")).alias("selected_code"), F.lit("").alias("reviewer_hash"), F.lit("").alias("reason"), "ts")


REVIEW = """
ev AS (SELECT event_id, user_id::VARCHAR AS record_id, CASE WHEN event_id = min(event_id) OVER (PARTITION BY user_id) THEN 'ENQUEUE' ELSE 'DECIDE' END AS kind,
  CASE event_type WHEN 'view' THEN 'ACCEPT_TOP1' WHEN 'click' THEN 'SELECT_ALTERNATIVE' WHEN 'purchase' THEN 'RECODE_OUTSIDE_TOPK' WHEN 'signup' THEN 'NO_CODE' ELSE 'ESCALATE' END AS act,
  'C' || json_extract_string(props, '$.k') AS selected_code, ts FROM events),
log AS (SELECT *, CASE WHEN kind = 'ENQUEUE' THEN '' ELSE act END AS action FROM ev)"""


def feedback(spark, sf_dir) -> DataFrame:
    """Feedback rows out of events: candidate codes from the value, so that some rows are inconsistent."""
    e = review_events(spark, sf_dir).filter("kind = 'DECIDE'")
    k = F.regexp_extract("selected_code", r"(\d+)", 1).cast("int")
    codes = F.array(*[F.concat(F.lit("C"), (F.floor(k / 10) * 10 + i).cast("string")) for i in (0, 3, 6)])
    return e.select(F.col("event_id"), "record_id", F.lit("r1").alias("model_release"), codes.alias("original_candidate_codes"), F.col("selected_code").alias("human_selected_code"), F.col("action").alias("human_action"))


FEEDBACK = REVIEW + """,
fb AS (SELECT event_id, record_id, selected_code AS code, action, list_transform([0, 3, 6], lambda i: 'C' || (substr(selected_code, 2)::INT // 10 * 10 + i)::VARCHAR) AS cands FROM log WHERE kind = 'DECIDE')"""


def spans(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Predicted and reference intervals: an order's lines that were returned against the others."""
    li = read(spark, sf_dir, "lineitem")
    s = (F.col("l_partkey") % 40 * 5).cast("int")
    rows = li.select((F.col("l_orderkey") % 500).alias("record_id"), F.concat(F.lit("C"), (F.col("l_suppkey") % 4).cast("string")).alias("code"), s.alias("s"), (s + F.col("l_quantity").cast("int") % 12 - 2).alias("e"), "l_returnflag")
    return rows.filter("l_returnflag = 'R'").drop("l_returnflag"), rows.filter("l_returnflag <> 'R'").drop("l_returnflag")


SPANS = """
sp AS (SELECT l_orderkey % 500 AS record_id, 'C' || (l_suppkey % 4)::VARCHAR AS code, (l_partkey % 40 * 5)::INT AS s, (l_partkey % 40 * 5)::INT + l_quantity::INT % 12 - 2 AS e, l_returnflag AS f FROM lineitem),
px AS (SELECT DISTINCT record_id, code, unnest(range(s, e)) AS x FROM sp WHERE f = 'R' AND e > s),
rx AS (SELECT DISTINCT record_id, code, unnest(range(s, e)) AS x FROM sp WHERE f <> 'R' AND e > s)"""
