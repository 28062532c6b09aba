"""Operator 3 where one record is a third of all rows, and with columns of maps and clashing names."""

from pyspark.sql import functions as F

from termweave.llm import sharding


def test_one_record_in_a_third_of_all_rows(spark):
    """20,000 copies are numbered in chunks, in more tasks than one, and every row comes out once, in even shards."""
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    marked = sharding.numbered(rows.withColumn("key", F.col("doc_id")), ["key", "text"])
    hot = marked.filter("doc_id = 7 and text = 'same text'").withColumn("task", F.spark_partition_id())
    assert hot.agg(F.count_distinct("nth"), F.min("nth"), F.max("nth")).first()[:] == (20_000, 1, 20_000)
    assert hot.select("task").distinct().count() > 1
    got = sharding.shuffled(rows, 8, bucket_rows=2000)
    assert sorted(r["count"] for r in got.groupBy("shard").count().collect()) == [7500] * 8
    assert got.groupBy("shard", "slot").count().filter("count > 1").isEmpty() and got.filter("doc_id = 7 and text = 'same text'").count() == 20_000
    # Copies spread over the shards as other rows do
    assert all(2000 < r["count"] < 3000 for r in got.filter("doc_id = 7").groupBy("shard").count().collect())


def test_maps_and_clashing_names(spark):
    rows = spark.createDataFrame([(1, "a", {"k": 1}, {"x": [1]}, "s", 5), (1, "a", {"k": 1}, {"x": [1]}, "s", 5), (2, None, None, {}, "t", 6)], "doc_id long, text string, m map<string,int>, bytes map<string,array<int>>, size string, `a.b` int")
    got = sharding.shuffled(rows, 2)
    out = sorted((r.doc_id, r.text, r.m, r.bytes, r["size"], r["a.b"]) for r in got.collect() if r.doc_id == 1) + [(r.doc_id, r.text, r.m, r.bytes, r["size"], r["a.b"]) for r in got.collect() if r.doc_id == 2]
    assert out == [(1, "a", {"k": 1}, {"x": [1]}, 17, 5)] * 2 + [(2, None, None, {}, 16, 6)]
    assert sharding.shuffled(rows.limit(0), 2).count() == 0
