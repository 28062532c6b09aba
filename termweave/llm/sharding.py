"""Operator 3: a two-pass external shuffle that deals records into shards of near-equal row counts.

Pass 1 scatters the records uniformly, by a seeded hash, into buckets sized to fit a task's memory. Records that repeat
often are counted first and numbered, and the number takes part in the hash, so that they scatter too. Pass 2 runs a
Fisher-Yates shuffle inside each bucket (Spark's `shuffle` over the bucket's array) and lays the buckets end to end;
the position in that order gives shard and slot. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termweave.llm.common import crc_unsigned, fresh_path, table

#: A bucket's share of the memory of a core: its rows are held as one array, which is sorted and shuffled.
SHARE = 16
#: Bytes that a record takes beside its text.
OVERHEAD = 256
#: Records that occur more often than this are numbered.
REPEATS = 64
#: Copies of a record whose numbers one task makes.
CHUNK = 1024
#: Repeated records, and starts of buckets, of at most so many rows are broadcast.
BROADCAST_ROWS = 1_000_000
SEED = 20240607


def bucket_size(spark) -> int:
    """Bytes of a bucket, from the memory and cores of an executor (of the driver, where it runs the tasks)."""
    conf = spark.sparkContext.getConf()
    local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
    memory = conf.get("spark.driver.memory" if local else "spark.executor.memory", "1g")
    number, unit = memory[:-1], memory[-1].lower()
    size = int(number) << {"k": 10, "m": 20, "g": 30, "t": 40}[unit] if unit in "kmgt" else int(memory) << 20
    cores = spark.sparkContext.defaultParallelism if local else int(conf.get("spark.executor.cores", "0")) or 4
    return max(1 << 20, size // cores // SHARE)


def numbered(rows: DataFrame, same: list[str]) -> DataFrame:
    """The rows with `nth`: 0, or for those that repeat more than REPEATS times their number among the equal ones.

    Equal rows collapse to a count in each task before they are shuffled; which of them gets which number makes no
    difference, so a task that runs again gives the same rows.
    """
    often = rows.groupBy(*same).agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > REPEATS).select(*[F.col(c).alias(f"often_{c}") for c in same]).persist()
    n = often.count()
    if not n:
        often.unpersist()
        return rows.withColumn("nth", F.lit(0).cast("long"))
    told = F.broadcast(often) if n <= BROADCAST_ROWS else often
    on = [F.col(c).eqNullSafe(F.col(f"often_{c}")) for c in same]
    many = rows.join(told, on, "left_semi").groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("c"))
    # A record that a third of all rows repeat is dealt over tasks before its numbers are made, a CHUNK in each
    many = many.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(c - 1) div {CHUNK}"))))
    many = many.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*same), F.col("chunk"))  # a number that stays: so few rows would be brought together again
    many = many.select(*rows.columns, F.explode(F.sequence(F.col("chunk") * CHUNK + 1, F.least((F.col("chunk") + 1) * CHUNK, "c"))).alias("nth"))
    return rows.join(told, on, "left_anti").withColumn("nth", F.lit(0).cast("long")).unionByName(many)


def shuffled(docs: DataFrame, n_shards: int, seed: int = SEED, text: str = "text", key: str = "doc_id", payload: bool = True, bucket_bytes: int | None = None, bucket_rows: int | None = None) -> DataFrame:
    """Every record with its size, shard and slot, in a uniformly random order fixed by the seed.

    Law `rows`: the shards' counts differ by one at most. Slots have no gaps. Null text has no bytes and size 16;
    repeated rows are dealt separately, each with its own slot; an empty table gives no rows. Columns of `docs` other
    than key and text are carried only with `payload`; clashing names (`size`, `shard`, ...) are overwritten by ours.
    Columns of maps, which cannot be compared, travel as their entries.
    """
    maps = [name for name, kind in docs.dtypes if kind.startswith("map<")]
    docs = docs.withColumns({c: F.map_entries(c) for c in maps})
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("key"), F.octet_length(body).cast("long").alias("bytes"), crc_unsigned(F.col(text)).alias("crc"), *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if payload else [])
    )
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("bytes") + 16), F.lit(0)).alias("b")).first()
    n, buckets = total["n"], max(1, -(-(total["b"] + OVERHEAD * total["n"]) // (bucket_bytes or bucket_size(docs.sparkSession))))
    if bucket_rows:
        buckets = max(buckets, -(-n // bucket_rows))
    # Pass 1. Key, size, content and, of records that repeat, their number decide the bucket.
    scattered = numbered(rows, ["key", "bytes", "crc"]).withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "key", "bytes", "crc", "nth"), F.lit(buckets)).cast("int")).drop("nth")
    # Pass 2. One bucket is one partition and one array: its shuffle depends on the seed and the bucket's number alone,
    # so that a task that runs again after a lost executor gives the same order.
    item = F.struct("key", "crc", "bytes", *(["row"] if payload else []))
    dealt = (
        scattered.repartitionById(buckets, F.col("bucket"))
        .groupBy("bucket")
        .agg(F.sort_array(F.collect_list(item)).alias("items"))
        .select("bucket", F.posexplode(F.shuffle("items", F.lit(seed))).alias("at", "item"))
    )
    # Where each bucket starts: counts by bucket, summed in blocks of 4096 buckets and then over the blocks.
    counts = scattered.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).withColumn("block", F.expr("bucket div 4096"))
    blocks = counts.groupBy("block").agg(F.sum("c").alias("bc"))
    blocks = blocks.select("block", (F.sum("bc").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, 0)) - F.col("bc")).alias("before"))
    starts = counts.join(blocks, "block").select("bucket", (F.col("before") + F.sum("c").over(W.partitionBy("block").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("c")).alias("start"))
    # Few rows of fixed width: a shuffle here would move all texts once more
    placed = dealt.join(F.broadcast(starts) if buckets <= BROADCAST_ROWS else starts, "bucket").withColumn("p", F.col("start") + F.col("at"))
    placed = placed.withColumn("shard", F.expr(f"cast((p * {n_shards}) div {max(n, 1)} as int)"))
    # First position of shard i: ceil(i * n / shards)
    placed = placed.withColumn("slot", F.col("p") - F.expr(f"(cast(shard as bigint) * {n} + {n_shards - 1}) div {n_shards}"))
    whole = lambda c: F.map_from_entries(F.col(f"item.row.`{c}`")) if c in maps else F.col(f"item.row.`{c}`")
    rest = [whole(c).alias(c) for c in docs.columns if c not in (key, "size", "text_crc32", "shard", "slot", "bucket")] if payload else []
    return placed.select(F.col("item.key").alias(key), (F.col("item.bytes") + 16).alias("size"), F.col("item.crc").alias("text_crc32"), "shard", "slot", "bucket", *rest)


def write_shards(docs: DataFrame, n_shards: int, path: str | None = None, **how) -> str:
    """Write the shuffled records with their texts, a folder for each shard, in the order of their slots. Returns the path."""
    path = path or fresh_path(docs.sparkSession, "shards")
    shuffled(docs, n_shards, **how).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return path


def read_shards(spark, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, size, text_crc32, shard, slot) of written shards: size and CRC from the texts that lie there."""
    rows = spark.read.parquet(path)
    size = F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long") + 16
    return rows.select(key, size.alias("size"), crc_unsigned(F.col(text)).alias("text_crc32"), F.col("shard").cast("int").alias("shard"), "slot")


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents written into 40 shards, law `rows`, and read back."""
    path = write_shards(table(spark, sf_dir, "documents"), 40)
    return read_shards(spark, path).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
