"""Hash splits, fingerprints and deterministic samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unit(key: Column, seed: int) -> Column:
    """The first 8 bytes of sha256("seed:key"), big-endian, as a number in [0, 1)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(18446744073709551616.0)


def unit_unsalted(key: Column) -> Column:
    """The first 8 hexadecimal digits of sha256(key) over 2^32 - 1."""
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def split_by_hash(key: Column, seed: int = 42, train: float = 0.70, val: float = 0.15) -> Column:
    if not (0 < train < 1 and 0 <= val < 1 and train + val < 1):
        raise ValueError("train and val must be fractions that leave room for test")
    u = unit(key, seed)
    return F.when(u < train, "train").when(u < train + val, "val").otherwise("test")


def cross_source_split(source: Column, key: Column, test_source: str, val: float = 0.15) -> Column:
    """All of one source is test; the others are dealt by an unsalted hash."""
    return F.when(F.lower(source) == test_source.lower(), "test").when(unit_unsalted(key) < val, "val").otherwise("train")


def assert_all_splits(df: DataFrame, column: str = "split") -> DataFrame:
    """The rows, if train, val and test all have some; ValueError otherwise."""
    there = {r[column] for r in df.select(column).distinct().collect()}
    if missing := sorted({"train", "val", "test"} - there):
        raise ValueError(f"Splits without records: {missing}")
    return df


def sample(df: DataFrame, n: int, key: Column, seed: int) -> DataFrame:
    """n rows in the order of a seeded hash: the same rows on every run (not numpy's)."""
    return df.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), key).limit(n)


def fingerprint(df: DataFrame) -> DataFrame:
    """One row that depends on the rows, not on their order: count, and the exclusive or and sum of their hashes."""
    h = F.xxhash64(*df.columns)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.bit_xor(h).alias("rows_xor"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("rows_sum"))
