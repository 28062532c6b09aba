"""What the operators of this subpackage share: the shared folder, written tables, words and hashes."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that Python's bytes.split() and the contracts' `[\x20\x09-\x0D]` both take as white space need no table;
#: this one lower-cases A-Z and leaves every other byte.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, on a local master alone and only where that is unset, a temporary one."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if not getattr(shared_dir, "own", None):
        shared_dir.own = tempfile.mkdtemp(prefix="termweave-")
    return shared_dir.own


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/termweave/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, narrow: bool = False) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again. Survives the loss of any executor.

    `narrow`: the rows are short (ids, hashes, counts), and a file for each shuffle partition would be a small one: Spark
    rebalances them into a sixteenth of the partitions, and cuts those that are larger than its advised size.
    """
    path = fresh_path(df.sparkSession, tag)
    if narrow:
        df = df.hint("rebalance", max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 16))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cleared(spark: SparkSession) -> None:
    """Delete what written() has left in the shared folder, for use between jobs: no result that has not been read yet may need it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/termweave")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_unsigned(col: Column) -> Column:
    """crc32 of the UTF-8 bytes as an unsigned long; null counts as empty."""
    return F.crc32(F.coalesce(col, F.lit("")).cast("binary"))


def plain_words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+`, unchanged; null has none."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: White space of the contracts: 0x20 and 0x09 to 0x0D.
_SPACE = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
_FIRST = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)
AT_ONCE = 2_000_000


def hashed_bytes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of a byte string that ends in white space begin and end, and a 64-bit hash of each, eight bytes at a time."""
    data = np.frombuffer(raw + bytes(16), np.uint8)
    space = _SPACE[data[: len(raw)]]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(raw) and not space[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[::2], edge[1::2]
    eight = np.ndarray((len(raw) + 8,), "<u8", data, strides=(1,))  # the eight bytes from each place on
    size = end - start
    with np.errstate(over="ignore"):
        h = mix64((eight[start] & _FIRST[np.minimum(size, 8)]) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        long, at = np.flatnonzero(size > 8), 8
        while len(long):
            part = eight[start[long] + at] & _FIRST[np.minimum(size[long] - at, 8)]
            h[long] = mix64(h[long] * np.uint64(0xD6E8FEB86659FD93) + part)
            at += 8
            long = long[size[long] > at]
    return start, end, h


def hashed_words(texts: list[str | None], lower: bool):
    """For each text, the 64-bit hashes of its words `[^\\x20\\x09-\\x0D]+`, with A-Z lower-cased if `lower`; null has none.

    Texts are taken together up to AT_ONCE characters, so that short ones cost no call each.
    """
    at = 0
    while at < len(texts):
        raw, size, to = [], 0, at
        while to < len(texts) and (to == at or size < AT_ONCE):
            raw.append((texts[to] or "").encode("utf-8", "surrogatepass"))
            size += len(raw[-1])
            to += 1
        joined = b"\n".join(raw) + b"\n"
        start, _, h = hashed_bytes(joined.translate(LOWER) if lower else joined)
        ends = np.cumsum([len(r) + 1 for r in raw])
        yield from np.split(h, np.searchsorted(start, ends[:-1]))
        at = to


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash for each run of n consecutive words (a polynomial of the word hashes, mixed)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        if n <= 8:
            for i in range(n):
                out = out * np.uint64(0x9E3779B97F4A7C15) + words[i : i + m]
        else:
            # By doubling: hashes of 2^k words, and of n as two overlapping parts at fixed offsets
            size, cur = 1, words
            while size * 2 <= n:
                a = len(cur) - size
                cur = mix64(cur[:a] * np.uint64(0x9E3779B97F4A7C15) + cur[size:])
                size *= 2
            out = cur[:m] * np.uint64(0xD6E8FEB86659FD93) + cur[n - size : n - size + m]
    return mix64(out)


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values, sorted."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def given_back() -> None:
    """Return freed memory to the system: Python workers are kept for the next task, beside an executor that may need it."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def sliced(batches, rows: int = 1024, most: int = 8 << 20):
    """Arrow batches of at most so many rows, and of about `most` bytes: texts become Python strings a part at a time. A larger row comes alone."""
    for batch in batches:
        step = max(1, min(rows, rows if not batch.nbytes else batch.num_rows * most // batch.nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
        del batch
    given_back()


def arrow_rows(batches, *names: str):
    """For each part of an Arrow batch, its columns as lists (null: None), so that long ids never pass through floats."""
    for batch in sliced(batches):
        yield [batch.column(n).to_pylist() for n in names]


def arrow_schema(ddl: str):
    """The Arrow schema of a Spark DDL string of longs, ints, strings, doubles, booleans, binaries and arrays of longs."""
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.strip().split(" ") for field in ddl.split(","))])


def arrow_batch(ddl: str, *columns):
    import pyarrow as pa

    schema = arrow_schema(ddl)
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def bit_filter(keys: DataFrame, column: str, count: int, most_bits: int = 1 << 27) -> tuple[np.ndarray, int]:
    """A bitmap of the long keys, by their lowest bits: at least 16 bits a key, and at most `most_bits` (16 MB) in all.

    It has no false negatives at any size. Beyond its bound only more false positives pass, which the exact step that
    follows each use removes.
    """
    bits = 1 << 16
    while bits < 16 * count and bits < most_bits:
        bits *= 2
    words = keys.select(F.expr(f"shiftright({column} & {bits - 1}L, 6)").alias("w"), F.expr(f"shiftleft(1L, cast({column} & 63L as int))").alias("b"))
    rows = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()  # at most bits / 64 rows
    out = np.zeros(bits // 64, np.uint64)
    out[rows["w"].to_numpy()] = rows["b"].to_numpy().view(np.uint64)
    return out, bits


def in_filter(bitmap: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
    """Which of the uint64 keys the bitmap may hold."""
    return (bitmap[((keys & np.uint64(bits - 1)) >> np.uint64(6)).astype(np.int64)] >> (keys & np.uint64(63))) & np.uint64(1) != 0


def carried_schema(ddl: str, rows: DataFrame, keep: tuple[str, ...]):
    """The Spark schema of `ddl` followed by the columns of `rows` named in `keep`."""
    from pyspark.sql.types import StructType

    return StructType([*StructType.fromDDL(ddl.replace(" long", " bigint")).fields, *(rows.schema[c] for c in keep)])


def carried(out, batch, keep: tuple[str, ...]):
    """The record batch `out` with the columns of `batch` named in `keep`, row by row."""
    import pyarrow as pa

    if not keep:
        return out
    return pa.RecordBatch.from_arrays([*out.columns, *(batch.column(c) for c in keep)], names=[*out.schema.names, *keep])
