"""Operator 5: removal of repeated passages, by level-wise doubling of window lengths.

The lengths double from about START words to the full window: 12, 25, 50. A level looks at its windows only where the
level before left candidates, and of these only at anchors: in every window of the next length, the window of this
length with the smallest hash. Two equal longer windows have equal anchors, so a longer window can only repeat if its
anchor occurs in two documents; windows repeated at one length alone are extended to twice that length. The loop ends
with the full length, or as soon as no candidate survives. Windows longer than the full one need no level of their own:
their words are covered by the full windows inside them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm.common import arrow_batch, arrow_rows, bit_filter, distinct, gram_hashes, hashed_words, in_filter, mix64, plain_words, signed, sliced, table, written

WINDOW = 50
#: The doubling starts at this many words or up to twice as many.
START = 12
#: A window that so many documents share is joined in SALTS parts.
OFTEN, SALTS = 4096, 64


def lengths(window: int) -> list[int]:
    """The lengths of the levels: the window halved again and again, from the shortest on."""
    out = [window]
    while out[0] // 2 >= START:
        out.insert(0, out[0] // 2)
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every run of `width` values, by doubling."""
    size, cur = 1, x
    while size * 2 <= width:
        cur = np.minimum(cur[:-size], cur[size:])
        size *= 2
    m = len(x) - width + 1
    return np.minimum(cur[:m], cur[width - size : width - size + m])


def anchors(words: np.ndarray, length: int, longer: int, levels: list) -> tuple[np.ndarray, np.ndarray]:
    """For every window of `longer` words that the levels before leave open, its start and the smallest hash of the windows of `length` words inside it.

    levels: (length, longer, bitmap, bits) of the levels before.
    """
    if len(words) < longer:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    least = sliding_min(gram_hashes(words, length), longer - length + 1)
    open_ = np.ones(len(least), bool)
    for short, twice, bitmap, bits in levels:
        # A window stays open if all windows of the earlier lengths inside it do; those at its two ends suffice
        inner = in_filter(bitmap, bits, sliding_min(gram_hashes(words, short), twice - short + 1))
        open_ &= inner[: len(open_)] & inner[longer - twice : longer - twice + len(open_)]
    at = np.flatnonzero(open_)
    return at, least[at]


def windows_at(words: np.ndarray, window: int, levels: list) -> np.ndarray:
    """The starts of the full windows that all levels leave open."""
    if len(words) < window:
        return np.empty(0, np.int64)
    open_ = np.ones(len(words) - window + 1, bool)
    for short, twice, bitmap, bits in levels:
        inner = in_filter(bitmap, bits, sliding_min(gram_hashes(words, short), twice - short + 1))
        open_ &= inner[: len(open_)] & inner[window - twice : window - twice + len(open_)]
    return np.flatnonzero(open_)


def second_hash(words: np.ndarray, window: int, at: np.ndarray) -> np.ndarray:
    """32 more bits of the windows that start at `at`, from other hashes of the words."""
    return (gram_hashes(mix64(words ^ np.uint64(0x5851F42D4C957F2D)), window)[at] >> np.uint64(32)).astype(np.int64).astype(np.int32)


def repeated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, at): the windows' starts, in words, whose word sequence also starts in a document of a smaller doc_id.

    Sequences are told apart by 96 bits of hashes. A window that very many documents share is joined in salted parts.
    """
    spark = docs.sparkSession
    docs = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    steps = lengths(window)
    told: list = []  # for each level so far: lengths, and a broadcast bitmap of the anchors that repeat

    def emitted(ddl: str, of) -> DataFrame:
        """Columns of `of(key, words, levels)` for every document, in batches of a bounded size."""
        names = [f.split()[0] for f in ddl.split(", ")]
        known = [(a, b, c) for a, b, c in told]

        def run(batches) -> Iterator:
            levels = [(a, b, *c.value) for a, b, c in known]
            for keys, texts in arrow_rows(batches, "doc_id", "text"):
                out, size = [[] for _ in names], 0
                for key, words in zip(keys, hashed_words(texts, False), strict=True):
                    got = of(key, words, levels)
                    if len(got[0]):
                        for c, x in zip(out, got, strict=True):
                            c.append(x)
                        size += len(got[0])
                    if size > 300_000:
                        yield arrow_batch(ddl, *map(np.concatenate, out))
                        out, size = [[] for _ in names], 0
                if size:
                    yield arrow_batch(ddl, *map(np.concatenate, out))

        return docs.mapInArrow(run, ddl)

    for length, longer in zip(steps, steps[1:], strict=False):

        def level(key, words, levels, length=length, longer=longer):
            h = distinct(anchors(words, length, longer, levels)[1])
            return signed(h), np.full(len(h), key, np.int64)

        found = emitted("h long, doc_id long", level).groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a <> b").select("h")
        found = written(found, "anchors")
        count = found.count()
        if not count:
            return spark.createDataFrame([], "doc_id long, at long")
        told.append((length, longer, spark.sparkContext.broadcast(bit_filter(found, "h", count))))

    def full(key, words, levels):
        at = windows_at(words, window, levels)
        h = gram_hashes(words, window)[at] if len(at) else np.empty(0, np.uint64)
        return signed(h), second_hash(words, window, at) if len(at) else np.empty(0, np.int32), np.full(len(at), key, np.int64), at

    windows = emitted("h long, g int, doc_id long, at long", full)
    first = windows.groupBy("h", "g").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("c")).filter("first <> last").select("h", "g", "first", "c")
    first = written(first, "first")
    count = first.count()
    if not count:
        return spark.createDataFrame([], "doc_id long, at long")
    often = first.filter(F.col("c") > OFTEN).select("h")
    n_often = often.count()
    kept, hot = spark.sparkContext.broadcast(bit_filter(first, "h", count)), spark.sparkContext.broadcast(bit_filter(often, "h", n_often))

    def again(key, words, levels):
        h, g, doc, at = full(key, words, levels)
        some = in_filter(*kept.value, h.view(np.uint64))
        h, g, doc, at = h[some], g[some], doc[some], at[some]
        return h, g, np.where(in_filter(*hot.value, h.view(np.uint64)), key % SALTS, 0).astype(np.int32), doc, at

    windows = emitted("h long, g int, salt int, doc_id long, at long", again)
    first = first.select("h", "g", "first", F.lit(0).alias("salt"))
    if n_often:  # what the bitmap takes for frequent is there once for each salt

        def salted(batches) -> Iterator:
            for batch in batches:
                h = batch.column("h").to_numpy()
                n = np.where(in_filter(*hot.value, h.view(np.uint64)), SALTS, 1)
                rows = np.repeat(np.arange(len(h)), n)
                salt = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
                yield arrow_batch("h long, g int, first long, salt int", *(batch.column(c).take(pa.array(rows)) for c in ("h", "g", "first")), salt)

        first = first.select("h", "g", "first").mapInArrow(salted, "h long, g int, first long, salt int")
    return windows.join(first, ["h", "g", "salt"]).filter("doc_id > first").select("doc_id", "at")


def without_repeats(docs: DataFrame, window: int = WINDOW, text: bool = True) -> DataFrame:
    """Per document: n_words, n_removed, kept_sha256 and, with `text`, the kept words joined by one space.

    A word goes if a window of `window` words that covers it also starts in a document with a smaller doc_id, judged
    on the input. Null and empty texts have no words, and the SHA-256 of the empty text. Rows that repeat a doc_id
    count as the same document: what is removed from one is removed from each, and its windows count once. Rows without a doc_id are kept whole
    and remove nothing elsewhere. Columns other than doc_id and text are not looked at.
    """
    ddl = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * text
    gone = repeated(docs, window).groupBy("doc_id").agg(F.collect_set("at").alias("at")).withColumnRenamed("doc_id", "id")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.join(gone, F.col("doc_id") == F.col("id"), "left").select("doc_id", "text", "at")

    def run(batches) -> Iterator:
        for batch in sliced(batches):
            out: list[list] = [[] for _ in range(4 + text)]
            starts = batch.column("at")
            for i, (key, body) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                words = plain_words(body)
                n = len(words)
                if starts[i].is_valid:
                    at = starts[i].values.to_numpy()
                    at = at[at + window <= n]
                    change = np.zeros(n + 1, np.int64)
                    np.add.at(change, at, 1)
                    np.add.at(change, at + window, -1)
                    words = [words[j] for j in np.flatnonzero(np.cumsum(change[:n]) == 0)]
                kept = b" ".join(words)
                for c, x in zip(out, (key, n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass")), strict=False):
                    c.append(x)
            yield arrow_batch(ddl, *out)

    return rows.mapInArrow(run, ddl)


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 50 words that a smaller doc_id has too."""
    return without_repeats(table(spark, sf_dir, "documents"), text=False)
