"""Operator 13: target-distribution importance resampling over hashed word n-grams.

The texts of a task are cut into parts of bounded size. The words of a part become ids, its texts one array of ids with
a separator after each, and the array's suffixes are sorted by their first three words, which is as deep as a feature
looks. Neighbours in that order share their longest common prefix, so every run whose prefixes reach n words is one
distinct n-gram with all its places: its bytes are hashed once for the run, out of the CRCs of its words, and the bucket
goes back to the places of the run. A first pass adds up the buckets of corpus and target, a second adds up the gains of
each document. Seeded Gumbel noise on the sums makes the draw one without replacement.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm.common import arrow_batch, carried, carried_schema, sliced, table, written

#: Longest feature, buckets, words that a document needs to be drawn, percent drawn.
GRAM, BUCKETS, LEAST_WORDS, PERCENT = 3, 10_000, 20, 5
#: Words of a part (three ids of it fit a 64-bit key) and bytes of a segment of a text; both bound memory, not results.
PART_WORDS, SEGMENT = 1_000_000, 1 << 20

#: Bytes outside words become blanks, A-Z become a-z; bytes of characters beyond ASCII stay.
WORDS = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def segments(text: str | None) -> Iterator[tuple[list[bytes], int]]:
    """(words, lead) for parts of a text: the first `lead` words are the last ones of the part before."""
    raw, at, tail = (text or "").encode("utf-8", "surrogatepass").translate(WORDS), 0, []
    while at < len(raw):
        to = at + SEGMENT
        if to < len(raw):
            to = raw.find(b" ", to)
            to = len(raw) if to < 0 else to
        own = raw[at:to].split()
        if own:
            yield tail + own, len(tail)
            tail = (tail + own)[-(GRAM - 1) :]
        at = to


class Crc:
    """CRC-32 of joined strings out of the CRCs of their parts: moving a CRC past n bytes is linear, so four table look-ups do it."""

    def __init__(self) -> None:
        step = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
        one = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32)[:, None])).astype(np.uint32)
        self.powers = [np.where(np.arange(4)[:, None] == 0, step[one & 255], one >> np.uint32(8)).astype(np.uint32)]  # past 1, 2, 4, ... bytes
        self.known: dict[int, np.ndarray] = {}

    @staticmethod
    def moved(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
        return tables[0][crc & 255] ^ tables[1][crc >> 8 & 255] ^ tables[2][crc >> 16 & 255] ^ tables[3][crc >> 24]

    def past(self, n: int) -> np.ndarray:
        """Tables (4, 256) that move a CRC past n bytes."""
        if n not in self.known:
            out = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32)[:, None])).astype(np.uint32)
            for k in range(n.bit_length()):
                while len(self.powers) <= k:
                    self.powers.append(self.moved(self.powers[-1], self.powers[-1]))
                if n >> k & 1:
                    out = self.moved(self.powers[k], out)
            if len(self.known) > 4096:
                self.known.clear()
            self.known[n] = out
        return self.known[n]

    def joined(self, left: np.ndarray, word: np.ndarray, size: np.ndarray, crcs: np.ndarray) -> np.ndarray:
        """CRCs of left strings followed by a blank and a word; size and crcs of the words with that blank, by id."""
        own, which = np.unique(size[word], return_inverse=True)
        tables = np.stack([self.past(int(n)) for n in own]) if len(own) else np.zeros((0, 4, 256), np.uint32)
        moved = tables[which, 0, left & 255] ^ tables[which, 1, left >> 8 & 255] ^ tables[which, 2, left >> 16 & 255] ^ tables[which, 3, left >> 24]
        return moved ^ crcs[word]


class Part:
    """Segments of texts as one array of word ids, with its suffixes in the order of their first three words."""

    def __init__(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.rows: list[int] = []
        self.arrays: list[np.ndarray] = []
        self.leads: list[int] = []
        self.n = 0

    def add(self, row: int, words: list[bytes], lead: int) -> None:
        ids = self.ids
        self.arrays.append(np.fromiter((ids.setdefault(w, len(ids) + 1) for w in words), np.int64, len(words)))
        self.rows.append(row)
        self.leads.append(lead)
        self.n += len(words)

    def places(self, crc: Crc) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For n = 1, 2, 3: the bucket of each distinct n-gram (a run), how many places it has, and these places, run after run.

        A place is a number of a segment; places whose n-gram lies in the words of an earlier segment are left out.
        """
        if not self.arrays:
            return
        gap = np.zeros(1, np.int64)
        text = np.concatenate([x for a in self.arrays for x in (a, gap)] + [np.zeros(GRAM, np.int64)])
        lengths = np.array([len(a) for a in self.arrays]) + 1
        begin = np.cumsum(lengths) - lengths
        n = int(lengths.sum())
        owner = np.repeat(np.arange(len(lengths)), lengths)
        offset = np.arange(n) - begin[owner]
        a, b, c = text[:n], text[1 : n + 1], text[2 : n + 2]
        c = np.where(b == 0, 0, c)
        base = len(self.ids) + 1
        key = (a * base + b) * base + c
        key[a == 0] = -1  # separators first
        order = np.argsort(key, kind="stable")[int((a == 0).sum()) :]
        s = [x[order] for x in (a, b, c)]
        same = [x[1:] == x[:-1] for x in s]
        common = np.concatenate([[0], same[0].astype(np.int8) + (same[0] & same[1]) + (same[0] & same[1] & same[2])])
        names = list(self.ids)
        whole = np.array([0] + [zlib.crc32(w) for w in names], np.uint32)
        spaced = np.array([0] + [zlib.crc32(b" " + w) for w in names], np.uint32)
        size = np.array([0] + [len(w) + 1 for w in names], np.int64)
        lead = np.array(self.leads)
        for m in range(1, GRAM + 1):
            # An n-gram of m words ends before a separator, and its last word is no repeated one of the segment before
            use = (s[m - 1] != 0) & (offset[order] + m - 1 >= lead[owner[order]])
            first = common < m
            run = np.cumsum(first) - 1
            kept = run[use]
            if not len(kept):
                continue
            fresh = np.r_[True, kept[1:] != kept[:-1]]
            at = np.flatnonzero(use)[fresh]  # a place of each run that is left
            value = whole[s[0][at]]
            for k in range(1, m):
                value = crc.joined(value, s[k][at], size, spaced)
            edges = np.append(np.flatnonzero(fresh), len(kept))
            yield value.astype(np.int64) % BUCKETS, np.diff(edges), owner[order][use]


def parts(texts: list) -> Iterator[Part]:
    """The texts' words in parts of about PART_WORDS words."""
    part = Part()
    for row, text in enumerate(texts):
        for words, lead in segments(text):
            part.add(row, words, lead)
            if part.n >= PART_WORDS:
                yield part
                part = Part()
    yield part


def counted(texts: DataFrame) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket; at most BUCKETS rows."""

    def run(batches) -> Iterator:
        total, crc = np.zeros(BUCKETS, np.int64), Crc()
        for batch in sliced(batches):
            for part in parts(batch.column("text").to_pylist()):
                for bucket, count, _ in part.places(crc):
                    np.add.at(total, bucket, count)
        some = np.flatnonzero(total)
        yield arrow_batch("bucket long, n long", some, total[some])

    return texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def totals(texts: DataFrame) -> np.ndarray:
    rows = counted(texts).toArrow()  # at most BUCKETS rows
    out = np.zeros(BUCKETS, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed ratio of a bucket's share of the target to that of the corpus)."""
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row, with the columns named in `keep`."""
    told = docs.sparkSession.sparkContext.broadcast(gain)
    ddl = "doc_id long, n_words long, n_features long, weight long"

    def run(batches) -> Iterator:
        crc = Crc()
        for batch in sliced(batches):
            words, features, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for part in parts(batch.column("text").to_pylist()):
                row = np.array(part.rows, np.int64)
                np.add.at(words, row, [len(a) - lead for a, lead in zip(part.arrays, part.leads, strict=True)])
                for bucket, count, place in part.places(crc):
                    np.add.at(features, row[place], 1)
                    np.add.at(weight, row[place], np.repeat(told.value[bucket], count))
            yield carried(arrow_batch(ddl, batch.column("doc_id"), words, features, weight), batch, keep)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep)
    return rows.mapInArrow(run, carried_schema(ddl, rows, keep))


def noise(key, seed: int):
    """Gumbel noise in thousandths, rounded down, from the first 32 bits of sha256 of `seed:key`."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def numbered(rows: DataFrame, order: list, tag: str) -> DataFrame:
    """`rows` with `place` (1, 2, 3, ... in the order): ranges of the order are sorted in tasks of their own, then shifted by what lies before."""
    spark = rows.sparkSession
    # Equal rows are told apart by where they were read, so that they spread over ranges too
    ranged = rows.withColumn("_own", F.monotonically_increasing_id()).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order, "_own").sortWithinPartitions(*order, "_own").drop("_own")
    cut = written(ranged.withColumn("_at", F.monotonically_increasing_id()), tag)
    part = F.shiftright("_at", 33)
    sizes = {r["p"]: r["n"] for r in cut.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each task
    before, start = 0, {}
    for p in sorted(sizes):
        start[p], before = before, before + sizes[p]
    shift = spark.createDataFrame(list(start.items()) or [(0, 0)], "_p long, _before long")
    return cut.withColumn("_p", part).join(F.broadcast(shift), "_p", "left").withColumn("place", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_p", "_before", "_at")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = 42, least_words: int = LEAST_WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, n_features, weight, score and rank (null where not drawn), with the columns named in `keep`.

    Drawn are percent/100 of the rows with at least `least_words` words, rounded down: those of the highest scores,
    ties to smaller doc_ids (null ones last); equal rows come in any order. A null text has no words, no features and
    weight 0; a null doc_id takes the noise of an empty one. Repeated rows are scored and drawn one by one. An empty
    target, or one without words, makes every bucket's share the smoothed one; an empty table gives no rows. Columns
    other than those used are not looked at.
    """
    scored = weighted(docs, gains(totals(docs), totals(target)), keep)
    scored = written(scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    fit = F.col("n_words") >= least_words
    drawn = scored.filter(fit).count() * percent // 100
    ranked = numbered(scored.withColumn("_fit", fit), [F.desc("_fit"), F.desc("score"), F.asc_nulls_last("doc_id")], "ranked")
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("place") <= drawn, F.col("place")).alias("rank"), *keep)


def op13_resampling(spark, sf_dir: str) -> DataFrame:
    """All documents, weighed towards the benchmark's texts."""
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: CRC-32 byte by byte over the distinct features, with its 256 remainders made by the rule that defines them.
ORACLE = """
WITH RECURSIVE bits(b, k, r) AS (
  SELECT i::BIGINT, 0, i::BIGINT FROM range(256) t(i)
  UNION ALL SELECT b, k + 1, CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END FROM bits WHERE k < 8),
tab AS (SELECT list(r ORDER BY b) AS t FROM bits WHERE k = 8),
texts AS (SELECT 0 AS kind, row_number() OVER () AS rid, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
split AS (SELECT kind, rid, doc_id, coalesce(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM texts),
grams AS (
  SELECT kind, rid, unnest(w) AS g FROM split
  UNION ALL SELECT kind, rid, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM split
  UNION ALL SELECT kind, rid, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM split),
counted AS (SELECT kind, rid, g, count(*) AS n FROM grams GROUP BY ALL),
distinct_g AS (SELECT DISTINCT g FROM counted),
hashed AS (
  SELECT g, xor(list_reduce(list_transform(range(0, strlen(g) + 1), lambda i: CASE WHEN i = 0 THEN 4294967295 ELSE ('0x' || substr(hex(encode(g)), 2 * i - 1, 2))::BIGINT END),
    lambda acc, x: xor(acc >> 8, t[(xor(acc, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM distinct_g, tab),
b AS (SELECT kind, rid, bucket, n FROM counted JOIN hashed USING (g)),
sums AS (SELECT bucket, sum(n) FILTER (WHERE kind = 0) AS s, sum(n) FILTER (WHERE kind = 1) AS t FROM b GROUP BY bucket),
tot AS (SELECT coalesce(sum(s), 0)::DOUBLE AS big_s, coalesce(sum(t), 0)::DOUBLE AS big_t FROM sums),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (big_s + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * (big_t + 10000))))::BIGINT AS gain FROM sums, tot),
per AS (SELECT rid, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM b JOIN gain USING (bucket) WHERE kind = 0 GROUP BY rid),
scored AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296.0)))::BIGINT AS score FROM split LEFT JOIN per USING (rid) WHERE kind = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (WHERE n_words >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * n // 100 THEN place END AS rank FROM ranked
"""
