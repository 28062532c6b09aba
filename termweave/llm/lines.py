"""Operator 9: line dedup by a deletion-neighbourhood join, with DataFrame functions only.

Two lines are within one edit (a character put in, left out or replaced) exactly if both become equal when one block
of characters that holds the edit is deleted from each. Emitting the deletions of every single character of every line
would square the text, so deletions go from coarse to fine: first the two halves are deleted, then, only for lines
whose rest occurs in another line too, sixteenths of the deleted block, and so on down to single characters. Each
level emits hashed keys, joins equal ones, and is exact: a pair within one edit shares a key on every level. What is
left at single characters is joined with the earliest line of its key, so no level pairs up a group's members, and the
edit distance of these pairs is verified on the texts.

Offsets of a block count in a line of R characters, where R is the length of the shorter of two lines; so every line of
n characters takes part for R = n and for R = n - 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.llm.common import table, written

#: Lines within one edit of each other count as repeats from this length on, as one edit is much of a shorter line; of
#: shorter ones only exact copies go. Both lengths are parameters; 1 takes every line that is not empty.
MIN_CHARS, EXACT_FROM = 12, 1
PARTS = 16
#: A side of at most this many bytes is broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 8 << 20
SECOND_SEED = 7919


def left(line: Column | str, n: Column) -> Column:
    return F.substring(line, F.lit(1), n)


def right(line: Column | str, length: Column, n: Column) -> Column:
    return F.substring(line, length - n + 1, n)


def fingerprints(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(SECOND_SEED), line).alias("h2")]


def within(side: DataFrame, rows: int, width: int) -> DataFrame:
    """The side, to be broadcast if so many rows of so many bytes are within the bound."""
    return F.broadcast(side) if rows * width <= BROADCAST_BYTES else side


def lines_of(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, line_no, line, pos) of the lines that take part; pos orders them by document, then line. Null ids come last."""
    at = F.expr("coalesce(cast(doc_id as decimal(20,0)), 9223372036854775808BD) * cast(2147483648 as decimal(10,0))")
    rows = docs.filter(F.col("text").isNotNull()).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.filter(F.length("line") >= least).withColumn("pos", (at + F.col("line_no")).cast("decimal(38,0)"))


def shared(keys: DataFrame) -> DataFrame:
    """The keys that more than one distinct line has."""
    return keys.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).filter("lo <> hi").select("key")


def halves(distinct: DataFrame) -> DataFrame:
    """(h1, n, R, a, b): the blocks [a, b) whose deletion leaves what another line has too."""
    n = F.col("n")
    kinds = []
    for r in (n, n - 1):
        half = F.floor(r / 2).cast("int")
        kinds += [F.struct(r.cast("int").alias("R"), half.alias("a"), r.cast("int").alias("b"), F.when(r == n, F.col("p1")).otherwise(F.col("p2")).alias("key"))]
        kinds += [F.struct(r.cast("int").alias("R"), F.lit(0).alias("a"), half.alias("b"), F.when(r == n, F.col("s1")).otherwise(F.col("s2")).alias("key"))]
    rows = distinct.select("h1", "n", F.explode(F.array(*kinds)).alias("x")).select("h1", "n", "x.*")
    return rows.join(shared(rows), "key").select("h1", "n", "R", "a", "b")


def distinct_lines(lines: DataFrame) -> DataFrame:
    """A row per distinct line: fingerprints, length, earliest position, count, and the keys of its two deleted halves for R = n and n - 1."""
    n = F.length("line")

    def keys(r: Column) -> tuple[Column, Column]:
        half = F.floor(r / 2).cast("int")
        return F.xxhash64(F.lit("p"), half, left("line", half)), F.xxhash64(F.lit("s"), r - half, right("line", n, r - half))

    (p1, s1), (p2, s2) = keys(n), keys(n - 1)
    rows = lines.select(*fingerprints(F.col("line")), "pos", n.alias("n"), p1.alias("p1"), s1.alias("s1"), p2.alias("p2"), s2.alias("s2"))
    same = [F.min(c).alias(c) for c in ("n", "p1", "s1", "p2", "s2")]  # equal in all rows of a line
    return rows.groupBy("h1", "h2").agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("copies"), *same)


def neighbours(docs: DataFrame, distinct: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, near): for lines within one edit of another, the earliest position of such a line that a key leads to."""
    blocks = written(halves(distinct), "halves", narrow=True)
    wanted = blocks.select("h1").distinct()
    n_wanted = wanted.count()
    # One text for each line that has a block left
    one = distinct.select("h1", "h2", "pos").join(within(wanted, n_wanted, 16), "h1", "left_semi")
    texts = lines_of(docs, least).select(*fingerprints(F.col("line")), F.col("pos").alias("at"), "line")
    texts = written(texts.join(within(one, n_wanted, 48), ["h1", "h2"]).filter("at = pos").select("h1", "h2", "pos", "line").dropDuplicates(["h1", "h2"]), "lines")
    single = None
    while True:
        step = F.ceil((F.col("b") - F.col("a")) / PARTS).cast("int")
        parts = blocks.filter("b > a").join(texts.select("h1", "line"), "h1").withColumn("step", step)
        parts = parts.select("h1", "n", "R", "line", "b", "step", F.explode(F.expr("sequence(a, b - 1, step)")).alias("a"))
        parts = parts.withColumn("b", F.least(F.col("a") + F.col("step"), F.col("b")))
        key = F.xxhash64("R", "a", "b", left("line", F.col("a")), right("line", F.col("n"), F.col("R") - F.col("b")))
        parts = written(parts.select("h1", "n", "R", "a", "b", key.alias("key")), "blocks", narrow=True)
        kept = parts.join(shared(parts), "key")
        done = kept.filter("b - a = 1")
        single = done if single is None else single.unionByName(done)
        blocks = written(kept.filter("b - a > 1").drop("key"), "blocks", narrow=True)
        if blocks.isEmpty():
            break
    single = written(single, "single", narrow=True)
    # Replaced characters: lines of one length that are equal without the character at one place
    place = texts.select("h1", "pos")
    same_length = single.filter("R = n").select("h1", "key").join(place, "h1")
    first = same_length.groupBy("key").agg(F.min(F.struct("pos", "h1")).alias("m")).select("key", F.col("m.h1").alias("near"))
    replaced = same_length.join(first, "key").select("h1", "near")
    # Characters put in or left out: a line without one of its characters is the other line
    longer = single.filter("R = n - 1").select("h1", "n", F.explode(F.array("a", "b")).alias("at")).distinct().join(texts.select("h1", "line"), "h1")
    shorter = F.concat(left("line", F.col("at")), F.substring("line", F.col("at") + 2, F.col("n")))
    longer = longer.select(F.col("h1").alias("long"), *fingerprints(shorter)).join(texts.select("h1", "h2"), ["h1", "h2"]).select("long", F.col("h1").alias("short")).distinct()
    by_short = longer.join(place.withColumnRenamed("h1", "long"), "long").groupBy("short").agg(F.min(F.struct("pos", "long")).alias("m"))
    by_long = longer.join(place.withColumnRenamed("h1", "short"), "short").groupBy("long").agg(F.min(F.struct("pos", "short")).alias("m"))
    pairs = replaced.unionByName(by_short.select(F.col("short").alias("h1"), F.col("m.long").alias("near"))).unionByName(by_long.select(F.col("long").alias("h1"), F.col("m.short").alias("near")))
    pairs = pairs.filter("h1 <> near").distinct()
    other = texts.select(F.col("h1").alias("near"), F.col("pos").alias("near_pos"), F.col("line").alias("near_line"))
    true = pairs.join(texts, "h1").join(other, "near").filter(F.levenshtein("line", "near_line", 1) >= 0)
    return true.groupBy("h1", "h2").agg(F.min("near_pos").alias("near"))


def without_repeated_lines(docs: DataFrame, keep: tuple[str, ...] = (), exact_from: int = EXACT_FROM, near_from: int = MIN_CHARS) -> DataFrame:
    """Per document: n_lines, n_removed and the text without the lines that an earlier line repeats.

    Lines lie between line feeds. A line of at least `near_from` characters goes if a line within one edit of it and of
    that length, itself included, occurs earlier (in a smaller doc_id, or further up); this is judged on the input. Of
    shorter lines, those of `exact_from` characters or more go if the same line occurs earlier; empty lines stay. Null text has no lines and stays null. Rows without a doc_id come after all others and are kept from losing
    lines. Rows that repeat a doc_id are the same document: lines at the same place do not remove each other. An empty
    table gives no rows. Columns other than doc_id and text are not looked at; those named in `keep` come along.
    """
    full = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(F.col(c).alias(f"keep_{c}") for c in keep))
    docs = full.select("doc_id", "text")
    least, near_from = max(1, min(exact_from, near_from)), max(1, near_from)
    distinct = written(distinct_lines(lines_of(docs, least)), "distinct")
    early = distinct.filter("copies > 1").select("h1", "h2", F.col("pos").alias("near"))
    early = written(early.unionByName(neighbours(docs, distinct.filter(F.col("n") >= near_from), near_from)).groupBy("h1", "h2").agg(F.min("near").alias("near")), "early", narrow=True)
    gone = lines_of(docs, least).select("doc_id", "line_no", "pos", *fingerprints(F.col("line"))).join(within(early, early.count(), 48), ["h1", "h2"])
    gone = gone.filter("pos > near").groupBy("doc_id").agg(F.collect_set("line_no").alias("gone")).withColumnRenamed("doc_id", "id")
    rows = full.join(gone, F.col("doc_id") == F.col("id"), "left").withColumn("lines", F.split("text", "\n"))
    size = F.coalesce(F.size("lines"), F.lit(0))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    text = F.when(F.col("text").isNotNull() & F.col("gone").isNotNull(), F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n")).otherwise(F.col("text"))
    n = F.when(F.col("text").isNull(), 0).otherwise(size)
    removed = F.when(F.col("gone").isNull() | F.col("text").isNull(), 0).otherwise(size - F.size(kept))
    return rows.select("doc_id", n.cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"), text.alias("text"), *(F.col(f"keep_{c}").alias(c) for c in keep))


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without the lines that an earlier line repeats within one edit (shorter ones than MIN_CHARS: exactly)."""
    out = without_repeated_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: Exact copies of lines of every length go. Lines of 12 characters or more within one edit share their first or their last half; those pairs are then compared place by place.
ORACLE = """
WITH line AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS no, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
taking AS (SELECT doc_id, no, line FROM line WHERE line <> ''),
every AS (SELECT line, min((doc_id::HUGEINT * 2147483648 + no)) AS pos, length(line) AS n FROM taking GROUP BY line),
one AS (SELECT * FROM every WHERE n >= 12),
half AS (
  SELECT line, n, pos, r, 'p' || left(line, (r // 2)::BIGINT) AS k FROM (SELECT *, unnest([n, n - 1]) AS r FROM one)
  UNION SELECT line, n, pos, r, 's' || right(line, (r - r // 2)::BIGINT) FROM (SELECT *, unnest([n, n - 1]) AS r FROM one)),
pair AS (SELECT DISTINCT a.line, a.n, b.line AS other, b.n AS m, b.pos AS other_pos FROM half a JOIN half b ON a.k = b.k AND a.r = b.r AND a.line <> b.line AND abs(a.n - b.n) <= 1),
near AS (
  SELECT line, min(other_pos) AS pos FROM pair WHERE len(list_filter(range(greatest(n, m)), lambda i:
    left(line, i) = left(other, i) AND substr(line, i + 1 + (n >= m)::INT) = substr(other, i + 1 + (m >= n)::INT))) > 0 GROUP BY line),
early AS (SELECT every.line, least(every.pos, near.pos) AS pos FROM every LEFT JOIN near USING (line)),
gone AS (SELECT doc_id, no FROM taking JOIN early USING (line) WHERE doc_id::HUGEINT * 2147483648 + no > pos)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines, coalesce(g.n, 0)::BIGINT AS n_removed,
  sha256(CASE WHEN d.text IS NULL THEN '' WHEN g.n IS NULL THEN d.text ELSE array_to_string(
    list_transform(list_filter(range(1, len(string_split(d.text, chr(10))) + 1), lambda i: NOT list_contains(g.nos, i)), lambda i: string_split(d.text, chr(10))[i]), chr(10)) END) AS kept_sha256
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, list(no) AS nos FROM gone GROUP BY doc_id) g USING (doc_id)
"""
