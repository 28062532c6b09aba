"""Operator 2: an exact Jaccard join of documents on word shingles, by regions, pivots and triangle-inequality windows.

Regions. With whole documents as pivots, two unrelated texts have distance exactly 1 to nearly every pivot, so that the
windows of the triangle inequality would replicate every document into every region. The first pivots are therefore
single shingles: under one fixed order of all shingles, the region of a shingle holds every document that has it among
its first |A| - ceil(0.75 |A|) + 1 shingles. Two documents within the distance share such a shingle, so every link lies
inside some region. Shingles that are frequent in a sample come last in the order, which only moves work: any order
gives all links. Regions with the same documents are one.

Inside a region, its smallest document is the pivot; all members' distances to it are bounded by profiles (below) and
computed exactly where the bound leaves a link possible. Members that link with it are one component. Of those, only
the boundary (members that the triangle inequality does not separate from all members that did not link) stays in the
region with the members that did not link. What stays joins itself in blocks: every two blocks of a region meet in one
task, which rules out pairs by sizes and profiles and hands on the few that are left for exact comparison. No pair is
looked for inside a component, none is left out, and none but possible links leaves a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm.common import arrow_batch, arrow_rows, bit_filter, distinct, gram_hashes, hashed_words, in_filter, mix64, signed, table, written

SHINGLE, PERCENT = 5, 75
#: One document in so many is looked at for frequent shingles; those it finds this often come last in the order.
SAMPLE, OFTEN = 8, 3
#: Members compared with one copy of a pivot in a task.
STAR = 512
#: Members of a region's block.
BLOCK = 512
#: A side of at most this many rows of fixed width is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def shingles(words: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the shingles of hashed words; fewer words are one shingle, none have none."""
    if not len(words):
        return np.empty(0, np.uint64)
    if len(words) < n:
        return mix64(gram_hashes(words, len(words)) ^ np.uint64(len(words)))
    return distinct(gram_hashes(words, n))


def prefix(own: np.ndarray, often: tuple[np.ndarray, int] | None, percent: int = PERCENT) -> np.ndarray:
    """The shingles, first in the common order, of which a linked document must share one."""
    keep = len(own) - -(-percent * len(own) // 100) + 1
    if often is not None and len(own):
        late = in_filter(*often, own)
        if late.any():
            own = np.concatenate([own[~late], own[late]])
    return own[:keep]


def profile(own: np.ndarray) -> bytes:
    """A bit for each class of the shingles' hashes: whether an odd number falls into it. Two to four classes a shingle.

    Bits that differ between two documents each need a shingle that only one of them has, so |A xor B| is at least
    their number. Profiles of different lengths are compared after the longer one is folded by exclusive or.
    """
    bits = max(64, 2 << int(len(own)).bit_length())
    odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(profiles: np.ndarray, words: int) -> np.ndarray:
    """Profiles (a row of uint64 each) folded to `words` words."""
    return np.bitwise_xor.reduce(profiles.reshape(len(profiles), -1, words), axis=1)


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of |A xor B| from two profiles."""
    x, y = np.frombuffer(a, "<u8")[None], np.frombuffer(b, "<u8")[None]
    m = min(x.shape[1], y.shape[1])
    return int(np.bitwise_count(folded(x, m) ^ folded(y, m)).sum())


def bounded(pairs: DataFrame, base: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, xor): sizes of the pair's sets and a lower bound of their symmetric difference."""
    side = base.select("doc_id", "n_shingles", "profile")
    rows = pairs.join(side.toDF("a", "n_a", "p_a"), "a").join(side.toDF("b", "n_b", "p_b"), "b").select("a", "b", "n_a", "n_b", "p_a", "p_b")
    ddl = "a long, b long, n_a long, n_b long, xor long"

    def run(batches) -> Iterator:
        for batch in batches:
            p, q = batch.column("p_a").to_pylist(), batch.column("p_b").to_pylist()
            yield arrow_batch(ddl, *(batch.column(c) for c in ("a", "b", "n_a", "n_b")), list(map(least_difference, p, q)))

    return rows.mapInArrow(run, ddl)


def open_between(left: list, right: list, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of two blocks of (doc_id, label, n, profile), of different labels, that sizes and profiles leave open."""
    for x in _same_length(left):
        for y in _same_length(right):
            m = min(x[3].shape[1], y[3].shape[1])
            if max(x[3].shape[1], y[3].shape[1]) > 2 * m:
                continue  # sizes differ by more than the similarity allows
            p, q = folded(x[3], m), folded(y[3], m)
            for at in range(len(p)):
                total = x[2][at] + y[2]
                xor = np.bitwise_count(q ^ p[at]).sum(1, dtype=np.int64)
                xor = np.maximum(xor, np.abs(x[2][at] - y[2]))
                for j in np.flatnonzero((100 * (total - xor) >= percent * (total + xor)) & (y[1] != x[1][at])):
                    yield int(x[0][at]), int(y[0][j])


def _same_length(rows: list) -> Iterator[tuple[np.ndarray, ...]]:
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(len(r[3]), []).append(r)
    for own in by.values():
        yield *(np.array([r[i] for r in own], np.int64) for i in range(3)), np.frombuffer(b"".join(r[3] for r in own), "<u8").reshape(len(own), -1)


def open_pairs(members: DataFrame, base: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs inside regions (sig, doc_id, label), of different labels, that are not ruled out.

    A region is dealt into blocks of about BLOCK members, and every two blocks of it meet in one task; only pairs that
    sizes and profiles leave open come out. Regions of one block are not looked up, so that the members of a large one
    never meet in one task.
    """
    sizes = members.groupBy("sig").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > BLOCK)
    sizes = written(sizes.select("sig", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks")), "large", narrow=True)
    small = F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes
    rows = members.join(small, "sig", "left").fillna(1, ["blocks"]).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("sig", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "doc_id", "label").join(base.select("doc_id", F.col("n_shingles").alias("n"), "profile"), "doc_id")
    rows = rows.repartition("sig", "lo", "hi").sortWithinPartitions("sig", "lo", "hi")

    def met(key, own) -> list[tuple[int, int]]:
        first, second = [r[1:] for r in own if r[0] == key[1]], [r[1:] for r in own if r[0] == key[2]]
        return [(min(p), max(p)) for p in open_between(first, second, percent) if p[0] != p[1]]

    def run(batches) -> Iterator:
        key, own, found = None, [], set()
        for cols in arrow_rows(batches, "sig", "lo", "hi", "block", "doc_id", "label", "n", "profile"):
            for sig, lo, hi, *row in zip(*cols, strict=True):
                if (sig, lo, hi) != key:
                    if own:
                        found.update(met(key, own))
                    key, own = (sig, lo, hi), []
                    if len(found) > 100_000:
                        yield arrow_batch("a long, b long", *map(list, zip(*found, strict=True)))
                        found = set()
                own.append(row)
        if own:
            found.update(met(key, own))
        if found:
            yield arrow_batch("a long, b long", *map(list, zip(*found, strict=True)))

    return rows.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, u: str = "a", v: str = "b") -> DataFrame:
    """(node, label): for every node with an edge, the smallest node that it can reach. Large-star and small-star rounds."""
    now = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u <> v").distinct()
    last = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = written(small.distinct(), "stars", narrow=True)
        is_ = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if is_ == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        last = is_


def compared(docs: DataFrame, pairs: DataFrame, n_pairs: int) -> DataFrame:
    """(a, b, both, n_a, n_b): the sizes of the sets of `n_pairs` pairs of documents, and of their intersection.

    The members of a pivot `a` are dealt over as many tasks as it takes for each to have about STAR of them, each with
    a copy of the pivot's text.
    """
    stars = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("c")).select("a", F.ceil(F.col("c") / STAR).cast("int").alias("salts"))
    members = pairs.join(stars, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role"), F.col("b").alias("doc_id"))
    pivots = stars.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("a").alias("doc_id"))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = docs.select("doc_id", "text").join(F.broadcast(ids) if 2 * n_pairs <= BROADCAST_ROWS else ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    rows = members.unionByName(pivots).join(texts, "doc_id").select("a", "salt", "role", "doc_id", "text").repartition("a", "salt").sortWithinPartitions("a", "salt", "role")
    ddl = "a long, b long, both long, n_a long, n_b long"

    def run(batches) -> Iterator:
        pivot, own = None, None
        for *cols, texts in arrow_rows(batches, "a", "role", "doc_id", "text"):
            out: list[list] = [[], [], [], [], []]
            for a, role, b, words in zip(*cols, hashed_words(texts, True), strict=True):
                mine = shingles(words)
                if role == 0:
                    pivot, own = a, mine
                    continue
                assert pivot == a
                at = np.searchsorted(own, mine)
                at[at == len(own)] = 0
                for c, x in zip(out, (a, b, int((own[at] == mine).sum()) if len(own) else 0, len(own), len(mine)), strict=True):
                    c.append(x)
            yield arrow_batch(ddl, *out)

    return rows.mapInArrow(run, ddl)


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_id, set_id2, profile): the set's size, 128 bits that stand for it, and its profile."""
    ddl = "doc_id long, n_shingles long, set_id long, set_id2 long, profile binary"

    def run(batches) -> Iterator:
        for keys, texts in arrow_rows(batches, "doc_id", "text"):
            n, one, two, by_class = [], [], [], []
            for words in hashed_words(texts, True):
                own = shingles(words)
                n.append(len(own))
                by_class.append(profile(own))
                one.append(int(signed(np.add.reduce(mix64(own), keepdims=True))[0]) if len(own) else 0)
                two.append(int(signed(np.bitwise_xor.reduce(mix64(own ^ np.uint64(0xA5A5A5A5A5A5A5A5)), keepdims=True))[0]) if len(own) else 0)
            yield arrow_batch(ddl, keys, n, one, two, by_class)

    return docs.mapInArrow(run, ddl)


def similar(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per document: n_shingles and component_id, the smallest doc_id that links reach.

    Documents link if 100 * |A and B| >= percent * |A or B|, over their sets of distinct 5-word shingles (fewer words:
    the whole sequence). Null and empty texts have an empty set, link with nothing and are their own component. Rows
    that repeat a doc_id are one document (its texts are taken to be the same). A row without a doc_id is linked to
    nothing but equal sets: it gets their component_id, or null. An empty table gives no rows. Columns other than
    doc_id and text are not looked at. Shingles are compared by 64-bit hashes, sets of different documents by 128 bits.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = written(classes(docs), "classes")
    same = ["n_shingles", "set_id", "set_id2"]
    first = written(base.filter("n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("first")), "first", narrow=True)
    named = docs.filter(F.col("doc_id").isNotNull())

    def emitted(rows: DataFrame, ddl: str, of) -> DataFrame:
        def run(batches) -> Iterator:
            for keys, texts in arrow_rows(batches, "doc_id", "text"):
                out, own, size = [], [], 0
                for key, words in zip(keys, hashed_words(texts, True), strict=True):
                    x = of(shingles(words))
                    out.append(x)
                    own.append(np.full(len(x), key, np.int64))
                    size += len(x)
                    if size > 300_000:
                        yield arrow_batch(ddl, signed(np.concatenate(out)), np.concatenate(own))
                        out, own, size = [], [], 0
                if size:
                    yield arrow_batch(ddl, signed(np.concatenate(out)), np.concatenate(own))

        return rows.mapInArrow(run, ddl)

    # The order of the shingles
    some = named.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)
    frequent = emitted(some, "sig long, doc_id long", lambda x: x).groupBy("sig").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= OFTEN).select("sig")
    frequent = written(frequent, "frequent", narrow=True)
    often = spark.sparkContext.broadcast(bit_filter(frequent, "sig", frequent.count()))
    # Regions: as many bits of a shingle as make chance meetings rare; meetings by chance only add comparisons
    total = base.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("n")).first()["n"]
    drop = np.uint64(max(0, 64 - 11 - int(total).bit_length()))

    def sigs(x: np.ndarray) -> np.ndarray:
        return mix64(prefix(x, often.value, percent)) >> drop

    held = emitted(named, "sig long, doc_id long", sigs).groupBy("sig").agg(F.count(F.lit(1)).alias("c"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.sum(F.xxhash64(F.lit(1), "doc_id").bitwiseAND(F.lit((1 << 31) - 1))).alias("y")).filter("lo < hi")
    # The exclusive or of an id that comes twice is 0, so a sum tells regions of repeated rows apart
    kept = written(held.groupBy("c", "lo", "hi", "x", "y").agg(F.min("sig").alias("sig")).select("sig"), "regions", narrow=True)
    told = spark.sparkContext.broadcast(bit_filter(kept, "sig", kept.count()))

    def wanted(x: np.ndarray) -> np.ndarray:
        x = sigs(x)
        return x[in_filter(*told.value, x)]

    members = emitted(named, "sig long, doc_id long", wanted).join(kept, "sig")
    # Of equal sets, the first document alone takes part
    firsts = first.filter("first is not null").select(F.col("first").alias("doc_id"))
    members = members.join(firsts, "doc_id", "left_semi").select("sig", "doc_id").distinct()
    labels = _labelled(docs, base, written(members, "members"), percent)
    reached = labels.filter("node <> label").select(F.col("node").alias("first"), "label")
    out = first.join(reached, "first", "left").select(*same, F.coalesce("label", "first").alias("component"))
    rows = base.join(out, same, "left")
    return rows.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _labelled(docs: DataFrame, base: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(node, label) of the linked documents, from regions (sig, doc_id)."""
    near = 1 - percent / 100
    one = base.filter("doc_id is not null").select("doc_id", "n_shingles", "profile").dropDuplicates(["doc_id"])
    # Each region's pivot against its members. First a bound from the profiles; what it leaves open is compared exactly
    # Written, so that the join is not tied to the grouping and the members of a large region may be split
    pivots = written(members.groupBy("sig").agg(F.min("doc_id").alias("a")), "pivots", narrow=True)
    pairs = members.join(pivots, "sig").filter("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct()
    bound = written(bounded(pairs, one), "bounds", narrow=True)
    left_open = F.expr(f"100 * (n_a + n_b - xor) >= {percent} * (n_a + n_b + xor)")
    exact = compared(docs, bound.filter(left_open).select("a", "b"), bound.filter(left_open).count())
    exact = written(exact.select("a", "b", (F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))).alias("s"), F.expr(f"100 * both >= {percent} * (n_a + n_b - both)").alias("link"), F.lit(True).alias("exact")), "compared", narrow=True)
    links = exact.filter("link").select("a", "b")
    labels = components(links)
    # For the others the similarity is at most s, so their distance is at least 1 - s
    far = bound.filter(~left_open).select("a", "b", F.expr("greatest(n_a + n_b - xor, 0) / (n_a + n_b + xor)").alias("s"), F.lit(False).alias("link"), F.lit(False).alias("exact"))
    d = far.unionByName(exact).select("a", F.col("b").alias("doc_id"), (1 - F.col("s")).alias("d"), "exact")
    known = labels.withColumnRenamed("node", "doc_id")
    members = members.join(known, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    several = members.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("sig")
    # Windows: linked members that the triangle inequality keeps apart from all that did not link go
    at = members.join(several, "sig").join(pivots, "sig").join(d, ["a", "doc_id"], "left")
    at = at.join(known.toDF("a", "now"), "a", "left").withColumn("inside", F.col("label") == F.coalesce("now", "a"))
    outside = at.filter("not inside").groupBy("sig").agg(F.min("d").alias("nearest"))
    at = at.filter("a <> doc_id").join(outside, "sig", "left")
    rest = at.filter(f"not inside or not coalesce(exact, false) or d >= nearest - {near} - 1e-9")
    # What is left of the regions joins itself; regions of one pivot together, so that a pair of a large group meets in few tasks
    rest = written(rest.select(F.col("a").alias("sig"), "doc_id", "label").distinct(), "rest", narrow=True)
    pairs = written(open_pairs(rest, one, percent), "open", narrow=True)
    n_pairs = pairs.count()
    if n_pairs:
        more = compared(docs, pairs, n_pairs).filter(f"100 * both >= {percent} * (n_a + n_b - both)").select("a", "b")
        more = written(more, "links", narrow=True)
        if not more.isEmpty():
            labels = components(links.unionByName(more))
    return labels


def op2_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """The near-duplicate components of all documents."""
    return similar(table(spark, sf_dir, "documents"))


#: All pairs that share a shingle, in SQL.
ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY ALL HAVING 100 * count(*) >= 75 * (any_value(na.n) + any_value(nb.n) - count(*))),
r AS (WITH RECURSIVE reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a) SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.b AS component_id FROM w LEFT JOIN n USING (doc_id) JOIN r ON r.a = w.doc_id
"""
