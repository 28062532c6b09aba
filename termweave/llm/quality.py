"""Operator 4: a quality classifier by perplexity under an interpolated modified Kneser-Ney n-gram model.

The model is one of characters, trained on all trusted text, with an open vocabulary: every code point is a symbol of
its own, and what no trusted text has falls back to a share of all code points. Counts are made shard by shard and
summed by n-gram; continuation counts, discounts, context totals and the interpolation with the lower order are grouped
sums and joins over those count tables, which grow with the corpus and are never brought to one place.

Documents are scored by joins too. They are put together in chunks; a chunk's distinct n-grams are joined with the
model, and their logarithms come back to the chunk, so that an n-gram is sent once a chunk and not once a document. A
document is kept up to a quantile of the trusted documents' perplexities in its language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termweave.llm.common import arrow_batch, arrow_rows, arrow_schema, given_back, mix64, signed, table, written

ORDER = 4
#: Share of a language's trusted documents, among those held out of training, whose perplexity is at most its threshold.
QUANTILE = 0.99
#: Thresholds lie on a grid of so many steps for each factor e of perplexity, so that they do not depend on any order.
STEPS = 1000
AT_ONCE = 2_000_000
#: Bits of a code point plus one (0 stands before a text): three of them fill a long.
WIDE = 21
CODE_POINTS = 0x110000
#: Characters of the documents of a chunk, about; a longer document has a chunk of its own.
CHUNK = 1 << 25
BROADCAST_ROWS = 1_000_000


def pieces(texts: list[str | None], most: int = AT_ONCE) -> Iterator[tuple[list[int], list[str], list[int]]]:
    """The texts in groups of about `most` characters; a longer text comes in parts, each after the first with the characters before it that an n-gram needs, and how many these are."""
    rows: list[int] = []
    own: list[str] = []
    before: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        for at in range(0, len(t or ""), most):
            lead = min(at, ORDER - 1)
            piece = t[at - lead : at + most]
            if own and size + len(piece) > most:
                yield rows, own, before
                rows, own, before, size = [], [], [], 0
            rows.append(i)
            own.append(piece)
            before.append(lead)
            size += len(piece)
    if own:
        yield rows, own, before


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def discounts(counts: DataFrame) -> list[float]:
    """D1, D2 and D3+ from how many n-grams occur once, twice, three and four times.

    The estimate has no value where one of these is 0 (a corpus of a few words): then the discounts are 0.5, 1 and 1.5,
    which keep every count positive.
    """
    n = counts.agg(*[F.coalesce(F.sum(F.when(F.col("c") == i, 1)), F.lit(0)).alias(f"n{i}") for i in range(1, 5)]).first()
    if not all(n[f"n{i}"] for i in range(1, 5)):
        return [0.5, 1.0, 1.5]
    y = n["n1"] / (n["n1"] + 2 * n["n2"])
    return [min(float(i), max(0.0, i - (i + 1) * y * n[f"n{i + 1}"] / n[f"n{i}"])) for i in range(1, 4)]


def low(column: str, symbols_: int):
    """The last symbols of a packed n-gram."""
    return F.col(column).bitwiseAND(F.lit((1 << (WIDE * symbols_)) - 1))


def gram_hash(context: np.ndarray, last: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return signed(mix64(mix64(context.view(np.uint64)) + last.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def wide_grams(texts: list[str], before: list[int] | None = None) -> tuple[np.ndarray, ...]:
    """The distinct n-grams of texts: hash, three symbols before the last, last three symbols, count; then each character's place among them and the characters of each text.

    before: how many of each text's first characters are context alone.
    """
    import pandas as pd

    n = np.array([len(t) for t in texts])
    sym = points("".join(texts)).astype(np.int64) + 1
    place = np.arange(len(sym)) - np.repeat(np.cumsum(n) - n, n)
    context = np.zeros_like(sym)
    for back in range(1, ORDER):
        context[back:] |= np.where(place[back:] >= back, sym[:-back], 0) << (WIDE * (back - 1))
    if before is not None and any(before):
        own = place >= np.repeat(before, n)
        sym, context, n = sym[own], context[own], n - np.array(before)
    g = gram_hash(context, sym)
    at, own = pd.factorize(g)
    first = np.empty(len(own), np.int64)
    first[at[::-1]] = np.arange(len(g))[::-1]
    context, last = context[first], sym[first]
    suffix = (context & ((1 << (WIDE * (ORDER - 2))) - 1)) << WIDE | last
    return own, context, suffix, np.bincount(at, minlength=len(own)), at, n


def wide_counts(docs: DataFrame) -> DataFrame:
    """(context, suffix, c): the n-grams of all texts, summed in each task and then by n-gram."""
    ddl = "context long, suffix long, c long"

    def run(batches) -> Iterator:
        for (texts,) in arrow_rows(batches, "text"):
            for _, own, before in pieces(texts):
                yield arrow_batch(ddl, *wide_grams(own, before)[1:4])

    return docs.select("text").mapInArrow(run, ddl).groupBy("context", "suffix").agg(F.sum("c").alias("c"))


def train(trusted: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """The model: for each order, tables of the n-grams seen with their probability (g, p; in the last order context, suffix, p) and of the contexts with their back-off mass (context, back)."""
    counts = {ORDER: written(wide_counts(trusted), "grams")}
    for k in range(ORDER - 1, 0, -1):  # in how many contexts an n-gram continues
        g = F.col("suffix") if k == ORDER - 1 else low("g", k)
        counts[k] = written(counts[k + 1].groupBy(g.alias("g")).agg(F.count(F.lit(1)).alias("c")), f"grams{k}")
    lower, orders = None, []
    for k in range(1, ORDER + 1):
        d = discounts(counts[k])
        cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        keys = (F.col("context"), F.col("suffix")) if k == ORDER else (F.shiftright("g", WIDE), low("g", k - 1))
        name = ("context", "suffix") if k == ORDER else ("g",)
        own = counts[k].select(*name[:1] * (k < ORDER), keys[0].alias("context"), keys[1].alias("suffix"), "c", cut.alias("cut"))
        context = own.groupBy("context").agg(F.sum("c").alias("total"), F.sum("cut").alias("mass")).select("context", "total", (F.col("mass") / F.col("total")).alias("back"))
        context = written(context, f"contexts{k}")
        own = own.join(F.broadcast(context) if k == 1 else context, "context")  # order 1 has one context
        below = F.lit(1.0 / CODE_POINTS) if lower is None else F.col("below")
        if lower is not None:
            own = own.join(lower.select(F.col("g").alias("suffix"), F.col("p").alias("below")), "suffix")
        lower = written(own.select(*name, (F.greatest(F.col("c") - F.col("cut"), F.lit(0.0)) / F.col("total") + F.col("back") * below).alias("p")), f"order{k}")
        orders.append((lower, context.select("context", "back")))
    return orders


def log_probabilities(grams: DataFrame, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(context, suffix, log): for distinct n-grams (context, suffix), seen or not, the logarithm of the last symbol's probability."""
    rows = grams.withColumn("p", F.lit(1.0 / CODE_POINTS))
    for k, (seen, contexts) in enumerate(model, 1):
        if k == ORDER:
            rows = rows.withColumn("before", F.col("context")).join(seen.withColumnRenamed("p", "seen"), ["context", "suffix"], "left")
        else:
            rows = rows.withColumn("key", low("suffix", k)).withColumn("before", F.shiftright("key", WIDE))
            rows = rows.join(seen.select(F.col("g").alias("key"), F.col("p").alias("seen")), "key", "left")
        left = contexts.select(F.col("context").alias("before"), "back")
        rows = rows.join(F.broadcast(left) if k == 1 else left, "before", "left")
        p = F.coalesce("seen", F.coalesce("back", F.lit(1.0)) * F.col("p"))
        rows = rows.select("context", "suffix", p.alias("p"))
    return rows.select("context", "suffix", F.log(F.greatest("p", F.lit(1e-15))).alias("log"))


def chunks(docs: DataFrame) -> DataFrame:
    """(chunk, ids, langs, sizes, texts): documents put together, their texts compressed as one; size is in bytes."""
    ddl = "chunk long, ids array<long>, langs array<string>, sizes array<long>, texts binary"

    def run(batches) -> Iterator:
        import bz2

        part, made, ids, langs, raw, size = TaskContext.get().partitionId(), 0, [], [], [], 0

        def flush():
            nonlocal made, ids, langs, raw, size
            body = bz2.compress(b"".join(raw))
            out = arrow_batch(ddl, [part << 32 | made], [ids], [langs], [[len(r) for r in raw]], [body])
            made, ids, langs, raw, size = made + 1, [], [], [], 0
            return out

        for rows in arrow_rows(batches, "doc_id", "lang", "text"):
            for key, lang, text in zip(*rows, strict=True):
                own = (text or "").encode("utf-8", "surrogatepass")
                if ids and size + len(own) > CHUNK:
                    yield flush()
                ids.append(key)
                langs.append(lang)
                raw.append(own)
                size += len(own)
        if ids:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text").mapInArrow(run, ddl)


def unpacked(sizes: list[int], body: bytes) -> Iterator[list[str]]:
    """The texts of a chunk, a thousand at a time."""
    import bz2

    raw, at = memoryview(bz2.decompress(body)), 0
    for start in range(0, len(sizes), 1024):
        own = []
        for size in sizes[start : start + 1024]:
            own.append(str(raw[at : at + size], "utf-8", "surrogatepass"))
            at += size
        yield own


def chunk_grams(stored: DataFrame) -> DataFrame:
    """(chunk, context, suffix): the distinct n-grams of each chunk, in order, so that they take little room."""
    ddl = "chunk long, context long, suffix long"

    def run(batches) -> Iterator:
        for batch in batches:
            for i in range(batch.num_rows):
                key, sizes, body = (batch.column(c)[i].as_py() for c in ("chunk", "sizes", "texts"))
                found = []
                for texts in unpacked(sizes, body):
                    found += [np.stack(wide_grams(own, before)[:3]) for _, own, before in pieces(texts)]
                if found:
                    g, context, suffix = np.concatenate(found, axis=1)
                    _, first = np.unique(g, return_index=True)
                    first = first[np.lexsort((suffix[first], context[first]))]
                    for at in range(0, len(first), 1 << 16):
                        part = first[at : at + (1 << 16)]
                        yield arrow_batch(ddl, np.full(len(part), key), context[part], suffix[part])
        given_back()

    return stored.select("chunk", "sizes", "texts").mapInArrow(run, ddl)


def perplexities(docs: DataFrame, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(doc_id, lang, perplexity); null where there is no text."""
    stored = written(chunks(docs), "chunks")
    grams = written(chunk_grams(stored), "chunk-grams")
    known = log_probabilities(grams.select("context", "suffix").distinct(), model)
    told = grams.join(known, ["context", "suffix"]).select("chunk", "context", "suffix", "log")
    ddl = "doc_id long, lang string, perplexity double"

    def run(told, stored):
        import pyarrow as pa

        context, suffix, log = (told.column(c).to_numpy() for c in ("context", "suffix", "log"))
        g = gram_hash(context, suffix & ((1 << WIDE) - 1))
        order = np.argsort(g)
        g, log, out = g[order], log[order], []
        for i in range(stored.num_rows):
            ids, langs, sizes, body = (stored.column(c)[i].as_py() for c in ("ids", "langs", "sizes", "texts"))
            start = 0
            for texts in unpacked(sizes, body):
                total, n = np.zeros(len(texts)), np.zeros(len(texts))
                for rows, part, before in pieces(texts):
                    own, *_, at, length = wide_grams(part, before)
                    sums = np.add.reduceat(log[np.searchsorted(g, own)][at], np.cumsum(length) - length)
                    np.add.at(total, rows, sums)
                    np.add.at(n, rows, length)
                value = np.exp(-total / np.maximum(n, 1))
                end = start + len(texts)
                out.append(arrow_batch(ddl, ids[start:end], langs[start:end], [float(v) if m else None for v, m in zip(value, n, strict=True)]))
                start = end
        given_back()
        return pa.Table.from_batches(out, arrow_schema(ddl))

    return told.groupBy("chunk").cogroup(stored.groupBy("chunk")).applyInArrow(run, ddl)


def judged(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(doc_id, lang, perplexity, threshold, keep) for every document.

    Trusted are the documents with labels, all of quality 1 and none toxic. Four fifths of them train the model, and
    the perplexities of the others give the thresholds. A document is kept if its perplexity is at most its language's
    threshold; a language without trusted documents held out takes the threshold of all such; null is a language like
    others. Null and empty texts have no perplexity and are not kept. Without any trusted text held out there is no
    threshold, and every document with text is kept. Repeated rows are judged alike; an empty table gives no rows. Other
    columns are not looked at. In a model of very few n-grams the discounts are fixed values (see discounts), and a
    symbol's probability counts as 1e-15 at least.
    """
    good = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce(F.col("toxic"), F.lit(0))).alias("t")).filter("q = 1 and t = 0").select("doc_id")
    good = written(good, "trusted")
    some = F.broadcast(good) if good.count() <= BROADCAST_ROWS else good
    trusted = docs.filter(F.col("text").isNotNull() & (F.col("text") != "")).join(some, "doc_id", "left_semi")
    scored = written(perplexities(docs, train(trusted.filter(~held_out()))), "perplexities")
    own = scored.join(some, "doc_id", "left_semi").filter(F.col("perplexity").isNotNull() & held_out())
    limits = written(thresholds(own, quantile), "thresholds")  # a row a language, and one for all
    by_lang = limits.filter("not everywhere").select("lang", "threshold")
    general = limits.filter("everywhere").select(F.col("threshold").alias("general"))
    rows = scored.join(F.broadcast(by_lang), scored["lang"].eqNullSafe(by_lang["lang"]), "left").drop(by_lang["lang"]).join(F.broadcast(general), F.lit(True), "left")
    limit = F.coalesce("threshold", "general")
    return rows.select("doc_id", "lang", "perplexity", limit.alias("threshold"), (F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= limit, F.lit(True))).alias("keep"))


def held_out(key: str = "doc_id"):
    """A fifth of the documents, by a hash of their ids: the model does not see them, and thresholds come from them."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def thresholds(scored: DataFrame, quantile: float) -> DataFrame:
    """(lang, everywhere, threshold): the quantile of the perplexities of each language and of all, rounded up to the grid.

    Counts by step of the grid are summed, so neither the order of merging nor the number of documents matters.
    """
    step = F.ceil(F.log("perplexity") * STEPS).cast("long")
    rows = scored.select(F.explode(F.array(F.struct(F.col("lang"), F.lit(False).alias("everywhere")), F.struct(F.lit(None).cast("string").alias("lang"), F.lit(True).alias("everywhere")))).alias("g"), step.alias("step"))
    counts = rows.groupBy("g.lang", "g.everywhere", "step").agg(F.count(F.lit(1)).alias("c"))
    w = W.partitionBy("lang", "everywhere")  # some ten thousand steps at most
    counts = counts.withColumn("below", F.sum("c").over(w.orderBy("step").rowsBetween(W.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(w))
    return counts.filter(F.col("below") >= quantile * F.col("n")).groupBy("lang", "everywhere").agg(F.exp(F.min("step") / F.lit(float(STEPS))).alias("threshold"))


def op4_quality(spark, sf_dir: str) -> DataFrame:
    """All documents, judged by a model of those that the labels trust."""
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
