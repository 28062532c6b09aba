"""Operator 7: language identification by n-gram filters that hold a bitmask of languages.

A Bloom filter is kept for every language, all of them sliced by bit into one table: slot i holds the bitmask of the
languages whose filter has bit i set. ANDing the slots of an n-gram gives all languages that contain it, in as many
reads as there are hash functions. A text's count for a language is the number of its n-grams whose mask has that bit,
corrected for the rate at which that language's filter answers yes by chance; the largest corrected count decides.
A language's filter leaves out n-grams that are rare in it, or far more frequent in another language.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm.common import arrow_batch, carried, carried_schema, mix64, sliced, table

#: The filters are fitted on about this many labelled documents of each language, taken by a hash of their ids.
PER_LANGUAGE = 3000
N, HASHES = 4, 3
#: Slots of a filter for each n-gram of the language that has most, and slots at least.
SLOTS_PER_GRAM, LEAST_SLOTS = 12, 1 << 16
#: An n-gram is put into a language's filter if it occurs this often there and its share is this part of its largest
#: share: filters hold what tells languages apart, not all that was ever seen in one (README has the accuracy of both).
LEAST, PART = 3, 0.25
#: Characters of text taken at once.
AT_ONCE = 250_000
UNKNOWN = "und"
OUT = "doc_id long, lang_pred string, score double"


@lru_cache(1)  # a Python worker makes it once, not in every task
def letters() -> np.ndarray:
    """For every code point, whether it is a letter (categories L*)."""
    return np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def symbols(code: np.ndarray, is_letter: np.ndarray, after_letter: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Which of the code points stay, and what they become: letters themselves, and one blank after each run of them."""
    letter = is_letter[code]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    if after_letter and len(keep):
        keep[0] = True
    return keep, np.where(letter, code, 32)[keep].astype(np.uint64)


def hashes_of(sym: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of n symbols; runs of up to three symbols have different ones before mixing."""
    m = len(sym) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(m, np.uint64)
    for i in range(n):
        h = (h << np.uint64(21)) ^ (h >> np.uint64(43)) ^ sym[i : i + m]
    return mix64(h)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def stream(texts: list[str], is_letter: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of lower-cased letters and single blanks, the text of each, and which texts have letters."""
    low = [t.lower() for t in texts]
    size = np.array([len(t) for t in low], np.int64)
    code = points("\0".join(low))
    ends = np.cumsum(size + 1) - 1  # of each text, where the separator stands
    owner = np.repeat(np.arange(len(texts)), size + 1)[: len(code)]
    has = np.zeros(len(texts), bool)
    has[np.unique(owner[is_letter[code]])] = True
    keep, sym = symbols(code, is_letter)
    owner = owner[keep]
    h = hashes_of(sym, n)
    same = owner[: len(h)] == owner[n - 1 :] if len(h) else np.zeros(0, bool)
    # A text's last run ends without a blank, as nothing stands after it
    last = np.zeros(len(code), bool)
    last[ends[:-1]] = True
    blank = last[keep]
    if len(h):
        same &= ~blank[n - 1 :]
    return h[same], owner[: len(h)][same], has


def long_stream(text: str, is_letter: np.ndarray, n: int = N, most: int = AT_ONCE) -> Iterator[tuple[np.ndarray, bool]]:
    """Hashes of the n-grams of one text, part by part: the last n - 1 symbols of a part are carried over to the next."""
    text, carry, after = text.lower(), np.empty(0, np.uint64), False
    for at in range(0, len(text), most):
        code = points(text[at : at + most])
        _, sym = symbols(code, is_letter, after)
        after = bool(is_letter[code[-1]])
        sym = np.concatenate([carry, sym])
        carry = sym[max(0, len(sym) - n + 1) :]
        yield hashes_of(sym, n), bool(is_letter[code].any())


def slots(h: np.ndarray, size: int, k: int) -> list[np.ndarray]:
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(i) * step) % np.uint64(size)).astype(np.int64) for i in range(k)]


def hashed(texts: list[str | None], is_letter: np.ndarray, most: int = AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For parts of about `most` characters: hashes of n-grams, the text of each, and the texts and whether they have letters."""
    at = 0
    while at < len(texts):
        if len(texts[at] or "") > most:
            for h, letter in long_stream(texts[at], is_letter, most=most):
                yield h, np.full(len(h), at), np.array([at]), np.array([letter])
            at += 1
            continue
        rows, size = [], 0
        while at < len(texts) and len(texts[at] or "") <= most and (not rows or size < most):
            if texts[at]:
                rows.append(at)
                size += len(texts[at])
            at += 1
        if rows:
            h, owner, letter = stream([texts[i] for i in rows], is_letter)
            yield h, np.array(rows)[owner], np.array(rows), letter


def grams(docs: DataFrame) -> DataFrame:
    """Counts by language and n-gram, summed in each task first."""
    ddl = "lang string, gram long, c long"

    def run(batches) -> Iterator:
        is_letter = letters()
        for batch in sliced(batches):
            langs, texts = np.array(batch.column("lang").to_pylist(), object), batch.column("text").to_pylist()
            for lang in sorted(set(langs)):
                for h, *_ in hashed([t for t, o in zip(texts, langs == lang, strict=True) if o], is_letter):
                    h, c = np.unique(h, return_counts=True)
                    yield arrow_batch(ddl, [lang] * len(h), h.view(np.int64), c)

    return docs.select("lang", "text").mapInArrow(run, ddl).groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, slots_: int | None = None, hashes: int = HASHES) -> dict:
    """The filters: languages, the table (a row of slots for every 64 languages), and each language's rate of false answers.

    `slots_`: slots of a filter, by default as many as the n-grams ask for.

    Learns from text and lang of the rows that are not held out, about `per_language` of each language.
    """
    from pyspark.sql.types import StringType

    known = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = known.select(F.col("doc_id"), F.col("lang").cast(StringType()).alias("lang"), "text")
    # A bounded part of each language, by a hash of the ids: nothing is ranked, so no language meets in one task
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    langs = sorted(r["lang"] for r in sizes)
    part = F.lit(0.0)
    for r in sizes:
        part = F.when(F.col("lang") == r["lang"], F.lit(min(1.0, per_language / r["n"]))).otherwise(part)
    sample = known.filter(F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 40) - 1)) < part * float(1 << 40))
    counts = grams(sample)
    total = counts.groupBy("lang").agg(F.sum("c").alias("total"))
    share = counts.join(F.broadcast(total), "lang").withColumn("share", F.col("c") / F.col("total"))  # a row a language
    best = share.groupBy("gram").agg(F.max("share").alias("best"))
    kept = share.filter(F.col("c") >= LEAST).join(best, "gram").filter(F.col("share") >= PART * F.col("best"))
    rows = kept.select("lang", "gram").toArrow()
    names = np.array(rows["lang"].to_pylist(), str)
    gram = rows["gram"].to_numpy().view(np.uint64)
    if slots_ is None:  # sized by the n-grams, so that no script fills its filter
        most, slots_ = int(np.unique(names, return_counts=True)[1].max(initial=0)) if len(names) else 0, LEAST_SLOTS
        while slots_ < SLOTS_PER_GRAM * most:
            slots_ *= 2
    masks = np.zeros((max(1, -(-len(langs) // 64)), slots_), np.uint64)
    false = np.zeros(len(langs))
    for i, lang in enumerate(langs):
        bit = np.uint64(1 << (i % 64))
        for s in slots(gram[names == lang], slots_, hashes):
            masks[i // 64][s] |= bit
        false[i] = (np.count_nonzero(masks[i // 64] & bit) / slots_) ** hashes
    return {"langs": langs, "masks": masks, "false": false, "hashes": hashes}


def predict(docs: DataFrame, model: dict, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred and score for every row; `und` and score 0 if the text is null or has no letter.

    The score is the winning language's corrected share of the sum of all. A text with letters, but no n-gram of any
    language, gets the first language in order of name, with score 0; so does every text with letters where nothing
    was learned, then `und`. Ties go to the first name. The columns named in `keep` come along.
    """
    told = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches) -> Iterator:
        is_letter, m = letters(), told.value
        langs, masks, false = m["langs"], m["masks"], m["false"]
        if len(langs) <= 8:
            masks = masks.astype(np.uint8)
        for batch in sliced(batches):
            keys, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            n = np.zeros(len(texts))
            hits = np.zeros((len(langs), len(texts)))
            has = np.zeros(len(texts), bool)
            for h, to, rows, letter in hashed(texts, is_letter):
                has[rows] |= letter
                n += np.bincount(to, minlength=len(texts))
                at = slots(h, masks.shape[1], m["hashes"])
                for w, mask in enumerate(masks):
                    found = mask[at[0]]
                    for s in at[1:]:
                        found &= mask[s]
                    for i in range(64 * w, min(64 * w + 64, len(langs))):
                        hits[i] += np.bincount(to, weights=(found >> mask.dtype.type(i % 64)) & mask.dtype.type(1), minlength=len(texts))
            true = np.maximum(0, (hits - n * false[:, None]) / (1 - np.minimum(false, 0.999))[:, None]) if langs else np.zeros((1, len(texts)))
            best, total = true.argmax(0), true.sum(0)
            score = np.where(has & (total > 0), true.max(0) / np.maximum(total, 1e-300), 0.0)
            lang = np.array([*langs, UNKNOWN], object)[np.where(has & bool(langs), best, len(langs))]
            yield carried(arrow_batch(OUT, keys, lang, score), batch, keep)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(c for c in keep if c not in ("doc_id", "text")))
    return rows.mapInArrow(run, carried_schema(OUT, rows, keep))


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
