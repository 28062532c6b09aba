"""Operator 10: benchmark decontamination with an FM-index per training shard.

The documents of a task are cut into shards. A shard's words become symbols of its own, and one separator stands for
words that the benchmark does not have and for the ends of texts, as no phrase holds those. Runs of benchmark words
shorter than the shortest phrase are left out, for the same reason. Over the rest an FM-index is built once (suffix
array, Burrows-Wheeler transform, wavelet matrix, sampled suffix positions). The benchmark's phrases come in blocks; a
block's words are looked up among the shard's symbols, its phrases searched backward at once, their occurrences located
from the sampled positions, and the spans of words they cover merged over all blocks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm.common import arrow_batch, carried, carried_schema, hashed_bytes, in_filter, sliced, table

PHRASE = 10
#: Indexed symbols and characters of a shard.
SHARD_SYMBOLS, SHARD_BYTES = 400_000, 2_000_000
#: Every so many suffix positions one is kept.
SAMPLED = 16
#: Bytes of benchmark texts in a block: driver and workers hold one block at a time.
BLOCK_BYTES = 4 << 20
#: Bits of the bitmap of all words of the benchmark, by their hashes (1 MB).
FILTER_BITS = 1 << 23

#: Bytes outside words become blanks, A-Z become a-z; bytes of characters beyond ASCII stay.
WORDS = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: The words of a text whose case is kept.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


class FMIndex:
    """Over an array of symbols 1..size-1; 0 ends the text."""

    def __init__(self, symbols: np.ndarray, size: int) -> None:
        text = np.append(symbols, 0).astype(np.int64)
        n = len(text)
        order = self.suffixes(text)
        bwt = text[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(bwt, minlength=size))])
        self.marked = order % SAMPLED == 0
        self.mark_rank = np.cumsum(self.marked) - self.marked
        self.kept = order[self.marked]
        self.bwt, self.levels, self.n = bwt, [], n
        cur = bwt
        for bit in range(max(1, int(size - 1).bit_length()) - 1, -1, -1):
            ones = (cur >> bit) & 1
            rank = np.concatenate([[0], np.cumsum(ones)]).astype(np.int32)
            self.levels.append((bit, rank, int(n - rank[-1])))
            cur = np.concatenate([cur[ones == 0], cur[ones == 1]])

    @staticmethod
    def suffixes(text: np.ndarray) -> np.ndarray:
        """The suffix array, by doubling the length that the ranks stand for."""
        n = len(text)
        rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
        step = 1
        while True:
            key = rank * (n + 1)
            key[: n - step] += rank[step:] + 1
            order = np.argsort(key, kind="stable")
            new = np.empty(n, np.int64)
            new[order] = np.cumsum(np.r_[False, key[order][1:] != key[order][:-1]])
            rank = new
            step *= 2
            if rank.max(initial=0) == n - 1 or step >= n:
                return order

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each symbol occurs among the first `row` symbols of the transform."""
        start, end = np.zeros_like(row), row
        for bit, ones, zeros in self.levels:
            one = (symbol >> bit & 1).astype(bool)
            start = np.where(one, zeros + ones[start], start - ones[start])
            end = np.where(one, zeros + ones[end], end - ones[end])
        return end - start

    def ranges(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For phrases of one length (a row each), the rows of the suffixes that begin with them."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        alive = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[alive, j]
            low[alive] = self.first[c] + self.rank(c, low[alive])
            high[alive] = self.first[c] + self.rank(c, high[alive])
            dead = low[alive] >= high[alive]
            high[alive[dead]] = low[alive[dead]]
            alive = alive[~dead]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: back through the text to the next position that was kept."""
        out, todo, rows, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            hit = self.marked[rows]
            out[todo[hit]] = self.kept[self.mark_rank[rows[hit]]] + steps
            todo, rows = todo[~hit], rows[~hit]
            c = self.bwt[rows]
            rows = self.first[c] + self.rank(c, rows)
            steps += 1
        return out


class Phrases:
    """The windows of some benchmark items: 64-bit hashes of their words, and by length an array of places among these with the items of each distinct window."""

    def __init__(self, items: list[tuple[str, str | None]], length: int = PHRASE) -> None:
        named: dict[str, int] = {}
        raw, lengths, who = [], [], []
        for item, text in items:
            h = word_hashes(text)[2]
            if len(h):
                raw.append(h)
                lengths.append(len(h))
                who.append(named.setdefault(item, len(named)))
        self.items = list(named)
        flat = np.concatenate([np.empty(0, np.uint64), *raw])
        self.words, place = np.unique(flat, return_inverse=True)
        size, who = np.array(lengths, np.int64), np.array(who, np.int64)
        begin = np.cumsum(size) - size
        #: (length, windows as places of words, where each window's items begin, the items)
        self.groups: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for m in sorted({min(int(n), length) for n in size}):
            own = np.flatnonzero((size == m) if m < length else (size >= length))
            count = size[own] - m + 1
            starts = np.repeat(begin[own] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
            windows = place[starts[:, None] + np.arange(m)].astype(np.int32)
            windows, which = np.unique(windows, axis=0, return_inverse=True)
            pairs = np.unique(np.stack([which.ravel(), np.repeat(who[own], count)]), axis=1)
            self.groups.append((m, windows, np.searchsorted(pairs[0], np.arange(len(windows) + 1)), pairs[1]))
        self.shortest = self.groups[0][0] if self.groups else 0

    def found(self, index: FMIndex, words: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(length, window of each occurrence, its place in the text, where each window's items begin, the items) for an index over `words`, whose symbols are their places and 2."""
        if not len(words):
            return
        at = np.minimum(np.searchsorted(words, self.words), len(words) - 1)
        symbol = np.where(words[at] == self.words, at + 2, 0)
        for m, windows, edges, items in self.groups:
            phrases = symbol[windows]
            some = np.flatnonzero((phrases > 0).all(1))  # the others have a word that the shard lacks
            low, high = index.ranges(phrases[some])
            count = high - low
            if count.any():
                rows = np.repeat(low - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
                yield m, np.repeat(some, count), index.locate(rows), edges, items


def word_hashes(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of a text begin and end in its translated bytes, and their hashes."""
    return hashed_bytes((text or "").encode("utf-8", "surrogatepass").translate(WORDS) + b" ")


def shard_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of some texts, and where each text's begin (and the last one's end)."""
    raw = [(t or "").encode("utf-8", "surrogatepass").translate(WORDS) + b" " for t in texts]
    start, _, h = hashed_bytes(b"".join(raw))
    return h, np.append(np.searchsorted(start, np.cumsum([0] + [len(r) for r in raw])[:-1]), len(h))


def searched(h: np.ndarray, edges: np.ndarray, known: np.ndarray, shortest: int, blocks: list) -> Iterator[tuple]:
    """What Phrases.found gives, with places of words in h, and the phrases: for the shard's indexes and every block of the benchmark.

    Words that no phrase has (`known` is false; a phrase's word never is) and ends of texts become separators, and runs
    too short for any phrase are left out. An index is built once and all blocks are searched in it.
    """
    if not shortest:
        return
    n = len(h)
    breaks = np.zeros(n + 1, bool)
    breaks[edges] = True  # a text begins here
    # Runs of known words inside one text
    begin = np.flatnonzero(known & (np.r_[True, ~known[:-1]] | breaks[:n]))
    end = np.flatnonzero(known & (np.r_[~known[1:], True] | breaks[1:])) + 1
    long = end - begin >= shortest
    begin, end = begin[long], end[long]
    ends = np.cumsum(end - begin + 1)  # each run, and the separator after it
    at = 0
    while at < len(begin):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + SHARD_SYMBOLS)))
        b, e = begin[at:to], end[at:to]
        size = e - b + 1
        place = np.repeat(b - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        gap = np.cumsum(size) - 1
        inside = np.ones(len(place), bool)
        inside[gap] = False
        words, symbol = np.unique(h[place[inside]], return_inverse=True)
        symbols = np.ones(len(place), np.int64)
        symbols[inside] = symbol + 2
        index = FMIndex(symbols, len(words) + 2)
        for told in blocks:
            phrases = told.value
            for m, window, where, starts, items in phrases.found(index, words):
                yield m, window, place[where], starts, items, phrases.items
            if len(blocks) > 1:
                told.__dict__.pop("_value", None)  # a worker holds one block at a time
        at = to


def spans_of(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Character spans of the runs of hit words, from each run's first word to its last."""
    out: list[list[int]] = []
    last = -2
    for i, m in enumerate(WORD.finditer(text)):
        if hit[i]:
            if last == i - 1:
                out[-1][1] = m.end()
            else:
                out.append([m.start(), m.end()])
            last = i
    return [(a, b) for a, b in out]


def blocks_of(benchmark: DataFrame, most: int) -> Iterator[list[tuple[str, str | None]]]:
    """The benchmark's items, in lists of about `most` bytes; one block at a time is on the driver."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    own, size = [], 0
    for r in rows.filter(F.col("item_id").isNotNull()).toLocalIterator():
        if own and size + len(r.text or "") > most:
            yield own
            own, size = [], 0
        own.append((r.item_id, r.text))
        size += len(r.text or "")
    yield own


def shards(batch) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) for parts of a batch of about SHARD_BYTES; a longer text is one."""
    texts, at = batch.column("text"), 0
    while at < len(texts):
        own, size = [], 0
        while at + len(own) < len(texts) and (not own or size < SHARD_BYTES):
            own.append(texts[at + len(own)].as_py())
            size += len(own[-1] or "")
        yield at, own
        at += len(own)


def decontaminate(docs: DataFrame, benchmark: DataFrame, length: int = PHRASE, text: bool = True, keep: tuple[str, ...] = (), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated and, with `text`, the spans hit and the text without them.

    Phrases are `length` consecutive words of an item, or all words of an item with fewer. A null text, of a document
    or an item, has no words. Items of the same id count once. An empty benchmark hits nothing; an empty table gives
    no rows; repeated rows are judged one by one. Columns other than those used are not looked at. Words are told apart
    by 64 bits. The benchmark is the stated query set: it is sent out in blocks of a bounded size, all of which are
    searched in each shard's index in the one pass over the documents; nothing is shuffled. The columns named in
    `keep` come along.
    """
    spark = docs.sparkSession
    ddl = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean" + ", starts array<long>, ends array<long>, text string" * text
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep)
    blocks, shortest, words = [], 0, np.zeros(FILTER_BITS // 64, np.uint64)
    for items in blocks_of(benchmark, block_bytes):
        block = Phrases(items, length)
        if block.shortest:
            shortest = min(shortest or block.shortest, block.shortest)
            at = block.words & np.uint64(FILTER_BITS - 1)
            np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
            blocks.append(spark.sparkContext.broadcast(block))
    #: Words that some phrase may have: a word that is let through by chance only makes an index larger
    told = spark.sparkContext.broadcast(words)

    def run(batches) -> Iterator:
        for batch in sliced(batches):
            keys = batch.column("doc_id").to_pylist()
            for at, texts in shards(batch):
                h, edges = shard_words(texts)
                change, owned = np.zeros(len(h) + 1, np.int32), {}
                known = in_filter(told.value, FILTER_BITS, h)
                for m, window, place, starts, items, names in searched(h, edges, known, shortest, blocks):
                    np.add.at(change, place, 1)
                    np.add.at(change, place + m, -1)
                    doc = np.searchsorted(edges, place, side="right") - 1
                    pairs = np.unique(np.stack([doc, window]), axis=1)
                    for d, w in pairs.T.tolist():
                        owned.setdefault(d, set()).update(names[i] for i in items[starts[w] : starts[w + 1]])
                hit = np.cumsum(change[:-1]) > 0
                out: list[list] = [[] for _ in range(6 + 3 * text)]
                for i, body in enumerate(texts):
                    own, found = hit[edges[i] : edges[i + 1]], sorted(owned.get(i, ()))
                    row = [keys[at + i], len(own), int(own.sum()), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), i in owned]
                    if text:
                        spans, clean = spans_of(body, own) if i in owned else [], body
                        for a, b in reversed(spans):
                            clean = clean[:a] + clean[b:]
                        row += [[a for a, _ in spans], [b for _, b in spans], clean]
                    for c, x in zip(out, row, strict=True):
                        c.append(x)
                yield carried(arrow_batch(ddl, *out), batch.slice(at, len(texts)), keep)

    return rows.mapInArrow(run, carried_schema(ddl, rows, keep))


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), text=False)
