"""Operator 1: packing by Karmarkar-Karp multiway differencing.

Documents are tokenised by partition. Each is cut into pieces of at most `piece` tokens (full sequences are cut off
first), and the pieces, small rows without text, are dealt by a hash. Every partition takes its pieces in sorted order,
in blocks of about `windows` sequences (fewer where the pieces are small and many), and partitions each block into equal windows by multiway differencing: the two
partial partitions of the largest spread merge, the fullest window of one on the emptiest of the other, until one is
left. If its fullest window exceeds the capacity, the window count rises and the block is partitioned anew.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm.common import LOWER, arrow_batch, arrow_rows, hashed_bytes, table

CAPACITY, PIECE, WINDOWS, EOD = 4096, 512, 128, 2
#: Pieces of a block, at most: differencing keeps an order of the windows for each.
MOST_PIECES = 16_384
#: Characters of text tokenised at once.
AT_ONCE = 2_500_000
MARKS = re.compile(rb"[.,;:!?|]+$", re.MULTILINE)
LETTERS = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def differenced(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Partition items into k windows by Karmarkar-Karp differencing. Returns each item's window and the windows' loads."""
    n = len(sizes)
    if n == 0 or k == 1:
        return np.zeros(n, np.int64), np.array([sizes.sum()] if k == 1 else [0] * k, np.int64)
    # A partial partition: its loads, descending, less the least of them. An item alone: (size, 0, ..., 0).
    loads: list = [None] * (2 * n - 1)
    merged: list = [None] * (2 * n - 1)
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)

    def of(i: int) -> np.ndarray:
        if loads[i] is None:
            loads[i] = np.zeros(k, np.int64)
            loads[i][0] = sizes[i]
        return loads[i]

    at = n
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        total = of(a) + of(b)[::-1]
        order = np.argsort(-total, kind="stable")
        total = total[order]
        loads[a] = loads[b] = None
        loads[at] = total - total[-1]
        merged[at] = (a, b, order)
        heapq.heappush(heap, (-int(loads[at][0]), at))
        at += 1
    window = np.empty(n, np.int64)
    todo = [(at - 1, np.arange(k))]
    while todo:
        i, slots = todo.pop()  # slots[j]: the window that this partition's j-th load ends in
        if merged[i] is None:
            window[i] = slots[0]
            continue
        a, b, order = merged[i]
        back = np.empty(k, np.int64)
        back[order] = slots
        todo += [(a, back), (b, back[::-1])]
    return window, np.bincount(window, weights=sizes, minlength=k).astype(np.int64)


def packed(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Windows for items that each fit the capacity; the count rises until the fullest window fits."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window, loads = differenced(sizes, k)
        if loads.max(initial=0) <= capacity:
            return window, k
        k += 1


@lru_cache(1)  # a Python worker keeps what it has learnt from task to task
def tokenizer_ids(path: str, most: int = 600_000):
    """A function from a list of texts to their ids as uint32 arrays, without special tokens added.

    White space separates the tokenizer's units whatever stands around, A-Z count as a-z, and sentence marks after a
    letter are a unit of their own. So each distinct word (told by a 64-bit hash) goes to the tokenizer once, without
    the marks at its end; its ids are laid down in one array, and a text's ids are gathered from there. What is kept is
    bounded. Texts that may hold the tokenizer's special strings keep their case, as these depend on it.
    """
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    # Hashes in order, the number of each one's word, and where that word's ids lie
    keys, number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    start, size, laid = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def plain(core: bytes) -> bool:
        """Whether it is one unit of the tokenizer: letters that neither normalising nor lower-casing takes apart."""
        if core.isalpha():  # ASCII
            return True
        word = core.decode("utf-8", "surrogatepass")
        return word.isalpha() and word.lower().isalpha() and is_normalized("NFC", word)

    def units(new: list[bytes]) -> dict[bytes, bytes]:
        out, apart, joined = {}, [], []
        for w in new:
            (joined if plain(w) else apart).append(w)
        for at in range(0, len(joined), 2000):
            some = joined[at : at + 2000]
            e = tok.encode(b" ".join(some).decode(), add_special_tokens=False)
            raw = array("I", e.ids).tobytes()
            edge = (np.searchsorted(np.fromiter(e.word_ids, np.int64, len(e)), np.arange(len(some) + 1)) * 4).tolist()
            out.update(zip(some, map(raw.__getitem__, map(slice, edge, edge[1:])), strict=True))
        for at in range(0, len(apart), 2000):
            some = apart[at : at + 2000]
            for w, e in zip(some, tok.encode_batch_fast([x.decode("utf-8", "surrogatepass") for x in some], add_special_tokens=False), strict=True):
                out[w] = array("I", e.ids).tobytes()
        return out

    def learn(words: list[bytes]) -> list[bytes]:
        stripped = MARKS.sub(b"", b"\n".join(words)).split(b"\n")
        todo, ends = set(), []
        for w, core in zip(words, stripped, strict=True):
            if core != w and core and (core[-1] in LETTERS or core[-1] >= 128 and core.decode("utf-8", "surrogatepass")[-1].isalpha()):
                todo.add(core)
                todo.add(w[len(core) :])
                ends.append(core)
            else:
                todo.add(w)
                ends.append(w)
        known = units(list(todo))
        return [known[w] if w is core or len(w) == len(core) else known[core] + known[w[len(core) :]] for w, core in zip(words, ends, strict=True)]

    def ids(texts: list[str]) -> list[np.ndarray]:
        nonlocal keys, number, start, size, laid
        if len(keys) > most:
            keys, number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            start, size, laid = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        body = b"\n".join([t if b"<|" in t else t.translate(LOWER) for t in raw]) + b"\n"
        begin, end, h = hashed_bytes(body)
        each, first, which = np.unique(h, return_index=True, return_inverse=True)
        near = np.searchsorted(keys, each)
        told = np.zeros(len(each), bool)
        inside = near < len(keys)
        told[inside] = keys[near[inside]] == each[inside]
        if not told.all():
            at = first[~told]
            got = learn([body[a:b] for a, b in zip(begin[at].tolist(), end[at].tolist(), strict=True)])
            n = np.fromiter(map(len, got), np.int64, len(got)) // 4
            keys, number = np.insert(keys, near[~told], each[~told]), np.insert(number, near[~told], np.arange(len(start), len(start) + len(got)))
            start = np.concatenate([start, len(laid) + np.cumsum(n) - n])
            size = np.concatenate([size, n])
            laid = np.concatenate([laid, np.frombuffer(b"".join(got), "<u4")])
            near = np.searchsorted(keys, each)
        word = number[near][which]
        n = size[word]
        out = laid[np.repeat(start[word] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
        ends = np.searchsorted(begin, np.cumsum([len(r) + 1 for r in raw])[:-1])
        return np.split(out, np.concatenate([[0], np.cumsum(n)])[ends])

    return ids


def sequences(packed_: DataFrame, docs: DataFrame, tokenizer: str) -> DataFrame:
    """(sequence_id, ids): the packed sequences' token ids, not padded.

    Placement is decided over small rows; the ids are cut again from the texts (tokenizing gives the same ids) and
    travel once, to their sequence. Rows that repeat a doc_id are taken to be the same document.
    """
    ddl = "doc_id long, start long, length long, sequence_id long, offset long, ids binary"

    def run(batches) -> Iterator:
        of = tokenizer_ids(tokenizer)
        for keys, texts, places in arrow_rows(batches, "doc_id", "text", "places"):
            out: list[list] = [[], [], [], [], [], []]
            for key, own, where in zip(keys, of([t or "" for t in texts]), places, strict=True):
                own = np.append(own, np.uint32(EOD)).astype("<u4")
                for x in where:
                    for c, v in zip(out, (key, x["start"], x["length"], x["sequence_id"], x["offset"], own[x["start"] : x["start"] + x["length"]].tobytes()), strict=True):
                        c.append(v)
            yield arrow_batch(ddl, *out)

    places = packed_.groupBy("doc_id").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("places"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").dropDuplicates(["doc_id"])
    cut_up = texts.join(places, texts["doc_id"].eqNullSafe(places["doc_id"])).select(texts["doc_id"], "text", "places").mapInArrow(run, ddl)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return cut_up.groupBy("sequence_id").agg(joined.alias("ids"))


def cut(lengths: int, capacity: int, piece: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full sequences first, then pieces of near-equal length."""
    full = lengths // capacity
    out = [(i * capacity, capacity) for i in range(full)]
    rest, at = lengths - full * capacity, full * capacity
    n = -(-rest // piece)
    for i in range(n):
        step = rest // n + (i < rest % n)
        out.append((at, step))
        at += step
    return out


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, piece: int = PIECE) -> DataFrame:
    """A row per piece with the CRC of its ids; null text: empty, so that its document is the end id alone."""

    def run(batches) -> Iterator:
        ids = tokenizer_ids(tokenizer)
        for keys, texts in arrow_rows(batches, "doc_id", "text"):
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size < AT_ONCE):
                    size += len(texts[end] or "")
                    end += 1
                rows = []
                for key, own in zip(keys[at:end], ids([t or "" for t in texts[at:end]]), strict=True):
                    own = np.append(own, np.uint32(EOD)).astype("<u4")
                    raw = memoryview(own.tobytes())
                    rows += [(key, s, m, zlib.crc32(raw[4 * s : 4 * (s + m)]), len(own)) for s, m in cut(len(own), capacity, piece)]
                yield arrow_batch(PIECES, *map(list, zip(*rows, strict=True)))
                at = end

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, piece: int = PIECE, windows: int = WINDOWS, most: int = MOST_PIECES) -> DataFrame:
    """Every id of every document in exactly one piece, each piece at an offset of a sequence of at most `capacity`.

    Null and empty texts are a document of one id (the end id). A block has `windows` sequences' ids or `most` pieces, whichever is less. Repeated rows are packed as often as they occur. An
    empty table gives no rows. Columns other than doc_id and text are not looked at.
    """

    def run(batches) -> Iterator:
        part, made, held, tokens, pieces_held = TaskContext.get().partitionId(), 0, [], 0, 0

        def flush(rows: pa.Table):
            nonlocal made
            sizes = rows["length"].to_numpy()
            full = sizes == capacity
            window = np.empty(len(sizes), np.int64)
            window[full] = np.arange(full.sum())
            own, k = packed(sizes[~full], capacity)
            window[~full] = own + full.sum()
            order = np.argsort(window, kind="stable")
            sizes, window = sizes[order], window[order]
            before = np.cumsum(sizes) - sizes
            offset = before - np.maximum.accumulate(np.where(np.r_[True, window[1:] != window[:-1]], before, 0))
            rows = rows.take(pa.array(order)).append_column("sequence_id", pa.array((np.int64(part) << 40) + made + window)).append_column("offset", pa.array(offset))
            made += int(full.sum()) + k
            yield from rows.combine_chunks().to_batches()

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            sizes = rows["length"].to_numpy()
            ends, at = np.cumsum(np.where(sizes < capacity, sizes, 0)), 0
            while at < len(sizes):
                before = int(ends[at - 1]) if at else 0
                to = min(int(np.searchsorted(ends, before + windows * capacity - tokens)) + 1, at + most - pieces_held, len(sizes))
                held.append(rows.slice(at, to - at))
                tokens, pieces_held, at = tokens + int(ends[to - 1]) - before, pieces_held + to - at, to
                if tokens >= windows * capacity or pieces_held >= most:
                    yield from flush(pa.concat_tables(held))
                    held, tokens, pieces_held = [], 0, 0
        if pieces_held:
            yield from flush(pa.concat_tables(held))

    # The number of the task that cut a piece takes part, so that a row that repeats very often is dealt out too
    cut_up = pieces(docs, tokenizer, capacity, piece).withColumn("part", F.spark_partition_id())
    dealt = cut_up.repartition(F.xxhash64("doc_id", "start", "ids_crc32", "part")).drop("part").sortWithinPartitions("doc_id", "start", "ids_crc32")
    return dealt.mapInArrow(run, f"{PIECES}, sequence_id long, offset long")


def op1_packing(spark, sf_dir: str) -> DataFrame:
    """All documents into sequences of at most 4096 ids of the 49k word tokenizer."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
