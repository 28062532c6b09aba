"""Operator 8: WARC archives in Zstandard with a shared dictionary, written and read.

An archive is a skippable frame that holds the dictionary, then one Zstandard frame per record. The reader loads the
dictionary from that leading frame, finds each frame's end from its block headers, decodes one frame at a time, and
checks the record's headers, lengths and digests. Archives travel as rows (path, content), as Spark's `binaryFile`
source gives them, so that any store Spark reads will do; `export_archives` makes files of them.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm.common import fresh_path, table

# Fixed values of the formats: RFC 8878 and the WARC/1.1 and Zstandard-WARC specifications.
FRAME_MAGIC, SKIPPABLE_DICTIONARY, WARC_VERSION = 0xFD2FB528, 0x184D2A5D, "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Payload bytes of an archive, before compression; one larger payload has an archive of its own.
ARCHIVE_BYTES = 8 << 20
DICTIONARY_BYTES, SAMPLE_BYTES, LEVEL = 16 << 10, 2 << 20, 6
DATE = "2024-01-01T00:00:00Z"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A record: the block is an HTTP response, whose body a revisit leaves out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = "".join((url or f"urn:page:{page_id}").split())
    head = [WARC_VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}"]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins at `at` ends, from the sizes in its headers."""
    import zstandard

    p = zstandard.get_frame_parameters(data[at : at + 18])
    pos = at + zstandard.frame_header_size(data[at : at + 18])
    while True:
        if pos + 3 > len(data):
            raise ValueError("a frame ends early")
        head = int.from_bytes(data[pos : pos + 3], "little")
        pos += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            break
    pos += 4 * p.has_checksum
    if pos > len(data):
        raise ValueError("a frame ends early")
    return pos


def fields(head: bytes, first: str) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith(first):
        raise ValueError(f"no {first} line: {lines[0][:40]!r}")
    out = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"a malformed header: {line[:80]!r}")
        out[name.lower()] = value.strip()
    return out


def number_of(urn: str) -> int | None:
    if not (urn.startswith("<urn:page:") and urn.endswith(">")):
        raise ValueError(f"an unknown record id: {urn[:80]!r}")
    return int(urn[10:-1]) if urn[10:-1] else None


def parsed(raw: bytes) -> tuple:
    """A record's fields, after its headers, lengths and digests have been checked."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("a record without an end of its headers")
    f = fields(head, WARC_VERSION)
    if missing := [k for k in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest", "warc-block-digest") if k not in f]:
        raise ValueError(f"missing headers: {missing}")
    size = int(f["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length is {size}, the block has {len(rest) - 4}")
    block = rest[:size]
    if f["warc-block-digest"] != f"sha1:{digest(block)}":
        raise ValueError("the block's digest differs")
    http, gap, payload = block.partition(b"\r\n\r\n")
    h = fields(http, "HTTP/1.1 ")
    if not gap or "content-length" not in h:
        raise ValueError("no HTTP headers")
    kind, own = f["warc-type"], f["warc-payload-digest"].removeprefix("sha1:")
    if kind == "revisit":
        if payload or f.get("warc-profile") != REVISIT_PROFILE:
            raise ValueError("a revisit with a payload, or of another profile")
    elif kind != "response":
        raise ValueError(f"an unknown type: {kind}")
    elif len(payload) != int(h["content-length"]) or digest(payload) != own:
        raise ValueError("the payload's length or digest differs")
    return number_of(f["warc-record-id"]), f.get("warc-target-uri"), int(h["content-length"]), own, kind, number_of(f["warc-refers-to"]) if kind == "revisit" else None, payload if kind == "response" else None


def read_archive(content: bytes) -> Iterator[tuple]:
    """The records of an archive. Raises ValueError where it is not well formed."""
    import zstandard

    data, at, using = memoryview(content), 0, {}
    if len(data) >= 8 and (head := struct.unpack("<II", data[:8]))[0] == SKIPPABLE_DICTIONARY:
        own = bytes(data[8 : 8 + head[1]])
        if len(own) != head[1]:
            raise ValueError("the dictionary ends early")
        if own[:4] == struct.pack("<I", FRAME_MAGIC):  # the format lets a dictionary be compressed itself
            own = zstandard.ZstdDecompressor().decompress(own)
        using, at = {"dict_data": zstandard.ZstdCompressionDict(own)}, 8 + head[1]
    d = zstandard.ZstdDecompressor(**using)
    while at < len(data):
        magic = int.from_bytes(data[at : at + 4], "little")
        if magic >> 4 == 0x184D2A5:  # any other skippable frame
            at += 8 + int.from_bytes(data[at + 4 : at + 8], "little")
            continue
        if magic != FRAME_MAGIC:
            raise ValueError(f"no frame at byte {at}")
        end = frame_end(data, at)
        yield parsed(d.decompress(data[at:end]))
        at = end


def write_archive(records: list[bytes], sample: list[bytes]) -> bytes:
    import zstandard

    try:
        own = zstandard.train_dictionary(DICTIONARY_BYTES, sample)
    except zstandard.ZstdError:  # too little to learn from: the first records themselves serve
        own = zstandard.ZstdCompressionDict(b"".join(sample)[:DICTIONARY_BYTES] or b"\r\n\r\n\r\n\r\n")
    raw = own.as_bytes()
    c = zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_checksum=True, write_content_size=True)
    return b"".join([struct.pack("<II", SKIPPABLE_DICTIONARY, len(raw)), raw, *(c.compress(r) for r in records)])


def archives(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Rows (path, content) of archives that hold a record for every row of `pages` (page_id, url, html).

    Of equal payloads, the smallest page_id's record is a response and the others are revisits that refer to it. Null
    html is the empty payload; it groups like any other. Rows of the same page_id and payload as a response are
    responses too; a null page_id is larger than any other. An empty table gives no archives.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("same", F.unhex(F.sha2("payload", 256)))
    # Sums by payload are made before the shuffle; the join splits a payload that many pages have.
    first = rows.groupBy("same").agg(F.min("page_id").alias("leader"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").drop("copies")
    rows = rows.join(first, "same", "left").select("page_id", "url", "payload", F.when(~F.col("leader").eqNullSafe(F.col("page_id")), F.col("leader")).alias("refers_to"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, made, records, sample, size = TaskContext.get().partitionId(), 0, [], [], 0

        def flush() -> pd.DataFrame:
            nonlocal made, records, sample, size
            made += 1
            out = pd.DataFrame({"path": [f"part-{part:06d}-{made:06d}.warc.zst"], "content": [write_archive(records, sample)]})
            records, sample, size = [], [], 0
            return out

        for pdf in batches:
            for key, url, payload, to in zip(pdf["page_id"], pdf["url"], pdf["payload"], pdf["refers_to"], strict=True):
                own = record(None if pd.isna(key) else int(key), url, bytes(payload), None if pd.isna(to) else int(to), not pd.isna(to))
                if records and size + len(own) > archive_bytes:
                    yield flush()
                records.append(own)
                size += len(own)
                if sum(map(len, sample)) < SAMPLE_BYTES:
                    sample.append(own[:65536])
        if records:
            yield flush()

    # Nullable integers come as objects, not floats, so that large ids stay exact
    return rows.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", F.col("refers_to").cast("string").alias("refers_to")).mapInPandas(run, "path string, content binary")


def read_archives(files: DataFrame) -> DataFrame:
    """Every record of archives given as rows (path, content). A malformed archive raises ValueError with its path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                rows, size = [], 0
                try:
                    for r in read_archive(bytes(content)):
                        rows.append(r)
                        size += len(r[6] or b"")
                        if size > ARCHIVE_BYTES:
                            yield framed(rows)
                            rows, size = [], 0
                except Exception as e:
                    raise ValueError(f"{path}: {e}") from e
                yield framed(rows)

    def framed(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"], dtype=object)
        return out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})

    return files.select("path", "content").mapInPandas(run, RECORDS)


def store_archives(pages: DataFrame, path: str | None = None, **how) -> str:
    """Write the archives as a table of (path, content) and return its path; the content is compressed already."""
    path = path or fresh_path(pages.sparkSession, "warc")
    archives(pages, **how).write.option("compression", "uncompressed").parquet(path)
    return path


def export_archives(stored: str, spark, folder: str) -> list[str]:
    """Make a file of each stored archive, through the file system that Spark has for `folder`."""
    jvm, out = spark.sparkContext._jvm, []
    fs = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for row in spark.read.parquet(stored).toLocalIterator():
        to = f"{folder.rstrip('/')}/{row.path}"
        with_ = fs.create(jvm.org.apache.hadoop.fs.Path(to), True)
        with_.write(bytearray(row.content))
        with_.close()
        out.append(to)
    return out


def op8_warc(spark, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back."""
    stored = store_archives(table(spark, sf_dir, "pages"))
    files = spark.read.schema("path string, content binary").parquet(stored)
    return read_archives(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: SHA-1 as base 32 in DuckDB: 160 bits are 32 digits of 5 bits each.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, h, strlen(h) AS payload_bytes, sha1(h) AS hex, min(page_id) OVER (PARTITION BY h) AS leader FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 +
    ((('0x' || substr(hex || '0', 1 + (i * 5) // 4, 3))::INTEGER >> (12 - 5 - (i * 5) % 4)) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = leader THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = leader THEN NULL ELSE leader END AS refers_to
FROM d
"""
