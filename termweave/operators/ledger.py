"""A ledger of answers of an external model: each request is asked once, however often tasks run again.

A request's name is the hash of what is asked, by whom (the model's name) and how (its settings). A task looks up what the
ledger has, asks the rest with a bounded number of calls at a time, and stores every answer as it comes, so that a task
that fails or runs twice only asks what is missing. Answers are files in a folder that all executors share (any store
that Arrow's file systems reach), written whole under another name and then moved.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.operators.contracts import stable_hash


def request_hash(model: str, settings: dict, request: dict) -> str:
    """The name of a request: the same for the same model, settings and content, whatever the order of fields."""
    return stable_hash({"model": model, "settings": settings, "request": request})


@dataclass(frozen=True)
class Ledger:
    """Stored answers, by request. Errors are stored too, so that a request that failed for good is not asked for ever; `retry_errors` asks them again."""

    folder: str
    retry_errors: bool = False

    def place(self, key: str) -> tuple[stores.FileSystem, str]:
        if "://" in self.folder or self.folder.startswith("file:"):
            store, root = stores.FileSystem.from_uri(self.folder if "://" in self.folder else "file://" + self.folder.removeprefix("file:"))
        else:
            store, root = stores.LocalFileSystem(), self.folder
        return store, f"{root.rstrip('/')}/{key[:2]}/{key}.json"

    def get(self, key: str) -> dict | None:
        store, path = self.place(key)
        if store.get_file_info(path).type == stores.FileType.NotFound:
            return None
        with store.open_input_stream(path) as f:
            value = json.loads(f.read())
        return None if self.retry_errors and value.get("error") else value

    def put(self, key: str, value: dict) -> None:
        store, path = self.place(key)
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        part = f"{path}.{uuid.uuid4().hex}.part"
        with store.open_output_stream(part) as f:
            f.write(json.dumps(value, ensure_ascii=False, default=str).encode())
        store.move(part, path)


@dataclass(frozen=True)
class Caller:
    """How a model is called: its callable, name and settings, calls at a time in a task, attempts, and the pause after a failed one."""

    model: Callable[[dict], object]
    name: str
    settings: dict = field(default_factory=dict)
    at_once: int = 6
    attempts: int = 2
    pause: float = 0.5

    def answer(self, request: dict) -> dict:
        error = "no_attempt"
        for i in range(max(1, self.attempts)):
            try:
                return {"payload": self.model(request), "error": None, "attempts": i + 1}
            except Exception as e:  # whatever a model raises means: no answer
                error = type(e).__name__
                if i + 1 < self.attempts:
                    time.sleep(self.pause * 2**i)
        return {"payload": None, "error": error, "attempts": max(1, self.attempts)}


def answered(requests: Iterator[tuple[object, dict]], caller: Caller, ledger: Ledger) -> Iterator[tuple[object, str, dict, bool]]:
    """(key, request's hash, answer, whether it was in the ledger) as answers come in; at most `at_once` calls are open, and requests are drawn as calls end."""
    open_: dict = {}
    waiting: dict[str, list] = {}
    with ThreadPoolExecutor(max_workers=max(1, caller.at_once)) as pool:

        def done() -> Iterator[tuple[object, str, dict, bool]]:
            for f in wait(open_, return_when=FIRST_COMPLETED).done:
                name = open_.pop(f)
                value = f.result()
                keys = waiting.pop(name)
                for i, key in enumerate(keys):
                    yield key, name, value, i > 0

        def ask(name: str, request: dict) -> dict:
            value = caller.answer(request)
            ledger.put(name, value)  # as soon as it is there, before the task goes on
            return value

        for key, request in requests:
            name = request_hash(caller.name, caller.settings, request)
            if name in waiting:  # the same request is open already
                waiting[name].append(key)
                continue
            known = ledger.get(name)
            if known is not None:
                yield key, name, known, True
                continue
            while len(open_) >= max(1, caller.at_once):
                yield from done()
            waiting[name] = [key]
            open_[pool.submit(ask, name, request)] = name
        while open_:
            yield from done()


def called(rows: DataFrame, caller: Caller, ledger: Ledger, key: str) -> DataFrame:
    """(key, request_hash, payload_json, error, attempts, from_ledger) for rows whose other columns are what is asked.

    Equal requests are brought into one task and asked once. Lost tasks run again and find their answers in the ledger.
    """
    names = [c for c in rows.columns if c != key]
    whole = F.xxhash64(*names) if names else F.lit(0)
    kind = dict(rows.dtypes)[key]

    def run(batches) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple[object, dict]]:
            for batch in batches:
                for row in batch.to_pylist():
                    yield row.pop(key), row

        keys, out = [], []
        for k, name, value, known in answered(each(), caller, ledger):
            keys.append(k)
            out.append((name, None if value["payload"] is None else json.dumps(value["payload"], ensure_ascii=False), value["error"], int(value["attempts"]), known))
            if len(out) >= 256:
                yield batch_of(keys, out)
                keys, out = [], []
        yield batch_of(keys, out)

    from termweave.operators.products import kind_of, made

    ddl, schema = kind_of(f"{key} {kind}, request_hash string, payload_json string, error string, attempts int, from_ledger boolean")

    def batch_of(keys: list, out: list) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [[] for _ in range(5)]
        return made(schema, [pa.array(keys, schema.field(0).type), *(pa.array(list(c), f.type) for c, f in zip(columns, list(schema)[1:], strict=True))])

    return rows.repartition(whole).mapInArrow(run, ddl)


def entries(spark, ledger: Ledger) -> DataFrame:
    """(request_hash, payload_json, error, attempts): what the ledger holds."""
    rows = spark.read.schema("payload string, error string, attempts int").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(ledger.folder)
    return rows.select(F.regexp_extract(F.input_file_name(), r"([0-9a-f]+)\.json$", 1).alias("request_hash"), F.col("payload").alias("payload_json"), "error", "attempts")


def acceptance(answers: DataFrame) -> DataFrame:
    """One row: requests, valid answers and their rate, errors by name, and how many answers the ledger had. answers: errors (array), from_ledger."""
    bad = F.size("errors") > 0
    first = F.when(bad, F.get("errors", F.lit(0)))
    counts = answers.groupBy(first.alias("name")).agg(F.count(F.lit(1)).alias("n"), F.count_if("from_ledger").alias("known"))
    named = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", "n")))))  # a row for each name of an error
    valid = F.coalesce(F.sum(F.when(F.col("name").isNull(), F.col("n"))), F.lit(0))
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_requests"), valid.alias("n_valid_responses"), (valid / F.sum("n")).alias("acceptance_rate"), F.coalesce(F.sum("known"), F.lit(0)).alias("n_from_ledger"), named.alias("errors"))
