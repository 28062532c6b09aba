"""The ledger: one call for each request, over failing tasks, repeated rows and second runs; calls at a time stay bounded."""

import json
import threading
import time

import pytest

from termweave.operators import ledger, models, retrieval
from termweave.plans import jobs


def counting(folder):
    """A model that leaves a file for each call, so that calls in all workers are counted."""

    def model(row):
        import uuid
        from pathlib import Path

        Path(folder, uuid.uuid4().hex).write_text(json.dumps(row, sort_keys=True))
        if row["phrase"] == "bad":
            raise TimeoutError
        return {"echo": row["phrase"]}

    return model


def calls(folder):
    return sorted(json.loads(p.read_text())["phrase"] for p in folder.iterdir())


def test_one_call_for_each_request(spark, tmp_path):
    log, store = tmp_path / "calls", ledger.Ledger(str(tmp_path / "ledger"))
    log.mkdir()
    caller = ledger.Caller(counting(str(log)), "fake", {"t": 0}, at_once=3, attempts=2, pause=0.0)
    rows = spark.createDataFrame([(i, f"p{i % 10}") for i in range(60)] + [(99, "bad")], "key long, phrase string").repartition(4)
    got = {r.key: r for r in ledger.called(rows, caller, store, "key").collect()}
    assert len(got) == 61 and all(json.loads(got[i].payload_json) == {"echo": f"p{i % 10}"} for i in range(60))
    assert (got[99].error, got[99].attempts, got[99].payload_json) == ("TimeoutError", 2, None)
    assert calls(log) == sorted([f"p{i}" for i in range(10)] + ["bad"] * 2)  # equal requests once; the failing one twice, by its attempts
    again = ledger.called(rows, caller, store, "key").collect()
    assert all(r.from_ledger for r in again) and len(calls(log)) == 12
    assert ledger.entries(spark, store).count() == 11 and ledger.entries(spark, store).filter("error is not null").count() == 1
    # Another model or setting is another request; errors are asked again where that is wanted
    ledger.called(rows.filter("key < 3"), ledger.Caller(counting(str(log)), "fake", {"t": 1}), store, "key").collect()
    assert len(calls(log)) == 15
    ledger.called(rows.filter("key = 99"), caller, ledger.Ledger(store.folder, retry_errors=True), "key").collect()
    assert calls(log).count("bad") == 4


def test_a_task_that_fails_asks_only_what_is_missing(spark, tmp_path):
    """The first attempt dies after some answers, as a lost executor would; the second finds them in the ledger."""
    log, store = tmp_path / "calls", ledger.Ledger(str(tmp_path / "ledger"))
    log.mkdir()
    caller = ledger.Caller(counting(str(log)), "fake", at_once=1)
    requests = [(i, {"phrase": f"q{i:02d}"}) for i in range(30)]

    def dying():
        for i, r in enumerate(requests):
            if i == 17:
                raise RuntimeError("executor lost")
            yield r

    with pytest.raises(RuntimeError):
        list(ledger.answered(dying(), caller, store))
    before = len(calls(log))
    assert 15 <= before <= 17
    out = list(ledger.answered(iter(requests), caller, store))
    assert sorted(k for k, *_ in out) == list(range(30)) and calls(log) == [f"q{i:02d}" for i in range(30)]
    assert sum(known for *_, known in out) == before


def test_calls_at_a_time_are_bounded(tmp_path):
    lock, now, most = threading.Lock(), [0], [0]

    def model(row):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.02)
        with lock:
            now[0] -= 1
        return row

    out = list(ledger.answered(((i, {"n": i}) for i in range(40)), ledger.Caller(model, "m", at_once=4), ledger.Ledger(str(tmp_path))))
    assert len(out) == 40 and 2 <= most[0] <= 4


def test_frozen_rerank(spark, tmp_path):
    """Corrected, harmed and invalid answers by hand, with the acceptance rate; a second run is answered by the ledger."""
    pred = spark.createDataFrame(
        [("1", "a", "red rash", "B", [(1, "A", 0.9), (2, "B", 0.8)]), ("1", "b", "sick", "A", [(1, "A", 0.9), (2, "B", 0.8)]), ("2", "c", "drop", "A", [(1, "A", 0.9), (2, "B", 0.8)]), ("3", "d", "fail", "B", [(1, "A", 0.9), (2, "B", 0.8)])],
        "record_id string, row_id string, phrase string, gold_code string, candidates array<struct<rank:int,code:string,score:double>>",
    )
    terms = spark.createDataFrame([("A", "alpha"), ("B", "beta")], "code string, term string")

    def model(row):
        if row["phrase"] == "fail":
            raise TimeoutError
        codes = [c["code"] for c in json.loads(row["candidates"])][::-1]
        codes = codes[:1] if row["phrase"] == "drop" else codes
        return {"ranked_codes": codes, "overall_uncertainty": "", "candidate_rationales": [{"code": c, "rationale": "x", "evidence_quotes": [row["phrase"]]} for c in "AB"]}

    caller = ledger.Caller(model, "fake", pause=0.0)
    with pytest.raises(models.ExternalModelPolicyError):
        jobs.rerank_frozen(pred, terms, caller, str(tmp_path / "l"))
    r = jobs.rerank_frozen(pred, terms, caller, str(tmp_path / "l"), allow=True, out=str(tmp_path / "out"))
    assert (r["n"], r["corrected"], r["harmed"], r["n_requests"], r["n_valid_responses"], r["acceptance_rate"], r["n_from_ledger"]) == (4, 1, 1, 4, 2, 0.5, 0)
    assert r["errors"] == {"candidate_set_changed": 1, "model_error:TimeoutError": 1}
    retrieval.release()  # else Spark answers from what the first run kept
    again = jobs.rerank_frozen(pred, terms, caller, str(tmp_path / "l"), allow=True)
    assert again["n_from_ledger"] == 4 and {k: v for k, v in again.items() if k != "n_from_ledger"} == {k: v for k, v in r.items() if k != "n_from_ledger"}
    rows = {x.row_id: (x.before, x.after, x.accepted) for x in spark.read.parquet(str(tmp_path / "out/paired_predictions.parquet")).collect()}
    assert rows == {"a": ("A", "B", True), "b": ("A", "B", True), "c": ("A", "A", False), "d": ("A", "A", False)}
    assert models.acceptance(spark.createDataFrame([], "errors array<string>, from_ledger boolean")).first().n_requests == 0
