"""The stateful review stream: the same states as the batch job, over restarts, with late and repeated events, and alerts when time has come."""

from datetime import datetime, timedelta

import pytest

from termweave.operators import review
from termweave.streaming import review as stream

START = datetime(2024, 1, 1)


@pytest.fixture()
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, stream.STORE)
    yield
    spark.conf.set(key, before)


def event(i, record, kind, hours, action="", code=""):
    return (i, record, kind, action, code, "", "", START + timedelta(hours=hours))


def run(spark, tmp_path, batch, out):
    """Append a file of events and let the query take what is new; the checkpoint carries the state over."""
    if batch:
        review_rows = spark.createDataFrame(batch, review.EVENT).coalesce(1)
        review_rows.write.mode("append").json(str(tmp_path / "log"))
    rows = stream.watched(spark.readStream.schema(review.EVENT).option("maxFilesPerTrigger", 1).json(str(tmp_path / "log")), pending_hours=24, escalated_hours=48)
    got = []
    q = rows.writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / out)).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return got


def test_states_alerts_and_restarts(spark, store, tmp_path):
    first = [event(1, "a", "ENQUEUE", 0), event(2, "b", "ENQUEUE", 0), event(3, "b", "DECIDE", 2, "ACCEPT_TOP1", "X"), event(4, "c", "ENQUEUE", 1), event(5, "c", "DECIDE", 3, "ESCALATE"), event(5, "c", "DECIDE", 3, "ESCALATE")]
    got = {r.record_id: (r.status, r.selected_code, r.n_decisions, r.alert) for r in run(spark, tmp_path, first, "cp")}
    assert got == {"a": ("PENDING", "", 0, ""), "b": ("RESOLVED", "X", 1, ""), "c": ("ESCALATED", "", 1, "")}
    # A restart with nothing new repeats nothing
    assert run(spark, tmp_path, [], "cp") == []
    # Time moves on by other records' events: a has waited 24 hours; c's 48 hours are not over
    second = run(spark, tmp_path, [event(6, "d", "ENQUEUE", 26), event(3, "b", "DECIDE", 2, "ACCEPT_TOP1", "X")], "cp") + run(spark, tmp_path, [event(7, "d", "DECIDE", 26.5, "NO_CODE")], "cp")
    assert [(r.record_id, r.alert) for r in second if r.alert] == [("a", "PENDING_TOO_LONG")]
    assert not [r for r in second if r.record_id == "b"]  # the repeated event changed nothing
    # A late event older than the state counts, but does not decide; c is decided before its time
    third = run(spark, tmp_path, [event(8, "d", "DECIDE", 26.2, "ACCEPT_TOP1", "Z"), event(9, "c", "DECIDE", 40, "RECODE_OUTSIDE_TOPK", "Y")], "cp")
    assert {r.record_id: (r.status, r.selected_code, r.n_decisions) for r in third if not r.alert} == {"d": ("RESOLVED", "", 2), "c": ("RESOLVED", "Y", 2)}
    last = run(spark, tmp_path, [event(10, "e", "ENQUEUE", 200), event(11, "a", "DECIDE", 199.5, "NO_CODE")], "cp") + run(spark, tmp_path, [event(12, "e", "DECIDE", 201, "NO_CODE")], "cp")
    assert not [r for r in last if r.alert]  # c was decided, a had its alert, e was decided in time


def test_stream_equals_the_batch_job(spark, store, tmp_path):
    import random

    rng = random.Random(3)
    events = []
    for i in range(120):
        decide = rng.random() < 0.6
        events.append(event(i, f"r{rng.randint(0, 9)}", "DECIDE" if decide else "ENQUEUE", rng.randint(0, 500) / 1000, rng.choice(review.ACTIONS) if decide else "", f"C{i}" if decide else ""))
    last = {}
    for at in range(0, 120, 40):
        for r in run(spark, tmp_path, events[at : at + 40], "cp2"):
            last[r.record_id] = r
    want = {r.record_id: r for r in review.queue_state(spark.createDataFrame(events, review.EVENT)).collect()}
    assert set(last) == set(want)
    for k, w in want.items():
        g = last[k]
        assert (g.status, g.action, g.selected_code, g.n_decisions, g.created_at, g.updated_at) == (w.status, w.action, w.selected_code, w.n_decisions, w.created_at, w.updated_at)
