"""Typed events: all types pass, each kind of fault is told, repeats count once, streams and batches agree."""

import json
from datetime import datetime

from quarryline.sources import event_log
from quarryline.streaming import stateful

RAW = "log string, event_id string, body string, received timestamp"
T0 = datetime(2024, 1, 1)


def good(log, kind, **more):
    subject = {event_log.SUBJECTS[log]: "s1"} if event_log.SUBJECTS[log] else {}
    return json.dumps({"event_type": kind, "tenant_id": "t", "correlation_id": "c", "timestamp": "2024-02-03T04:05:06Z", **subject, **more})


def test_every_type_of_every_log(spark):
    rows = [(log, f"{log}-{i}", good(log, kind, version=3, detail="d"), T0) for log, names in event_log.EVENT_TYPES.items() for i, kind in enumerate(names.split())]
    got = event_log.checked(spark.createDataFrame(rows, RAW)).collect()
    assert len(got) == 74 and {r["reason"] for r in got} == {None}
    assert {(r["at"], r["version"], r["detail"], r["tenant_id"]) for r in got} == {(datetime(2024, 2, 3, 4, 5, 6), 3, "d", "t")}
    assert {r["subject"] for r in got if r["log"] != "platform"} == {"s1"}


def test_faults(spark):
    cases = {
        "bad_json": ("sync", "{"), "unknown_log": ("elsewhere", good("sync", "DocumentMoved")), "missing_type": ("sync", '{"tenant_id": "t"}'), "unknown_type": ("sync", good("sync", "ChunksGenerated")),
        "missing_tenant": ("sync", good("sync", "DocumentMoved", tenant_id="")), "missing_subject": ("chunking", good("chunking", "AssetStored", document_id=None)),
        "missing_correlation": ("orchestration", good("orchestration", "StageFailed", correlation_id=None)), "bad_timestamp": ("sync", good("sync", "DocumentMoved", timestamp="yesterday")), "bad_version": ("sync", good("sync", "DocumentMoved", version="three")),
    }
    rows = [(log, why, body, T0) for why, (log, body) in cases.items()] + [(None, "unknown_log", "{}", T0), ("sync", "bad_json", None, T0), ("conversation", None, good("conversation", "agent_invoked", detail={"a": "b"}), T0)]
    got = event_log.checked(spark.createDataFrame(rows, RAW)).collect()
    assert all(r["reason"] == r["event_id"] for r in got if r["log"] != "conversation")
    last = next(r for r in got if r["log"] == "conversation")
    assert last["reason"] is None and last["detail"] == '{"a":"b"}' and len(last["event_id"]) == 64
    assert {r["body"] for r in got} == {r[2] for r in rows}


def test_repeats_and_streams(spark, tmp_path):
    body = good("sync", "DocumentMoved")
    rows = [("sync", "e1", body, T0), ("sync", "e1", good("sync", "DocumentDeleted"), T0.replace(hour=1)), ("chunking", "e1", good("chunking", "AssetStored"), T0), ("sync", "e2", body, T0), ("sync", "e2", body, T0)]
    df = spark.createDataFrame(rows, RAW)
    once = sorted((r["log"], r["event_id"], r["event_type"]) for r in event_log.once(event_log.checked(df)).collect())
    assert once == [("chunking", "e1", "AssetStored"), ("sync", "e1", "DocumentMoved"), ("sync", "e2", "DocumentMoved")]
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = stateful.distinct_arrivals(event_log.checked(spark.readStream.schema(RAW).parquet(str(tmp_path / "in"))), ["log", "event_id"], "received")
    stream.writeStream.format("memory").queryName("typed_events").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination()
    assert sorted((r["log"], r["event_id"], r["event_type"]) for r in spark.table("typed_events").collect()) == once
