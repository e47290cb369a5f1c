"""Purges over many tables: nothing named is left, counts agree, a second run removes nothing; recovery of lost payloads."""

import pytest
from pyspark.sql import functions as F

from quarryline.operators import purge
from quarryline.operators.purge import Table


def world(spark):
    memory = spark.createDataFrame([(f"t{i % 2}", f"u{i % 7}", i) for i in range(100)] + [(None, "u1", 900), ("t1", None, 901)], "tenant_id string, user_id string, n long")
    vectors = spark.createDataFrame([(f"d{i % 20}", f"c{i % 9}", i) for i in range(300)], "document_id string, conv string, n long")
    audit = spark.createDataFrame([(i,) for i in range(5)], "n long")
    tables = {"memory": Table(memory, [("users", ["tenant_id", "user_id"])]), "vectors": Table(vectors, [("documents", ["document_id"]), ("conversations", ["conv"])]), "audit": Table(audit)}
    keys = {
        "users": spark.createDataFrame([("t1", "u1"), ("t1", "u1"), ("t0", "u2"), (None, "u1"), ("t9", "u9")], "a string, b string"),
        "documents": spark.createDataFrame([(f"d{i}",) for i in range(5)], "x string"), "conversations": spark.createDataFrame([("c8",)], "y string"),
    }
    return tables, keys


@pytest.mark.parametrize("most", [100_000, 1])
def test_subjects_are_gone_from_all_tables(spark, monkeypatch, most):
    monkeypatch.setattr(purge, "PLACES", 8)  # most rows share a place with some key: the exact join settles them
    tables, keys = world(spark)
    after, proof = purge.purge(tables, keys, most)
    got = {r["table_name"]: (r["before"], r["removed"], r["after"], r["left"], r["proved"]) for r in proof.collect()}
    gone = lambda r: (r["tenant_id"], r["user_id"]) in {("t1", "u1"), ("t0", "u2")}
    memory = [r for r in tables["memory"].rows.collect() if not gone(r)]
    vectors = [r for r in tables["vectors"].rows.collect() if int(r["document_id"][1:]) >= 5 and r["conv"] != "c8"]
    assert sorted(map(str, after["memory"].collect())) == sorted(map(str, memory))
    assert sorted(map(str, after["vectors"].collect())) == sorted(map(str, vectors))
    assert got == {"memory": (102, 102 - len(memory), len(memory), 0, True), "vectors": (300, 300 - len(vectors), len(vectors), 0, True), "audit": (5, 0, 5, 0, True)}
    again = purge.purge({n: Table(after[n], t.refers) for n, t in tables.items()}, keys, most)[1]
    assert {r["removed"] for r in again.collect()} == {0} and all(r["proved"] for r in again.collect())


def test_a_row_that_is_left_is_no_proof(spark, monkeypatch):
    tables, keys = world(spark)
    monkeypatch.setattr(purge, "without", lambda rows, *a: rows)
    assert {r["table_name"]: r["proved"] for r in purge.purge(tables, keys)[1].collect()} == {"memory": False, "vectors": False, "audit": True}


def test_recovery(spark):
    jobs = spark.createDataFrame(
        [(1, "t", "d1", "ingest", "dead_letter", 3, "payload unavailable: x", "w"), (2, "t", "d2", "ingest", "dead_letter", 3, "payload unavailable", None), (3, "t", "d1", "ingest", "succeeded", 1, None, None),
         (4, "t", "d3", "ingest", "dead_letter", 3, "timeout", None), (5, "other", "d1", "ingest", "dead_letter", 3, "payload unavailable", None)],
        "job_id int, tenant_id string, document_id string, kind string, status string, attempts int, last_error string, locked_by string",
    ).withColumns({"available_at": F.lit("2020-01-01").cast("timestamp"), "locked_at": F.lit(None).cast("timestamp")})
    by_doc = lambda rows: spark.createDataFrame(rows, "document_id string, asset_id string")
    assets = by_doc([("d1", "a1"), ("d1", "a2"), ("d2", "b1"), ("d3", "c1")])
    lineage = spark.createDataFrame([("a2", "a1"), ("b1", "a1"), ("c1", "b1")], "asset_id string, parent_asset_id string")
    tables = {"jobs": jobs, "sources": spark.createDataFrame([("t", "d1"), ("t", "d3")], "tenant_id string, document_id string"), "assets": assets, "lineage": lineage, "states": assets.select("document_id"), "workflows": assets.select("document_id")}
    after = purge.recover(tables, "t", F.lit("2024-01-01").cast("timestamp"))
    state = {r["job_id"]: (r["status"], r["attempts"], r["last_error"], r["locked_by"], r["available_at"].year) for r in after["jobs"].collect()}
    assert state == {1: ("queued", 0, None, None, 2024), 2: ("dead_letter", 3, "payload unavailable", None, 2020), 3: ("succeeded", 1, None, None, 2020), 4: ("dead_letter", 3, "timeout", None, 2020), 5: ("dead_letter", 3, "payload unavailable", None, 2020)}
    assert sorted(r["asset_id"] for r in after["assets"].collect()) == ["b1", "c1"]
    assert [(r["asset_id"], r["parent_asset_id"]) for r in after["lineage"].collect()] == [("c1", "b1")]
    assert {r["document_id"] for r in after["states"].collect()} == {r["document_id"] for r in after["workflows"].collect()} == {"d2", "d3"}
    assert after["sources"].count() == 2
