"""Exact values of governance, jobs, dialog, memory, gateway, streams and the catalog."""

import importlib.util
import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quarryline.operators import changes, dialog, gateway, governance, jobs, memory
from quarryline.sources import stores
from quarryline.streaming import stateful

UTC = dt.timezone.utc


def at(hour, day=1, minute=0):
    return dt.datetime(2024, 1, day, hour, minute, tzinfo=UTC)


def now(hour, day=1):
    return F.lit(f"2024-01-{day:02d} {hour:02d}:00:00").cast("timestamp")


MASKED = {
    "write to josé.b@x.io now": ("write to [REDACTED-EMAIL] now", 1),
    "card 4242 4242 4242 4242 end": ("card [REDACTED-CARD] end", 1),
    "card 1234 5678 9012 3456 end": ("card 1234 5678 9012 3456 end", 0),
    "ssn 123-45-6789": ("ssn [REDACTED-SSN]", 1),
    "nothing": ("nothing", 0),
}


def test_retrieval_masks_check_card_numbers(spark):
    rows = spark.createDataFrame([(t,) for t in MASKED] + [(None,)], "content string").withColumn("t", F.col("content"))
    got = {r["t"]: (r["content"], r["redactions"]) for r in governance.mask_retrieval(rows).collect()}
    assert got.pop(None) == (None, 0)
    assert got["card 4242 4242 4242 4242 end"][0].startswith("card [REDACTED-CARD]")
    for text in MASKED.keys() - {"card 4242 4242 4242 4242 end"}:
        assert got[text] == MASKED[text]


def test_chat_masks(spark):
    rows = spark.createDataFrame([("a@b.co 123-45-6789 4111 1111 1111 1111, (555) 123-4567",)], "content string")
    row = governance.mask_chat(rows).first()
    assert row["redactions"] == 4 and re.findall(r"REDACTED-(\w+)", row["content"]) == ["EMAIL", "SSN", "CARD", "PHONE"]


def test_secrets_and_keys(spark):
    df = spark.createDataFrame([("token abc and abcdef", {"Password": "x", "user": "y"})], "t string, m map<string,string>")
    row = df.select(governance.redact_secrets(F.col("t"), ["abc", "abcdef", ""]).alias("t"), governance.redact_keys(F.col("m")).alias("m")).first()
    assert row["t"] == "token ***redacted*** and ***redacted***" and row["m"] == {"Password": "***redacted***", "user": "y"}


def test_decisions(spark):
    rows = [(["viewer"], "embed", "restricted", "public"), (["viewer", "engineer"], "embed", "internal", "confidential"), (["engineer"], "embed", "confidential", "confidential"), ([], "embed", "restricted", "public"), (["engineer"], "embed", "odd", "public")]
    df = spark.createDataFrame(rows, "roles array<string>, permission string, clearance string, classification string")
    reasons = [r["reason"] for r in governance.decide(df, governance.INGESTION_ROLES).collect()]
    assert reasons == ["role_missing_permission:embed", "insufficient_clearance:internal<confidential", "granted", "role_missing_permission:embed", "insufficient_clearance:odd<public"]
    assert all(r["allowed"] for r in governance.decide(df, {}, enforce=False).collect())
    with pytest.raises(Exception, match="downgrade"):
        df.select(governance.propagated(F.lit("restricted"), F.lit("public"))).collect()


def test_transitions(spark):
    rows = spark.createDataFrame([("r", "registered", 1), ("r", "connecting", 2), ("r", "active", 3)], "k string, state string, ts int")
    wrong = changes.illegal_transitions(changes.transitions(rows, "k"), changes.REPOSITORY_EDGES).collect()
    assert [(r["from_state"], r["to_state"]) for r in wrong] == [("connecting", "active")]
    assert (len(changes.REPOSITORY_EDGES), len(changes.DOCUMENT_EDGES)) == (19, 18)


JOB = "job_id string, document_id string, status string, priority int, attempts int, max_attempts int, available_at timestamp, created_at timestamp, locked_by string, locked_at timestamp, last_error string"


def job(i, status="queued", priority=0, attempts=0, available=at(1), locked=None):
    return (i, i, status, priority, attempts, 3, available, at(0), None, locked, None)


def test_claims_leases_and_retries(spark):
    rows = [job("late", available=at(9)), job("low"), job("high", priority=5), job("stale", "running", locked=at(1)), job("fresh", "running", locked=at(4)), job("done", "succeeded")]
    df = spark.createDataFrame(rows, JOB)
    taken = jobs.claim(df, "w", now(5), 10).collect()
    assert [r["job_id"] for r in taken] == ["high", "low", "stale"] and {r["attempts"] for r in taken} == {1}
    failing = spark.createDataFrame([job("a", "running", attempts=1), job("b", "running", attempts=2), job("c", "running", attempts=3)], JOB).withColumn("error", F.lit("e" * 5000))
    out = {r["job_id"]: r for r in jobs.failed(failing, now(5)).collect()}
    assert [out[k]["status"] for k in "abc"] == ["queued", "queued", "dead_letter"] and len(out["a"]["last_error"]) == 4000
    assert [(out[k]["available_at"].minute, out[k]["available_at"].second) for k in "ab"] == [(0, 30), (1, 0)]
    assert jobs.released(failing, now(6)).where("job_id = 'a'").first()["attempts"] == 0
    assert jobs.cancelled(df).count() == 5 and jobs.requeued(jobs.cancelled(df), now(7)).first()["status"] == "queued"


def test_stage_prefixes(spark):
    done = spark.createDataFrame([("a", "markdown"), ("a", "chunks"), ("b", "intelligence"), *(("c", n) for n, _ in jobs.STAGES)], "document_id string, asset_type string")
    got = {r["document_id"]: (r["completed_stages"], r["status"]) for r in jobs.reconcile(done).collect()}
    assert got["a"] == (["markdown"], "running") and got["b"] == ([], "pending") and got["c"][1] == "completed"


TURNS = "conv_id int, turn int, role string, content string"


def test_kinds_of_turns(spark):
    rows = [
        (1, 0, "user", "Explain billing cycles for enterprise plans"), (1, 1, "assistant", "They are monthly."), (1, 2, "user", "what about annual ones"), (1, 3, "assistant", dialog.CLARIFICATION),
        (1, 4, "user", "billing"), (2, 0, "user", "banana"), (2, 1, "assistant", "?"), (2, 2, "user", "Which enterprise billing plans exist for schools and universities today"), (3, 0, "user", " "),
    ]
    got = {(r["conv_id"], r["turn"]): (r["turn_type"], r["search_query"]) for r in dialog.classify_turns(spark.createDataFrame(rows, TURNS)).collect()}
    assert got[1, 0][0] == "fresh" and got[1, 2] == ("follow_up", "Explain billing cycles for enterprise plans what about annual ones")
    assert got[1, 4][0] == "clarification_reply" and got[2, 0] == ("clarification_needed", "banana") and got[2, 2][0] == "fresh" and got[3, 0][0] is None


def test_history_ends_at_the_first_turn_that_does_not_fit(spark):
    policy = dialog.DialogPolicy(history_turns=4, history_tokens=10)
    rows = [(1, i, "user", t) for i, t in enumerate(["x" * 4, "y" * 400, "z" * 8, " ", "w" * 8])] + [(2, 0, "user", "v" * 4000)]
    kept = dialog.prune_history(spark.createDataFrame(rows, TURNS), policy)
    assert {(r["conv_id"], r["turn"]) for r in kept.collect()} == {(1, 4), (1, 2), (2, 0)}
    assert dialog.rendered_history(kept).where("conv_id = 1").first()["history"] == "User: zzzzzzzz\nUser: wwwwwwww"


def test_sessions_end_at_their_ttl_in_batch_and_stream(spark, tmp_path):
    rows = [(1, "u", at(0)), (2, "u", at(0, minute=59)), (3, "u", at(1, minute=59)), (4, "u", at(2, minute=58)), (5, "v", at(0)), (9, "z", at(23, day=5))]
    df = spark.createDataFrame(rows, "event_id int, user_id string, ts timestamp")
    batch = {(r["user_id"], r["started_at"], r["events"]) for r in dialog.ttl_sessions(df, "user_id").collect()}
    assert sorted(n for u, _, n in batch if u == "u") == [2, 2]
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    query = stateful.sessions(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "user_id").writeStream.format("memory").queryName("s").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    # the last event only moves the watermark on
    assert {(r["user_id"], r["started_at"], r["events"]) for r in spark.table("s").collect()} == {x for x in batch if x[0] != "z"}


MEMORY = "memory_id string, tenant_id string, scope string, content string, memory_type string, topic string, tags array<string>, confidence double, status string, conversation_id string, user_id string, retrieval_count int, created_at timestamp, expires_at timestamp, related_memories array<string>, position int"


def item(i, content="likes tea", confidence=0.9, created=at(0), scope="user", related=(), topic="drinks"):
    return (i, "t", scope, content, "fact", topic, ["Tea"], confidence, "active", "c1", "u", 0, created, None, list(related), int(i))


def test_recall_scores(spark):
    items = spark.createDataFrame([item("1"), item("2", "other words", created=at(0, day=2)), item("3", confidence=0.4)], MEMORY)
    rows = memory.recall(items, spark.createDataFrame([("q", "t", "tea please")], "query_id string, tenant_id string, query string"), now(0, day=2)).orderBy("rank").collect()
    assert [r["memory_id"] for r in rows] == ["2", "1"]
    assert rows[1]["score"] == pytest.approx(0.4 * 0.5 + 0.2 * 0.5 + 0.15 * 0.8 + 0.15 * 0.9)
    assert memory.counted(items, memory.recall(items, spark.createDataFrame([("q", "t", "tea")], "query_id string, tenant_id string, query string"), now(0, day=2))).agg(F.sum("retrieval_count")).first()[0] == 2


def test_duplicates_summaries_and_routes(spark):
    items = spark.createDataFrame([item("1", "Tea", 0.5, related=["a"]), item("2", " tea ", 0.7, related=["b", "a"]), item("3", "TEA", 0.7), item("4", "One. Two", scope="session", topic="")], MEMORY)
    best = {r["content"]: (r["memory_id"], r["related_memories"], r["merged_from"]) for r in memory.consolidate_duplicates(items, "tenant_id").collect()}
    assert best[" tea "] == ("2", ["a", "b"], 3)
    assert memory.summarize(items, "tenant_id").first()["summary"] == "Summary of 4 memories on drinks: Tea; tea; TEA; One"
    assert memory.summarize(items, "tenant_id", "abstract").first()["summary"] == "Consolidated 4 memories on drinks."
    insights, after = memory.consolidate_conversations(items)
    assert insights.first()["memories"] == 1 and after.where("status = 'archived'").count() == 1
    assert [tuple(r[0]) for r in spark.createDataFrame([("mixed",), ("unknown",)], "s string").select(memory.routing(F.col("s"))).collect()] == [(True, True, "knowledge"), (False, False, "none")]


def test_order_of_tasks_and_cycles(spark):
    kind = "plan_id string, task_id string, priority int, dependencies array<string>"
    tasks = spark.createDataFrame([("p", "c", 1, ["a", "b"]), ("p", "a", 3, []), ("p", "b", 2, ["missing"]), ("p", "d", 9, ["c"])], kind)
    assert [r["task_id"] for r in gateway.topological_order(tasks).orderBy("position").collect()] == ["b", "a", "c", "d"]
    with pytest.raises(Exception, match="cycle"):
        gateway.topological_order(spark.createDataFrame([("p", "a", 1, ["b"]), ("p", "b", 1, ["a"])], kind)).collect()


def test_a_plan_of_many_tasks(spark):
    kind = "plan_id string, task_id string, priority int, dependencies array<string>"
    chain = [("p", f"t{i:02d}", 40 - i, [f"t{i - 1:02d}"] if i else []) for i in range(40)]
    assert [r["task_id"] for r in gateway.topological_order(spark.createDataFrame(chain, kind)).orderBy("position").collect()] == [t[1] for t in chain]


def test_selections_of_jobs_and_documents(spark):
    kind = "job_id long, tenant_id string, document_id string, kind string, status string, last_error string"
    rows = spark.createDataFrame([(1, "a", "d", "ingest", "failed", None), (2, "a", "d", "ingest", "queued", "x"), (3, "a", "e", "ingest", "dead_letter", "missing_chunks"), (4, "b", "d", "ingest", "dead_letter", "missing_chunks")], kind)
    ids = lambda df: sorted(r["job_id"] for r in df.collect())
    assert (ids(jobs.to_requeue(rows, "a")), ids(jobs.to_requeue(rows, "a", document_id="d")), ids(jobs.to_requeue(rows, "a", job_id=2)), ids(jobs.to_requeue(rows, "a", job_id=4))) == ([1, 3], [1, 2], [2], [])
    lost = jobs.lost_payloads(rows, spark.createDataFrame([("b", "e")] * 2, "tenant_id string, document_id string"), "a")
    assert [(r["job_id"], r["recoverable"]) for r in lost.collect()] == [(3, False)]


def test_a_breaker_half_opens(spark):
    rows = [(i, "k", f"2024-01-01 00:00:{s:02d}", ok) for i, (s, ok) in enumerate([(0, False), (1, False), (2, False), (40, False), (41, True), (42, True)])]
    calls = spark.createDataFrame(rows, "event_id int, key string, t string, ok boolean").withColumn("ts", F.col("t").cast("timestamp"))
    assert [r["met"] for r in jobs.breaker_states(calls, "key", 2).orderBy("event_id").collect()] == ["closed", "closed", "open", "half_open", "open", "closed"]


def test_plans_and_echo(spark):
    tasks = gateway.plan_tasks(spark.createDataFrame([("p", "Fetch data and get approval"), ("q", "hum"), ("r", " ")], "plan_id string, objective string"))
    assert [(r["plan_id"], r["capability"]) for r in tasks.orderBy("plan_id", "priority").collect()] == [("p", "sql_querying"), ("p", "reasoning"), ("q", "reasoning")]
    assert {r["plan_id"]: (r["strategy"], r["completed_tasks"]) for r in gateway.plan_strategy(tasks).collect()} == {"p": ("conditional", 1), "q": ("sequential", 1)}
    said = spark.createDataFrame([("Context\nUser request: do it\n\nRespond",), ("only\nlast ",), ("",)], "t string").select(gateway.echo(F.col("t"))).collect()
    assert [r[0].split(": ", 1)[1] for r in said] == ["do it", "last", ""]


def test_event_log_round_trip(spark, tmp_path):
    schema = "stage string, tenant_id string, detail map<string,string>"
    stores.append_events(spark.createDataFrame([("sync", "a", {"k": "v"}), ("sync", "b", {})], schema), str(tmp_path / "log"))
    assert stores.read_events(spark, str(tmp_path / "log"), schema, "a").first()["detail"] == {"k": "v"}


def test_streams(spark, tmp_path):
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "a.md").write_text("x")
    (tmp_path / "files" / "b.tmp").write_text("y")
    query = stateful.arriving_files(spark, str(tmp_path / "files")).writeStream.format("memory").queryName("f").start()
    query.processAllAvailable()
    query.stop()
    assert [r["source_path"].rsplit("/", 1)[1] for r in spark.table("f").collect()] == ["a.md"]


def test_catalog_names_agree():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 90
    if importlib.util.find_spec("corpus_pipeline"):
        assert "pipeline" in queries and sum(n.startswith("op") for n in queries) == 13
