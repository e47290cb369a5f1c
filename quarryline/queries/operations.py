"""Jobs, boards, state machines, access, metrics, models and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import changes, concurrency, evaluation, gateway, governance, jobs, purge, search
from quarryline.queries.common import CORPUS_SQL, DIMENSION, Registry, corpus, documents, events, lit_ts, table
from quarryline.sources import event_log

R = Registry()

NOW = "2024-01-20 00:00:00"
STATUSES = ["queued", "running", "succeeded", "dead_letter", "cancelled", "queued"]


def job_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ingestion jobs, made of their numbers."""
    pick = F.get(F.array(*map(F.lit, STATUSES)), (F.col("event_id") % 6).cast("int"))
    return events(spark, sf_dir).select(
        F.col("event_id").alias("job_id"), F.concat(F.lit("tenant-"), (F.col("user_id") % 3).cast("string")).alias("tenant_id"), F.col("user_id").cast("string").alias("document_id"),
        F.lit("ingest").alias("kind"), pick.alias("status"), F.col("event_type").alias("content_hash"), (F.col("event_id") % 3).cast("int").alias("priority"),
        (F.col("event_id") % 4).cast("int").alias("attempts"), F.lit(3).alias("max_attempts"), (F.col("ts") + jobs.seconds((F.col("event_id") % 7 * 3600).cast("decimal(18,6)"))).alias("available_at"),
        F.lit(None).cast("string").alias("locked_by"), F.when(pick == "running", F.col("ts")).alias("locked_at"), F.col("ts").alias("created_at"), F.lit(None).cast("string").alias("last_error"),
    )


JOBS_SQL = f"""jobs AS (
  SELECT event_id AS job_id, 'tenant-' || (user_id % 3) AS tenant_id, user_id::VARCHAR AS document_id, {STATUSES}[event_id % 6 + 1] AS status, event_type AS content_hash, event_id % 3 AS priority, event_id % 4 AS attempts, 3 AS max_attempts,
         ts + to_hours((event_id % 7)::INT) AS available_at, CASE WHEN event_id % 6 = 1 THEN ts END AS locked_at, ts AS created_at FROM events)"""


@R.add(f"""WITH {JOBS_SQL} SELECT job_id, 'running' AS status, attempts + 1 AS attempts, 'w1' AS locked_by FROM jobs
WHERE available_at <= TIMESTAMP '{NOW}' AND (status = 'queued' OR (status = 'running' AND locked_at < TIMESTAMP '{NOW}' - INTERVAL 1 HOUR)) ORDER BY priority DESC, available_at, created_at, job_id LIMIT 25""")
def job_claim(spark, sf_dir):
    return jobs.claim(job_rows(spark, sf_dir), "w1", lit_ts(NOW), 25).select("job_id", "status", "attempts", "locked_by")


@R.add(f"""WITH {JOBS_SQL} SELECT job_id, CASE WHEN attempts >= 3 THEN 'dead_letter' ELSE 'queued' END AS status,
  CASE WHEN attempts >= 3 THEN epoch_us(available_at) ELSE epoch_us(TIMESTAMP '{NOW}') + (least(30 * power(2, greatest(attempts - 1, 0)), 900) * 1000000)::BIGINT END AS available_us FROM jobs WHERE status = 'running'""")
def job_backoff(spark, sf_dir):
    rows = job_rows(spark, sf_dir).where("status = 'running'").withColumn("error", F.lit("timeout"))
    return jobs.failed(rows, lit_ts(NOW)).select("job_id", "status", F.unix_micros("available_at").alias("available_us"))


@R.add(f"""WITH {JOBS_SQL}, incoming AS (SELECT 1000000 + user_id % 40 * 10 + k AS job_id, 'tenant-' || (user_id % 40 % 3) AS tenant_id, (user_id % 40)::VARCHAR AS document_id, ['click', 'fresh'][k + 1] AS content_hash FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest([0, 1]) AS k)),
f AS (SELECT tenant_id, document_id, content_hash, min(job_id) AS job_id FROM incoming GROUP BY ALL)
SELECT job_id, document_id, content_hash FROM f ANTI JOIN (SELECT * FROM jobs WHERE status IN ('queued', 'running')) USING (tenant_id, document_id, content_hash)""")
def job_enqueue(spark, sf_dir):
    users = table(spark, sf_dir, "events").select("user_id").distinct().withColumn("u", F.col("user_id") % 40)
    incoming = users.select("u", F.posexplode(F.array(F.lit("click"), F.lit("fresh"))).alias("k", "content_hash")).select(
        F.concat(F.lit("tenant-"), (F.col("u") % 3).cast("string")).alias("tenant_id"), F.col("u").cast("string").alias("document_id"), F.lit("ingest").alias("kind"), "content_hash", (F.lit(1000000) + F.col("u") * 10 + F.col("k")).alias("job_id")
    )
    return jobs.enqueue(job_rows(spark, sf_dir), incoming).select("job_id", "document_id", "content_hash")


@R.add(f"WITH {JOBS_SQL} SELECT document_id, arg_max(job_id, (created_at, job_id)) AS job_id, arg_max(status, (created_at, job_id)) AS status FROM jobs GROUP BY 1")
def latest_jobs(spark, sf_dir):
    rows = changes.latest(job_rows(spark, sf_dir), ["document_id"], F.col("created_at"), F.col("job_id"))
    return rows.select("document_id", "job_id", "status")


@R.add(f"WITH {JOBS_SQL} SELECT job_id, document_id, status, attempts FROM jobs WHERE tenant_id = 'tenant-1' AND status IN ('dead_letter', 'failed')")
def requeue_selection(spark, sf_dir):
    return jobs.to_requeue(job_rows(spark, sf_dir), "tenant-1").select("job_id", "document_id", "status", "attempts")


@R.add(f"""WITH {JOBS_SQL}, sources AS (SELECT DISTINCT user_id::VARCHAR AS document_id FROM events WHERE user_id % 5 > 1),
e AS (SELECT *, ['timeout', 'stage failed: missing_markdown', 'payload unavailable', NULL, 'missing_chunks in asset'][job_id % 5 + 1] AS last_error FROM jobs)
SELECT job_id, document_id, document_id IN (SELECT document_id FROM sources) AS recoverable FROM e
WHERE tenant_id = 'tenant-2' AND status = 'dead_letter' AND (contains(last_error, 'payload unavailable') OR contains(last_error, 'missing_markdown') OR contains(last_error, 'missing_chunks'))""")
def lost_payload_recovery(spark, sf_dir):
    errors = F.array(F.lit("timeout"), F.lit("stage failed: missing_markdown"), F.lit("payload unavailable"), F.lit(None).cast("string"), F.lit("missing_chunks in asset"))
    rows = job_rows(spark, sf_dir).withColumn("last_error", F.get(errors, (F.col("job_id") % 5).cast("int")))
    sources = rows.where(F.col("document_id").cast("long") % 5 > 1).select("tenant_id", "document_id")
    return jobs.lost_payloads(rows, sources, "tenant-2").select("job_id", "document_id", "recoverable")


@R.add(f"""WITH {JOBS_SQL}, sources AS (SELECT DISTINCT user_id::VARCHAR AS document_id FROM events WHERE user_id % 5 > 1),
e AS (SELECT *, ['timeout', 'stage failed: missing_markdown', 'payload unavailable', NULL, 'missing_chunks in asset'][job_id % 5 + 1] AS last_error FROM jobs),
back AS (
  SELECT job_id, document_id FROM e WHERE tenant_id = 'tenant-2' AND status = 'dead_letter' AND document_id IN (SELECT document_id FROM sources)
  AND (contains(last_error, 'payload unavailable') OR contains(last_error, 'missing_markdown') OR contains(last_error, 'missing_chunks'))),
doomed AS (SELECT DISTINCT document_id FROM back),
assets AS (SELECT DISTINCT user_id AS u, user_id::VARCHAR AS document_id FROM events)
SELECT 'jobs queued again' AS what, count(*) AS n FROM e WHERE job_id IN (SELECT job_id FROM back)
UNION ALL SELECT 'jobs dead', count(*) FROM e WHERE status = 'dead_letter' AND job_id NOT IN (SELECT job_id FROM back)
UNION ALL SELECT 'assets', count(*) FROM assets WHERE document_id NOT IN (SELECT document_id FROM doomed)
UNION ALL SELECT 'lineage', count(*) FROM assets WHERE document_id NOT IN (SELECT document_id FROM doomed) AND (u + 1)::VARCHAR NOT IN (SELECT document_id FROM doomed)""")
def lost_payload_reset(spark, sf_dir):
    """Documents with a lost payload cleared and queued again; a user is a document with one asset, which comes from the next user's."""
    errors = F.array(F.lit("timeout"), F.lit("stage failed: missing_markdown"), F.lit("payload unavailable"), F.lit(None).cast("string"), F.lit("missing_chunks in asset"))
    rows = job_rows(spark, sf_dir).withColumn("last_error", F.get(errors, (F.col("job_id") % 5).cast("int")))
    sources = rows.where(F.col("document_id").cast("long") % 5 > 1).select("tenant_id", "document_id")
    assets = events(spark, sf_dir).select("user_id").distinct().select(F.col("user_id").cast("string").alias("document_id"), F.col("user_id").cast("string").alias("asset_id"))
    lineage = assets.select("asset_id", (F.col("asset_id").cast("long") + 1).cast("string").alias("parent_asset_id"))
    tables = {"jobs": rows, "sources": sources, "assets": assets, "lineage": lineage, "states": assets.select("document_id"), "workflows": assets.select("document_id")}
    after = purge.recover(tables, "tenant-2", lit_ts(NOW))
    count = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    back = after["jobs"].where((F.col("status") == "queued") & (F.col("attempts") == 0) & (F.col("available_at") == lit_ts(NOW)))
    out = count(back, "jobs queued again").unionByName(count(after["jobs"].where("status = 'dead_letter'"), "jobs dead"))
    return out.unionByName(count(after["assets"], "assets")).unionByName(count(after["lineage"], "lineage"))


@R.add("""WITH t AS (
  SELECT 'activity' AS table_name, user_id % 11 = 3 AS gone FROM events
  UNION ALL SELECT 'messages', conv_id % 11 = 3 FROM conversations
  UNION ALL SELECT 'documents', doc_id % 11 = 3 FROM documents
  UNION ALL SELECT 'vectors', (vec_id % 11 = 3 AND vec_id IN (SELECT doc_id FROM documents)) OR vec_id % 1000 = 7 FROM embeddings)
SELECT table_name, count(*) AS before, count(*) FILTER (WHERE gone) AS removed, count(*) FILTER (WHERE NOT gone) AS after, 0::BIGINT AS "left", true AS proved FROM t GROUP BY 1""")
def purge_proof(spark, sf_dir):
    """Every eleventh user's rows removed from four tables; documents, conversations and vectors have their owner's remainder."""
    numbers = lambda name, column: table(spark, sf_dir, name).select(F.col(column).alias("id"))
    of = lambda df: df.where("id % 11 = 3").distinct()
    keys = {"users": of(numbers("events", "user_id")), "conversations": of(numbers("conversations", "conv_id")), "documents": of(numbers("documents", "doc_id")), "vectors": numbers("embeddings", "vec_id").where("id % 1000 = 7")}
    tables = {
        "activity": purge.Table(events(spark, sf_dir).select("event_id", "user_id"), [("users", ["user_id"])]),
        "messages": purge.Table(table(spark, sf_dir, "conversations").select("conv_id", "turn"), [("conversations", ["conv_id"])]),
        "documents": purge.Table(table(spark, sf_dir, "documents").select("doc_id"), [("documents", ["doc_id"])]),
        "vectors": purge.Table(table(spark, sf_dir, "embeddings").select("vec_id", "label"), [("documents", ["vec_id"]), ("vectors", ["vec_id"])]),
    }
    return purge.purge(tables, keys)[1]


ASSETS = [name for name, _ in jobs.STAGES]


def board_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Users as documents and the stages that they have got to."""
    e = events(spark, sf_dir)
    docs = e.groupBy("user_id").agg(F.max("ts").alias("updated_at")).select(
        F.col("user_id").cast("string").alias("document_id"), F.concat(F.lit("docs/"), F.col("user_id").cast("string"), F.lit(".md")).alias("source_path"),
        F.when(F.col("user_id") % 17 == 0, "deleted").otherwise("active").alias("status"), "updated_at",
    )
    stage = F.get(F.array(*map(F.lit, ASSETS)), (F.col("event_id") % 5).cast("int"))
    assets = e.where("(user_id % 3 = 0 OR event_id % 5 < 2) AND user_id % 4 > 0").select(F.col("user_id").cast("string").alias("document_id"), stage.alias("asset_type"), F.col("ts").alias("created_at"))
    return docs, assets


BOARD_SQL = f"""{JOBS_SQL},
docs AS (SELECT user_id::VARCHAR AS document_id, CASE WHEN user_id % 17 = 0 THEN 'deleted' ELSE 'active' END AS status, max(ts) AS updated_at FROM events GROUP BY user_id),
assets AS (SELECT user_id::VARCHAR AS document_id, {ASSETS}[event_id % 5 + 1] AS asset_type, ts AS created_at FROM events WHERE (user_id % 3 = 0 OR event_id % 5 < 2) AND user_id % 4 > 0),
made AS (SELECT document_id, list(DISTINCT asset_type) AS stages, max(created_at) AS last_asset FROM assets GROUP BY 1),
newest AS (SELECT document_id, arg_max({{'s': status, 'a': attempts, 'p': priority, 'v': available_at, 'c': created_at}}, (created_at, job_id)) AS job FROM jobs GROUP BY 1),
b AS (SELECT d.document_id, coalesce(len(stages), 0) AS done, coalesce(stages, []) AS stages, job, updated_at, last_asset,
  CASE WHEN d.status = 'deleted' THEN 'deleted' WHEN coalesce(len(stages), 0) = 5 THEN 'complete' WHEN job.s = 'dead_letter' THEN 'dead_letter' WHEN job.s = 'running' THEN 'running'
       WHEN coalesce(len(stages), 0) > 0 AND job.s IS NULL THEN 'running' WHEN coalesce(len(stages), 0) > 0 THEN 'waiting' ELSE 'queued' END AS board_status
  FROM docs d LEFT JOIN made USING (document_id) LEFT JOIN newest USING (document_id)),
board AS (SELECT *, CASE WHEN job.s = 'queued' THEN row_number() OVER (PARTITION BY coalesce(job.s = 'queued', false) ORDER BY job.p DESC, job.v, job.c, document_id) END AS line_no,
  row_number() OVER (ORDER BY list_position(['dead_letter', 'running', 'waiting', 'queued', 'complete', 'deleted'], board_status), coalesce(last_asset, updated_at) DESC, document_id) AS position FROM b)"""


@R.add(f"""WITH {BOARD_SQL} SELECT document_id, board_status, done AS stages_done, line_no, position,
  CASE WHEN job.s = 'queued' THEN greatest(0, (epoch_us(job.v) - epoch_us(TIMESTAMP '{NOW}')) // 1000000) END AS defer_seconds,
  (CASE WHEN list_contains(stages, 'markdown') THEN 'T' ELSE '.' END) || (CASE WHEN list_contains(stages, 'intelligence') THEN 'I' ELSE '.' END) || (CASE WHEN list_contains(stages, 'chunks') THEN 'C' ELSE '.' END)
  || (CASE WHEN list_contains(stages, 'embedding') THEN 'E' ELSE '.' END) || (CASE WHEN list_contains(stages, 'vector') THEN 'P' ELSE '.' END) AS marks FROM board""")
def job_status_board(spark, sf_dir):
    docs, assets = board_tables(spark, sf_dir)
    board = jobs.status_board(docs, assets, job_rows(spark, sf_dir), lit_ts(NOW), newest=None)
    return board.select("document_id", "board_status", "stages_done", "line_no", "position", "defer_seconds", "marks")


@R.add(f"WITH {BOARD_SQL} SELECT board_status, count(*) AS n FROM board GROUP BY 1")
def board_counts(spark, sf_dir):
    docs, assets = board_tables(spark, sf_dir)
    return jobs.board_counts(jobs.board_rows(docs, assets, job_rows(spark, sf_dir), lit_ts(NOW)))


@R.add(f"""WITH {BOARD_SQL}, p AS (SELECT document_id, list_position([list_contains(stages, s) FOR s IN {ASSETS}], false) AS gap FROM made)
SELECT document_id, (CASE WHEN coalesce(gap, 0) = 0 THEN 5 ELSE gap - 1 END)::BIGINT AS completed, CASE WHEN coalesce(gap, 0) = 0 THEN 'completed' WHEN gap > 1 THEN 'running' ELSE 'pending' END AS status FROM p""")
def stage_reconcile(spark, sf_dir):
    _, assets = board_tables(spark, sf_dir)
    return jobs.reconcile(assets).select("document_id", F.size("completed_stages").alias("completed"), "status")


@R.add("""WITH p AS (SELECT user_id::VARCHAR AS document_id, event_type AS stage, arg_max(event_id % 50, (ts, event_id % 50)) AS processed, arg_max(30 + user_id % 10, (ts, event_id % 50)) AS total FROM events GROUP BY ALL)
SELECT document_id, stage, processed, total, CASE WHEN processed >= total THEN 'completed' ELSE 'running' END AS status FROM p""")
def stage_progress(spark, sf_dir):
    rows = events(spark, sf_dir).select(F.col("user_id").cast("string").alias("document_id"), F.col("event_type").alias("stage"), (F.col("event_id") % 50).alias("processed"), (F.lit(30) + F.col("user_id") % 10).alias("total"), "ts")
    return jobs.stage_progress(rows)


@R.add("""WITH r AS (SELECT CASE WHEN user_id % 3 = 0 THEN 'hot' ELSE 'tenant-' || (user_id % 7) END AS tenant, epoch_us(ts) AS b, epoch_us(ts) + (event_id % 14400 + 1) * 1000000 AS e FROM events),
m AS (SELECT tenant, t, sum(d) AS d FROM (SELECT tenant, b AS t, 1 AS d FROM r UNION ALL SELECT tenant, e, -1 FROM r) GROUP BY ALL HAVING sum(d) <> 0),
s AS (SELECT tenant, t, sum(d) OVER w AS active, lead(t) OVER w AS until FROM m WINDOW w AS (PARTITION BY tenant ORDER BY t))
SELECT tenant AS tenant_id, max(active)::BIGINT AS peak, arg_min(t, (-active, t)) AS peak_at, coalesce(sum(until - t) FILTER (WHERE active > 4), 0)::BIGINT AS over_micros, count(*) FILTER (WHERE active > 4) AS over_spells FROM s GROUP BY 1""")
def tenant_pressure(spark, sf_dir):
    """Events as requests of up to four hours; a third of them are one tenant's."""
    tenant = F.when(F.col("user_id") % 3 == 0, "hot").otherwise(F.concat(F.lit("tenant-"), (F.col("user_id") % 7).cast("string")))
    length = jobs.seconds((F.col("event_id") % 14400 + 1).cast("decimal(18,6)"))
    rows = events(spark, sf_dir).select(tenant.alias("tenant_id"), F.col("ts").alias("begun"), (F.col("ts") + length).alias("ended"))
    return concurrency.pressure(rows, 4).withColumnRenamed("tenant", "tenant_id")


@R.add("""WITH c AS (SELECT user_id, event_id, ts, event_type <> 'error' AS ok, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events),
s AS (SELECT user_id, event_id, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS failures FROM c)
SELECT user_id, max(failures)::BIGINT AS most_failures, count(*) FILTER (WHERE failures = 3) AS openings FROM s GROUP BY 1""")
def circuit_breaker(spark, sf_dir):
    calls = events(spark, sf_dir).withColumn("ok", F.col("event_type") != "error")
    rows = jobs.breaker_states(calls, "user_id", 3)
    return rows.groupBy("user_id").agg(F.max("failures_in_row").alias("most_failures"), F.count_if("opens").alias("openings"))


@R.add("""WITH c AS (SELECT user_id, event_id, ts, event_type <> 'error' AS ok, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events),
s AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS failures FROM c),
l AS (SELECT *, lag(failures) OVER w AS before, lag(ts) OVER w AS last FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT met, count(*) AS calls, count(*) FILTER (WHERE ok) AS good FROM (SELECT ok, CASE WHEN before IS NULL OR before < 2 THEN 'closed' WHEN epoch_us(ts) - epoch_us(last) >= 86400000000 THEN 'half_open' ELSE 'open' END AS met FROM l) GROUP BY 1""")
def breaker_probes(spark, sf_dir):
    calls = events(spark, sf_dir).withColumn("ok", F.col("event_type") != "error")
    return jobs.breaker_states(calls, "user_id", 2, 86400.0).groupBy("met").agg(F.count("*").alias("calls"), F.count_if("ok").alias("good"))


# --- state machines -------------------------------------------------------------------------

STATES = ["registered", "connecting", "discovering", "synchronizing", "active"]


@R.add(f"""WITH s AS (SELECT user_id, event_id, {STATES}[(event_id * 7 + user_id) % 5 + 1] AS state FROM events),
m AS (SELECT user_id, lag(state) OVER (PARTITION BY user_id ORDER BY event_id) AS from_state, state AS to_state FROM s),
edges AS (SELECT unnest({[list(e) for e in changes.REPOSITORY_EDGES]}) AS e)
SELECT from_state, to_state, count(*) AS n FROM m WHERE from_state IS NOT NULL AND NOT EXISTS (SELECT 1 FROM edges WHERE e[1] = from_state AND e[2] = to_state) GROUP BY ALL""")
def state_violations(spark, sf_dir):
    state = F.get(F.array(*map(F.lit, STATES)), ((F.col("event_id") * 7 + F.col("user_id")) % 5).cast("int"))
    history = table(spark, sf_dir, "events").select("user_id", "event_id", state.alias("state"))
    wrong = changes.illegal_transitions(changes.transitions(history, "user_id", order="event_id"), changes.REPOSITORY_EDGES)
    return wrong.groupBy("from_state", "to_state").agg(F.count("*").alias("n"))


@R.add("""WITH v AS (SELECT user_id, event_id // 2 AS version FROM events), c AS (SELECT user_id, version, count(*) AS writes FROM v GROUP BY ALL)
SELECT user_id, version, writes FROM (SELECT *, lag(version) OVER (PARTITION BY user_id ORDER BY version) AS before FROM c) WHERE writes > 1 OR before + 1 <> version""")
def version_conflicts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.expr("event_id div 2").alias("version"))
    return changes.version_conflicts(rows, "user_id").select("user_id", "version", "writes")


# --- access ------------------------------------------------------------------------------------

ROLES = ["viewer", "engineer", "data_scientist", "service_worker", "nobody"]
PERMISSIONS = ["read_workflow", "embed", "manage_plugins", "ingest_document"]
GRANTED_SQL = "map {" + ", ".join(f"'{r}': {p}" for r, p in governance.INGESTION_ROLES.items()) + ", 'nobody': []::VARCHAR[]}"


@R.add(f"""WITH r AS (SELECT doc_id, {ROLES}[doc_id % 5 + 1] AS role, {PERMISSIONS}[doc_id // 5 % 4 + 1] AS permission, {search.CLEARANCES}[doc_id // 3 % 5 + 1] AS clearance, doc_id // 3 % 5 AS held, {search.CLEARANCES}[doc_id // 7 % 5 + 1] AS classification, doc_id // 7 % 5 AS needed FROM documents),
d AS (SELECT *, CASE WHEN NOT list_contains(map_extract_value({GRANTED_SQL}, role), permission) THEN 'role_missing_permission:' || permission WHEN held < needed THEN 'insufficient_clearance:' || clearance || '<' || classification ELSE 'granted' END AS reason FROM r)
SELECT reason, reason = 'granted' AS allowed, count(*) AS n FROM d GROUP BY ALL""")
def rbac_abac(spark, sf_dir):
    pick = lambda values, by: F.get(F.array(*map(F.lit, values)), by.cast("int"))
    rows = table(spark, sf_dir, "documents").select(
        F.array(pick(ROLES, F.expr("doc_id % 5"))).alias("roles"), pick(PERMISSIONS, F.expr("doc_id div 5 % 4")).alias("permission"),
        pick(search.CLEARANCES, F.expr("doc_id div 3 % 5")).alias("clearance"), pick(search.CLEARANCES, F.expr("doc_id div 7 % 5")).alias("classification"),
    )
    return governance.decide(rows, governance.INGESTION_ROLES).groupBy("reason", "allowed").agg(F.count("*").alias("n"))


@R.add("""SELECT event_type, count(*) AS n FROM events WHERE user_id % 5 IN (1, 3) GROUP BY 1""")
def stage_guard(spark, sf_dir):
    """What may enter the embedding stage: roles that hold its permission."""
    roles = F.array(F.get(F.array(*map(F.lit, ("viewer", "engineer", "nobody", "data_scientist", "viewer"))), (F.col("user_id") % 5).cast("int")))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("document_id"), "event_type", roles.alias("roles"), F.lit("restricted").alias("clearance"), F.lit("internal").alias("classification"))
    passed, _ = governance.guard_stage(rows, "embed")
    return passed.groupBy("event_type").agg(F.count("*").alias("n"))


@R.add("""WITH e AS (SELECT user_id AS trace_id, ['query_understanding', 'vector', 'ranking', 'assembly'][event_id % 4 + 1] AS stage, sum((value * 100)::BIGINT) AS ms FROM events GROUP BY ALL)
SELECT trace_id, (sum(ms) / 100)::DOUBLE AS total_ms, sum(ms) / 100 > 500 AS over_budget, array_to_string(list_sort(list(stage) FILTER (WHERE ms / 100 > map_extract_value(map {'query_understanding': 20, 'vector': 150, 'ranking': 100, 'assembly': 50}, stage))), ',') AS breaches FROM e GROUP BY 1""")
def trace_budget(spark, sf_dir):
    stage = F.get(F.array(*map(F.lit, governance.BUDGETS_MS)), (F.col("event_id") % 4).cast("int"))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("trace_id"), stage.alias("stage"), (F.round(F.col("value") * 100).cast("decimal(18,0)") / 100).cast("decimal(18,2)").alias("ms"))
    out = governance.trace_summary(rows)
    return out.select("trace_id", F.col("total_ms").cast("double").alias("total_ms"), "over_budget", F.coalesce(F.array_join("breaches", ","), F.lit("")).alias("breaches"))


# --- metrics -------------------------------------------------------------------------------------

EVAL_SQL = f"""{CORPUS_SQL},
q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v, label FROM embeddings WHERE vec_id % 50 = 0),
res AS (SELECT query_id, doc_id AS item_id, row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(vector, v) DESC, document_id, chunk_id) AS rank FROM corpus, q WHERE vector IS NOT NULL AND list_cosine_similarity(vector, v) > 0 QUALIFY rank <= 20),
rel AS (SELECT query_id, vec_id AS item_id FROM q JOIN embeddings USING (label)),
sz AS (SELECT query_id, count(*) AS relevant FROM rel GROUP BY 1),
hit AS (SELECT query_id, count(*) FILTER (WHERE rank <= 10) AS hits, min(rank) AS first, sum(CASE WHEN rank <= 10 THEN 1.0::DOUBLE / log2(rank + 1) ELSE 0 END) AS dcg FROM res SEMI JOIN rel USING (query_id, item_id) GROUP BY 1),
met AS (SELECT query_id, coalesce(hits, 0) / 10.0::DOUBLE AS precision, coalesce(hits, 0) / relevant AS recall, coalesce(1.0::DOUBLE / first, 0) AS reciprocal_rank,
  coalesce(dcg / list_sum(list_transform(range(1, least(relevant, 10) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))), 0) AS ndcg FROM sz LEFT JOIN hit USING (query_id))"""


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of vector search, where equal labels are relevant."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 50 = 0")
    queries = asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q_vector"), F.lit("restricted").alias("q_clearance"), F.lit("").alias("q_tenant"))
    found = search.vector_search(corpus(spark, sf_dir), queries, 20, DIMENSION)
    results = found.select("query_id", F.col("doc_id").alias("item_id"), (F.col("rank") + 1).alias("rank"))
    judged = asked.select(F.col("vec_id").alias("query_id"), "label").join(vectors.select(F.col("vec_id").alias("item_id"), "label"), "label").select("query_id", "item_id")
    return evaluation.query_metrics(judged, results, 10)


@R.add(f"WITH {EVAL_SQL} SELECT query_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(reciprocal_rank, 6) AS reciprocal_rank, round(ndcg, 6) AS ndcg FROM met")
def eval_metrics(spark, sf_dir):
    rows = evaluated(spark, sf_dir)
    return rows.select("query_id", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "reciprocal_rank", "ndcg")))


@R.add(f"WITH {EVAL_SQL} SELECT count(*) AS queries, round_even(avg(precision), 6) AS mean_precision, round_even(avg(recall), 6) AS mean_recall, round_even(avg(reciprocal_rank), 6) AS mrr, round_even(avg(ndcg), 6) AS mean_ndcg, least(avg(precision), avg(recall), avg(reciprocal_rank), avg(ndcg)) >= 0.5 AS passed FROM met")
def eval_report(spark, sf_dir):
    return evaluation.report(evaluated(spark, sf_dir))


@R.add("""SELECT event_type, count(*) AS total, count(*) FILTER (WHERE event_id % 10 > 0) AS succeeded, count(*) FILTER (WHERE event_id % 10 = 0) AS dead_lettered, round(count(*) / 3600.0::DOUBLE, 6) AS throughput, round(count(*) FILTER (WHERE event_id % 10 > 0) / count(*), 6) AS success_rate,
  quantile_disc(value, 0.5) AS p50_seconds, quantile_disc(value, 0.95) AS p95_seconds FROM events GROUP BY 1""")
def load_percentiles(spark, sf_dir):
    runs = table(spark, sf_dir, "events").select("event_type", F.col("value").alias("duration_seconds"), F.when(F.col("event_id") % 10 == 0, "dead_letter").otherwise("completed").alias("status"))
    out = evaluation.load_report(runs, 3600.0, "event_type")
    return out.select("event_type", "total", "succeeded", "dead_lettered", F.round("throughput", 6).alias("throughput"), F.round("success_rate", 6).alias("success_rate"), "p50_seconds", "p95_seconds")


@R.add("""WITH m AS (SELECT user_id::VARCHAR AS document_id, count(*) AS n FROM events GROUP BY 1)
SELECT 'chunk_count_mismatch' AS "check", document_id AS subject FROM m WHERE document_id::INT % 10 = 0
UNION ALL SELECT 'duplicate_chunk_id', '7' WHERE EXISTS (SELECT 1 FROM m WHERE document_id = '7')""")
def chunk_findings(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    doc = F.col("user_id").cast("string")
    chunks = e.select(doc.alias("document_id"), F.when(F.col("user_id") == 7, "same").otherwise(F.col("event_id").cast("string")).alias("chunk_id"), F.lit(5).alias("token_count"))
    manifests = e.groupBy(doc.alias("document_id")).agg((F.count("*") + F.when(F.first("user_id") % 10 == 0, 1).otherwise(0)).alias("chunk_count"), (F.count("*") * 5).alias("total_tokens"))
    return evaluation.validate_chunks(manifests, chunks).select("check", "subject")


@R.add("SELECT count(*) AS errors, 0::BIGINT AS warnings, count(*) = 0 AS passed FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def vector_findings(spark, sf_dir):
    chunks = documents(spark, sf_dir).select("document_id", "chunk_id")
    vectors = corpus(spark, sf_dir).where("vector IS NOT NULL").select("document_id", "chunk_id", "vector")
    return evaluation.verdict(evaluation.validate_vectors(chunks, vectors, DIMENSION))


@R.add("SELECT count(*) AS risks, CASE WHEN bool_or(event_type = 'error' AND event_id % 100 = 0) THEN 'NO_GO' ELSE 'GO' END AS decision FROM events")
def release_decision(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("event_type") == "error").alias("blocking"), (F.col("event_id") % 100 != 0).alias("resolved"))
    return evaluation.release_decision(rows)


# --- models, costs, plans ------------------------------------------------------------------------

MODELS = [
    ("small", "approved", ["text"], 4096, 120.0, 0.0005, 0.0015, 0.6), ("large", "production", ["text", "image"], 128000, 900.0, 0.01, 0.03, 0.95),
    ("draft", "draft", ["text"], 8192, 60.0, 0.0001, 0.0002, 0.5), ("mid", "production", ["text"], 32000, 300.0, 0.002, 0.004, 0.8),
]
MODEL_SCHEMA = "model_id string, status string, modalities array<string>, context_window int, avg_latency_ms double, prompt_cost_per_1k double, completion_cost_per_1k double, quality_score double"
MODELS_SQL = "models AS (SELECT * FROM (VALUES " + ", ".join(f"('{m[0]}', '{m[1]}', {m[2]}, {m[3]}, {m[4]}, {m[5]}, {m[6]}, {m[7]})" for m in MODELS) + ") t(model_id, status, modalities, context_window, latency, pc, cc, quality))"


@R.add(f"""WITH {MODELS_SQL}, r AS (SELECT conv_id AS request_id, count(*) * 1500 AS ctx, [0.0, 400.0][conv_id % 2 + 1] AS most_ms, [0.0, 0.01][conv_id % 3 // 2 + 1] AS ceiling FROM conversations GROUP BY conv_id)
SELECT request_id, model_id, row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN request_id % 4 = 0 AND model_id = 'small' THEN 0 ELSE 1 END, quality DESC, latency, model_id) AS place FROM r JOIN models
ON status IN ('approved', 'production') AND ctx <= context_window AND (most_ms <= 0 OR latency <= most_ms) AND (ceiling <= 0 OR pc + cc <= ceiling)""")
def model_select(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.count("*") * 1500).alias("required_context"))
    k = F.col("conv_id")
    requests = rows.select(
        k.alias("request_id"), "required_context", F.array(F.lit("text")).alias("required_modalities"), F.when(k % 2 == 1, 400.0).otherwise(0.0).alias("max_latency_ms"),
        F.when(k % 3 == 2, 0.01).otherwise(0.0).alias("cost_ceiling"), F.when(k % 4 == 0, "small").alias("preferred_model_id"),
    )
    models = spark.createDataFrame(MODELS, MODEL_SCHEMA)
    return gateway.select_models(requests, models).select("request_id", "model_id", "place")


@R.add("""WITH u AS (SELECT 'tenant-' || (conv_id % 3) AS tenant_id, length(coalesce(text, '')) // 4 AS p, length(coalesce(text, '')) // 8 AS c FROM conversations)
SELECT tenant_id, count(*) AS requests, sum(p + c)::BIGINT AS tokens, round(sum(round_even(p / 1000.0::DOUBLE * 0.002::DOUBLE + c / 1000.0::DOUBLE * 0.004::DOUBLE, 6)), 4) AS cost FROM u GROUP BY 1""")
def cost_ledger(spark, sf_dir):
    chars = F.length(F.coalesce("text", F.lit("")))
    usage = table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("tenant-"), (F.col("conv_id") % 3).cast("string")).alias("tenant_id"), F.floor(chars / 4).alias("prompt_tokens"), F.floor(chars / 8).alias("completion_tokens"),
        F.lit(0.002).alias("prompt_cost_per_1k"), F.lit(0.004).alias("completion_cost_per_1k"),
    )
    usage = usage.withColumn("cost", gateway.usage_cost(F.col("prompt_tokens"), F.col("completion_tokens")))
    return gateway.cost_ledger(usage).withColumn("cost", F.round("cost", 4))


OBJECTIVES = ["Gather sales data, validate it and notify the stakeholder", "Write a poem", "Compare trends, then seek approval for the report", "Check compliance policy"]
RULE_SQL = " UNION ALL ".join(
    "SELECT plan_id, {} AS k, '{}' AS description, '{}' AS capability, {} AS approval FROM o WHERE {}".format(i, name, capability, str(approval).lower(), " OR ".join(f"contains(l, '{s}')" for s in signals))
    for i, (signals, name, capability, approval) in enumerate(gateway.PLAN_RULES)
)
TASKS_SQL = f"""o AS (SELECT 'p' || conv_id AS plan_id, lower({OBJECTIVES}[conv_id % 4 + 1]) AS l FROM (SELECT DISTINCT conv_id FROM conversations)), f AS ({RULE_SQL}),
g AS (SELECT * FROM f UNION ALL SELECT plan_id, 0, 'Fulfill the request', 'reasoning', false FROM o ANTI JOIN f USING (plan_id)),
tasks AS (SELECT plan_id, row_number() OVER (PARTITION BY plan_id ORDER BY k) AS priority, description, capability, approval AS approval_required FROM g)"""


def task_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    text = F.get(F.array(*map(F.lit, OBJECTIVES)), (F.col("conv_id") % 4).cast("int"))
    return gateway.plan_tasks(rows.select(F.concat(F.lit("p"), F.col("conv_id").cast("string")).alias("plan_id"), text.alias("objective")))


@R.add(f"WITH {TASKS_SQL} SELECT plan_id, priority, description, capability, approval_required, CASE WHEN priority > 1 THEN plan_id || '-t' || (priority - 1) END AS depends_on FROM tasks")
def plan_tasks(spark, sf_dir):
    return task_rows(spark, sf_dir).select("plan_id", "priority", "description", "capability", "approval_required", "depends_on")


@R.add(f"WITH {TASKS_SQL} SELECT plan_id, count(*) AS tasks, CASE WHEN bool_or(approval_required) THEN 'conditional' ELSE 'sequential' END AS strategy, coalesce(min(priority) FILTER (WHERE approval_required) - 1, count(*)) AS completed_tasks FROM tasks GROUP BY 1")
def plan_strategy(spark, sf_dir):
    return gateway.plan_strategy(task_rows(spark, sf_dir)).select("plan_id", "tasks", "strategy", "completed_tasks")


@R.add(f"WITH {TASKS_SQL} SELECT plan_id, priority - 1 AS position, plan_id || '-t' || priority AS task_id FROM tasks")
def topological_order(spark, sf_dir):
    tasks = task_rows(spark, sf_dir).withColumn("dependencies", F.array_compact(F.array("depends_on"))).withColumn("priority", -F.col("priority"))
    return gateway.topological_order(tasks)


AGENTS = [("a1", ["reporting", "reasoning"], [], 0.7, True), ("a2", ["reporting"], ["invoke_tool"], 0.9, True), ("a3", ["reasoning", "data_analysis"], [], 0.8, True), ("a4", ["sql_querying"], [], 0.9, False)]


@R.add(f"WITH {TASKS_SQL} SELECT plan_id || '-t' || priority AS task_id, CASE capability WHEN 'reporting' THEN CASE WHEN substr(plan_id, 2)::INT % 2 = 0 THEN 'a2' ELSE 'a1' END ELSE 'a3' END AS agent_id FROM tasks WHERE capability IN ('reporting', 'reasoning', 'data_analysis')")
def agent_select(spark, sf_dir):
    agents = spark.createDataFrame(AGENTS, "agent_id string, capabilities array<string>, required_permissions array<string>, quality_score double, available boolean")
    even = F.substring("plan_id", 2, 18).cast("long") % 2 == 0
    tasks = task_rows(spark, sf_dir).withColumn("granted_permissions", F.when(even, F.array(F.lit("invoke_tool"))).otherwise(F.array().cast("array<string>")))
    return gateway.select_agents(tasks, agents).select("task_id", "agent_id")


@R.add("""SELECT conv_id, count(*) AS n, sum(CASE WHEN turn % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS from_knowledge FROM (SELECT conv_id, turn FROM conversations WHERE conv_id % 2 = 0 AND turn % 3 = 0 UNION ALL SELECT conv_id, 1 FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE conv_id % 2 = 0 AND turn % 3 = 0)) GROUP BY 1""")
def knowledge_or_memory(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), "turn")
    knowledge = rows.where("query_id % 2 = 0 AND turn % 3 = 0").withColumn("known", F.lit(1))
    out = gateway.knowledge_or_memory(knowledge, rows.withColumn("known", F.lit(0)))
    return out.groupBy(F.col("query_id").alias("conv_id")).agg(F.count("*").alias("n"), F.sum("known").alias("from_knowledge"))


# --- registries, redaction and lifecycles ---------------------------------------------------------


def pick(values: list, by):
    return F.get(F.array(*map(F.lit, values)), by.cast("int"))


@R.add("""SELECT event_id, replace(replace('key k-secret-1 of ' || event_type || ' with k-secret', 'k-secret-1', '***redacted***'), 'k-secret', '***redacted***') AS message, '***redacted***' AS token, user_id::VARCHAR AS user FROM events""")
def redact_logs(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("key k-secret-1 of "), "event_type", F.lit(" with k-secret")).alias("message"), F.create_map(F.lit("Token"), F.lit("abc"), F.lit("user"), F.col("user_id").cast("string")).alias("fields"))
    out = rows.select("event_id", governance.redact_secrets(F.col("message"), ["k-secret", "k-secret-1"]).alias("message"), governance.redact_keys(F.col("fields")).alias("f"))
    return out.select("event_id", "message", F.element_at("f", F.lit("Token")).alias("token"), F.element_at("f", F.lit("user")).alias("user"))


@R.add("SELECT doc_id, doc_id // 5 % 5 < doc_id % 5 AS downgrade FROM documents")
def classification_downgrade(spark, sf_dir):
    source, target = pick(search.CLEARANCES, F.col("doc_id") % 5), pick(search.CLEARANCES, F.expr("doc_id div 5 % 5"))
    return table(spark, sf_dir, "documents").select("doc_id", governance.is_downgrade(source, target).alias("downgrade"))


@R.add(f"""WITH {JOBS_SQL} SELECT 'released' AS step, count(*) AS n, sum(greatest(attempts - 1, 0))::BIGINT AS attempts FROM jobs WHERE status = 'running'
UNION ALL SELECT 'cancelled', count(*), sum(attempts)::BIGINT FROM jobs WHERE status IN ('queued', 'running') UNION ALL SELECT 'requeued', count(*), 0 FROM jobs WHERE status IN ('dead_letter', 'cancelled')""")
def job_lifecycle(spark, sf_dir):
    rows = job_rows(spark, sf_dir)
    steps = {"released": jobs.released(rows.where("status = 'running'"), lit_ts(NOW)), "cancelled": jobs.cancelled(rows), "requeued": jobs.requeued(rows, lit_ts(NOW))}
    parts = [df.agg(F.count("*").alias("n"), F.sum("attempts").alias("attempts")).select(F.lit(name).alias("step"), "n", "attempts") for name, df in steps.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def lifecycle_sql(states: list[str], edges: list[tuple[str, str]]) -> str:
    return f"""WITH s AS (SELECT user_id, event_id, {states}[(event_id * 3 + user_id) % {len(states)} + 1] AS state FROM events), m AS (SELECT lag(state) OVER (PARTITION BY user_id ORDER BY event_id) AS from_state, state AS to_state FROM s),
    edges AS (SELECT unnest({[list(e) for e in edges]}) AS e)
    SELECT from_state, to_state, count(*) AS n FROM m WHERE from_state IS NOT NULL AND NOT EXISTS (SELECT 1 FROM edges WHERE e[1] = from_state AND e[2] = to_state) GROUP BY ALL"""


def lifecycle(spark: SparkSession, sf_dir: str, states: list[str], edges: list[tuple[str, str]]) -> DataFrame:
    state = pick(states, (F.col("event_id") * 3 + F.col("user_id")) % len(states))
    history = table(spark, sf_dir, "events").select("user_id", "event_id", state.alias("state"))
    wrong = changes.illegal_transitions(changes.transitions(history, "user_id", order="event_id"), edges)
    return wrong.groupBy("from_state", "to_state").agg(F.count("*").alias("n"))


CONVERSATION_STATES = sorted({a for a, _ in changes.CONVERSATION_EDGES})
WORKFLOW_STATES = sorted({b for _, b in changes.WORKFLOW_EDGES})
DOCUMENT_STATES = sorted({a for a, _ in changes.DOCUMENT_EDGES})


@R.add(lifecycle_sql(CONVERSATION_STATES, changes.CONVERSATION_EDGES))
def conversation_violations(spark, sf_dir):
    return lifecycle(spark, sf_dir, CONVERSATION_STATES, changes.CONVERSATION_EDGES)


@R.add(lifecycle_sql(WORKFLOW_STATES, changes.WORKFLOW_EDGES))
def workflow_violations(spark, sf_dir):
    return lifecycle(spark, sf_dir, WORKFLOW_STATES, changes.WORKFLOW_EDGES)


@R.add(lifecycle_sql(DOCUMENT_STATES, changes.DOCUMENT_EDGES))
def document_violations(spark, sf_dir):
    return lifecycle(spark, sf_dir, DOCUMENT_STATES, changes.DOCUMENT_EDGES)


@R.add("SELECT event_type, count(*) FILTER (WHERE event_id % 1000 + event_id % 700 > 1200) AS by_tokens, count(*) FILTER (WHERE event_id % 1000 + event_id % 700 <= 1200 AND value > 15) AS by_cost FROM events GROUP BY 1")
def budget_breaches(spark, sf_dir):
    usage = table(spark, sf_dir, "events").select("event_type", (F.col("event_id") % 1000).alias("prompt_tokens"), (F.col("event_id") % 700).alias("completion_tokens"), F.col("value").alias("cost"))
    over = gateway.over_limits(usage, 1200, 15.0)
    types = usage.select("event_type").distinct()
    counts = over.groupBy("event_type").agg(F.count_if(F.col("reason") == "tokens").alias("by_tokens"), F.count_if(F.col("reason") == "cost").alias("by_cost"))
    return types.join(counts, "event_type", "left").fillna(0)


TOOLS = [("calc", ["math"], []), ("sql", ["math", "query"], ["invoke_tool"]), ("mail", ["notify"], ["invoke_tool"]), ("ops", ["math"], ["admin"])]


@R.add("SELECT unnest(['calc', 'sql']) AS tool_id")
def tool_discovery(spark, sf_dir):
    tools = spark.createDataFrame(TOOLS, "tool_id string, capabilities array<string>, required_permissions array<string>")
    return gateway.find_tools(tools, "math", ["invoke_tool"]).select("tool_id")


@R.add("SELECT unnest(['events', 'documents', 'vectors']) AS rule, unnest([(SELECT count(*) > 0 FROM events), (SELECT count(*) > 0 FROM documents), (SELECT count(*) FROM embeddings) >= (SELECT count(*) FROM documents)]) AS passed")
def readiness(spark, sf_dir):
    """One table of rules over counted facts."""
    count = lambda name: table(spark, sf_dir, name).agg(F.count("*").alias(name))
    facts = count("events").crossJoin(count("documents")).crossJoin(count("embeddings"))  # one row each
    rules = {"events": F.col("events") > 0, "documents": F.col("documents") > 0, "vectors": F.col("embeddings") >= F.col("documents")}
    return evaluation.readiness(facts, rules)


# --- typed event logs ----------------------------------------------------------------

SYNC, CHUNKING, CHAT = (event_log.EVENT_TYPES[x].split() for x in ("sync", "chunking", "conversation"))
FAULTS_SQL = f"""raw AS (
  SELECT event_id, user_id, ['sync', 'chunking', 'conversation', 'nowhere'][event_id % 4 + 1] AS log,
         CASE WHEN event_id % 13 = 0 THEN 'Mystery' WHEN event_id % 4 = 1 THEN {CHUNKING}[event_id // 4 % {len(CHUNKING)} + 1] WHEN event_id % 4 = 2 THEN {CHAT}[event_id // 4 % {len(CHAT)} + 1] ELSE {SYNC}[event_id // 4 % {len(SYNC)} + 1] END AS kind
  FROM events),
told AS (
  SELECT *, CASE WHEN event_id % 17 = 0 THEN 'bad_json' WHEN log = 'nowhere' THEN 'unknown_log' WHEN kind = 'Mystery' THEN 'unknown_type' WHEN event_id % 19 = 0 THEN 'missing_tenant'
                 WHEN event_id % 23 = 0 THEN 'missing_subject' WHEN event_id % 29 = 0 THEN 'bad_timestamp' END AS reason FROM raw)"""


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of four logs, one of them unknown; some broken in each way, every tenth delivered twice."""
    n = F.col("event_id")
    pick = lambda names: F.get(F.array(*map(F.lit, names)), (F.floor(n / 4) % len(names)).cast("int"))
    kind = F.when(n % 13 == 0, "Mystery").when(n % 4 == 1, pick(CHUNKING)).when(n % 4 == 2, pick(CHAT)).otherwise(pick(SYNC))
    subject = F.when(n % 23 != 0, F.col("user_id").cast("string"))
    stamp = F.when(n % 29 == 0, "yesterday").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    body = F.to_json(F.struct(kind.alias("event_type"), F.when(n % 19 != 0, F.concat(F.lit("tenant-"), (F.col("user_id") % 3).cast("string"))).alias("tenant_id"), *(subject.alias(c) for c in ("repository_id", "document_id", "conversation_id")), stamp.alias("timestamp")))
    log = F.get(F.array(F.lit("sync"), F.lit("chunking"), F.lit("conversation"), F.lit("nowhere")), (n % 4).cast("int"))
    rows = events(spark, sf_dir).select(log.alias("log"), n.cast("string").alias("event_id"), F.when(n % 17 == 0, F.left(body, F.length(body) - 1)).otherwise(body).alias("body"), F.col("ts").alias("received"))
    return rows.unionByName(rows.where("event_id % 10 = 0").withColumn("received", F.col("received") + F.expr("INTERVAL 1 MINUTE")))


@R.add(f"WITH {FAULTS_SQL} SELECT log, kind AS event_type, count(*) AS n, count(DISTINCT user_id) AS subjects FROM told WHERE reason IS NULL GROUP BY ALL")
def typed_events(spark, sf_dir):
    """Good events of each type, each delivery once."""
    good = event_log.once(event_log.checked(raw_events(spark, sf_dir))).where("reason IS NULL")
    return good.groupBy("log", "event_type").agg(F.count("*").alias("n"), F.countDistinct("subject").alias("subjects"))


@R.add(f"WITH {FAULTS_SQL} SELECT log, reason, count(*) AS n FROM told WHERE reason IS NOT NULL GROUP BY ALL")
def event_rejects(spark, sf_dir):
    """What the checks turned down, by reason."""
    bad = event_log.once(event_log.checked(raw_events(spark, sf_dir))).where("reason IS NOT NULL")
    return bad.groupBy("log", "reason").agg(F.count("*").alias("n"))
