"""Dialog turns, history, context, memory and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarryline.functions import vectors as V
from quarryline.operators import assembly, dialog, gateway, memory
from quarryline.plans import chat
from quarryline.queries.common import DIMENSION, SQL_WORD, Registry, corpus, documents, events, lit_ts, table, turns
from quarryline.sources import stores

R = Registry()

BLANK = "[^\\t-\\r \\x{85}\\p{Z}]"
STRIP = "regexp_replace({}, '^[\\t-\\r \\x{{85}}\\p{{Z}}]+|[\\t-\\r \\x{{85}}\\p{{Z}}]+$', '', 'g')"

#: Messages that bring out every kind of turn, by their number; others are the table's own texts.
SPOKEN = ["and what about it", "compare the policy documents of our company", "hi", "what is the refund policy for the premium plan"]


def spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose even conversations hold short user messages."""
    rows = turns(spark, sf_dir)
    said = F.get(F.array(*map(F.lit, SPOKEN)), ((F.col("conv_id") + F.col("turn")) / 2 % len(SPOKEN)).cast("int"))
    asked = F.when((F.col("conv_id") % 5 == 0) & (F.col("role") == "assistant"), dialog.CLARIFICATION)
    return rows.withColumn("content", F.coalesce(asked, F.when((F.col("conv_id") % 2 == 0) & (F.col("role") == "user"), said), F.col("content")))


def has(column: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, $${p}$$)" for p in parts) + ")"


STOP_SQL = "[" + ", ".join(f"'{w}'" for w in dialog.STOP_WORDS) + "]"
SPOKEN_SQL = f"""t AS (
  SELECT conv_id, turn, role, CASE WHEN conv_id % 5 = 0 AND role = 'assistant' THEN $${dialog.CLARIFICATION}$$
    WHEN conv_id % 2 = 0 AND role = 'user' THEN [{', '.join(repr(s) for s in SPOKEN)}][((conv_id + turn) // 2) % 4 + 1] ELSE coalesce(text, '') END AS content FROM conversations),
s AS (SELECT *, {STRIP.format('content')} AS said, list_distinct(list_filter(regexp_extract_all(lower(content), '[a-z0-9]+'), lambda x: length(x) > 1 AND NOT list_contains({STOP_SQL}, x))) AS terms FROM t),
h AS (
  SELECT *, count(*) OVER w AS history_turns, last_value(CASE WHEN role = 'user' AND said <> '' THEN said END IGNORE NULLS) OVER w AS last_user,
         last_value(CASE WHEN role = 'assistant' AND said <> '' THEN said END IGNORE NULLS) OVER w AS last_assistant,
         flatten(coalesce(list(CASE WHEN role = 'user' THEN terms ELSE [] END) OVER w, [])) AS prior
  FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT *, CASE WHEN len(terms) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(terms, prior)) / len(terms) END AS topic_overlap FROM h),
i AS (
  SELECT *, lower(said) AS l, len(regexp_extract_all(said, '{SQL_WORD}')) AS n, {has('lower(said)', dialog.PERSONAL)} AS personal, {has('lower(said)', dialog.ORGANIZATIONAL)} AS organizational,
         {has('lower(said)', dialog.QUESTIONS + [w for ws in dialog.INTENTS.values() for w in ws])} AS matched FROM o),
c AS (
  SELECT *, round_even(greatest(0.0::DOUBLE, least(0.99::DOUBLE, (CASE WHEN n < 2 AND NOT matched THEN 0.2::DOUBLE ELSE 0.5::DOUBLE + CASE WHEN matched THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN personal OR organizational THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN n >= 4 THEN 0.05::DOUBLE ELSE 0 END END)
         - CASE WHEN personal AND organizational THEN 0.1::DOUBLE ELSE 0 END)), 4) AS confidence FROM i),
k AS (
  SELECT *, CASE WHEN said = '' THEN NULL
    WHEN history_turns > 0 AND last_assistant = $${dialog.CLARIFICATION}$$ THEN 'clarification_reply'
    WHEN history_turns > 0 AND ({' OR '.join(f"starts_with(l, '{p}')" for p in dialog.CONTINUATIONS)} OR {has('l', dialog.REFERENCES)}
      OR (len(regexp_extract_all(l, '[a-z0-9]+')) <= 8 AND list_has_any(regexp_extract_all(l, '[a-z0-9]+'), [{', '.join(repr(w) for w in dialog.ANAPHORA)}]))) THEN 'follow_up'
    WHEN length(said) <= 8000 AND confidence < 0.35 THEN 'clarification_needed'
    WHEN history_turns > 0 AND topic_overlap >= 0.15 THEN 'follow_up' ELSE 'fresh' END AS turn_type FROM c WHERE role = 'user')"""


@R.add(f"WITH {SPOKEN_SQL} SELECT conv_id, turn, turn_type, history_turns, round(topic_overlap, 6) AS topic_overlap FROM k")
def turn_classification(spark, sf_dir):
    rows = dialog.classify_turns(spoken(spark, sf_dir))
    return rows.select("conv_id", "turn", "turn_type", "history_turns", F.round("topic_overlap", 6).alias("topic_overlap"))


@R.add(f"""WITH {SPOKEN_SQL}, q AS (SELECT conv_id, turn, CASE WHEN turn_type IN ('fresh', 'clarification_needed') OR last_user IS NULL THEN said ELSE NULL END AS alone, {STRIP.format("coalesce(last_user, '') || ' ' || said")} AS joined, turn_type FROM k)
SELECT conv_id, turn, sha256(coalesce(alone, CASE WHEN length(joined) <= 512 THEN joined ELSE regexp_replace(left(joined, 512), '[\\t-\\r \\x{{85}}\\p{{Z}}]+$', '') END)) AS query_sha256 FROM q WHERE turn_type IS NOT NULL""")
def search_queries(spark, sf_dir):
    rows = dialog.classify_turns(spoken(spark, sf_dir)).where("turn_type IS NOT NULL")
    return rows.select("conv_id", "turn", F.sha2("search_query", 256).alias("query_sha256"))


INTENT_SQL = "CASE " + " ".join(f"WHEN {has('l', signals)} THEN '{name}'" for name, signals in dialog.INTENTS.items()) + " ELSE 'question' END"


@R.add(f"""WITH {SPOKEN_SQL} SELECT conv_id, turn, {INTENT_SQL} AS intent, CASE WHEN personal AND organizational THEN 'mixed' WHEN personal THEN 'personal' WHEN organizational THEN 'organizational' ELSE 'unknown' END AS scope,
  CASE WHEN n <= 4 THEN 'simple' WHEN n <= 16 THEN 'moderate' ELSE 'complex' END AS complexity, confidence,
  CASE WHEN confidence < 0.6 THEN 'none' WHEN personal AND NOT organizational THEN 'memory' WHEN organizational THEN 'knowledge' ELSE 'none' END AS routing FROM c WHERE role = 'user'""")
def message_intent(spark, sf_dir):
    rows = spoken(spark, sf_dir).where("role = 'user'").withColumn("i", dialog.message_intent(F.col("content")))
    return rows.select("conv_id", "turn", "i.intent", "i.scope", "i.complexity", "i.confidence", "i.routing")


@R.add(f"WITH {SPOKEN_SQL} SELECT conv_id, count(*) AS interactions, count(*) FILTER (WHERE turn_type = 'clarification_needed') AS clarifications FROM k GROUP BY 1")
def interaction_counts(spark, sf_dir):
    return dialog.interaction_counts(dialog.classify_turns(spoken(spark, sf_dir)))


HISTORY_SQL = f"""n AS (SELECT conv_id, turn, role, coalesce(text, '') AS content, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM conversations WHERE regexp_matches(text, '{BLANK}')),
u AS (SELECT *, greatest(1, length({STRIP.format('content')}) // 4) AS cost FROM n WHERE age <= 8),
r AS (SELECT *, sum(cost) OVER (PARTITION BY conv_id ORDER BY age ROWS UNBOUNDED PRECEDING) AS used FROM u),
kept AS (SELECT * FROM r WHERE age = 1 OR used <= 600)"""


@R.add(f"WITH {HISTORY_SQL} SELECT conv_id, turn, used::BIGINT AS used FROM kept")
def history_prune(spark, sf_dir):
    return dialog.prune_history(turns(spark, sf_dir)).select("conv_id", "turn", "used")


@R.add(f"""WITH {HISTORY_SQL} SELECT conv_id, sha256(string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || array_to_string(regexp_extract_all(content, '{SQL_WORD}'), ' '), chr(10) ORDER BY age DESC)) AS history_sha256 FROM kept GROUP BY conv_id""")
def history_text(spark, sf_dir):
    rows = dialog.rendered_history(dialog.prune_history(turns(spark, sf_dir)))
    return rows.select("conv_id", F.sha2("history", 256).alias("history_sha256"))


def context_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as history, memory, policy and enterprise items by their number."""
    rows = turns(spark, sf_dir).where(f"content rlike '[^\\\\s]'")
    kind = F.get(F.array(*map(F.lit, ("enterprise", "conversation", "memory", "policy"))), (F.col("turn") % 4).cast("int"))
    return rows.select("conv_id", kind.alias("source"), "content", (F.col("turn") % 5 / 4.0).alias("score"), F.col("turn").alias("position"))


@R.add(f"""WITH RECURSIVE b AS (
  SELECT conv_id, ['enterprise', 'conversation', 'memory', 'policy'][turn % 4 + 1] AS source, {STRIP.format('text')} AS content, turn % 5 / 4.0::DOUBLE AS score, turn AS position FROM conversations WHERE regexp_matches(text, '\\S')),
p AS (SELECT *, source = 'policy' AS forced, source <> 'policy' AND score < 0.25 AS low, list_position(['policy', 'enterprise', 'conversation', 'memory'], source) AS place, greatest(1, length(content) // 4) AS tokens FROM b),
d AS (SELECT *, NOT forced AND NOT low AND row_number() OVER (PARTITION BY conv_id, forced, low, lower(content) ORDER BY score DESC, place, position) > 1 AS copy FROM p),
q AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY NOT forced, CASE WHEN forced THEN 0 ELSE place END, CASE WHEN forced THEN 0 ELSE -score END, CASE WHEN forced THEN '' ELSE content END, position) AS k FROM d WHERE NOT low AND NOT copy),
walk AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS k, 0::BIGINT AS total, 0::BIGINT AS chosen, 0::BIGINT AS dropped FROM d
  UNION ALL
  SELECT w.conv_id, q.k, w.total + CASE WHEN NOT forced AND chosen > 0 AND w.total + tokens > 900 THEN 0 ELSE tokens END,
    w.chosen + CASE WHEN NOT forced AND chosen > 0 AND w.total + tokens > 900 THEN 0 ELSE 1 END, w.dropped + CASE WHEN NOT forced AND chosen > 0 AND w.total + tokens > 900 THEN 1 ELSE 0 END
  FROM walk w JOIN q ON q.conv_id = w.conv_id AND q.k = w.k + 1),
ends AS (SELECT conv_id, arg_max(total, k) AS total_tokens, arg_max(chosen, k) AS selected_count, arg_max(dropped, k) AS dropped_for_budget FROM walk GROUP BY 1)
SELECT conv_id, count(*) AS considered, count(*) FILTER (WHERE low) AS dropped_below_relevance, count(*) FILTER (WHERE copy) AS dropped_duplicates, any_value(dropped_for_budget) AS dropped_for_budget,
  any_value(total_tokens) AS total_tokens, any_value(selected_count) AS selected_count FROM d JOIN ends USING (conv_id) GROUP BY conv_id""")
def chat_context(spark, sf_dir):
    rows = assembly.assemble_chat_context(context_items(spark, sf_dir), budget=1000, min_relevance=0.25)
    return rows.select("conv_id", "considered", "dropped_below_relevance", "dropped_duplicates", "dropped_for_budget", "total_tokens", "selected_count")


@R.add("""WITH n AS (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)
SELECT conv_id, turn, round_even(least(0.9::DOUBLE, 0.4::DOUBLE + 0.4::DOUBLE * ((i + 1) / n)), 4) AS score FROM n""")
def history_scores(spark, sf_dir):
    by = W.partitionBy("conv_id")
    rows = turns(spark, sf_dir).withColumn("n", F.count("*").over(by)).withColumn("i", F.row_number().over(by.orderBy("turn")) - 1)
    return rows.select("conv_id", "turn", assembly.history_score(F.col("i"), F.col("n")).alias("score"))


@R.add("""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'missing source_path' WHEN doc_id % 11 = 0 THEN 'missing document_id' WHEN doc_id % 13 = 0 THEN 'missing chunk_id' END AS problem FROM documents WHERE regexp_matches(text, '\\S')""")
def citation_readiness(spark, sf_dir):
    rows = documents(spark, sf_dir).where("content rlike '[^\\\\s]'")
    spoil = lambda c, k: F.when(F.col("doc_id") % k == 0, " ").otherwise(F.col(c))
    problem = assembly.citation_problem(F.col("content"), spoil("source_path", 7), spoil("document_id", 11), spoil("chunk_id", 13))
    return rows.select("doc_id", problem.alias("problem"))


@R.add(f"""WITH l AS (SELECT doc_id, text, list_filter(string_split_regex(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: regexp_matches(x, '{BLANK}') AND NOT regexp_matches(x, '^[\\t-\\r \\x{{85}}\\p{{Z}}]*[>#]')) AS lines FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, array_to_string(regexp_extract_all(CASE WHEN len(lines) > 0 THEN array_to_string(lines, ' ') ELSE '> Context: A > B # Title ' || text END, '{SQL_WORD}'), ' ') AS t FROM l)
SELECT doc_id, CASE WHEN length(t) > 240 THEN regexp_replace(left(t, 240), ' +$', '') || '…' ELSE t END AS snippet FROM x""")
def citation_snippet(spark, sf_dir):
    rows = documents(spark, sf_dir).where("content IS NOT NULL")
    framed = F.concat(F.lit("> Context: A > B\n\n# Title\n\n"), "content")
    return rows.select("doc_id", assembly.snippet(framed).alias("snippet"))


KINDS_SQL = "['\n| a | b |\n|---|---|\n| 1 | 2 |', '\n```py\nx\n```', '\n- one\n- two\n', '\n**bold** text', '']"
KINDS = ["\n| a | b |\n|---|---|\n| 1 | 2 |", "\n```py\nx\n```", "\n- one\n- two\n", "\n**bold** text", ""]


@R.add(f"""WITH k AS (SELECT conv_id, turn, coalesce(text, '') || {KINDS_SQL}[turn % 5 + 1] AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN regexp_matches(t, '{assembly.RESPONSE_TABLE}') THEN 'table' WHEN contains(t, '```') THEN 'structured' WHEN len(regexp_extract_all(t, '{assembly.RESPONSE_ITEM}')) >= 2 THEN 'list'
  WHEN regexp_matches(t, '{assembly.RESPONSE_MARKS}') THEN 'markdown' ELSE 'conversational' END AS response_type FROM k""")
def response_type(spark, sf_dir):
    rows = turns(spark, sf_dir)
    extra = F.get(F.array(*map(F.lit, KINDS)), (F.col("turn") % 5).cast("int"))
    return rows.select("conv_id", "turn", assembly.response_type(F.concat("content", extra)).alias("response_type"))


@R.add("""SELECT conv_id, count(*) AS messages, max(turn) AS last_turn, left(regexp_replace(trim(coalesce(arg_min(CASE WHEN role = 'user' THEN coalesce(text, '') END, CASE WHEN role = 'user' THEN turn END), 'New conversation')), '\\s+', ' ', 'g'), 60) AS title FROM conversations GROUP BY conv_id""")
def conversation_list(spark, sf_dir):
    return stores.conversation_list(turns(spark, sf_dir)).select("conv_id", "messages", "last_turn", "title")


@R.add()
def chat_answers(spark, sf_dir):
    """The whole chat plan over the spoken turns."""
    answered = chat.answer_turns(spoken(spark, sf_dir), corpus(spark, sf_dir), lambda text: V.hash_embedding(text, DIMENSION), DIMENSION, ("", "internal"))
    return answered.select("conv_id", "turn", "turn_type", "citations", "prompt.token_estimate", F.sha2("answer", 256).alias("answer_sha256"))


# --- memory ------------------------------------------------------------------------------

NOW = "2024-01-20 00:00:00"
SCOPES = ["working", "session", "conversation", "workspace", "user", "organizational"]
TYPES = ["fact", "decision", "preference", "procedure", "insight", "relationship"]
TOPICS = ["billing", "", "search engine", "release"]


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as memory items, made of their numbers."""
    e = events(spark, sf_dir)
    pick = lambda values, by: F.get(F.array(*map(F.lit, values)), (by % len(values)).cast("int"))
    scope = pick(SCOPES, F.col("event_id"))
    return e.select(
        F.col("event_id").alias("memory_id"), F.concat(F.lit("tenant-"), (F.col("user_id") % 3).cast("string")).alias("tenant_id"), scope.alias("scope"),
        F.concat(F.lit("User "), F.col("user_id").cast("string"), F.lit(" did "), F.col("event_type"), F.lit(". Then left\nagain")).alias("content"),
        pick(TYPES, F.col("user_id")).alias("memory_type"), pick(TOPICS, F.col("event_id")).alias("topic"), F.array(F.lit("Log"), "event_type").alias("tags"),
        (F.lit(0.4) + (F.col("event_id") % 7) / 10.0).alias("confidence"), F.lit("active").alias("status"), (F.col("user_id") % 20).cast("string").alias("conversation_id"),
        F.col("user_id").cast("string").alias("user_id"), (F.col("event_id") % 12).alias("retrieval_count"), F.col("ts").alias("created_at"),
        memory.expiry(scope, F.col("ts")).alias("expires_at"), F.array((F.col("event_id") + 1).cast("string")).alias("related_memories"), F.col("event_id").alias("position"),
    )


MEMORY_SQL = f"""m AS (
  SELECT event_id AS memory_id, 'tenant-' || (user_id % 3) AS tenant_id, {SCOPES}[event_id % 6 + 1] AS scope, 'User ' || user_id || ' did ' || event_type || '. Then left' || chr(10) || 'again' AS content,
    {TYPES}[user_id % 6 + 1] AS memory_type, {TOPICS}[event_id % 4 + 1] AS topic, event_type, 0.4::DOUBLE + (event_id % 7) / 10.0::DOUBLE AS confidence, user_id % 20 AS conversation_id, event_id % 12 AS retrieval_count, ts AS created_at,
    ts + to_seconds([1800, 28800, 2592000, 31536000, 94608000, NULL][event_id % 6 + 1]) AS expires_at FROM events)"""


@R.add(f"""WITH {MEMORY_SQL}, q AS (SELECT * FROM (VALUES (1, 'tenant-0', ['user', '3', 'click', 'log']), (2, 'tenant-1', ['billing', 'view']), (3, 'tenant-2', []::VARCHAR[])) v(query_id, tenant_id, tokens)),
s AS (
  SELECT query_id, memory_id, created_at, round_even(greatest(0, least(1, (0.4::DOUBLE * CASE WHEN len(tokens) = 0 THEN 0.5::DOUBLE ELSE len(list_intersect(tokens, list_concat(string_split(replace(lower(content), chr(10), ' '), ' '), string_split(topic, ' '), ['log', event_type]))) / len(tokens) END
    + 0.2::DOUBLE * power(0.5::DOUBLE, greatest(0, epoch_us(TIMESTAMP '{NOW}') - epoch_us(created_at)) / 3.6e9::DOUBLE / 24.0::DOUBLE)
    + 0.15::DOUBLE * map_extract_value(map {{'decision': 1.0::DOUBLE, 'preference': 0.9::DOUBLE, 'procedure': 0.85::DOUBLE, 'fact': 0.8::DOUBLE, 'insight': 0.75::DOUBLE, 'relationship': 0.7::DOUBLE}}, memory_type)
    + 0.1::DOUBLE * least(1.0::DOUBLE, retrieval_count / 10.0::DOUBLE) + 0.15::DOUBLE * confidence) / 1.0::DOUBLE)), 6) AS score
  FROM m JOIN q USING (tenant_id) WHERE (expires_at IS NULL OR expires_at > TIMESTAMP '{NOW}') AND confidence >= 0.5)
SELECT query_id::BIGINT AS query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, created_at, memory_id) AS rank, memory_id, score FROM s QUALIFY rank <= 10""")
def memory_recall(spark, sf_dir):
    asked = spark.createDataFrame([(1, "tenant-0", "User 3 click log"), (2, "tenant-1", "billing view"), (3, "tenant-2", " ")], "query_id long, tenant_id string, query string")
    found = memory.recall(memories(spark, sf_dir), asked, lit_ts(NOW))
    return found.select("query_id", "rank", "memory_id", "score")


@R.add(f"WITH {MEMORY_SQL} SELECT scope, CASE WHEN expires_at <= TIMESTAMP '{NOW}' THEN 'expired' ELSE 'active' END AS status, count(*) AS n FROM m GROUP BY ALL")
def memory_expiry(spark, sf_dir):
    rows = memory.expire(memories(spark, sf_dir), lit_ts(NOW))
    return rows.groupBy("scope", "status").agg(F.count("*").alias("n"))


@R.add(f"""WITH {MEMORY_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, lower(content) ORDER BY confidence DESC, memory_id) AS k, count(*) OVER (PARTITION BY tenant_id, lower(content)) AS merged_from FROM m)
SELECT tenant_id, memory_id, merged_from, merged_from AS related FROM r WHERE k = 1""")
def memory_consolidate(spark, sf_dir):
    rows = memory.consolidate_duplicates(memories(spark, sf_dir), "tenant_id")
    return rows.select("tenant_id", "memory_id", "merged_from", F.size("related_memories").alias("related"))


@R.add(f"""WITH {MEMORY_SQL} SELECT conversation_id::VARCHAR AS conversation_id, count(*) AS memories, 'Summary of ' || count(*) || ' memories on ' || coalesce(string_agg(DISTINCT CASE WHEN topic <> '' THEN topic END, ', ' ORDER BY CASE WHEN topic <> '' THEN topic END), 'general') || ': '
  || string_agg(split_part(content, '. ', 1), '; ' ORDER BY memory_id) AS summary FROM m WHERE scope IN ('working', 'session', 'conversation') GROUP BY 1""")
def memory_summary(spark, sf_dir):
    insights, _ = memory.consolidate_conversations(memories(spark, sf_dir))
    return insights.select("conversation_id", "memories", "summary")


@R.add(f"WITH {MEMORY_SQL} SELECT tenant_id, count(*) AS n FROM m WHERE NOT (tenant_id = 'tenant-1' AND conversation_id = 4) GROUP BY 1")
def memory_purge(spark, sf_dir):
    rows = memory.purge(memories(spark, sf_dir), "tenant-1", conversation_id="4")
    return rows.groupBy("tenant_id").agg(F.count("*").alias("n"))


@R.add("""WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 3600000000 THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, session::BIGINT AS session, count(*) AS events, epoch_us(min(ts)) AS started_us, epoch_us(max(ts)) AS last_us FROM s GROUP BY ALL""")
def sessions_ttl(spark, sf_dir):
    rows = dialog.ttl_sessions(events(spark, sf_dir), "user_id")
    return rows.select("user_id", "session", "events", F.unix_micros("started_at").alias("started_us"), F.unix_micros("last_seen").alias("last_us"))


@R.add(f"WITH {MEMORY_SQL} SELECT memory_id, row_number() OVER (ORDER BY created_at, memory_id) AS place FROM m WHERE tenant_id = 'tenant-2' AND scope = 'session'")
def memory_listing(spark, sf_dir):
    rows = memory.listed(memories(spark, sf_dir), "tenant-2", "session")
    return rows.withColumn("place", F.row_number().over(W.partitionBy("tenant_id").orderBy("created_at", "memory_id"))).select("memory_id", "place")


@R.add("SELECT conv_id, turn % 4 IN (0, 2) AS use_memory, turn % 4 IN (1, 2) AS use_knowledge, ['memory', 'knowledge', 'knowledge', 'none'][turn % 4 + 1] AS primary_target, turn FROM conversations")
def memory_routing(spark, sf_dir):
    scope = F.get(F.array(*map(F.lit, ("personal", "organizational", "mixed", "unknown"))), (F.col("turn") % 4).cast("int"))
    return turns(spark, sf_dir).select("conv_id", "turn", memory.routing(scope).alias("r")).select("conv_id", "turn", "r.*")


@R.add(f"""WITH p AS (SELECT conv_id, turn, 'You are bot. Be brief. Answer strictly from the provided context and cite sources. If the context is insufficient, say so.' || chr(10) || chr(10) || 'Organizational policies to honor:' || chr(10) || 'none' || chr(10) || chr(10)
  || {STRIP.format("'Conversation objective: ' || coalesce(text, '')")} || chr(10) || chr(10) || {STRIP.format("'Relevant context:' || chr(10) || 'ctx' || chr(10) || chr(10) || 'User request: ' || coalesce(text, '')")} || chr(10) || chr(10) || 'Respond in markdown format.' AS prompt FROM conversations)
SELECT conv_id, turn, sha256(prompt) AS prompt_sha256, length(prompt) // 4 AS tokens, CASE WHEN length(prompt) // 4 > 500 THEN 'token_exceeded' ELSE 'valid' END AS status FROM p""")
def prompt_build(spark, sf_dir):
    values = {"identity": F.lit("bot"), "behavior": F.lit("Be brief."), "policies": F.lit("none"), "objective": F.col("content"), "context": F.lit("ctx"), "format": F.lit("markdown")}
    rows = turns(spark, sf_dir).withColumn("p", assembly.prompt(values, max_tokens=500))
    return rows.select("conv_id", "turn", F.sha2("p.prompt_text", 256).alias("prompt_sha256"), F.col("p.token_estimate").alias("tokens"), F.col("p.validation_status").alias("status"))


@R.add("""SELECT conv_id, turn, 'Based on the assembled context, here is a grounded response to: ' || CASE WHEN turn % 2 = 0 THEN 'turn ' || turn ELSE 'Respond.' END AS answer FROM conversations""")
def echo_answers(spark, sf_dir):
    n = F.col("turn").cast("string")
    prompt = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Context\n  User request: turn "), n, F.lit("\n\nRespond."))).otherwise(F.lit("Context\nRespond.\n \n"))
    return turns(spark, sf_dir).select("conv_id", "turn", gateway.echo(prompt).alias("answer"))
