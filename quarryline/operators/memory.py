"""Memory items: recall, retention, consolidation and routing."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarryline.functions.text import first_of, strip, words
from quarryline.functions.vectors import clamp
from quarryline.operators.jobs import seconds

#: Importance by type, confidence by method, seconds to live by scope (none: for ever).
IMPORTANCE = {"decision": 1.0, "preference": 0.9, "procedure": 0.85, "fact": 0.8, "insight": 0.75, "relationship": 0.7}
CONFIDENCE = {"user_confirmed": 0.95, "tool_verified": 0.90, "knowledge_retrieved": 0.80, "agent_generated": 0.75, "llm_inferred": 0.60}
TTL_SECONDS = {"working": 1800.0, "session": 28800.0, "conversation": 2592000.0, "workspace": 31536000.0, "user": 94608000.0}
CONSOLIDATED_SCOPES = ["working", "session", "conversation"]
FRAGMENT_CHARS = 160


@dataclass(frozen=True)
class RecallPolicy:
    weights: dict[str, float] = field(default_factory=lambda: {"relevance": 0.4, "recency": 0.2, "importance": 0.15, "frequency": 0.1, "trust": 0.15})
    half_life_hours: float = 24.0
    min_confidence: float = 0.5
    limit: int = 10


def table_of(values: dict[str, float], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), key)


def confidence_for(method: Column) -> Column:
    return table_of(CONFIDENCE, method)


def expiry(scope: Column, created_at: Column) -> Column:
    """When an item of the scope expires; null if never."""
    return created_at + seconds(table_of(TTL_SECONDS, scope).cast("decimal(18,6)"))


def is_expired(now: Column) -> Column:
    return F.coalesce(F.col("expires_at") <= now, F.lit(False))


def token_set(*texts: Column) -> Column:
    return F.array_distinct(F.concat(*(words(F.lower(t)) for t in texts)))


def recall(items: DataFrame, queries: DataFrame, now: Column, policy: RecallPolicy = RecallPolicy(), on: list[str] | None = None) -> DataFrame:
    """Best memories of each query (query_id, query and the columns ``on`` which it shares with items)."""
    live = items.where(~is_expired(now) & (F.col("confidence") >= policy.min_confidence))
    corpus = F.array_distinct(F.concat(token_set(F.col("content"), F.col("topic")), F.transform("tags", F.lower)))
    hours = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(F.col("created_at"))) / 3.6e9)
    rows = live.withColumn("corpus", corpus).withColumns({
        "recency": F.pow(F.lit(0.5), hours / policy.half_life_hours), "importance": table_of(IMPORTANCE, F.col("memory_type")),
        "frequency": F.least(F.lit(1.0), F.col("retrieval_count") / 10.0), "trust": F.col("confidence"),
    })
    asked = queries.withColumn("q_tokens", token_set(F.col("query")))
    joined = rows.join(asked, on or ["tenant_id"])
    share = F.size(F.array_intersect("q_tokens", "corpus")) / F.size("q_tokens")
    joined = joined.withColumn("relevance", F.when(F.size("q_tokens") == 0, 0.5).otherwise(share))
    total = None
    for name, weight in policy.weights.items():
        term = F.lit(weight) * F.col(name)
        total = term if total is None else total + term
    scored = joined.withColumn("score", F.bround(clamp(total / (sum(policy.weights.values()) or 1.0)), 6))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "created_at", "memory_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= policy.limit).drop("corpus", "q_tokens")


def counted(items: DataFrame, recalled: DataFrame) -> DataFrame:
    """Items with their retrieval counts after a recall."""
    hits = recalled.groupBy("memory_id").agg(F.count("*").alias("__hits"))
    return items.join(hits, "memory_id", "left").withColumn("retrieval_count", F.col("retrieval_count") + F.coalesce("__hits", F.lit(0))).drop("__hits")


def expire(items: DataFrame, now: Column) -> DataFrame:
    """Active items that are past their time become expired."""
    over = (F.col("status") == "active") & is_expired(now)
    return items.withColumn("status", F.when(over, "expired").otherwise(F.col("status")))


def purge(items: DataFrame, tenant_id: str, user_id: str | None = None, conversation_id: str | None = None) -> DataFrame:
    """Items without those of a tenant's user, conversation or both; of the whole tenant if neither is given."""
    doomed = F.col("tenant_id") == tenant_id
    doomed = doomed & F.col("user_id").eqNullSafe(F.lit(user_id)) if user_id is not None else doomed
    doomed = doomed & F.col("conversation_id").eqNullSafe(F.lit(conversation_id)) if conversation_id is not None else doomed
    return items.where(~F.coalesce(doomed, F.lit(False)))


def consolidate_duplicates(items: DataFrame, *within: str) -> DataFrame:
    """One item per text (trimmed, in lower case): the most confident, the earliest of equals, with all related ids.

    ``items`` carry a position; each group is reduced by aggregates.
    """
    order = F.struct("confidence", (-F.col("position")).alias("earlier"))
    own = [c for c in items.columns if c not in within and c != "related_memories"]
    keyed = items.withColumn("__key", F.lower(strip(F.col("content"))))
    related = F.array_sort(F.collect_list(F.struct("position", "related_memories")))
    best = keyed.groupBy(*within, "__key").agg(
        F.max_by(F.struct(*own), order).alias("__best"), F.array_distinct(F.flatten(F.transform(related, lambda r: r["related_memories"]))).alias("related_memories"), F.count("*").alias("merged_from")
    )
    return best.select(*within, "__best.*", "related_memories", "merged_from")


def first_sentence(text: Column) -> Column:
    """Up to the first full stop with a space, else the first line, cut to a fragment's length."""
    bare = strip(text)
    head = F.when(bare.contains(". "), F.substring_index(bare, ". ", 1)).otherwise(F.substring_index(bare, "\n", 1))
    return strip(F.substring(head, 1, FRAGMENT_CHARS))


def summarize(items: DataFrame, key: str, level: str = "summary") -> DataFrame:
    """One summary per key: sorted topics and first sentences in order, or a line that only counts."""
    topics = F.array_sort(F.collect_set(F.when(F.coalesce("topic", F.lit("")) != "", F.col("topic"))))
    parts = F.array_sort(F.collect_list(F.struct("position", first_sentence(F.col("content")).alias("part"))))
    grouped = items.groupBy(key).agg(F.count("*").alias("n"), topics.alias("topics"), parts.alias("parts"))
    label = F.when(F.size("topics") > 0, F.array_join("topics", ", ")).otherwise("general")
    joined = F.array_join(F.filter(F.transform("parts", lambda p: p["part"]), lambda p: p != ""), "; ")
    text = (
        F.concat(F.lit("Consolidated "), F.col("n").cast("string"), F.lit(" memories on "), label, F.lit("."))
        if level == "abstract"
        else F.concat(F.lit("Summary of "), F.col("n").cast("string"), F.lit(" memories on "), label, F.lit(": "), joined)
    )
    return grouped.select(key, F.col("n").alias("memories"), text.alias("summary"))


def consolidate_conversations(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one insight per conversation, all items with its sources archived)."""
    source = (F.col("status") == "active") & F.col("scope").isin(*CONSOLIDATED_SCOPES) & F.col("conversation_id").isNotNull()
    insights = summarize(items.where(source), "conversation_id").withColumn("memory_type", F.lit("insight"))
    return insights, items.withColumn("status", F.when(source, "archived").otherwise(F.col("status")))


def listed(items: DataFrame, tenant_id: str, scope: str | None = None, status: str = "active") -> DataFrame:
    rows = items.where((F.col("tenant_id") == tenant_id) & (F.col("status") == status))
    rows = rows.where(F.col("scope") == scope) if scope else rows
    return rows.orderBy("created_at", "memory_id")


def routing(scope: Column) -> Column:
    """A struct of use_memory, use_knowledge and primary_target."""
    return F.struct(
        scope.isin("personal", "mixed").alias("use_memory"), scope.isin("organizational", "mixed").alias("use_knowledge"),
        first_of([(scope == "personal", "memory"), (scope.isin("organizational", "mixed"), "knowledge")], "none").alias("primary_target"),
    )
