"""Search, fusion, ranking, assembly and query understanding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import vectors as V
from quarryline.operators import assembly, fusion, governance, search, understanding, vector_index
from quarryline.plans import retrieval as plan
from quarryline.queries.common import CORPUS_SQL, DIMENSION, DOCS_SQL, Registry, corpus, documents, table
from quarryline.session import new_folder

R = Registry()


def whole_text():
    return F.coalesce("text", F.lit(""))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding whose id is divisible by 50, asked with the clearance of its number."""
    rows = table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0")
    level = F.get(F.array(F.lit("public"), F.lit("internal"), F.lit("restricted")), (F.col("vec_id") / 50 % 3).cast("int"))
    return rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q_vector"), level.alias("q_clearance"), F.lit("").alias("q_tenant"))


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark texts; odd ones belong to a tenant."""
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), whole_text().alias("query"))
    tenant = F.when(F.col("query_id") % 2 == 1, F.concat(F.lit("tenant-"), (F.col("query_id") % 3).cast("string"))).otherwise("")
    return rows.withColumn("q_clearance", F.lit("confidential")).withColumn("q_tenant", tenant).withColumn("terms", search.query_terms(F.col("query")))


VECTOR_SQL = CORPUS_SQL + """,
vq AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q_vector, [0, 1, 3][(vec_id // 50) % 3 + 1] AS q_level FROM embeddings WHERE vec_id % 50 = 0),
vscored AS (SELECT query_id, document_id, chunk_id, source_path, content, list_cosine_similarity(vector, q_vector) AS score FROM corpus, vq WHERE vector IS NOT NULL AND level <= q_level),
vfound AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id, chunk_id) - 1 AS rank FROM vscored WHERE score > 0)"""

KEYWORD_SQL = """
tq AS (
  SELECT item_id AS query_id, coalesce(text, '') AS query,
         list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_\\-]+'), lambda x: lower(x)) AS terms,
         CASE WHEN item_id % 2 = 1 THEN 'tenant-' || (item_id % 3) ELSE '' END AS q_tenant
  FROM benchmark),
kscored AS (
  SELECT query_id, document_id, chunk_id, source_path, content, len(list_filter(terms, lambda t: contains(lower(coalesce(content, '')), t))) / len(terms) AS score
  FROM docs, tq WHERE len(terms) > 0 AND level <= 2 AND (q_tenant = '' OR q_tenant = tenant_id)),
kfound AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id, chunk_id) - 1 AS rank FROM kscored WHERE score > 0)"""


@R.add(f"""WITH {CORPUS_SQL}
SELECT document_id, chunk_id, source_path, round(greatest(0, least(1, score)), 6) AS score
FROM (SELECT *, list_cosine_similarity(vector, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS score FROM corpus WHERE vector IS NOT NULL AND level <= 1)
WHERE score > 0 ORDER BY score DESC, document_id, chunk_id LIMIT 10""")
def vector_topk(spark, sf_dir):
    first = table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()
    rows = search.visible(corpus(spark, sf_dir), search.allowed_clearances("internal"))
    best = search.best_vectors(rows, [float(x) for x in first[0]], 10)
    return best.select("document_id", "chunk_id", "source_path", F.round("score", 6).alias("score"))


@R.add(f"""WITH {VECTOR_SQL}
SELECT query_id, document_id, rank, round(greatest(0, least(1, score)), 6) AS score FROM vfound WHERE rank < 10""")
def vector_topk_batch(spark, sf_dir):
    found = search.vector_search(corpus(spark, sf_dir), vector_queries(spark, sf_dir), 10, DIMENSION)
    return found.select("query_id", "document_id", "rank", F.round("score", 6).alias("score"))


def inverted_file(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, vector_index.Centroids]:
    rows = corpus(spark, sf_dir).where("vector IS NOT NULL").drop("content", "metadata")  # lists are for the search; contents join what it finds
    centroids = vector_index.fit(rows, DIMENSION)
    return vector_index.build(rows, new_folder(spark, "lists"), centroids, DIMENSION), centroids


def ivf_topk(spark, sf_dir):
    """The ten nearest of every query from the probed lists; approximate, so without SQL."""
    index, centroids = inverted_file(spark, sf_dir)
    found = vector_index.search(index, vector_queries(spark, sf_dir), centroids, DIMENSION)
    return found.select("query_id", "document_id", "rank", F.round("score", 6).alias("score"))


def ivf_recall(spark, sf_dir):
    """How much of the exact ten nearest the probed lists hold, and how many rows were scored for it."""
    index, centroids = inverted_file(spark, sf_dir)
    asked = vector_queries(spark, sf_dir)
    found = vector_index.search(index, asked, centroids, DIMENSION)
    each = vector_index.recall(found, search.vector_search(corpus(spark, sf_dir), asked, 10, DIMENSION))
    scored = vector_index.pair_count(index, vector_index.probed(index, asked, centroids, DIMENSION)).withColumnRenamed("n", "scored_rows")
    exact = vector_index.pair_count(index, asked).withColumnRenamed("n", "exact_rows")
    sums = each.agg(F.count("*").alias("queries"), F.sum("wanted").alias("wanted"), F.sum("found").alias("found"))
    return sums.crossJoin(scored).crossJoin(exact).withColumn("recall", F.col("found") / F.col("wanted"))  # one row each


R.add()(ivf_topk)
R.add()(ivf_recall)


@R.add(f"""WITH {VECTOR_SQL}
SELECT query_id, document_id, rank, round(greatest(0, least(1, score)), 6) AS score FROM vfound WHERE rank < 10""")
def ivf_all_lists(spark, sf_dir):
    """Every list probed: the exact result, from the same table."""
    index, centroids = inverted_file(spark, sf_dir)
    found = vector_index.search(index, vector_queries(spark, sf_dir), centroids, DIMENSION, probes=len(centroids.matrix))
    return found.select("query_id", "document_id", "rank", F.round("score", 6).alias("score"))


@R.add(f"""WITH {VECTOR_SQL},
scored AS (SELECT query_id, document_id, greatest(0, least(1, 1 / (1 + list_distance(vector, q_vector)))) AS score FROM corpus, vq WHERE vector IS NOT NULL AND level <= q_level)
SELECT query_id, document_id, round(score, 6) AS score FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) <= 5""")
def vector_topk_euclidean(spark, sf_dir):
    found = search.vector_search(corpus(spark, sf_dir), vector_queries(spark, sf_dir), 5, DIMENSION, metric="euclidean")
    return found.select("query_id", "document_id", F.round("score", 6).alias("score"))


@R.add(f"""WITH {DOCS_SQL}, {KEYWORD_SQL} SELECT query_id, document_id, rank, round(score, 6) AS score FROM kfound WHERE rank < 10""")
def keyword_topk(spark, sf_dir):
    found = search.keyword_search(documents(spark, sf_dir), text_queries(spark, sf_dir), 10)
    return found.select("query_id", "document_id", "rank", F.round("score", 6).alias("score"))


FILTERS = [
    (0, [("language", "eq", "de")]), (1, [("source_group", "gte", "src3"), ("source_group", "lte", "src5")]),
    (2, [("classification_clearance", "eq", "public"), ("language", "eq", "fr")]), (3, []), (4, [("missing", "eq", "x")]),
]


@R.add(f"""WITH {DOCS_SQL}, hits AS (
  SELECT 0 AS query_id, document_id, chunk_id FROM docs WHERE language = 'de' AND level <= 2
  UNION ALL SELECT 1, document_id, chunk_id FROM docs WHERE source BETWEEN 'src3' AND 'src5' AND level <= 2
  UNION ALL SELECT 2, document_id, chunk_id FROM docs WHERE level = 0 AND language = 'fr')
SELECT query_id::BIGINT AS query_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY document_id, chunk_id) - 1 AS rank, 1.0::DOUBLE AS score
FROM hits QUALIFY rank < 25""")
def metadata_search(spark, sf_dir):
    asked = spark.createDataFrame(FILTERS, "query_id long, filters array<struct<field:string,operator:string,value:string>>")
    asked = asked.withColumn("q_clearance", F.lit("confidential")).withColumn("q_tenant", F.lit(""))
    return search.metadata_search(documents(spark, sf_dir), asked, 25).select("query_id", "document_id", "rank", "score")


@R.add("""SELECT count(*) FILTER (WHERE n_chars >= 1000 AND n_chars <= 3000) AS numeric_range, count(*) FILTER (WHERE CAST(n_chars AS VARCHAR) >= '1000' AND CAST(n_chars AS VARCHAR) <= '3000') AS text_range FROM documents""")
def range_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("metadata", F.create_map(F.lit("n_chars"), F.col("n_chars").cast("string")))
    wanted = F.array(*(F.struct(F.lit("n_chars").alias("field"), F.lit(op).alias("operator"), F.lit(v).alias("value")) for op, v in (("gte", "1000"), ("lte", "3000"))))
    return rows.agg(F.count_if(search.matches(rows, wanted, numeric=True)).alias("numeric_range"), F.count_if(search.matches(rows, wanted)).alias("text_range"))


@R.add(f"""WITH {DOCS_SQL} SELECT source, count(*) AS visible FROM docs WHERE level <= 2 AND tenant_id = 'tenant-1' GROUP BY source""")
def clearance_and_tenant(spark, sf_dir):
    rows = search.visible(documents(spark, sf_dir), search.allowed_clearances("confidential"), "tenant-1")
    return rows.groupBy("source").agg(F.count("*").alias("visible"))


@R.add(f"""WITH {DOCS_SQL} SELECT document_id, coalesce(nullif(CASE WHEN doc_id % 5 = 0 THEN '' ELSE source_path END, ''), '/' || document_id) AS source_path
FROM docs WHERE regexp_matches(content, '[^\\t-\\r \\x{{85}}\\p{{Z}}]')""")
def candidate_normalization(spark, sf_dir):
    rows = documents(spark, sf_dir).withColumn("source_path", F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("source_path")))
    found = rows.withColumns({"query_id": F.lit(0), "engine": F.lit("metadata"), "score": F.lit(1.0), "rank": F.lit(0)})
    return search.candidates(found).select("document_id", "source_path")


def both_engines(spark: SparkSession, sf_dir: str, limit: int = 20) -> DataFrame:
    """Vector and keyword candidates of the same queries: numbers of benchmark texts, vectors of their number times 50."""
    vectors = vector_queries(spark, sf_dir).withColumn("query_id", F.expr("query_id div 50"))
    rows = corpus(spark, sf_dir)
    found = search.candidates(search.vector_search(rows, vectors, limit, DIMENSION))
    return found.unionByName(search.candidates(search.keyword_search(rows.drop("vector"), text_queries(spark, sf_dir), limit)))


BOTH_SQL = VECTOR_SQL + "," + KEYWORD_SQL + """,
found AS (
  SELECT query_id // 50 AS query_id, 'vector' AS engine, 0 AS place, document_id, chunk_id, source_path, content, greatest(0, least(1, score)) AS score, rank FROM vfound WHERE rank < 20 AND regexp_matches(content, '[^\\t-\\r \\x{85}\\p{Z}]')
  UNION ALL SELECT query_id, 'keyword', 1, document_id, chunk_id, source_path, content, score, rank FROM kfound WHERE rank < 20 AND regexp_matches(content, '[^\\t-\\r \\x{85}\\p{Z}]'))"""


@R.add(f"""WITH {BOTH_SQL} SELECT query_id, document_id, engine, round(score, 6) AS score FROM found
QUALIFY row_number() OVER (PARTITION BY query_id, document_id, chunk_id ORDER BY round(score, 9) DESC, place, rank) = 1""")
def candidate_dedupe(spark, sf_dir):
    best = search.best_of_engines(both_engines(spark, sf_dir).withColumn("score", F.round("score", 9)))
    return best.select("query_id", "document_id", "engine", F.round("score", 6).alias("score"))


@R.add(f"""WITH {BOTH_SQL} SELECT query_id, engine, count(*) AS candidates FROM found GROUP BY ALL""")
def source_counts(spark, sf_dir):
    return fusion.source_counts(both_engines(spark, sf_dir))


FUSED_SQL = BOTH_SQL + """,
fused AS (
  SELECT query_id, document_id, chunk_id, any_value(source_path) AS source_path, any_value(content) AS content, sum(1.0::DOUBLE / (61 + rank) ORDER BY place, rank) AS fusion_score, max(score) AS best_score,
         coalesce(max(score) FILTER (WHERE engine = 'vector'), 0) AS semantic, coalesce(max(score) FILTER (WHERE engine = 'keyword'), 0) AS lexical,
         list(DISTINCT engine) AS engines, count(*) AS evidence
  FROM found GROUP BY query_id, document_id, chunk_id)"""


@R.add(f"""WITH {FUSED_SQL} SELECT query_id, 'ko-' || document_id || '-' || chunk_id AS knowledge_id, evidence, len(engines) AS engines, round(fusion_score, 6) AS fusion_score, round(best_score, 6) AS best_score FROM fused""")
def rrf_fusion(spark, sf_dir):
    fused = fusion.fuse(both_engines(spark, sf_dir))
    return fused.select("query_id", "knowledge_id", F.size("evidence").alias("evidence"), F.size("engines").alias("engines"), F.round("fusion_score", 6).alias("fusion_score"), F.round("best_score", 6).alias("best_score"))


@R.add(f"""WITH {BOTH_SQL} SELECT query_id, 'ko-' || document_id AS knowledge_id, round(sum(1.0::DOUBLE / (61 + rank) ORDER BY place, rank), 6) AS fusion_score FROM found GROUP BY query_id, document_id""")
def rrf_by_document(spark, sf_dir):
    return fusion.fuse(both_engines(spark, sf_dir), "document").select("query_id", "knowledge_id", F.round("fusion_score", 6).alias("fusion_score"))


STOP_SQL = "[" + ", ".join(f"'{w}'" for w in fusion.STOP_WORDS) + "]"
TERMS_SQL = f"list_distinct(list_filter(regexp_extract_all(lower(query), '[a-z0-9]+'), lambda t: length(t) > 1 AND NOT list_contains({STOP_SQL}, t)))"


@R.add(f"""WITH q AS (SELECT item_id AS query_id, coalesce(text, '') AS query FROM benchmark) SELECT query_id, unnest({TERMS_SQL}) AS term FROM q""")
def distinctive_terms(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark")
    return rows.select(F.col("item_id").alias("query_id"), F.explode(fusion.coverage_terms(F.col("text"))).alias("term"))


RANKED_SQL = FUSED_SQL + f""",
factors AS (
  SELECT fused.*, coalesce({TERMS_SQL}, []) AS query_terms,
         lower(source_path || '  ' || coalesce(content, '')) AS haystack, fusion_score / max(fusion_score) OVER (PARTITION BY query_id) AS fusion
  FROM fused JOIN tq USING (query_id)),
covered AS (
  SELECT *, CASE WHEN len(query_terms) = 0 THEN 1.0::DOUBLE ELSE len(list_filter(query_terms, lambda t: contains(haystack, t))) / len(query_terms) END AS coverage FROM factors),
composed AS (SELECT *, round_even(semantic * 0.35::DOUBLE + lexical * 0.2::DOUBLE + 0.0::DOUBLE * 0.1::DOUBLE + fusion * 0.1::DOUBLE + coverage * 0.25::DOUBLE, 6) AS composite FROM covered),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY composite DESC, best_score DESC, document_id, chunk_id) AS place FROM composed)"""


def ranked_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = text_queries(spark, sf_dir).select("query_id", fusion.coverage_terms(F.col("query")).alias("query_terms"))
    return fusion.rank(fusion.fuse(both_engines(spark, sf_dir)).join(terms, "query_id"))


@R.add(f"""WITH {RANKED_SQL} SELECT query_id, place AS rank, document_id, composite, round(coverage, 6) AS coverage, round(fusion, 6) AS fusion FROM ranked WHERE place <= 10""")
def rank_composite(spark, sf_dir):
    rows = ranked_objects(spark, sf_dir)
    return rows.select("query_id", "rank", "document_id", "composite", F.round("coverage", 6).alias("coverage"), F.round("fusion", 6).alias("fusion"))


BUDGET = assembly.AssemblyPolicy(max_tokens=1500, max_objects=5, min_relevance=0.2)


@R.add(f"""WITH RECURSIVE {RANKED_SQL},
items AS (
  SELECT query_id, place, composite, trim(regexp_replace(content, '[\\t-\\r \\x{{85}}\\p{{Z}}]+', ' ', 'g')) AS text FROM ranked WHERE place <= 10),
sized AS (SELECT *, CASE WHEN text = '' THEN 0 ELSE greatest(1, length(text) // 4) END AS tokens, count(*) OVER (PARTITION BY query_id) AS considered FROM items),
walk AS (
  SELECT query_id, 0::BIGINT AS place, 0::BIGINT AS total, 0::BIGINT AS chosen, 0::BIGINT AS budget, 0::BIGINT AS copies, 0::BIGINT AS low, []::VARCHAR[] AS seen, any_value(considered) AS considered FROM sized GROUP BY query_id
  UNION ALL
  SELECT w.query_id, s.place,
         w.total + CASE WHEN s.composite >= 0.2 AND NOT list_contains(seen, text) AND chosen < 5 AND (chosen = 0 OR w.total + tokens <= 1500) THEN tokens ELSE 0 END,
         w.chosen + CASE WHEN s.composite >= 0.2 AND NOT list_contains(seen, text) AND chosen < 5 AND (chosen = 0 OR w.total + tokens <= 1500) THEN 1 ELSE 0 END,
         w.budget + CASE WHEN s.composite >= 0.2 AND NOT list_contains(seen, text) AND NOT (chosen < 5 AND (chosen = 0 OR w.total + tokens <= 1500)) THEN 1 ELSE 0 END,
         w.copies + CASE WHEN s.composite >= 0.2 AND list_contains(seen, text) THEN 1 ELSE 0 END,
         w.low + CASE WHEN s.composite < 0.2 THEN 1 ELSE 0 END,
         CASE WHEN s.composite >= 0.2 AND NOT list_contains(seen, text) AND chosen < 5 AND (chosen = 0 OR w.total + tokens <= 1500) THEN list_append(seen, text) ELSE seen END, w.considered
  FROM walk w JOIN sized s ON s.query_id = w.query_id AND s.place = w.place + 1)
SELECT query_id, considered, chosen AS selected_count, total AS total_tokens, budget AS dropped_for_budget, copies AS dropped_duplicates, low AS dropped_below_relevance FROM walk WHERE place = considered""")
def context_selection(spark, sf_dir):
    rows = assembly.select_context(ranked_objects(spark, sf_dir), BUDGET)
    return rows.select("query_id", "considered", "selected_count", "total_tokens", "dropped_for_budget", "dropped_duplicates", "dropped_below_relevance")


def hash_vector(text):
    return V.hash_embedding(text, DIMENSION)


@R.add()
def retrieve(spark, sf_dir):
    """The whole retrieval plan for every benchmark text, against the corpus and its vectors."""
    asked = text_queries(spark, sf_dir).select("query_id", "query", "q_clearance", "q_tenant", hash_vector(F.col("query")).alias("q_vector"))
    found = plan.retrieve(corpus(spark, sf_dir), asked, DIMENSION)
    return found.select("query_id", "position", "document_id", "source_path", F.round("relevance", 6).alias("relevance"), "tokens", "redactions")


@R.add()
def retrieve_audit(spark, sf_dir):
    asked = text_queries(spark, sf_dir).select("query_id", "query", "q_clearance", "q_tenant", hash_vector(F.col("query")).alias("q_vector"))
    return plan.audit_rows(plan.retrieve(corpus(spark, sf_dir), asked, DIMENSION))


# --- understanding ---------------------------------------------------------------

VOCABULARY = understanding.Vocabulary(
    acronyms={"api": "application programming interface", "sla": "service level agreement"}, synonyms={"the": ["article"], "policy": ["rule", "guideline"]}, products={"blue whale": "blue-whale"}
)


def asked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark sentences dressed up with filters, quotes, acronyms and intents, by their number."""
    rows = table(spark, sf_dir, "benchmark")
    dressed = [" compare API policy", " latest guide after:2024", ' how to "Blue Whale" product:Tools', " gdpr audit 2024-05-01 costs 12.5", ""]
    extra = F.get(F.array(*map(F.lit, dressed)), (F.col("item_id") % len(dressed)).cast("int"))
    return rows.select(F.col("item_id").alias("query_id"), F.concat(whole_text(), extra).alias("query"))


ASKED_SQL = """asked AS (
  SELECT item_id AS query_id, coalesce(text, '') || [' compare API policy', ' latest guide after:2024', ' how to "Blue Whale" product:Tools', ' gdpr audit 2024-05-01 costs 12.5', ''][item_id % 5 + 1] AS query FROM benchmark),
normal AS (SELECT *, trim(regexp_replace(regexp_replace(query, '\\b([a-zA-Z_][a-zA-Z0-9_]*):([^\\s]+)', ' ', 'g'), '\\s+', ' ', 'g')) AS normalized_query FROM asked)"""


@R.add(f"""WITH {ASKED_SQL} SELECT query_id, normalized_query,
  list_distinct(regexp_extract_all(query, '\\b(\\d{{4}}-\\d{{2}}-\\d{{2}}|\\d{{4}})\\b', 1))[1] AS first_date,
  len(list_distinct(regexp_extract_all(normalized_query, '\\b\\d+(?:\\.\\d+)?\\b'))) AS numbers,
  array_to_string(list_transform(regexp_extract_all(query, '\\b([a-zA-Z_][a-zA-Z0-9_]*):([^\\s]+)', 1), lambda f: CASE lower(f) WHEN 'product' THEN 'source_group' ELSE lower(f) END), ',')
    || CASE WHEN contains(lower(query), 'blue whale') AND NOT contains(query, 'product:') THEN 'source_group' ELSE '' END AS filter_fields,
  array_to_string(list_transform(regexp_extract_all(query, '\\b([a-zA-Z_][a-zA-Z0-9_]*):([^\\s]+)', 2), lambda v: CASE WHEN contains(query, 'product:') THEN lower(v) ELSE v END), ',') AS filter_values,
  CASE WHEN contains(query, ' API ') THEN 'application programming interface' ELSE '' END AS terms
FROM normal""")
def query_understanding(spark, sf_dir):
    rows = understanding.understood(asked_texts(spark, sf_dir), VOCABULARY)
    join = lambda c: F.array_join(c, ",")
    return rows.select(
        "query_id", "normalized_query", F.get("dates", F.lit(0)).alias("first_date"), F.size("numbers").alias("numbers"),
        join(F.transform("filters", lambda f: f["field"])).alias("filter_fields"), join(F.transform("filters", lambda f: f["value"])).alias("filter_values"), join("enterprise_terms").alias("terms"),
    )


INTENT_SQL = "CASE " + " ".join(
    f"WHEN {' OR '.join(f'contains(padded, $${s}$$)' for s in signals)} THEN '{name}'" for name, signals in understanding.INTENTS.items()
) + " ELSE 'research' END"


@R.add(f"""WITH {ASKED_SQL}, p AS (SELECT *, ' ' || lower(normalized_query) || ' ' AS padded FROM normal), i AS (SELECT *, {INTENT_SQL} AS intent FROM p)
SELECT query_id, intent, map_extract_value(map {{'exact_lookup': 'precision', 'navigation': 'precision', 'research': 'recall', 'discovery': 'recall', 'comparison': 'balanced', 'analytical': 'balanced', 'compliance': 'compliance'}}, intent) AS profile,
  map_extract_value(map {{'exact_lookup': 5, 'navigation': 5, 'research': 50, 'discovery': 50, 'comparison': 20, 'analytical': 20, 'compliance': 30}}, intent)::BIGINT AS candidate_count FROM i""")
def query_intent(spark, sf_dir):
    rows = understanding.classified(understanding.understood(asked_texts(spark, sf_dir), VOCABULARY))
    return rows.select("query_id", "intent", "profile", "candidate_count")


@R.add()
def query_plan(spark, sf_dir):
    plans = understanding.plan_queries(asked_texts(spark, sf_dir), VOCABULARY)
    return plans.select("query_id", "plan_id", "intent", "complexity", "confidence", "intent_confidence", F.array_join("engines", ",").alias("engines"), "ranking_strategy", "total_candidate_limit", F.array_join("enriched_terms", ",").alias("enriched_terms"))


@R.add(f"""WITH {ASKED_SQL}, p AS (SELECT *, ' ' || lower(normalized_query) || ' ' AS padded FROM normal), i AS (SELECT *, {INTENT_SQL} AS intent FROM p),
tasks AS (
  SELECT 'plan-' || query_id AS plan_id, 'vector' AS engine, 0 AS place FROM i UNION ALL SELECT 'plan-' || query_id, 'keyword', 1 FROM i
  UNION ALL SELECT 'plan-' || query_id, 'metadata', 2 FROM i WHERE intent = 'compliance' OR regexp_matches(query, '\\b([a-zA-Z_][a-zA-Z0-9_]*):([^\\s]+)') OR contains(lower(query), 'blue whale'))
SELECT plan_id, engine, plan_id || '-' || engine AS task_id, row_number() OVER (PARTITION BY plan_id ORDER BY place) AS position FROM tasks""")
def schedule_tasks(spark, sf_dir):
    asked = asked_texts(spark, sf_dir).withColumn("tenant_id", F.lit("tenant-0"))
    steps = understanding.plan_steps(understanding.plan_queries(asked, VOCABULARY))
    return search.schedule(steps).select("plan_id", "engine", "task_id", "position")


@R.add("""SELECT user_id AS session_id, count(*) AS workers, count(*) FILTER (WHERE event_type <> 'error') AS succeeded,
  CASE WHEN count(*) FILTER (WHERE event_type = 'error') = 0 THEN 'completed' WHEN count(*) FILTER (WHERE event_type <> 'error') = 0 THEN 'failed' ELSE 'partial' END AS status FROM events GROUP BY user_id""")
def session_status(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), (F.col("event_type") != "error").alias("succeeded"))
    return search.session_status(rows)


# --- masking ----------------------------------------------------------------------


@R.add("""WITH a AS (SELECT doc_id, text AS t, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) AS n0, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[REDACTED-EMAIL]', 'g') AS t1 FROM documents),
b AS (SELECT *, len(regexp_extract_all(t1, '\\b\\d{3}-\\d{2}-\\d{4}\\b')) AS n1, regexp_replace(t1, '\\b\\d{3}-\\d{2}-\\d{4}\\b', '[REDACTED-SSN]', 'g') AS t2 FROM a),
c AS (SELECT *, len(regexp_extract_all(t2, '\\b(?:\\d[ -]?){13,16}\\b')) AS n2, regexp_replace(t2, '\\b(?:\\d[ -]?){13,16}\\b', '[REDACTED-CARD]', 'g') AS t3 FROM b),
d AS (SELECT *, len(regexp_extract_all(t3, '\\b(?:\\+?\\d{1,2}[ -]?)?\\(?\\d{3}\\)?[ -]?\\d{3}[ -]?\\d{4}\\b')) AS n3, regexp_replace(t3, '\\b(?:\\+?\\d{1,2}[ -]?)?\\(?\\d{3}\\)?[ -]?\\d{3}[ -]?\\d{4}\\b', '[REDACTED-PHONE]', 'g') AS t4 FROM c)
SELECT doc_id, (n0 + n1 + n2 + n3)::BIGINT AS redactions, sha256(replace(t4, ' ', '')) AS masked_sha256 FROM d""")
def mask_chat(spark, sf_dir):
    """Digests leave spaces out: whether one after a card number goes with it hangs on Unicode word bounds, which SQL lacks."""
    rows = governance.mask_chat(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content")))
    return rows.select("doc_id", "redactions", F.sha2(F.replace("content", F.lit(" ")), 256).alias("masked_sha256"))


@R.add()
def mask_retrieval_luhn(spark, sf_dir):
    rows = governance.mask_retrieval(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content")))
    return rows.select("doc_id", "redactions", F.sha2("content", 256).alias("masked_sha256"))
