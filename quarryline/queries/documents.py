"""Change detection, text, Markdown, profiles, chunks, embeddings and publication."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import text as X
from quarryline.functions import vectors as V
from quarryline.operators import changes, chunking, evaluation, lineage, markdown, profile, publishing
from quarryline.plans import ingestion
from quarryline.queries.common import CORPUS_SQL, DIMENSION, DOCS_SQL, LEVELS, SQL_WORD, Registry, corpus, documents, table
from quarryline.session import new_folder
from quarryline.sources import bucketed, files, stores
from quarryline.streaming import mirror

R = Registry()

# --- snapshots ---------------------------------------------------------------------


def twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir)
    return rows.select(F.concat(F.lit("d"), "document_id").alias("document_id"), "source_path", X.sha256(F.col("content")).alias("content_hash"), F.col("doc_id").alias("position"))


def second_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth document gone, others changed, renamed, moved or new."""
    rows = documents(spark, sf_dir).where("doc_id % 10 <> 0")
    kind = F.col("doc_id") % 10
    path = (
        F.when(kind == 2, F.concat("source", F.lit("/renamed-"), "document_id", F.lit(".md")))
        .when(kind == 3, F.concat(F.lit("archive/"), "document_id", F.lit(".md")))
        .when(kind == 4, F.concat(F.lit("new/"), "document_id", F.lit(".md")))
        .otherwise(F.col("source_path"))
    )
    text = F.when(kind == 1, F.concat("content", F.lit("x"))).when(kind == 4, F.concat("document_id", F.lit(" is new"))).otherwise(F.col("content"))
    return rows.select(path.alias("source_path"), X.sha256(text).alias("content_hash"), F.octet_length(text).cast("long").alias("size_bytes"), F.col("doc_id").alias("position"))


SNAPSHOT_SQL = DOCS_SQL + """,
twins AS (SELECT 'd' || document_id AS document_id, source_path, sha256(content) AS content_hash, doc_id AS position FROM docs),
inventory AS (
  SELECT CASE doc_id % 10 WHEN 2 THEN source || '/renamed-' || doc_id || '.md' WHEN 3 THEN 'archive/' || doc_id || '.md' WHEN 4 THEN 'new/' || doc_id || '.md' ELSE source_path END AS source_path,
         sha256(CASE doc_id % 10 WHEN 1 THEN content || 'x' WHEN 4 THEN doc_id || ' is new' ELSE content END) AS content_hash, doc_id AS position
  FROM docs WHERE doc_id % 10 <> 0),
fresh AS (SELECT i.* FROM inventory i ANTI JOIN twins t USING (source_path)),
gone AS (SELECT t.* FROM twins t ANTI JOIN inventory i USING (source_path)),
pairs AS (
  SELECT f.source_path, g.document_id, g.source_path AS previous_path
  FROM (SELECT content_hash, arg_min(source_path, position) AS source_path FROM fresh GROUP BY 1) f
  JOIN (SELECT content_hash, arg_max(document_id, position) AS document_id, arg_max(source_path, position) AS source_path FROM gone GROUP BY 1) g USING (content_hash)),
diff AS (
  SELECT CASE WHEN i.content_hash = t.content_hash THEN 'unchanged' ELSE 'modified' END AS change_type, source_path, t.document_id, NULL AS previous_path FROM inventory i JOIN twins t USING (source_path)
  UNION ALL
  SELECT CASE WHEN p.document_id IS NULL THEN 'created' WHEN regexp_replace(f.source_path, '/[^/]*$', '') = regexp_replace(p.previous_path, '/[^/]*$', '') THEN 'renamed' ELSE 'moved' END, source_path, p.document_id, p.previous_path
  FROM fresh f LEFT JOIN pairs p USING (source_path)
  UNION ALL
  SELECT 'deleted', g.source_path, g.document_id, NULL FROM gone g ANTI JOIN pairs p USING (document_id))"""


def difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.snapshot_diff(second_snapshot(spark, sf_dir), twins(spark, sf_dir))


@R.add(f"WITH {SNAPSHOT_SQL} SELECT * FROM diff")
def snapshot_diff(spark, sf_dir):
    return difference(spark, sf_dir).select("change_type", "source_path", "document_id", "previous_path")


LISTED_AT = datetime(2024, 1, 1)


@R.add(f"WITH {SNAPSHOT_SQL} SELECT * FROM diff")
def mirror_changes(spark, sf_dir):
    """The second snapshot as a stream of observations, in files of mixed order, against the first one as the known state."""
    listed = second_snapshot(spark, sf_dir).withColumn("gone", F.lit(False)).withColumn("at", F.lit(LISTED_AT) + F.make_dt_interval(secs=(F.col("position") % 600).cast("decimal(18,6)")))
    columns = [f.name for f in spark.createDataFrame([], mirror.OBSERVATION).schema]
    folder = new_folder(spark, "mirror")
    listed.select(*columns).repartition(8, F.xxhash64("source_path")).write.parquet(f"{folder}/observations")
    mirror.tick(spark, LISTED_AT + timedelta(days=1)).coalesce(1).write.mode("append").parquet(f"{folder}/observations")
    found = mirror.replay(twins(spark, sf_dir), folder, complete_ms=int((LISTED_AT + timedelta(minutes=20)).replace(tzinfo=UTC).timestamp() * 1000))
    return found.select("change_type", "source_path", "document_id", "previous_path")


@R.add(f"""WITH {SNAPSHOT_SQL},
left_paths AS (SELECT CASE change_type WHEN 'deleted' THEN source_path ELSE previous_path END AS path FROM diff WHERE change_type IN ('deleted', 'moved', 'renamed')),
above AS (SELECT path, array_to_string(string_split(path, '/')[1:d], '/') AS folder FROM (SELECT path, unnest(range(1, len(string_split(path, '/')))) AS d FROM left_paths)),
live AS (SELECT DISTINCT array_to_string(string_split(source_path, '/')[1:d], '/') AS folder FROM (SELECT source_path, unnest(range(1, len(string_split(source_path, '/')))) AS d FROM diff WHERE change_type <> 'deleted'))
SELECT DISTINCT folder FROM above ANTI JOIN live USING (folder)""")
def pruned_folders(spark, sf_dir):
    """Folders that the changes to the second snapshot left without any file."""
    found = difference(spark, sf_dir)
    after = found.where("change_type <> 'deleted'").select("source_path", F.lit("active").alias("status"))
    return mirror.pruned_folders(found, after)


@R.add(f"WITH {SNAPSHOT_SQL} SELECT change_type, count(*) AS n FROM diff GROUP BY 1")
def change_counts(spark, sf_dir):
    return changes.change_counts(difference(spark, sf_dir))


@R.add(f"""WITH {SNAPSHOT_SQL}, known AS (SELECT *, 1 AS version FROM twins)
SELECT status, version, count(*) AS n FROM (
  SELECT CASE WHEN d.change_type = 'deleted' THEN 'deleted' ELSE 'active' END AS status, (CASE WHEN d.change_type = 'modified' THEN 2 ELSE 1 END)::BIGINT AS version FROM known k JOIN diff d USING (document_id)
  UNION ALL SELECT 'active', 1 FROM diff WHERE change_type = 'created') GROUP BY ALL""")
def apply_changes(spark, sf_dir):
    known = twins(spark, sf_dir).select("document_id", "source_path", "content_hash", F.lit(1).alias("version"), F.lit("active").alias("status"))
    after = changes.apply_changes(known, difference(spark, sf_dir))
    return after.groupBy("status", "version").agg(F.count("*").alias("n"))


@R.add(f"WITH {DOCS_SQL} SELECT lower(source) AS source_group, 'md' AS extension, count(*) AS n FROM docs GROUP BY 1")
def source_groups(spark, sf_dir):
    path = F.col("source_path")
    return documents(spark, sf_dir).groupBy(changes.source_group(path).alias("source_group"), files.extension(path).alias("extension")).agg(F.count("*").alias("n"))


@R.add(f"""WITH {DOCS_SQL} SELECT count(*) FILTER (WHERE doc_id % 4 = 3 AND length(content) <= 4000) AS included, count(*) FILTER (WHERE doc_id % 4 = 0) AS hidden, count(*) FILTER (WHERE doc_id % 4 IN (1, 2)) AS temporary FROM docs""")
def file_policy(spark, sf_dir):
    name = F.concat(F.get(F.array(*map(F.lit, (".git/", "a/~$", "b/c~tmp.tmp-", "d/"))), (F.col("doc_id") % 4).cast("int")), "document_id", F.get(F.array(*map(F.lit, (".md", ".MD", ".tmp", ".Md"))), (F.col("doc_id") % 4).cast("int")))
    rows = documents(spark, sf_dir).select(name.alias("source_path"), F.length("content").alias("size_bytes"))
    policy = files.FilePolicy(extensions=("md",), max_bytes=4000)
    return rows.agg(
        F.count_if(files.included(policy)).alias("included"), F.count_if(files.is_hidden(F.col("source_path"))).alias("hidden"),
        F.count_if(files.is_temporary(F.col("source_path"))).alias("temporary"),
    )


@R.add(f"WITH {DOCS_SQL} SELECT doc_id, 'sha256:' || sha256(content) AS content_hash, row_number() OVER (PARTITION BY content ORDER BY doc_id) > 1 AS is_copy FROM docs WHERE content IS NOT NULL")
def content_hash_dedupe(spark, sf_dir):
    rows = documents(spark, sf_dir).where("content IS NOT NULL")
    return chunking.content_copies(rows, "content", "doc_id").select("doc_id", "content_hash", "is_copy")


@R.add("""WITH v AS (SELECT user_id AS key, event_id AS version, md5(event_type) AS content_hash FROM events)
SELECT key, max(version) AS version, arg_max(content_hash, version) AS content_hash FROM v GROUP BY key""")
def latest_version(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("version"), F.md5(F.col("event_type").cast("binary")).alias("content_hash"))
    return changes.latest(rows, ["key"], F.col("version"))


# --- text ---------------------------------------------------------------------------


@R.add(f"""SELECT doc_id, len(regexp_extract_all(text, '{SQL_WORD}')) AS tokens, round_even(len(regexp_extract_all(text, '{SQL_WORD}')) / 200.0::DOUBLE * 60.0::DOUBLE, 2) AS reading_seconds,
  CASE WHEN length(coalesce(text, '')) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS char_tokens FROM documents WHERE text IS NOT NULL""")
def token_stats(spark, sf_dir):
    tokens = X.word_count(F.col("text"))
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return rows.select("doc_id", tokens.alias("tokens"), X.reading_seconds(tokens).alias("reading_seconds"), X.char_tokens(F.col("text")).alias("char_tokens"))


@R.add("""WITH n AS (
  SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '\\r\\n?', chr(10), 'g'), '[\\x00-\\x08\\x0b-\\x1f\\x7f-\\x9f\\x{ad}\\p{Cf}]', '', 'g'),
         '[\\t\\x0b-\\r \\x{85}\\p{Z}]+\\n', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\n+|[\\t-\\r \\x{85}\\p{Z}]+$', '', 'g') AS body
  FROM (SELECT doc_id, '  ' || text || '  ' || chr(13) || chr(10) || chr(10) || chr(10) || 'end' || chr(7) AS text FROM documents WHERE text IS NOT NULL))
SELECT doc_id, sha256(body || chr(10)) AS normalized_sha256 FROM n""")
def normalize_text(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    dirty = F.concat(F.lit("  "), "text", F.lit("  \r\n\n\nend\u0007"))
    return rows.select("doc_id", F.sha2(X.normalize_text(dirty), 256).alias("normalized_sha256"))


# --- profiles -----------------------------------------------------------------------


def hits_sql(words: list[str]) -> str:
    return f"len(list_filter(w, lambda x: list_contains([{', '.join(repr(x) for x in words)}], x)))"


LANGUAGE_SQL = f"""w AS (SELECT doc_id, lang, list_transform(regexp_extract_all(text, '[a-zA-Z\\x{{c0}}-\\x{{24f}}]+'), lambda x: lower(x)) AS w FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, lang, {", ".join(f"{hits_sql(v)} AS {k}" for k, v in profile.LANGUAGE_WORDS.items())} FROM w),
d AS (SELECT doc_id, lang, CASE WHEN greatest(en, de, fr, es) = 0 THEN 'en' WHEN en = greatest(en, de, fr, es) THEN 'en' WHEN de = greatest(de, fr, es) THEN 'de' WHEN fr = greatest(fr, es) THEN 'fr' ELSE 'es' END AS detected FROM h)"""


@R.add(f"WITH {LANGUAGE_SQL} SELECT doc_id, detected FROM d")
def language_detect(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return rows.select("doc_id", profile.language(F.col("text")).alias("detected"))


@R.add(f"WITH {LANGUAGE_SQL} SELECT lang, count(*) AS n, count(*) FILTER (WHERE detected = lang) AS correct FROM d GROUP BY lang")
def language_accuracy(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("lang", profile.language(F.col("text")).alias("detected"))
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("detected") == F.col("lang")).alias("correct"))


CATEGORY_SQL = "CASE " + " ".join(f"WHEN regexp_matches(t, '(?i){p}') THEN '{name}'" for name, p in profile.CATEGORIES.items()) + " ELSE 'general' END"


@R.add(f"""WITH t AS (SELECT doc_id, text || ['', ' maintenance plan', ' the API spec', ' policies', ' step 3', ' user manual'][doc_id % 6 + 1] AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, {CATEGORY_SQL} AS category FROM t""")
def category(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    extra = F.get(F.array(*map(F.lit, ("", " maintenance plan", " the API spec", " policies", " step 3", " user manual"))), (F.col("doc_id") % 6).cast("int"))
    return rows.select("doc_id", profile.category(F.concat("text", extra)).alias("category"))


COUNTED = ["email_address", "national_id", "api_key", "secret"]
COUNT_SQL = {
    "email_address": r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+", "national_id": r"\b\d{3}-\d{2}-\d{4}\b",
    "api_key": r"(?i)\b(?:api[_-]?key|access[_-]?token)\b\s*[:=]\s*\S+", "secret": r"(?i)\b(?:password|passwd|secret|client[_-]?secret)\b\s*[:=]\s*\S+",
}


@R.add("SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{p}')) AS {n}" for n, p in COUNT_SQL.items()) + " FROM documents WHERE text IS NOT NULL")
def sensitive_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    counts = profile.sensitive_counts(F.col("text"))
    return rows.select("doc_id", *(counts[n].alias(n) for n in COUNTED))


@R.add()
def sensitive_findings(spark, sf_dir):
    """Of all texts and kinds, with card numbers and phones."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(profile.findings(F.col("text"))).alias("f"))
    return rows.select("doc_id", "f.finding_type", "f.count")


# --- Markdown --------------------------------------------------------------------------


def markdown_text(number, body, size):
    """A document with front matter, headings, a table, a list, a note, code and a figure around its text."""
    lit = F.lit
    n, ragged = number.cast("string"), F.when(number % 5 == 0, "\n| loose |").otherwise("")
    deep = F.when(number % 3 == 0, "\n\n#### Details\n\nSee step 2.").otherwise("")
    return F.concat(
        lit("---\ntitle: Report "), n, lit('\nlanguage: en\nsource_type: txt\n---\n# Report '), n, lit("\n\n"), F.regexp_replace(body, r"\n", "\n\n"),
        lit("\n\n## Data\n\n| id | size |\n| --- | --- |\n| AB-"), n, lit(" | "), size.cast("string"), lit(" |"), ragged,
        lit("\n\n## Steps\n\n1. Open\n2. Close\n\n> Warning: hot\n\n```sql\nSELECT 1\n```\n\n![plot]("), n, lit(".png)"), deep, lit("\n\n#tag line\n"),
    )


def markdown_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).where("content IS NOT NULL")
    text = markdown_text(F.col("doc_id"), F.col("content"), F.length("content"))
    return markdown.with_structure(rows.select("doc_id", "document_id", "source_path", "tenant_id", "classification_clearance", "source", text.alias("text")))


PLAIN_SQL = "content IS NOT NULL"


@R.add(f"""WITH {DOCS_SQL} SELECT document_id, section_id, title, level::BIGINT AS level, parent_id, breadcrumb FROM (
  SELECT document_id, doc_id, unnest([
    {{'section_id': 'SEC-1', 'title': 'Report ' || doc_id, 'level': 1, 'parent_id': NULL, 'breadcrumb': 'Report ' || doc_id}},
    {{'section_id': 'SEC-2', 'title': 'Data', 'level': 2, 'parent_id': 'SEC-1', 'breadcrumb': 'Report ' || doc_id || ' > Data'}},
    {{'section_id': 'SEC-3', 'title': 'Steps', 'level': 2, 'parent_id': 'SEC-1', 'breadcrumb': 'Report ' || doc_id || ' > Steps'}},
    {{'section_id': 'SEC-4', 'title': 'Details', 'level': 4, 'parent_id': 'SEC-3', 'breadcrumb': 'Report ' || doc_id || ' > Steps > Details'}}], recursive := true) FROM docs WHERE {PLAIN_SQL})
WHERE section_id <> 'SEC-4' OR doc_id % 3 = 0""")
def breadcrumbs(spark, sf_dir):
    return markdown.section_rows(markdown_docs(spark, sf_dir), "document_id").select("document_id", "section_id", "title", "level", "parent_id", "breadcrumb")


@R.add()
def markdown_blocks(spark, sf_dir):
    rows = markdown.block_rows(markdown_docs(spark, sf_dir), "document_id")
    return rows.select("document_id", "position", "block_type", "section_id", "level", X.sha256(F.col("text")).alias("text_sha256"), X.sha256(markdown.render_block(F.struct("block_type", "text", "level", "language", "table_rows"))).alias("rendered_sha256"))


@R.add(f"""WITH {DOCS_SQL} SELECT document_id, (CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END)::BIGINT AS rows, 2::BIGINT AS columns, 1.0::DOUBLE AS header_confidence, true AS contains_ids, true AS contains_numeric, false AS contains_dates,
  (CASE WHEN doc_id % 3 = 0 THEN 'high' ELSE 'low' END) AS complexity, (CASE WHEN doc_id % 3 = 0 THEN 85 ELSE 100 END)::BIGINT AS structure_score, (CASE WHEN doc_id % 5 = 0 THEN 75 ELSE 100 END)::BIGINT AS table_score,
  round_even(((CASE WHEN doc_id % 3 = 0 THEN 85 ELSE 100 END) + 100 + (CASE WHEN doc_id % 5 = 0 THEN 75 ELSE 100 END) + 100) / 4.0::DOUBLE, 0)::BIGINT AS quality, 'Report ' || doc_id AS primary_topic
FROM docs WHERE {PLAIN_SQL}""")
def document_profile(spark, sf_dir):
    rows = profile.profiled(markdown_docs(spark, sf_dir)).withColumn("t", F.get("tables", F.lit(0)))
    return rows.select("document_id", "t.rows", "t.columns", "t.header_confidence", "t.contains_ids", "t.contains_numeric", "t.contains_dates", "complexity", "structure_score", "table_score", "quality", "primary_topic")


@R.add(f"""WITH {DOCS_SQL} SELECT document_id, s AS section_id, s = 'SEC-2' AS contains_table, s = 'SEC-3' AS contains_image, s = 'SEC-3' AS contains_code, s = 'SEC-3' AS contains_warning
FROM (SELECT document_id, doc_id, unnest(['SEC-1', 'SEC-2', 'SEC-3', 'SEC-4']) AS s FROM docs WHERE {PLAIN_SQL}) WHERE s <> 'SEC-4' OR doc_id % 3 = 0""")
def section_flags(spark, sf_dir):
    rows = profile.profiled(markdown_docs(spark, sf_dir))
    sections = rows.select("document_id", F.explode("section_stats").alias("s")).select("document_id", "s.*")
    return sections.select("document_id", "section_id", "contains_table", "contains_image", "contains_code", "contains_warning")


@R.add(f"""WITH {DOCS_SQL} SELECT document_id, '---' || chr(10) || 'document_id: ' || document_id || chr(10) || 'repository_id: ' || source || chr(10) || 'version: 1' || chr(10) || 'source_type: txt' || chr(10)
  || 'source_hash: "sha256:' || sha256(content) || '"' || chr(10) || 'language: ' || language || chr(10) || '---' AS front_matter FROM docs WHERE {PLAIN_SQL}""")
def front_matter(spark, sf_dir):
    rows = documents(spark, sf_dir).where(PLAIN_SQL)
    values = {
        "document_id": F.col("document_id"), "repository_id": F.col("source"), "version": F.lit(1), "source_type": F.lit("txt"),
        "source_hash": F.concat(F.lit("sha256:"), X.sha256(F.col("content"))), "language": F.col("language"),
    }
    return rows.select("document_id", markdown.render_front_matter(values).alias("front_matter"))


# --- chunks ------------------------------------------------------------------------------


def chunk_rows(spark: SparkSession, sf_dir: str, policy: chunking.ChunkPolicy) -> DataFrame:
    drafts = chunking.draft_rows(markdown_docs(spark, sf_dir), policy)
    valid, _ = chunking.split_failures(drafts)
    rows = chunking.chunks(valid)
    return rows.select("document_id", "chunk_id", "section_id", "heading_level", "token_count", "content_hash", "contains_table", "contains_code", "contains_image")


@R.add()
def chunk_semantic(spark, sf_dir):
    return chunk_rows(spark, sf_dir, chunking.ChunkPolicy(oversize="split"))


@R.add()
def chunk_token(spark, sf_dir):
    return chunk_rows(spark, sf_dir, chunking.ChunkPolicy(strategy="token", oversize="split"))


@R.add()
def chunk_recursive(spark, sf_dir):
    return chunk_rows(spark, sf_dir, chunking.ChunkPolicy(strategy="recursive"))


@R.add(f"""WITH {DOCS_SQL}, paragraphs AS (SELECT document_id, unnest(string_split(content, chr(10))) AS p FROM docs WHERE {PLAIN_SQL})
SELECT document_id, 'exceeds_token_budget' AS errors FROM paragraphs GROUP BY document_id HAVING max(len(regexp_extract_all(p, '{SQL_WORD}'))) + len(regexp_extract_all('> Context: Report ' || document_id, '{SQL_WORD}')) > 1024""")
def chunk_failures(spark, sf_dir):
    """Documents that fail as one paragraph is beyond the limit, when oversize paragraphs are kept."""
    drafts = chunking.draft_rows(markdown_docs(spark, sf_dir), chunking.ChunkPolicy())
    _, failed = chunking.split_failures(drafts)
    return failed.select("document_id", F.array_join("errors", ",").alias("errors"))


# --- embeddings and publication -----------------------------------------------------------

WORD_SQL = " + ".join(f"power(16, {7 - i}) * (strpos('0123456789abcdef', substr(digest, k * 8 + {i + 1}, 1)) - 1)" for i in range(8))


@R.add(f"""WITH d AS (SELECT item_id, c, sha256(c || ':' || CASE WHEN coalesce(text, '') = '' THEN chr(0) ELSE text END) AS digest FROM benchmark, (SELECT unnest(range(8)) AS c)),
v AS (SELECT item_id, c * 8 + k AS i, ({WORD_SQL}) / 4294967296.0::DOUBLE * 2.0::DOUBLE - 1.0::DOUBLE AS x FROM d, (SELECT unnest(range(8)) AS k)),
n AS (SELECT item_id, sqrt(sum(x * x)) AS norm FROM v GROUP BY 1)
SELECT item_id, i::BIGINT AS i, round(x / norm, 9) AS x FROM v JOIN n USING (item_id)""")
def hash_embedding(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(V.hash_embedding(F.col("text"), DIMENSION)).alias("i", "x"))
    return rows.select("item_id", "i", F.round("x", 9).alias("x"))


@R.add("""SELECT vec_id, CASE vec_id % 5 WHEN 1 THEN 'wrong_dimension' WHEN 2 THEN 'non_finite_value' WHEN 3 THEN 'zero_vector' WHEN 4 THEN 'empty_vector' ELSE '' END AS errors FROM embeddings""")
def vector_validation(spark, sf_dir):
    """Stored vectors, of which some are spoilt by their number."""
    kind, v = F.col("vec_id") % 5, V.doubles(F.col("embedding"))
    nan, zero = F.transform(v, lambda x, i: F.when(i == 3, float("nan")).otherwise(x)), F.transform(v, lambda x: F.lit(0.0))
    spoilt = F.when(kind == 1, F.slice(v, 1, 10)).when(kind == 2, nan).when(kind == 3, zero).when(kind == 4, F.slice(v, 1, 0)).otherwise(v)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(V.vector_errors(spoilt, DIMENSION), ",").alias("errors"))


@R.add(f"""WITH {DOCS_SQL}, cut AS (SELECT doc_id, regexp_extract_all(content, '{SQL_WORD}') AS w FROM docs WHERE {PLAIN_SQL})
SELECT doc_id, len(w) > 100 AS truncated, sha256(CASE WHEN len(w) > 100 THEN array_to_string(w[1:100], ' ') ELSE (SELECT text FROM documents d WHERE d.doc_id = cut.doc_id) END) AS input_sha256, round_even(least(len(w), 100) / 1000.0::DOUBLE * 0.02::DOUBLE, 6) AS cost FROM cut""")
def embedding_inputs(spark, sf_dir):
    rows = documents(spark, sf_dir).where(PLAIN_SQL)
    fitted = publishing.fit_to_context(rows, 100)
    return fitted.select("doc_id", "truncated", X.sha256(F.col("input")).alias("input_sha256"), publishing.cost(X.word_count(F.col("input")), 0.02).alias("cost"))


@R.add("SELECT label::BIGINT AS label, vec_id, ((row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 16)::BIGINT AS batch FROM embeddings")
def embedding_batches(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("label", "vec_id", publishing.batch_number(F.col("vec_id"), 16, "label").alias("batch"))


def point_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored embeddings as points of their documents."""
    rows = corpus(spark, sf_dir).where("vector IS NOT NULL")
    name = publishing.collection_name("kb", F.lit("local"), F.lit("Hash Model v2"), F.lit(DIMENSION))
    out = rows.withColumns({"collection": name, "embedding_version": F.lit(1), "dimension": F.size("vector"), "distance_metric": F.lit("cosine"), "embedding_model": F.lit("Hash Model v2")})
    return out.withColumn("vector_id", publishing.vector_id(F.col("collection"), F.col("document_id"), F.col("chunk_id"), F.col("embedding_version")))


@R.add(f"""WITH {CORPUS_SQL} SELECT document_id, 'kb__local__hash_model_v2__d64::' || document_id || '::CHK-000001::e1' AS vector_id, CASE WHEN doc_id % 11 = 0 THEN 'tenant_id' ELSE '' END || CASE WHEN doc_id % 13 = 0 THEN CASE WHEN doc_id % 11 = 0 THEN ',' ELSE '' END || 'dimension' ELSE '' END AS missing
FROM corpus WHERE vector IS NOT NULL""")
def publish_gate(spark, sf_dir):
    rows = point_rows(spark, sf_dir)
    rows = rows.withColumn("tenant_id", F.when(F.col("doc_id") % 11 == 0, " ").otherwise(F.col("tenant_id"))).withColumn("dimension", F.when(F.col("doc_id") % 13 == 0, 0).otherwise(F.col("dimension")))
    return rows.select("document_id", "vector_id", F.array_join(publishing.missing_fields(), ",").alias("missing"))


@R.add(f"""WITH {CORPUS_SQL} SELECT document_id, CASE WHEN doc_id % 7 = 0 THEN 'missing_vector' WHEN doc_id % 7 = 1 THEN 'dimension_mismatch' WHEN doc_id % 7 = 2 THEN 'collection_mismatch' WHEN doc_id % 7 = 3 THEN 'metadata_mismatch' END AS reason
FROM corpus WHERE vector IS NOT NULL""")
def publish_verify(spark, sf_dir):
    """Points read back after a publication that went wrong in known ways."""
    expected, k = point_rows(spark, sf_dir), F.col("doc_id") % 7
    stored = expected.where(k != 0).withColumns({
        "vector": F.when(k == 1, F.slice("vector", 1, 3)).otherwise(F.col("vector")), "collection": F.when(k == 2, "other").otherwise(F.col("collection")),
        "tenant_id": F.when(k == 3, "tenant-x").otherwise(F.col("tenant_id")),
    })
    checked = publishing.verify(expected, stored, "kb__local__hash_model_v2__d64", ["document_id", "chunk_id", "tenant_id"])
    return checked.select("document_id", "reason")


@R.add(f"""WITH {CORPUS_SQL} SELECT doc_id % 4 = 0 AS replaced, count(*) AS n, sum(len(vector))::BIGINT AS numbers FROM corpus WHERE vector IS NOT NULL GROUP BY 1""")
def upsert_vectors(spark, sf_dir):
    stored = point_rows(spark, sf_dir).withColumn("replaced", F.lit(False)).withColumn("position", F.col("doc_id"))
    incoming = stored.where("doc_id % 4 = 0").withColumn("replaced", F.lit(True))
    twice = incoming.unionByName(incoming.withColumn("position", F.col("position") - 1).withColumn("replaced", F.lit(False)))
    after = stores.upsert_vectors(stored, twice, DIMENSION)
    return after.groupBy("replaced").agg(F.count("*").alias("n"), F.sum(F.size("vector")).alias("numbers"))


def published_in_batches(spark: SparkSession, sf_dir: str, batch_rows: int = 1000) -> tuple[bucketed.BucketedTable, DataFrame]:
    """A vector table with two thirds of the embeddings as version 1, then every second one as version 2; and the progress of both jobs."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("vector_id"), F.col("embedding").alias("vector"))
    columns = "vector_id long, vector array<float>, version long, position long"
    points = bucketed.BucketedTable(spark, new_folder(spark, "vectors"), columns, ["vector_id"])
    first = rows.where("vector_id % 3 <> 0").withColumn("version", F.lit(1).cast("long")).withColumn("position", F.col("vector_id") + 1)
    second = rows.where("vector_id % 2 = 0").withColumn("version", F.lit(2).cast("long")).withColumn("position", F.col("vector_id") + 1)
    progress = [bucketed.upsert_in_batches(points, job, part, "position", batch_rows) for job, part in (("first", first), ("second", second))]
    return points, progress[0].unionByName(progress[1])


@R.add("""SELECT vec_id AS vector_id, CASE WHEN vec_id % 2 = 0 THEN 2 ELSE 1 END AS version, len(embedding) AS dimension, embedding[1]::DOUBLE AS first_value
FROM embeddings WHERE vec_id % 2 = 0 OR vec_id % 3 <> 0""")
def batched_upsert(spark, sf_dir):
    points, _ = published_in_batches(spark, sf_dir)
    return points.read().select("vector_id", "version", F.size("vector").alias("dimension"), F.get("vector", F.lit(0)).cast("double").alias("first_value"))


@R.add("""WITH jobs AS (
  SELECT 'first' AS job, vec_id // 1000 AS batch FROM embeddings WHERE vec_id % 3 <> 0
  UNION ALL SELECT 'second', vec_id // 1000 FROM embeddings WHERE vec_id % 2 = 0),
counted AS (SELECT job, batch, count(*) AS n FROM jobs GROUP BY ALL),
totals AS (SELECT job, sum(n)::BIGINT AS total FROM counted GROUP BY job)
SELECT job, batch, 'published' AS state, (sum(n) OVER (PARTITION BY job ORDER BY batch))::BIGINT AS processed, total, 1::BIGINT AS attempts FROM counted JOIN totals USING (job)
UNION ALL SELECT job, NULL, 'started', 0, total, 0 FROM totals""")
def upsert_progress(spark, sf_dir):
    return published_in_batches(spark, sf_dir)[1].select("job", "batch", "state", "processed", "total", "attempts")


@R.add(f"WITH {CORPUS_SQL} SELECT document_id FROM corpus WHERE vector IS NULL")
def coverage_gap(spark, sf_dir):
    return evaluation.coverage_gaps(documents(spark, sf_dir), point_rows(spark, sf_dir), ["document_id"])


@R.add(f"WITH {CORPUS_SQL} SELECT 'kb__local__hash_model_v2__d64' AS collection, count(*) AS points, 64::BIGINT AS dimension, 'Hash Model v2' AS embedding_model FROM corpus WHERE vector IS NOT NULL")
def collection_schema(spark, sf_dir):
    return stores.collection_schema(point_rows(spark, sf_dir)).select("collection", "points", "dimension", "embedding_model")


@R.add("""WITH edges AS (SELECT vec_id AS id, vec_id + 1 AS parent FROM embeddings),
doomed AS (SELECT doc_id AS id FROM documents WHERE doc_id % 9 = 0)
SELECT 'lineage' AS kind, count(*) AS n FROM edges WHERE id NOT IN (SELECT id FROM doomed) AND parent NOT IN (SELECT id FROM doomed)
UNION ALL SELECT 'assets', count(*) FROM documents WHERE doc_id % 9 <> 0""")
def cascade_delete(spark, sf_dir):
    docs = documents(spark, sf_dir)
    assets = docs.select("document_id", F.col("document_id").alias("asset_id"))
    lineage = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("asset_id"), (F.col("vec_id") + 1).cast("string").alias("parent_asset_id"))
    left = changes.cascade_delete({"assets": assets, "lineage": lineage}, docs.where("doc_id % 9 = 0"))
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n") for name, df in left.items()]
    return parts[0].unionByName(parts[1])


@R.add()
def ingest(spark, sf_dir):
    """The whole ingestion: documents and dead letters by stage, chunks, tokens and points."""
    docs = documents(spark, sf_dir).withColumn("repository_id", F.col("source")).withColumnRenamed("content", "text")
    done = ingestion.ingest(docs)
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n")
    dead = done.dead_letters.groupBy(F.concat(F.lit("dead:"), "stage").alias("kind")).agg(F.countDistinct("document_id").alias("n"))
    return count(done.profiles, "profiles").unionByName(count(done.chunks, "chunks")).unionByName(count(done.points, "points")).unionByName(dead)


@R.add("""WITH b AS (SELECT doc_id, encode(text) || CASE WHEN doc_id % 2 = 0 THEN '\\xFF'::BLOB ELSE ''::BLOB END AS content FROM documents WHERE text IS NOT NULL)
SELECT doc_id, length(text) + (doc_id % 2 = 0)::INT AS n_chars FROM documents WHERE text IS NOT NULL""")
def decode_utf8(spark, sf_dir):
    """Texts as bytes, half of them with a byte that is no UTF-8."""
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    bad = F.when(F.col("doc_id") % 2 == 0, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit("")))
    return rows.select("doc_id", F.length(files.decoded(F.concat(F.col("text").cast("binary"), bad))).alias("n_chars"))


# --- files, registries and repair -------------------------------------------------------------

SUFFIXES = [".pdf", ".PNG", ".mp3", ".mov", ".txt", ".md", ""]


@R.add("""SELECT CASE doc_id % 7 WHEN 0 THEN 'document' WHEN 1 THEN 'image' WHEN 2 THEN 'audio' WHEN 3 THEN 'video' ELSE 'text' END AS kind, CASE doc_id % 7 WHEN 4 THEN 'text' WHEN 5 THEN 'markdown' WHEN 6 THEN 'text' END AS parser, count(*) AS n FROM documents GROUP BY ALL""")
def file_routing(spark, sf_dir):
    """Files by extension, then by MIME type."""
    path = F.concat("source", F.lit("/f"), "document_id", F.get(F.array(*map(F.lit, SUFFIXES)), (F.col("doc_id") % 7).cast("int")))
    mime = F.when(F.col("doc_id") % 7 == 6, "text/plain")
    rows = documents(spark, sf_dir).select(files.file_kind(path, F.length("content")).alias("kind"), files.parser_for(path, mime).alias("parser"))
    return rows.groupBy("kind", "parser").agg(F.count("*").alias("n"))


@R.add("""WITH t AS (SELECT doc_id, regexp_extract_all(text || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '![a](img/' || doc_id || '.png) ![b](x.png) ![a](img/' || doc_id || '.png)' ELSE '' END, '!\\[[^\\]]*\\]\\(([^)\\s]+)\\)', 1) AS links FROM documents WHERE text IS NOT NULL)
SELECT doc_id, links[1] AS first_image, len(list_distinct(links)) AS images, doc_id % 4 = 0 AS described FROM t""")
def image_links(spark, sf_dir):
    rows = documents(spark, sf_dir).where("content IS NOT NULL")
    link = F.concat(F.lit("\n![a](img/"), "document_id", F.lit(".png) ![b](x.png) ![a](img/"), "document_id", F.lit(".png)"))
    docs = rows.select("doc_id", "document_id", F.concat("content", F.when(F.col("doc_id") % 2 == 0, link).otherwise("")).alias("text"))
    known = rows.where("doc_id % 4 = 0").select(F.concat(F.lit("img/"), "document_id", F.lit(".png")).alias("image"), F.lit("a plot").alias("description"))
    out = files.describe_images(docs, known)
    found = files.image_links(F.col("text"))
    return out.select("doc_id", F.get(found, F.lit(0)).alias("first_image"), F.size(found).alias("images"), F.col("text").endswith(": a plot").alias("described"))


@R.add("SELECT 'kb__local__hash_model_v2__d64' AS collection, 64::BIGINT AS dimension, 'cosine' AS distance_metric, 'Hash Model v2' AS embedding_model, 'inherited' AS source UNION ALL SELECT 'old', 64, 'cosine', 'local-hash', 'hybrid'")
def embedding_profile(spark, sf_dir):
    known = stores.collection_schema(point_rows(spark, sf_dir)).select("collection", "dimension", "distance_metric", "embedding_model")
    old = spark.createDataFrame([("old", None, None, None)], "collection string, dimension int, distance_metric string, embedding_model string")
    return stores.embedding_profile(known.unionByName(old))


@R.add(f"""WITH {DOCS_SQL}, cur AS (SELECT DISTINCT 'tenant-0' AS tenant_id, source AS name, 'r-' || source AS repository_id, 'old' AS uri FROM docs WHERE doc_id % 2 = 0), inc AS (SELECT DISTINCT 'tenant-0' AS tenant_id, source AS name, 'new' AS uri FROM docs WHERE doc_id % 3 = 0)
SELECT coalesce(repository_id, 'repo-' || left(sha256(tenant_id || chr(0) || name), 16)) AS repository_id, name, coalesce(inc.uri, cur.uri) AS uri FROM cur FULL JOIN inc USING (tenant_id, name)""")
def register_repositories(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.lit("tenant-0").alias("tenant_id"), F.col("source").alias("name"))
    current = rows.where("doc_id % 2 = 0").select("tenant_id", "name").distinct().withColumns({"repository_id": F.concat(F.lit("r-"), "name"), "uri": F.lit("old")})
    incoming = rows.where("doc_id % 3 = 0").select("tenant_id", "name").distinct().withColumn("uri", F.lit("new"))
    return changes.register_repositories(current, incoming).select("repository_id", "name", "uri")


@R.add(f"WITH {DOCS_SQL} SELECT document_id FROM docs WHERE source = 'src3' AND doc_id % 5 <> 0 ORDER BY source_path, document_id LIMIT 20")
def repository_documents(spark, sf_dir):
    rows = documents(spark, sf_dir).withColumn("repository_id", F.col("source")).withColumn("status", F.when(F.col("doc_id") % 5 == 0, "deleted").otherwise("active"))
    return changes.repository_documents(rows, "src3", limit=20).select("document_id")


@R.add(f"WITH {CORPUS_SQL} SELECT count(*) FILTER (WHERE doc_id % 3 <> 0) AS by_manifest, count(*) FILTER (WHERE NOT (document_id = '7' AND tenant_id = 'tenant-1')) AS by_filter FROM corpus WHERE vector IS NOT NULL")
def purge_vectors(spark, sf_dir):
    points = point_rows(spark, sf_dir)
    listed = changes.purge_vectors(points, ("", ""), points.where("doc_id % 3 = 0"))
    filtered = changes.purge_vectors(points, ("7", "tenant-1"), None)
    return listed.agg(F.count("*").alias("by_manifest")).crossJoin(filtered.agg(F.count("*").alias("by_filter")))  # one row each


@R.add(f"WITH {CORPUS_SQL} SELECT document_id FROM corpus WHERE vector IS NOT NULL AND doc_id % 6 = 1")
def missing_from_store(spark, sf_dir):
    """Documents called published whose path the store lacks."""
    points = point_rows(spark, sf_dir)
    return changes.missing_from_store(points.select("document_id", "source_path"), points.where("doc_id % 6 <> 1")).select("document_id")


@R.add(f"""WITH {DOCS_SQL} SELECT document_id, source_path, 'name of ' || source AS repository FROM docs
WHERE tenant_id = 'tenant-1' AND doc_id % 5 = 2 AND (source = 'none' OR NOT ends_with(source, '7'))""")
def purge_selection(spark, sf_dir):
    state = F.when(F.col("doc_id") % 5 == 2, "deleted").otherwise("active")
    rows = documents(spark, sf_dir).select("document_id", "source_path", "tenant_id", F.col("source").alias("repository_id"), state.alias("status"))
    uri = F.when(F.endswith("repository_id", F.lit("7")), "/data/docs//").when(F.col("repository_id") != "none", F.concat(F.lit("/data/"), "repository_id", F.lit("/")))
    homes = rows.select("tenant_id", "repository_id", F.concat(F.lit("name of "), "repository_id").alias("name"), uri.alias("uri")).distinct()
    return changes.to_purge(rows, homes, "tenant-1", target="/data/docs/", status="deleted")


@R.add(f"WITH {DOCS_SQL} SELECT DISTINCT source AS repository_id FROM docs WHERE source NOT IN (SELECT source FROM docs WHERE doc_id % 40 = 3)")
def orphaned_repositories(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.col("source").alias("repository_id"))
    return changes.orphaned_repositories(rows.select("repository_id").distinct(), rows.where("doc_id % 40 = 3"))


@R.add("""WITH a AS (SELECT doc_id AS id, ['markdown', 'chunks', 'vector'][doc_id % 3 + 1] AS kind FROM documents), e AS (SELECT vec_id AS id, vec_id + 5 AS parent FROM embeddings)
SELECT 'unknown_asset' AS "check", count(*) AS n FROM e WHERE id NOT IN (SELECT id FROM a) HAVING count(*) > 0 UNION ALL SELECT 'unknown_parent', count(*) FROM e WHERE parent NOT IN (SELECT id FROM a) HAVING count(*) > 0
UNION ALL SELECT 'missing_lineage', count(*) FROM a WHERE kind <> 'markdown' AND id NOT IN (SELECT id FROM e) HAVING count(*) > 0""")
def lineage_findings(spark, sf_dir):
    kind = F.get(F.array(F.lit("markdown"), F.lit("chunks"), F.lit("vector")), (F.col("doc_id") % 3).cast("int"))
    assets = documents(spark, sf_dir).select(F.col("doc_id").alias("asset_id"), kind.alias("asset_type"))
    edges = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("asset_id"), (F.col("vec_id") + 5).alias("parent_asset_id"))
    return evaluation.validate_lineage(assets, edges).groupBy("check").agg(F.count("*").alias("n"))


# --- lineage -----------------------------------------------------------------------


def lineage_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as assets that come from those of half and of a third of their number; some from none there is, some from each other."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    name = lambda c: c.cast("string")
    half = docs.where("doc_id > 0").select(name(F.col("doc_id")).alias("asset_id"), name(F.floor(F.col("doc_id") / 2)).alias("parent_asset_id"))
    third = docs.where("doc_id % 2 = 1").select(name(F.col("doc_id")).alias("asset_id"), name(F.floor(F.col("doc_id") / 3)).alias("parent_asset_id"))
    level = F.get(F.array(*map(F.lit, LEVELS)), (F.col("doc_id") * 7 % 11 % 4).cast("int"))
    kind = F.when(F.col("doc_id") == 0, "source").otherwise("derived")
    return docs.select(name(F.col("doc_id")).alias("asset_id"), kind.alias("asset_type"), level.alias("classification_clearance")), half.unionByName(third)


def broken_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 97th document comes from a lost one, and every 89th from itself by way of the next."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    name = lambda c: c.cast("string").alias("asset_id")
    lost = docs.where("doc_id % 97 = 5").select(name(F.col("doc_id")), F.concat(F.lit("lost-"), F.col("doc_id").cast("string")).alias("parent_asset_id"))
    there = docs.where("doc_id % 89 = 88").select(name(F.col("doc_id")), (F.col("doc_id") + 1).cast("string").alias("parent_asset_id"))
    back = docs.where("doc_id % 89 = 88").select(name(F.col("doc_id") + 1), F.col("doc_id").cast("string").alias("parent_asset_id"))
    return lost.unionByName(there).unionByName(back)


LINEAGE_SQL = """
edges AS (SELECT doc_id::VARCHAR AS a, (doc_id // 2)::VARCHAR AS p FROM documents WHERE doc_id > 0 UNION SELECT doc_id::VARCHAR, (doc_id // 3)::VARCHAR FROM documents WHERE doc_id % 2 = 1),
assets AS (SELECT doc_id::VARCHAR AS a, doc_id = 0 AS root, doc_id * 7 % 11 % 4 AS level FROM documents)"""


@R.add(f"""WITH RECURSIVE {LINEAGE_SQL},
ways AS (SELECT a, p, 1 AS n FROM edges UNION SELECT w.a, e.p, w.n + 1 FROM ways w JOIN edges e ON e.a = w.p),
least AS (SELECT a, p, min(n) AS n FROM ways GROUP BY a, p)
SELECT a AS asset_id, count(*) AS ancestors, max(n)::BIGINT AS farthest, sum(n)::BIGINT AS steps FROM least GROUP BY a""")
def lineage_closure(spark, sf_dir):
    _, edges = lineage_tables(spark, sf_dir)
    return lineage.closure(edges).groupBy("asset_id").agg(F.count("*").alias("ancestors"), F.max("steps").alias("farthest"), F.sum("steps").alias("steps"))


@R.add(f"""WITH RECURSIVE {LINEAGE_SQL},
broken AS (
  SELECT * FROM edges UNION SELECT doc_id::VARCHAR, 'lost-' || doc_id FROM documents WHERE doc_id % 97 = 5
  UNION SELECT doc_id::VARCHAR, (doc_id + 1)::VARCHAR FROM documents WHERE doc_id % 89 = 88 UNION SELECT (doc_id + 1)::VARCHAR, doc_id::VARCHAR FROM documents WHERE doc_id % 89 = 88),
ways AS (SELECT a, p FROM broken UNION SELECT w.a, b.p FROM ways w JOIN broken b ON b.a = w.p),
cyclic AS (SELECT a FROM ways WHERE a = p)
SELECT 'missing_parent' AS "check", 'error' AS severity, a AS subject FROM (SELECT DISTINCT a FROM ways WHERE p NOT IN (SELECT a FROM assets))
UNION ALL SELECT 'cyclic_lineage', 'error', a FROM cyclic
UNION ALL SELECT 'below_cycle', 'warning', a FROM (SELECT DISTINCT a FROM ways WHERE p IN (SELECT a FROM cyclic) AND a NOT IN (SELECT a FROM cyclic))
UNION ALL SELECT 'unrooted', 'error', a FROM assets WHERE NOT root AND a NOT IN (SELECT a FROM ways WHERE p = '0')""")
def lineage_breaks(spark, sf_dir):
    assets, edges = lineage_tables(spark, sf_dir)
    return lineage.findings(assets, edges.unionByName(broken_edges(spark, sf_dir)))


@R.add(f"""WITH RECURSIVE {LINEAGE_SQL},
ways AS (SELECT a, p FROM edges UNION SELECT w.a, e.p FROM ways w JOIN edges e ON e.a = w.p),
above AS (SELECT w.a, max(x.level) AS level FROM ways w JOIN assets x ON x.a = w.p GROUP BY w.a)
SELECT assets.a AS asset_id, ['public', 'internal', 'confidential', 'restricted'][greatest(assets.level, coalesce(above.level, 0)) + 1] AS least_clearance, coalesce(above.level, 0) > assets.level AS downgraded
FROM assets LEFT JOIN above USING (a)""")
def clearance_propagation(spark, sf_dir):
    assets, edges = lineage_tables(spark, sf_dir)
    ways = lineage.closure(edges)
    down = lineage.downgrades(assets, ways).select(F.col("subject").alias("asset_id"), F.lit(True).alias("downgraded"))
    rows = lineage.least_clearances(assets, ways).select("asset_id", "least_clearance").join(down, "asset_id", "left")
    return rows.withColumn("downgraded", F.coalesce("downgraded", F.lit(False)))
