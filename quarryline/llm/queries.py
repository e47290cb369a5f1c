"""The operators bound to the driver's tables, and the pipeline's stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import chat_trees, harmonic, html_consensus, langid_hd, mixing, mpeg_audio, ngram_automaton, quality_bayes, quality_llr, simhash, tput_search, turn_trie, url_rules
from quarryline.llm.common import table

URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
CONTROL_TURNS = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def quality_verdicts(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Sites of ``documents``: a source is a host, its languages are the paths."""
    return quality_bayes.classify(docs, labels, "text", "doc_id", F.col("source"), F.col("lang"), keep)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id", "source", "lang"])
    return judged.select("doc_id", "source", "lang", "doc_llr", "host_posterior", "path_posterior", "quality_score", "kept")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(CONTROL_TURNS, rows.schema))
    texts = chat_trees.format_trees(chat_trees.linear_trees(rows))
    read = texts.select("conv_id", chat_trees.read_back("formatted", "loss_spans").alias("r"))
    return read.select("conv_id", "r.*")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "shards", "words")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    prototypes = langid_hd.learn(docs, "text", "lang", "doc_id", ~held_out)
    judged = langid_hd.predict(docs.select("doc_id", "text"), prototypes)
    return judged.select("doc_id", held_out.alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    judged = quality_llr.judge(docs, quality_llr.log_ratios(docs, labels))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def packed(docs: DataFrame) -> DataFrame:
    import public_tokenizers  # the vocabulary files; only packing needs them

    return harmonic.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_consensus.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "host_path")


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = mpeg_audio.with_media(table(spark, sf_dir, "documents").select("doc_id", "text"))
    read = mpeg_audio.probed(stored)
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "duration_ms", "n_frames", "frame_offsets", "bad_checksums")


def op11_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False)).alias("held_out")
    scored = ngram_automaton.score(docs.select("doc_id", held_out, "text"), ~F.col("held_out"), ["doc_id", "held_out"])
    return scored.select("own.*", "scores.n_tokens", "scores.n_known", "train_tokens", "scores.base_score", "scores.score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tput_search.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = turn_trie.trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_simhash, op3_quality_classifier, op4_chat_format, op5_mixing, op6_language_id, op7_quality_rules, op8_packing, op9_html_extraction, op10_media_columns, op11_lm_scores, op12_ranked_search, op13_prefix_trie)}

ORACLES = {
    "op1_url_filter": r"""
WITH parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
hits AS (
  SELECT parts.*, h || p AS rule, v AS verdict, length(h) + length(p) AS n
  FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM hits QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n DESC NULLS LAST) = 1""",
    "op4_chat_format": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
), sized AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', ''))
            + len(regexp_extract_all(text, '<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|</?s>|\[/?INST\]|<</?SYS>>')) + length(role) + 24 AS chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn)) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id""",
    "op12_ranked_search": r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), asked AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL
), counts AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM counts GROUP BY doc_id),
totals AS (SELECT count(*) AS all_n, CAST(sum(n) AS BIGINT) AS all_l FROM sizes),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * all_n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts, totals GROUP BY term, all_n),
scored AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * all_n) // all_l))))) AS BIGINT) AS score
  FROM asked JOIN counts USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), totals GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 20""",
    "op13_prefix_trie": r"""
WITH named AS (
  SELECT conv_id, turn, coalesce(role, '') AS role,
         left(sha256(CAST(length(coalesce(role, '')) AS VARCHAR) || chr(10) || coalesce(role, '') || chr(10) || coalesce(text, '')), 32) AS digest,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list(digest ORDER BY turn NULLS FIRST, role, digest) AS digests, list(words ORDER BY turn NULLS FIRST, role, digest) AS counts
  FROM named GROUP BY conv_id
), shared AS (
  -- CRC-32 of the decimal id, bit by bit
  SELECT *, conv_id - conv_id % 20 AS source,
         xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
             lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1)))) % 4 AS h
  FROM own
), rebuilt AS (
  SELECT s.conv_id, list_concat(coalesce(o.digests[1:s.h], []), s.digests[s.h + 1:]) AS digests, list_concat(coalesce(o.counts[1:s.h], []), s.counts[s.h + 1:]) AS counts
  FROM shared s LEFT JOIN own o ON o.conv_id = s.source
), members AS (
  SELECT conv_id, d AS depth, array_to_string(digests[1:d], '') AS node, CASE WHEN d > 0 THEN array_to_string(digests[1:d - 1], '') END AS above,
         CASE WHEN d > 0 THEN counts[d] ELSE 0 END AS words, d = len(digests) AS ends
  FROM (SELECT *, unnest(range(len(digests) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT node, any_value(depth) AS depth, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM members GROUP BY node
), children AS (SELECT above AS node, count(*) AS n_children FROM nodes WHERE above IS NOT NULL GROUP BY above),
counted AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (node)),
below AS (SELECT DISTINCT a.node AS node, b.node AS lower FROM members a JOIN members b ON a.conv_id = b.conv_id AND a.depth <= b.depth),
sums AS (
  SELECT below.node, sum((c.n_children = 0)::INT) AS n_leaves, sum((c.n_convs - 1) * c.words) AS saved_tokens
  FROM below JOIN counted c ON c.node = below.lower GROUP BY below.node
)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, c.ends_sha256
FROM counted c JOIN sums USING (node) LEFT JOIN nodes p ON p.node = c.above""",
}
