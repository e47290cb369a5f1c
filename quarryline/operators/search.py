"""Search over a governed corpus: vector, keyword and metadata engines.

A corpus row is (document_id, chunk_id, content, source_path, tenant_id,
classification_clearance, vector, and optional section_title, section_id,
language, repository_id, metadata).  Queries are rows too, so a batch of them
runs as one plan; results carry query_id and a rank from 0.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarryline.functions import vectors as V
from quarryline.functions.text import is_blank
from quarryline.operators.nearest import nearest
from quarryline.session import settle

#: Clearances from least to most restrictive.  Retrieval contracts
#: name four of them; ingestion also knows highly_confidential.
CLEARANCES = ["public", "internal", "confidential", "highly_confidential", "restricted"]
#: Order of the engines.
ENGINES = ["vector", "keyword", "metadata"]
#: Terms of a keyword query.
TERM = r"[A-Za-z0-9_\-]+"
#: Columns of a corpus row that metadata filters may name besides the metadata map.
ATTRIBUTES = ["classification_clearance", "section_id", "language", "repository_id"]
#: A batch of more queries than this isn't broadcast.
MOST_BROADCAST_QUERIES = 20_000
MOST_BROADCAST_BYTES = 64 << 20
#: Rows that other rows look up by an equal key, one for each at most, are bounded by their bytes.
MOST_BROADCAST_KEYS = 1_000_000

CANDIDATE = ["query_id", "engine", "document_id", "chunk_id", "source_path", "section_title", "content", "score", "rank"]


def clearance_rank(clearance: Column) -> Column:
    """0 for public and so on; null for unknown levels."""
    return F.nullif(F.array_position(F.array(*map(F.lit, CLEARANCES)), clearance), F.lit(0)) - 1


def allowed_clearances(clearance: str | None, required: bool = False) -> list[str]:
    """Levels that a principal may see: its own and those below; public alone without a principal."""
    if clearance is None:
        if required:
            raise ValueError("a security context is required to retrieve candidates")
        return ["public"]
    return CLEARANCES[: CLEARANCES.index(clearance) + 1]


def visible(corpus: DataFrame, allowed: list[str], tenant_id: str = "") -> DataFrame:
    """Rows of the levels and the tenant (all tenants if empty), by plain column filters that reach the scan."""
    rows = corpus.where(F.col("classification_clearance").isin(allowed))
    return rows.where(F.col("tenant_id") == tenant_id) if tenant_id else rows


def visible_to_queries(corpus: DataFrame) -> Column:
    """The same as a join condition, for queries that carry their own principal as q_clearance and q_tenant."""
    seen = clearance_rank(F.col("classification_clearance")) <= clearance_rank(F.coalesce("q_clearance", F.lit("public")))
    return seen & ((F.coalesce("q_tenant", F.lit("")) == "") | (F.col("tenant_id") == F.col("q_tenant")))


def attribute(corpus: DataFrame, field: Column) -> Column:
    """A named attribute of a corpus row as a string; null if it has none."""
    value = F.element_at("metadata", field) if "metadata" in corpus.columns else F.lit(None).cast("string")
    for name in ATTRIBUTES:
        if name in corpus.columns:
            value = F.when(field == name, F.col(name)).otherwise(value)
    return value


def matches(corpus: DataFrame, filters: Column, numeric: bool = False) -> Column:
    """All filters (structs of field, operator, value) hold; a missing attribute fails.

    Ranges compare strings; with ``numeric`` they compare numbers, and are
    equalities where a side isn't one.
    """

    def one(f: Column) -> Column:
        value, target = attribute(corpus, f["field"]), f["value"]
        if numeric:
            a, b = value.try_cast("double"), target.try_cast("double")
            gte, lte = F.coalesce(a >= b, value == target), F.coalesce(a <= b, value == target)
        else:
            gte, lte = value >= target, value <= target
        held = F.when(f["operator"] == "gte", gte).when(f["operator"] == "lte", lte).otherwise(value == target)
        return F.coalesce(held, F.lit(False))

    return F.forall(filters, one)


def row_bytes(df: DataFrame) -> Column:
    """About what a row holds when it is broadcast."""
    return F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)))).cast("long")


def few(queries: DataFrame, most: int = MOST_BROADCAST_QUERIES, most_bytes: int = MOST_BROADCAST_BYTES) -> DataFrame:
    """Marked for broadcast if the rows are few and small; no more rows than that are read to see it."""
    seen = queries.limit(most + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(row_bytes(queries)), F.lit(0)).alias("bytes")).first()
    return F.broadcast(queries) if seen["n"] <= most and seen["bytes"] <= most_bytes else queries


def paired(rows: DataFrame, queries: DataFrame, most: int = MOST_BROADCAST_QUERIES, most_bytes: int = MOST_BROADCAST_BYTES) -> DataFrame:
    """Every row with every query that may see it, by equal keys.

    A query stands once for each clearance level that it sees, at most five,
    and joins rows on the level; queries of a tenant also join on the tenant.
    Blocks of at most ``most`` queries and ``most_bytes`` are broadcast, one
    reading of the rows for each, so that neither side is shuffled or paired
    without a key.
    """
    rank = clearance_rank(F.coalesce("q_clearance", F.lit("public")))
    levels = F.slice(F.array(*map(F.lit, CLEARANCES)), F.lit(1), F.coalesce(rank + 1, F.lit(0)).cast("int"))
    asked = queries.withColumn("q_level", F.explode(levels))
    of_tenant = F.coalesce("q_tenant", F.lit("")) != ""
    seen = queries.groupBy(of_tenant.alias("t")).agg(F.count("*").alias("n"), F.sum(row_bytes(queries)).alias("bytes")).collect()  # two rows
    level = F.col("classification_clearance") == F.col("q_level")
    found = None
    for r in seen:
        part, match = (asked.where(of_tenant), level & (F.col("tenant_id") == F.col("q_tenant"))) if r["t"] else (asked.where(~of_tenant), level)
        blocks = max(-(-r["n"] // most), -(-len(CLEARANCES) * r["bytes"] // most_bytes))
        for block in range(blocks):
            own = part.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
            pairs = rows.join(F.broadcast(own), match).drop("q_level")
            found = pairs if found is None else found.unionByName(pairs)
    return rows.join(asked, level).drop("q_level").limit(0) if found is None else found


def top(scored: DataFrame, limit: Column | int, most: int | None = None) -> DataFrame:
    """The best ``limit`` rows of each query, ranked from 0; ties go by document and chunk.

    Where the limit is a column, ``most`` is its greatest value: only a number
    lets Spark cut the rows down before the shuffle.
    """
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "document_id", "chunk_id")
    ranked = scored.withColumn("rank", F.row_number().over(order))
    kept = ranked.where(F.col("rank") <= limit)
    kept = kept.where(F.col("rank") <= most) if most else kept
    return kept.withColumn("rank", (F.col("rank") - 1).cast("int")).withColumn("score", V.clamp(F.col("score")))


def _similarity(metric: str, size: int | None) -> Column:
    if metric == "dot":
        return V.dot(F.col("vector"), F.col("q_vector"), size)
    if metric == "euclidean":
        return V.euclidean_similarity(F.col("vector"), F.col("q_vector"), size)
    return V.cosine(F.col("vector"), F.col("q_vector"), F.col("norm"), F.col("q_norm"), size)


def parts_of(queries: DataFrame, most: int = MOST_BROADCAST_QUERIES, most_bytes: int = MOST_BROADCAST_BYTES) -> list[DataFrame]:
    """Queries in parts of at most about ``most`` rows and ``most_bytes``, by a hash of their id."""
    seen = queries.agg(F.count("*").alias("n"), F.coalesce(F.sum(row_bytes(queries)), F.lit(0)).alias("bytes")).first()
    n = max(1, -(-seen["n"] // most), -(-seen["bytes"] // most_bytes))
    return [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i) for i in range(n)] if n > 1 else [queries]


def levelled(queries: DataFrame, *columns: str) -> DataFrame:
    """What ``nearest`` wants of queries."""
    rank = F.coalesce(clearance_rank(F.coalesce("q_clearance", F.lit("public"))), F.lit(-1)).cast("int")
    return queries.select("query_id", *columns, rank.alias("q_level"), F.coalesce("q_tenant", F.lit("")).alias("q_tenant"), V.doubles(F.col("q_vector")).alias("vector"))


def comparable(rows: DataFrame, *columns: str) -> DataFrame:
    """What ``nearest`` wants of rows; those of an unknown level are seen by nobody."""
    level = F.coalesce(clearance_rank(F.col("classification_clearance")), F.lit(len(CLEARANCES))).cast("int")
    tenant = F.col("tenant_id") if "tenant_id" in rows.columns else F.lit(None).cast("string").alias("tenant_id")
    return rows.select("document_id", "chunk_id", tenant, level.alias("level"), *columns, V.doubles(F.col("vector")).alias("vector"))


def with_best(corpus: DataFrame, best: DataFrame) -> DataFrame:
    """The corpus' columns of the best rows (query_id, document_id, chunk_id, score, rank); the corpus isn't shuffled while they are few."""
    key = ["document_id", "chunk_id"]
    contents = corpus.join(few(best.select(*key).distinct(), MOST_BROADCAST_KEYS), key, "left_semi").dropDuplicates(key)
    return contents.join(few(best, MOST_BROADCAST_KEYS), key)


def vector_search(corpus: DataFrame, queries: DataFrame, limit: Column | int = 10, size: int | None = None, metric: str = "cosine", filters: str | None = None, most: int | None = None) -> DataFrame:
    """Best rows by similarity to each query's ``q_vector``; scores of 0 and less are dropped.

    ``size`` is the vectors' length, if all share it.  Queries without filters
    are compared by blocks (``nearest``), those with filters pair by pair.
    Only what names a row and settles who sees it meets the queries; the other
    columns join the best rows.
    """
    key = ["document_id", "chunk_id"]
    rows = corpus.where("vector IS NOT NULL")
    asked = queries.where("q_vector IS NOT NULL")
    if size:
        rows, asked = rows.where(F.size("vector") == size), asked.where(F.size("q_vector") == size)
    own = ["__limit"] if isinstance(limit, Column) else []
    asked = asked.withColumn("__limit", limit) if own else asked
    free = asked.where(F.size(filters) == 0) if filters else asked
    cut = F.col("__limit") if own else limit
    k = most if own else limit
    if k is None:
        raise ValueError("a limit by query needs its greatest value")
    scored = nearest(comparable(rows), parts_of(levelled(free, *own)), k, metric, ["query_id", *own])
    if filters:
        light = rows.select(*(c for c in corpus.columns if c in (*key, "tenant_id", "classification_clearance", "metadata", "vector", *ATTRIBUTES)))
        light = light.withColumn("vector", V.doubles(F.col("vector"))).withColumn("norm", V.norm(F.col("vector")))
        narrow = asked.where(F.size(filters) > 0).select("query_id", *own, filters, "q_clearance", "q_tenant", V.doubles(F.col("q_vector")).alias("q_vector"))
        joined = paired(light, narrow.withColumn("q_norm", V.norm(F.col("q_vector")))).where(matches(light, F.col(filters)))
        hits = joined.withColumn("score", _similarity(metric, size)).where("score > 0")
        scored = scored.unionByName(hits.select("query_id", *own, *key, "score"))
    best = settle(top(scored, cut, most).select("query_id", *key, "score", "rank"))  # at most the limit for each query
    return with_best(corpus, best).withColumn("engine", F.lit("vector"))


def best_vectors(corpus: DataFrame, vector: list[float], limit: int = 10) -> DataFrame:
    """One query against a corpus that is already filtered: a scan and a bounded sort."""
    size = len(vector)
    given = F.array(*(F.lit(float(x)) for x in vector))
    rows = corpus.where(F.size("vector") == size).withColumn("vector", V.doubles(F.col("vector")))
    score = V.cosine(F.col("vector"), given, V.norm(F.col("vector")), F.lit(math.sqrt(sum(x * x for x in vector))), size)
    best = rows.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "document_id", "chunk_id").limit(limit)
    return best.withColumn("score", V.clamp(F.col("score")))


def query_terms(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower)


#: A term is a substring, and of lower-cased text it can only lie within a run of these.
RUN = r"[a-z0-9_\-]+"
#: Characters of a gram; shorter terms are their own gram.
GRAM = 3


def grams(word: Column) -> Column:
    """All substrings of up to ``GRAM`` characters, each once."""
    n = F.length(word)
    of = lambda k: F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.substring(word, i, F.lit(k)))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*(F.when(n >= k, of(k)).otherwise(none) for k in range(1, GRAM + 1))))


#: Words that are looked up in a broadcast table, and the rows of which they are taken.
COMMON_WORDS, SAMPLED_ROWS = 100_000, 20_000


def runs(content: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(content, F.lit(""))), F.lit(RUN), F.lit(0)))


def common_words(corpus: DataFrame, most: int) -> DataFrame:
    """Distinct words that are frequent in some rows of the corpus, at most ``most``; words that lack here only cost more later."""
    n = corpus.count()
    some = corpus.sample(min(1.0, SAMPLED_ROWS / max(1, n)), seed=7).select(F.explode(runs(F.col("content"))).alias("word"))
    return some.groupBy("word").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "word").limit(most).select("word")


def rare_grams(words: DataFrame, terms: DataFrame) -> DataFrame:
    """``terms`` (term) with the ``gram`` by which words look them up: of its longest ones that which fewest ``words`` hold."""
    sizes = words.select(F.explode(grams(F.col("word"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    long = lambda x: F.length(x) == F.least(F.lit(GRAM), F.length("term"))
    own = terms.select("term", F.explode(F.filter(grams(F.col("term")), long)).alias("gram"))
    chosen = own.join(sizes, "gram", "left").groupBy("term").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    return terms.join(chosen, "term")


def one_bit(bit: Column) -> Column:
    """Of 64 bits that at ``bit`` modulo 64."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))


def marks(rows: DataFrame, by: list[str], start: Column, times: Column) -> DataFrame:
    """The ``times`` bits from ``start`` on of all rows of a key, as (``at``, ``mask``) of 64 bits each."""
    bits = rows.select(*by, F.explode(F.sequence(start, start + times - 1)).alias("bit"))
    return bits.groupBy(*by, F.floor(F.col("bit") / 64).cast("int").alias("at")).agg(F.bit_or(one_bit(F.col("bit"))).alias("mask"))


def held_terms(corpus: DataFrame, light: list[str], spots: DataFrame, common: DataFrame) -> DataFrame:
    """The ``light`` columns of rows with ``marks``, the bits of all terms (term, gram, at, mask) that their content holds.

    A word that is among the common ones brings the bits of all terms that it
    holds; another looks for terms by its grams, and ``contains`` settles the
    rest.  Both look up broadcast tables, and rows are dealt with their words
    before, so that what words bring is united without a shuffle.
    """
    key = ["document_id", "chunk_id"]
    mark = F.struct("at", "mask")
    postings = common.select("word", F.explode(grams(F.col("word"))).alias("gram"))
    pairs = postings.join(F.broadcast(spots), "gram").where(F.contains("word", "term")).groupBy("word", "at").agg(F.bit_or("mask").alias("mask"))
    none = F.array().cast("array<struct<at:int,mask:bigint>>")
    known = settle(common.join(pairs.groupBy("word").agg(F.collect_list(mark).alias("marks")), "word", "left").select("word", F.coalesce("marks", none).alias("marks")))
    words = corpus.select(*key, runs(F.col("content")).alias("runs")).repartition(*key).select(*key, F.explode("runs").alias("word")).join(F.broadcast(known), "word", "left")
    looked = words.withColumn("gram", F.explode_outer(F.when(F.col("marks").isNull(), grams(F.col("word"))))).join(F.broadcast(spots), "gram", "left")
    hits = looked.where(F.col("marks").isNotNull() | F.contains("word", "term"))
    each = hits.select(*key, F.explode(F.coalesce("marks", F.array(mark))).alias("m")).select(*key, "m.at", "m.mask")
    united = each.groupBy(*key, "at").agg(F.bit_or("mask").alias("mask")).groupBy(*key).agg(F.collect_list(mark).alias("marks"))
    return corpus.select(*light).dropDuplicates(key).join(united, key)


def keyword_search(corpus: DataFrame, queries: DataFrame, limit: Column | int = 10, filters: str | None = None, most: int | None = None) -> DataFrame:
    """Share of each query's ``terms`` (repeats count) that the lower-cased content holds; no terms find nothing.

    Terms are bits, as many as they stand times in a query.  Those of a row
    are found once, and a pair's score is how many bits row and query share:
    64 bits of rows meet those of queries on equal places, and a row's pairs
    are summed where the row is.  Pairs aren't sorted: scores are few numbers,
    so they are counted for each query first, and only pairs from the score up
    that fills the limit are ordered.  (document_id, chunk_id) names a row;
    rows that repeat it count as one.  Contents join the best rows only.
    """
    key = ["document_id", "chunk_id"]
    wanted = (*key, "tenant_id", "classification_clearance", *(("metadata", *ATTRIBUTES) if filters else ()))
    light = [c for c in corpus.columns if c in wanted]
    asked = queries.where(F.size("terms") > 0).withColumn("__limit", limit if isinstance(limit, Column) else F.lit(limit))
    times = settle(asked.select("query_id", F.explode("terms").alias("term")).groupBy("query_id", "term").agg(F.count("*").cast("int").alias("times")))
    # In one task, but these are the distinct terms of the queries only.
    start = (F.sum("times").over(W.orderBy("term").rowsBetween(W.unboundedPreceding, 0)) - F.col("times")).cast("int")
    common = settle(common_words(corpus, COMMON_WORDS))
    numbered = settle(rare_grams(common, times.groupBy("term").agg(F.max("times").alias("most")).withColumnRenamed("most", "times").withColumn("start", start)))
    rows = settle(held_terms(corpus, light, settle(marks(numbered, ["term", "gram"], F.col("start"), F.col("times"))), common))
    own = marks(times.join(numbered.select("term", "start"), "term"), ["query_id"], F.col("start"), F.col("times")).withColumnRenamed("mask", "q_mask")
    narrow = asked.select("query_id", "__limit", "q_clearance", "q_tenant", *([filters] if filters else []), F.size("terms").alias("n_terms"))
    meets = visible_to_queries(corpus)
    meets = meets & ((F.size(filters) == 0) | matches(corpus, F.col(filters))) if filters else meets
    spread = rows.repartition(*key)
    best = None
    for part in parts_of(settle(narrow.join(own, "query_id")), MOST_BROADCAST_KEYS):
        met = spread.select(*light, F.explode("marks").alias("m")).select(*light, "m.*").join(F.broadcast(part), "at").where(meets)
        hits = met.groupBy(*key, "query_id", "__limit", "n_terms").agg(F.sum(F.bit_count(F.col("mask").bitwiseAND(F.col("q_mask")))).alias("held"))
        counts = hits.groupBy("query_id", "__limit", "held").agg(F.count("*").alias("n")).where("held > 0")
        above = F.sum("n").over(W.partitionBy("query_id").orderBy(F.desc("held"))) - F.col("n")
        least = counts.withColumn("above", above).where(F.col("above") < F.col("__limit")).groupBy("query_id").agg(F.min("held").alias("least"))
        near = hits.join(few(settle(least), MOST_BROADCAST_KEYS), "query_id").where("held >= least")
        scored = near.withColumn("score", F.col("held") / F.col("n_terms"))
        one = settle(top(scored, F.col("__limit"), limit if isinstance(limit, int) else most).select("query_id", *key, "score", "rank"))  # at most the limit for each query
        best = one if best is None else best.unionByName(one)
    return with_best(corpus, best).withColumn("engine", F.lit("keyword"))


def metadata_search(corpus: DataFrame, queries: DataFrame, limit: Column | int = 10, filters: str = "filters", numeric: bool = False, most: int | None = None) -> DataFrame:
    """Rows that meet all of a query's filters, with score 1; a query without filters finds nothing."""
    asked = queries.where(F.size(filters) > 0)
    joined = paired(corpus, asked).where(matches(corpus, F.col(filters), numeric))
    return top(joined.withColumn("score", F.lit(1.0)), limit, most).withColumn("engine", F.lit("metadata"))


def candidates(found: DataFrame) -> DataFrame:
    """Results as candidates: blank contents go, an empty path becomes ``/document_id``."""
    path = F.coalesce(F.nullif(F.col("source_path"), F.lit("")), F.concat(F.lit("/"), F.col("document_id")))
    title = F.col("section_title") if "section_title" in found.columns else F.lit(None).cast("string")
    kept = found.where(~is_blank(F.col("content"))).withColumn("source_path", path).withColumn("section_title", title)
    return kept.select(*CANDIDATE)


def best_of_engines(found: DataFrame) -> DataFrame:
    """One candidate per query, document and chunk: the best score, then the earlier engine and rank."""
    engine = F.array_position(F.array(*map(F.lit, ENGINES)), F.col("engine"))
    key = W.partitionBy("query_id", "document_id", "chunk_id").orderBy(F.desc("score"), engine, "rank")
    return found.withColumn("__n", F.row_number().over(key)).where("__n = 1").drop("__n")


def schedule(tasks: DataFrame) -> DataFrame:
    """Tasks that may run (a tenant, a positive timeout and limit), in order of group, engine and name."""
    priority = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ENGINES)), F.col("engine")), F.lit(0)), F.lit(100)).cast("int") - 1
    admitted = tasks.where((F.coalesce("tenant_id", F.lit("")) != "") & (F.col("timeout_ms") > 0) & (F.col("candidate_limit") > 0))
    ordered = W.partitionBy("plan_id").orderBy("parallel_group", priority, "engine")
    return admitted.withColumn("position", F.row_number().over(ordered))


def session_status(outcomes: DataFrame) -> DataFrame:
    """completed, partial or failed, by how many of a session's workers succeeded."""
    done = outcomes.groupBy("session_id").agg(F.count("*").alias("workers"), F.count_if("succeeded").alias("succeeded"))
    status = F.when(F.col("succeeded") == F.col("workers"), "completed").when(F.col("succeeded") == 0, "failed").otherwise("partial")
    return done.withColumn("status", status)
