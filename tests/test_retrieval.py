"""Exact values of search, fusion, ranking and assembly."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quarryline.functions import vectors as V
from quarryline.operators import assembly, fusion, search, understanding

CANDIDATE = "query_id int, engine string, document_id string, chunk_id string, source_path string, section_title string, content string, score double, rank int"


def candidate(engine, doc, chunk, score, rank, content="text", query=1):
    return (query, engine, doc, chunk, f"/{doc}", None, content, score, rank)


CORPUS = "document_id string, chunk_id string, content string, source_path string, tenant_id string, classification_clearance string, language string, metadata map<string,string>, vector array<double>"


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [
        ("d1", "c1", "Compare EKA and EKB architecture", "/docs/d1.md", "t1", "restricted", "en", {"group": "a"}, [1.0, 0.0]),
        ("d2", "c1", "unrelated topic", "/docs/d2.md", "t1", "public", "en", {"group": "b"}, [0.6, 0.8]),
        ("d3", "c1", "another topic about architecture", "/docs/d3.md", "t2", "internal", "de", {}, [0.6, 0.8]),
        ("d4", "c1", None, "", "t2", "public", None, None, [-1.0, 0.0]),
        ("d5", "c1", " ", "", "t2", "public", None, None, None),
        ("d6", "c1", "three numbers", "", "t1", "public", None, None, [1.0, 0.0, 0.0]),
    ]
    return spark.createDataFrame(rows, CORPUS)


def asked(spark, **columns):
    base = {"query_id": 1, "q_clearance": "restricted", "q_tenant": ""} | columns
    kinds = {"query_id": "int", "q_clearance": "string", "q_tenant": "string", "q_vector": "array<double>", "terms": "array<string>", "filters": "array<struct<field:string,operator:string,value:string>>"}
    return spark.createDataFrame([tuple(base.values())], ", ".join(f"{k} {kinds[k]}" for k in base))


def found(df):
    return [(r["document_id"], r["rank"], round(r["score"], 6)) for r in df.orderBy("rank").collect()]


def test_vector_search_drops_what_does_not_point_the_same_way(spark, corpus):
    assert found(search.vector_search(corpus, asked(spark, q_vector=[1.0, 0.0]), 10)) == [("d1", 0, 1.0), ("d2", 1, 0.6), ("d3", 2, 0.6)]
    assert found(search.vector_search(corpus, asked(spark, q_vector=[1.0, 0.0]), 10, size=2)) == [("d1", 0, 1.0), ("d2", 1, 0.6), ("d3", 2, 0.6)]
    assert found(search.vector_search(corpus, asked(spark, q_vector=[0.0, 0.0]), 10)) == []


def test_clearance_and_tenant_hold_in_every_engine(spark, corpus):
    public = asked(spark, q_vector=[1.0, 0.0], q_clearance="public")
    assert [d for d, _, _ in found(search.vector_search(corpus, public, 10))] == ["d2"]
    tenant = asked(spark, terms=["architecture"], q_tenant="t2")
    assert [d for d, _, _ in found(search.keyword_search(corpus, tenant, 10))] == ["d3"]
    low = asked(spark, filters=[("language", "eq", "en")], q_clearance="internal")
    assert [d for d, _, _ in found(search.metadata_search(corpus, low, 10))] == ["d2"]


def test_keyword_scores_count_repeats_and_substrings(spark, corpus):
    got = found(search.keyword_search(corpus, asked(spark, terms=["architecture", "arch", "topic", "topic"]), 10))
    assert got == [("d3", 0, 1.0), ("d1", 1, 0.5), ("d2", 2, 0.5)]
    assert found(search.keyword_search(corpus, asked(spark, terms=[]), 10)) == []


def test_keyword_index_against_contains(spark):
    rng = random.Random(3)
    docs = [(f"d{i}", "c", "".join(rng.choices("ab c", k=30)), "/p", "t", "public", None, None, None) for i in range(60)]
    queries = [(i, ["".join(rng.choices("abc", k=rng.randrange(1, 4))) for _ in range(rng.randrange(0, 5))], "public", "") for i in range(20)]
    df = search.keyword_search(spark.createDataFrame(docs, CORPUS), spark.createDataFrame(queries, "query_id int, terms array<string>, q_clearance string, q_tenant string"), 100)
    got = {(r["query_id"], r["document_id"]): r["score"] for r in df.collect()}
    want = {(q, d[0]): sum(t in d[2] for t in terms) / len(terms) for q, terms, _, _ in queries for d in docs if any(t in d[2] for t in terms)}
    assert got == pytest.approx(want)


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_keyword_search_is_joins_on_equal_keys(spark):
    docs = [(f"d{i}", "c", f"Word{i % 7} plain-word_x {'É' * i}", "/p", "t", "public", None, None, None) for i in range(40)]
    docs += [docs[3]] * 3  # a repeated row is one row
    corpus = spark.createDataFrame(docs, CORPUS)
    queries = spark.createDataFrame([(1, ["ord3", "n-word_x", "x", "ord3"], "public", ""), (2, ["absent", "wor"], "public", "t")], "query_id int, terms array<string>, q_clearance string, q_tenant string")
    df = search.keyword_search(corpus, queries, 100)
    got = sorted((r["query_id"], r["document_id"], round(r["score"], 9)) for r in df.collect())
    want = []
    for q, terms in ((1, ["ord3", "n-word_x", "x", "ord3"]), (2, ["absent", "wor"])):
        want += [(q, d, round(n / len(terms), 9)) for d, text in {d[0]: d[2].lower() for d in docs}.items() if (n := sum(t in text for t in terms))]
    assert got == sorted(want)
    assert not any(x in plan_of(df) for x in ("Python", "MapInArrow", "NestedLoop", "Cartesian"))


def test_many_queries_need_no_nested_loop(spark, corpus):
    queries = spark.range(25_000).select(F.col("id").alias("query_id"), F.array(F.lit(1.0), (F.col("id") % 7 / 10).cast("double")).alias("q_vector"), F.lit("restricted").alias("q_clearance"),
                                         F.when(F.col("id") % 3 == 0, "t2").otherwise("").alias("q_tenant"), F.array(F.struct(F.lit("language").alias("field"), F.lit("eq").alias("operator"), F.lit("en").alias("value"))).alias("filters"))
    for df in (search.vector_search(corpus, queries, 10, 2), search.metadata_search(corpus, queries, 10)):
        assert not any(x in plan_of(df) for x in ("NestedLoop", "Cartesian"))
    some = queries.where("query_id < 60")
    small = search.paired(corpus, some, most=7)
    key = lambda df: sorted((r["query_id"], r["document_id"]) for r in df.select("query_id", "document_id").collect())
    assert key(small) == key(search.paired(corpus, some)) == key(corpus.join(some, search.visible_to_queries(corpus))) != []
    assert search.paired(corpus, some.limit(0)).count() == 0


def test_filters(spark, corpus):
    assert found(search.metadata_search(corpus, asked(spark, filters=[]), 10)) == []
    assert [d for d, _, _ in found(search.metadata_search(corpus, asked(spark, filters=[("group", "gte", "b")]), 10))] == ["d2"]
    assert found(search.metadata_search(corpus, asked(spark, filters=[("nowhere", "eq", "x")]), 10)) == []


def test_allowed_clearances():
    assert search.allowed_clearances(None) == ["public"]
    assert search.allowed_clearances("confidential") == ["public", "internal", "confidential"]
    with pytest.raises(ValueError):
        search.allowed_clearances(None, required=True)


def test_candidates_skip_blank_contents_and_default_the_path(spark, corpus):
    rows = search.candidates(search.vector_search(corpus, asked(spark, q_vector=[1.0, 0.0, 0.0]), 10)).collect()
    assert [(r["document_id"], r["source_path"]) for r in rows] == [("d6", "/d6")]


def test_two_first_hits_fuse_to_two_sixty_firsts(spark):
    df = spark.createDataFrame([candidate("vector", "d1", "c1", 0.9, 0), candidate("keyword", "d1", "c1", 0.7, 0), candidate("vector", "", "c", 0.1, 1)], CANDIDATE)
    row = fusion.fuse(df).first()
    assert row["fusion_score"] == pytest.approx(2 / 61) and row["best_score"] == 0.9 and row["knowledge_id"] == "ko-d1-c1"
    assert [e["engine"] for e in row["evidence"]] == ["vector", "keyword"]


def test_identity_policies_and_order_of_rows(spark):
    rows = [candidate("vector", "d1", "c1", 0.9, 0), candidate("vector", "d1", "c2", 0.8, 1), candidate("keyword", "d2", "c1", 0.9, 0)]
    assert {r["knowledge_id"] for r in fusion.fuse(spark.createDataFrame(rows, CANDIDATE), "document").collect()} == {"ko-d1", "ko-d2"}
    a = fusion.fuse(spark.createDataFrame(rows, CANDIDATE)).orderBy("fusion_rank").collect()
    b = fusion.fuse(spark.createDataFrame(rows[::-1], CANDIDATE).repartition(3)).orderBy("fusion_rank").collect()
    assert a == b and [r["knowledge_id"] for r in a] == ["ko-d1-c1", "ko-d2-c1", "ko-d1-c2"]


def test_ranking_composes_explains_and_limits(spark):
    fused = fusion.fuse(spark.createDataFrame([candidate("vector", "d1", "c1", 0.8, 0, "Alpha beta"), candidate("keyword", "d1", "c1", 0.5, 0, "Alpha beta"), candidate("keyword", "d2", "c1", 0.5, 1, " ")], CANDIDATE))
    rows = fusion.rank(fused.withColumn("query_terms", F.array(F.lit("alpha"), F.lit("gamma")))).collect()
    assert len(rows) == 1 and rows[0]["coverage"] == 0.5 and rows[0]["fusion"] == 1.0
    assert rows[0]["composite"] == pytest.approx(0.8 * 0.35 + 0.5 * 0.2 + 0.1 + 0.5 * 0.25)
    assert rows[0]["explanation"] == "composite=0.6050 <- coverage=0.500*0.25 + fusion=1.000*0.10 + lexical=0.500*0.20 + metadata=0.000*0.10 + semantic=0.800*0.35"


def select(items, policy):
    """What the greedy selection must do, read in order."""
    chosen, seen, total, drops = [], set(), 0, {"budget": 0, "copies": 0, "low": 0}
    for rank, composite, text in items:
        text = " ".join(text.split())
        tokens = max(1, len(text) // 4) if text else 0
        if composite < policy.min_relevance:
            drops["low"] += 1
        elif text in seen:
            drops["copies"] += 1
        elif len(chosen) >= policy.max_objects or (chosen and total + tokens > policy.max_tokens):
            drops["budget"] += 1
        else:
            chosen.append(rank)
            seen.add(text)
            total += tokens
    return chosen, total, drops


def test_greedy_selection_against_a_loop(spark):
    rng = random.Random(1)
    policy = assembly.AssemblyPolicy(max_tokens=60, max_objects=4, min_relevance=0.2)
    rows, want = [], {}
    for q in range(40):
        items = [(i + 1, rng.random(), rng.choice(["short", "a  b\n c", "x" * rng.randrange(300), "long " * rng.randrange(1, 60)])) for i in range(rng.randrange(1, 9))]
        want[q] = select(items, policy)
        rows += [(q, r, c, t, f"d{r}", "c", "/p", "why") for r, c, t in items]
    df = spark.createDataFrame(rows, "query_id int, rank int, composite double, content string, document_id string, chunk_id string, source_path string, explanation string")
    for r in assembly.select_context(df, policy).collect():
        chosen, total, drops = want[r["query_id"]]
        assert [s["rank"] for s in r["selected"]] == chosen and r["total_tokens"] == total
        assert (r["dropped_for_budget"], r["dropped_duplicates"], r["dropped_below_relevance"]) == tuple(drops.values())


def test_citation_lineage_is_kept_or_fails(spark):
    df = spark.createDataFrame([(1, 1, 0.5, "text", "d", "c", "", "why")], "query_id int, rank int, composite double, content string, document_id string, chunk_id string, source_path string, explanation string")
    with pytest.raises(Exception, match="citation lineage"):
        assembly.context_items(assembly.select_context(df)).collect()


def test_snippet_response_type_and_prompt(spark):
    one = lambda c, **v: spark.createDataFrame([tuple(v.values())], ", ".join(f"{k} string" for k in v)).select(c).first()[0]
    assert one(assembly.snippet(F.col("t")), t="> Context: A\n\n# Title\n\nSome  text\nhere") == "Some text here"
    assert one(assembly.snippet(F.col("t")), t="x" * 300) == "x" * 240 + "…"
    kinds = {"| a | b |\n|---|---|": "table", "```\nx": "structured", "- a\n- b": "list", "- a": "conversational", "**b**": "markdown", "plain": "conversational"}
    assert {t: one(assembly.response_type(F.col("t")), t=t) for t in kinds} == kinds
    values = {n: F.lit(n) for n in ("identity", "behavior", "policies", "objective", "context", "format")}
    text = one(assembly.prompt(values)["prompt_text"], t="")
    assert text.startswith("You are identity. behavior Answer strictly") and text.endswith("User request: objective\n\nRespond in format format.")


def test_cosine_cases(spark):
    cases = [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0], [1.0, 0.0], 0.0), ([0.0, 0.0], [1.0, 0.0], 0.0), (None, [1.0], 0.0), ([3.0, 4.0], [4.0, 3.0], 24 / 25)]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "a array<double>, b array<double>")
    got = df.select(V.cosine(F.col("a"), F.col("b"), V.norm(F.col("a")), V.norm(F.col("b")))).collect()
    assert [r[0] for r in got] == pytest.approx([c for _, _, c in cases])


def test_hash_embedding_is_that_of_the_digest(spark):
    import hashlib
    import struct

    for text in ("hello", "", "é"):
        seed, values = text or "\x00", []
        for counter in range(2):
            values += [w / 2**32 * 2 - 1 for w in struct.unpack(">8I", hashlib.sha256(f"{counter}:{seed}".encode()).digest())]
        values = values[:12]
        length = math.sqrt(sum(v * v for v in values))
        got = spark.createDataFrame([(text,)], "t string").select(V.hash_embedding(F.col("t"), 12)).first()[0]
        assert got == pytest.approx([v / length for v in values])


QUERIES = {
    "after:2024 Show the Sales Report": {"filters": [("after", "gte", "2024")], "entities": ["Show", "Sales Report"], "dates": ["2024"], "normalized_query": "Show the Sales Report"},
    '“big deal” and "Blue Whale" 3.5': {"entities": ["Blue Whale"], "numbers": ["3.5"], "normalized_query": "\"big deal\" and \"Blue Whale\" 3.5", "filters": [("source_group", "eq", "whale")]},
    "product:Tools blue whale": {"filters": [("source_group", "eq", "tools")]},
    "what is the API": {"enterprise_terms": ["interface"], "confidence": 0.9},
}


@pytest.mark.parametrize("query", QUERIES)
def test_understanding(spark, query):
    vocabulary = understanding.Vocabulary(acronyms={"api": "interface"}, products={"blue whale": "whale", "whale": "other"})
    row = understanding.understood(spark.createDataFrame([(1, query)], "query_id int, query string"), vocabulary).first()
    got = {k: [tuple(f) for f in row[k]] if k == "filters" else row[k] for k in QUERIES[query]}
    assert got == QUERIES[query]


def test_refused_queries_and_plans(spark):
    df = spark.createDataFrame([(1, " "), (2, "x" * 2049), (3, "compare a versus b"), (4, "gdpr")], "query_id int, query string")
    errors = {r["query_id"]: r["error"] for r in understanding.understood(df).collect()}
    assert errors == {1: "empty_query", 2: "query_too_long", 3: None, 4: None}
    plans = {r["query_id"]: r for r in understanding.plan_queries(df, force_hybrid=False).collect()}
    assert plans[3]["engines"] == ["vector", "keyword"] and plans[3]["ranking_strategy"] == "hybrid" and plans[3]["candidate_count"] == 20
    assert plans[4]["engines"] == ["vector", "metadata"] and plans[4]["ranking_strategy"] == "metadata_weighted" and plans[4]["total_candidate_limit"] == 60
    assert understanding.parse_products("a=b; Big Cat = big-cat ;bad;=x") == {"a": "b", "big cat": "big-cat"}


def test_bits_of_terms_by_common_words_and_by_grams(spark):
    docs = [("d1", "c", "Alpha beta-x rare9 alpha"), ("d1", "c", "gamma"), ("d2", "c", "betaxy a"), ("d3", "c", None)]
    corpus = spark.createDataFrame(docs, "document_id string, chunk_id string, content string")
    terms = ["alpha", "lph", "beta", "a", "are9", "gamma", "none"]
    for common in (["alpha", "betaxy"], []):
        words = spark.createDataFrame([(w,) for w in common], "word string")
        numbered = search.rare_grams(words, spark.createDataFrame([(t, 40, 40 * i) for i, t in enumerate(terms)], "term string, times int, start int"))
        spots = search.marks(numbered, ["term", "gram"], F.col("start"), F.col("times"))
        got = {}
        for r in search.held_terms(corpus, ["document_id", "chunk_id"], spots, words).collect():
            got[r["document_id"]] = {m["at"] * 64 + b for m in r["marks"] for b in range(64) if m["mask"] >> b & 1}
        held = {"d1": ["alpha", "lph", "beta", "a", "are9", "gamma"], "d2": ["beta", "a"]}
        assert got == {d: {40 * terms.index(t) + j for t in own for j in range(40)} for d, own in held.items()}


def test_fusion_gathers_no_content_that_nobody_asks_for(spark):
    rows = spark.createDataFrame([candidate("vector", "d", "c", 0.4, 0), candidate("keyword", "d", "c", 0.9, 3), candidate("keyword", "e", "c", 0.9, 1)], CANDIDATE)
    light = fusion.fuse(rows).select("query_id", "knowledge_id", "fusion_score", "best_score")
    assert "content" not in light._jdf.queryExecution().optimizedPlan().toString().split("LogicalRDD")[0].split("LocalRelation")[0]
    assert sorted((r["knowledge_id"], round(r["fusion_score"], 6), r["best_score"]) for r in light.collect()) == [("ko-d-c", round(1 / 61 + 1 / 64, 6), 0.9), ("ko-e-c", round(1 / 62, 6), 0.9)]
