"""The registered queries and the pipeline on small tables: columns, types, edge rows, clashing names, no rows."""

import importlib
import math
import random
import zlib
from importlib.util import find_spec

import pytest
from pyspark.sql import functions as F

from quarryline.llm import html_consensus, langid_hd, mixing, mpeg_audio, quality_bayes, quality_llr, queries, simhash, url_rules
from tests.llm.test_mixing import WORD, water
from tests.llm.test_quality import base
from tests.llm.test_simhash import fingerprint, groups

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
TABLES = {
    "documents": DOCUMENTS, "pages": "page_id long, url string, html string", "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string", "benchmark": "item_id long, text string",
}
#: Names that operators may use on their way, or that other users of them may.
CLASHES = ["__a", "__b", "__copy", "host_n", "path_n", "language", "media", "text_", "node", "row", "host", "path", "odds", "vote", "read", "size", "copy", "stored", "words", "component", "has_word", "verdict", "meta.site", "a`tick", "a", "b", "shards", "taken", "target", "__key"]
#: Columns that operators return beside those that they get; the stages of the pipeline return none.
VERDICTS = ["kept", "quality_score", "doc_llr", "host_posterior", "path_posterior", "llr", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "fingerprint", "component_id", "source_size", "held_out", "lang_pred", "score"]


def documents():
    rng = random.Random(21)
    words = ["the", "river", "runs", "over", "stones", "été", "mills", "stand", "beside", "it"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(8, 200))), ["en", "fr", None][i % 3], ["a", "b", "hot", "hot", None][i % 5], 1) for i in range(60)]
    rows += [(100 + i, "BUY NOW $$$ ### | win!!! " * 12, "en", "hot", 1) for i in range(6)]
    rows += [(200, None, None, None, None), (201, "", "en", "a", 0), (202, " \n\t", "en", "a", 0), (None, "no id here at all", "en", "b", 3), (203, "w " * 60_000, "en", "hot", 9), (204, "x" * 300_000, None, "hot", 9)]
    return rows + [rows[3]] * 5 + [(300, rows[4][1], "en", "b", 1)]


ROWS = {
    "documents": documents(), "labels": [(i, 1, 0) for i in range(0, 60, 2)] + [(100 + i, 0, 0) for i in range(5)] + [(None, 1, 0), (0, None, 0), (999, 0, 1)],
    "pages": [(1, "http://Example.com/en/71?x", "<nav>m</nav><article><p>a &amp;  b<p>c"), (2, None, None), (None, "no scheme", ""), (2, None, None), (3, "http://x.net/" + "de/" * 400, "<div>" * 2000 + "deep")],
    "conversations": [(1, 0, "user", "hi"), (1, 1, "assistant", None), (None, None, None, None), (1, 1, "assistant", None), (2, 0, "assistant", "long " * 50_000)],
    "benchmark": [(1, "The river runs over stones"), (2, None), (None, "été"), (1, "buy now"), (3, "w")],
}


def folder_of(spark, path, rows):
    for name, schema in TABLES.items():
        spark.createDataFrame(rows[name], schema).repartition(3).write.parquet(str(path / f"{name}.parquet"))
    return str(path)


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    return folder_of(spark, tmp_path_factory.mktemp("small"), ROWS)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return folder_of(spark, tmp_path_factory.mktemp("empty"), dict.fromkeys(TABLES, []))


COLUMNS = {
    "op1_url_filter": "page_id bigint, host string, path string, rule string, verdict string", "op2_simhash": "doc_id bigint, fingerprint string, component_id bigint", "op3_quality_classifier": "doc_id bigint",
    "op4_chat_format": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint", "op5_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op6_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double", "op7_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op8_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint", "op9_html_extraction": "page_id bigint, url string, text string, n_chars bigint",
    "op10_media_columns": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op11_lm_scores": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double", "op12_ranked_search": "item_id bigint, rank int, doc_id bigint, score bigint",
    "op13_prefix_trie": "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string",
}


@pytest.mark.parametrize("name", queries.QUERIES)
def test_columns_and_empty_tables(spark, small, empty, name):
    out = queries.QUERIES[name](spark, small)
    assert ", ".join(f"{n} {t}" for n, t in out.dtypes).startswith(COLUMNS[name])
    own = {"op1_url_filter": "pages", "op9_html_extraction": "pages", "op4_chat_format": None, "op8_packing": None, "op12_ranked_search": None, "op13_prefix_trie": None}.get(name, "documents")
    assert out.count() == len(ROWS[own]) if own else out.count() > 0
    assert queries.QUERIES[name](spark, empty).count() == (1 if name == "op4_chat_format" else 0)


def test_op2(spark, small):
    rows = sorted(ROWS["documents"], key=lambda r: (r[0] is None, r[0] or 0))
    label = groups([fingerprint(r[1]) for r in rows])
    want = sorted((str(r[0]), f"{fingerprint(r[1]):016x}", str(rows[x][0])) for r, x in zip(rows, label, strict=True))
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in queries.op2_simhash(spark, small).collect()) == want


def test_op5(spark, small):
    got, sizes = queries.op5_mixing(spark, small).collect(), {}
    for _, text, _, source, _ in ROWS["documents"]:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    goal = water(sizes)
    assert sorted(r["size"] for r in got) == sorted(len(WORD.findall(r[1] or "")) for r in ROWS["documents"])
    for source in sizes:
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - goal[source]) <= 1 and own[0]["target"] == pytest.approx(goal[source])
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert sorted(map(str, got)) == sorted(map(str, queries.op5_mixing(spark, small).collect()))


def test_op7(spark, small):
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = sorted(str((r["doc_id"], *(r[c] for c in fields))) for r in queries.op7_quality_rules(spark, small).collect())
    assert got == sorted(str((r[0], *base(r[1]))) for r in ROWS["documents"])


def test_op10(spark, small):
    for r in queries.op10_media_columns(spark, small).collect():
        assert len(r["frame_offsets"]) == r["n_frames"] and r["frame_offsets"] == sorted(r["frame_offsets"]) and r["bad_checksums"] == 0
        assert r["payload_bytes"] % 64 == 0 and 0 <= r["payload_bytes"] - r["n_bytes"] <= 64
    empty_text = mpeg_audio.payload_of(None)[1]
    assert zlib.crc32(empty_text) in {r["tail_crc32"] for r in queries.op10_media_columns(spark, small).where("n_bytes = 0").collect()}


# --- clashing names -----------------------------------------------------------------


def with_clashes(df, names, clashes=CLASHES):
    value = lambda c: F.concat(F.lit(f"{c}-"), F.coalesce(F.col(names).cast("string"), F.lit("none")))
    own = [F.col(c) for c in df.columns]
    return df.select(*own, *(value(c).alias(c) for c in clashes))


def stage(name):
    return lambda df, folder: dict(importlib.import_module("corpus_pipeline").STAGES)[name](df.sparkSession, df, folder)


OPERATORS = {
    "op1": ("pages", lambda df, _: url_rules.judge_urls(df, df.sparkSession.createDataFrame(queries.URL_RULES, "host string, path string, verdict string"))),
    "op3": ("documents", lambda df, folder: quality_bayes.classify(df, df.sparkSession.read.parquet(f"{folder}/labels.parquet"), "text", "doc_id", F.col("source"), F.col("lang"))),
    "op5": ("documents", lambda df, _: mixing.mixed_documents(df)), "op6": ("documents", lambda df, _: langid_hd.predict(df, langid_hd.learn(df, "text", "lang", "doc_id", F.lit(True)))),
    "op7": ("documents", lambda df, folder: quality_llr.judge(df, quality_llr.log_ratios(df, df.sparkSession.read.parquet(f"{folder}/labels.parquet")))),
    "op9": ("pages", lambda df, _: html_consensus.main_text(df)), "op10": ("documents", lambda df, _: mpeg_audio.probed(mpeg_audio.with_media(df))),
    "dedup": ("documents", lambda df, _: simhash.keep_one(df)),
} | ({x: ("documents", stage(x)) for x in ("quality classifier", "quality rules", "near-dedup", "mixing")} if find_spec("corpus_pipeline") else {})


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_keep_their_values(spark, small, name):
    table, run = OPERATORS[name]
    df = spark.read.parquet(f"{small}/{table}.parquet")
    key = df.columns[0]
    plain, clashed = run(df, small), run(with_clashes(df, key), small)
    outputs = set(plain.columns) - set(df.columns)
    extra = [c for c in CLASHES if c not in outputs]
    assert set(clashed.columns) == set(plain.columns) | set(extra)
    rows = clashed.collect()
    for r in rows:
        assert all(r[c] == f"{c}-{'none' if r[key] is None else r[key]}" for c in extra)
    if name not in ("op5", "mixing", "dedup", "near-dedup"):  # there, the choice among copies goes by the whole row
        digits = lambda v: round(v, 9) if isinstance(v, float) and not math.isnan(v) else v
        of = lambda rs: sorted(str([digits(r[c]) for c in plain.columns if c != "media"]) for r in rs)
        assert of(rows) == of(plain.collect())
    else:
        assert sorted(str(r[key]) for r in rows if name.endswith("dedup")) == sorted(str(r[key]) for r in plain.collect() if name.endswith("dedup"))


@pytest.mark.skipif(find_spec("corpus_pipeline") is None, reason="no pipeline")
@pytest.mark.parametrize("name", ["quality classifier", "quality rules", "near-dedup", "mixing"])
def test_stages_keep_columns_of_all_names_and_types(spark, small, name):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    wide = with_clashes(docs, "doc_id", CLASHES + VERDICTS)
    wide = wide.select("*", F.create_map(F.lit("k"), F.struct(F.col("doc_id"), F.create_map(F.lit("m"), F.col("n_chars"))), F.lit("a"), F.lit(None)).alias("map"), F.array(F.create_map(F.lit("x"), "lang")).alias("maps"))
    out = stage(name)(wide, small)
    assert out.dtypes == wide.dtypes and 0 < out.count()
    for r in out.collect():
        own = "none" if r["doc_id"] is None else r["doc_id"]
        assert all(r[c] == f"{c}-{own}" for c in CLASHES + VERDICTS)
        assert r["map"]["k"]["doc_id"] == r["doc_id"] and r["maps"] == [{"x": r["lang"]}] and r["map"]["a"] is None
    plain = stage(name)(docs, small)
    if name != "mixing":
        assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(str(r["doc_id"]) for r in plain.collect())


@pytest.mark.skipif(find_spec("corpus_pipeline") is None, reason="no pipeline")
def test_pipeline_of_edge_rows_and_of_none(spark, small, empty):
    pipeline = importlib.import_module("corpus_pipeline")
    out = pipeline.run(spark, small)
    assert out.count() > 0 and {r["doc_id"] for r in out.collect()} <= {r[0] for r in ROWS["documents"]}
    assert pipeline.run(spark, empty).count() == 0


# --- many copies of one row -------------------------------------------------------------


def test_copies_of_one_row_are_counted_and_numbered(spark, monkeypatch):
    rows = [(1, "a b c", "hot")] * 700 + [(2, "d e", "hot")] * 3 + [(3, "f", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    told = mixing.told_apart(df, chunk=100).collect()
    assert sorted((r["doc_id"], r["copy"]) for r in told) == sorted([(1, i) for i in range(700)] + [(2, i) for i in range(3)] + [(3, 0)])
    out = mixing.mixed_documents(df)
    plan = mixing.mix(df).collect()
    assert len(plan) == len(rows) and len({(r["doc_id"], r["copy"]) for r in plan}) == len(rows)
    assert out.agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == sum(r["taken"] for r in plan)
