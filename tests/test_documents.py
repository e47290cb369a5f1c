"""Exact values of change detection, Markdown, profiles, chunks, publication and sources."""

import random

import pytest
from pyspark.sql import functions as F

from quarryline.functions import text as X
from quarryline.operators import changes, chunking, evaluation, markdown, profile, publishing
from quarryline.plans import ingestion
from quarryline.sources import files, stores

INVENTORY = "source_path string, content_hash string, size_bytes long, position long"
TWINS = "document_id string, source_path string, content_hash string, position long"


def diff(spark, inventory, twins, **options):
    rows = changes.snapshot_diff(
        spark.createDataFrame([(p, h, 1, i) for i, (p, h) in enumerate(inventory)], INVENTORY), spark.createDataFrame([(f"t{i}", p, h, i) for i, (p, h) in enumerate(twins)], TWINS), **options
    )
    return sorted((r["change_type"], r["source_path"], r["document_id"], r["previous_path"]) for r in rows.collect())


def test_rename_move_and_copies(spark):
    assert diff(spark, [("docs/new.txt", "h")], [("docs/old.txt", "h")]) == [("renamed", "docs/new.txt", "t0", "docs/old.txt")]
    assert diff(spark, [("archive/a.txt", "h")], [("docs/a.txt", "h")]) == [("moved", "archive/a.txt", "t0", "docs/a.txt")]
    assert [x[0] for x in diff(spark, [("n", "h")], [("o", "h")], detect_renames=False)] == ["created", "deleted"]
    # two new items, two vanished twins of one hash: the first item takes the last twin
    assert diff(spark, [("n1", "h"), ("n2", "h")], [("o1", "h"), ("o2", "h")]) == [("created", "n2", None, None), ("deleted", "o1", "t0", None), ("renamed", "n1", "t1", "o2")]
    same = [(f"p{i}", f"h{i}") for i in range(5)]
    assert {x[0] for x in diff(spark, same, same)} == {"unchanged"} and diff(spark, [], []) == []


def by_loop(inventory, twins):
    paths, known, used, out, fresh = dict(inventory), {p: (i, h) for i, (p, h) in enumerate(twins)}, set(), [], []
    for p, h in inventory:
        if p in known:
            used.add(known[p][0])
            out.append(("unchanged" if known[p][1] == h else "modified", p, f"t{known[p][0]}", None))
        else:
            fresh.append((p, h))
    vanished = {h: (i, p) for i, (p, h) in enumerate(twins) if p not in paths}
    for p, h in fresh:
        i, old = vanished.get(h, (None, None))
        if i is not None and i not in used:
            used.add(i)
            kind = "renamed" if p.rpartition("/")[0] == old.rpartition("/")[0] else "moved"
            out.append((kind, p, f"t{i}", old))
        else:
            out.append(("created", p, None, None))
    return out + [("deleted", p, f"t{i}", None) for i, (p, _) in enumerate(twins) if i not in used]


def test_diff_against_a_loop(spark):
    rng = random.Random(9)
    paths = [f"{a}/{b}" for a in "xyz" for b in range(12)]
    for _ in range(4):
        inventory = [(p, f"h{rng.randrange(8)}") for p in rng.sample(paths, 20)]
        twins = [(p, f"h{rng.randrange(8)}") for p in rng.sample(paths, 20)]
        assert diff(spark, inventory, twins) == sorted(by_loop(inventory, twins), key=lambda x: (x[0], x[1]))


def test_paths(spark):
    cases = {"a.md": (".", "", "md", "a"), "/a.md": ("/", "", "md", "a"), "My Docs/Sub/A.TXT": ("My Docs/Sub", "my-docs", "txt", "A"), "x/.hidden": ("x", "x", "", ".hidden"), "x/no": ("x", "x", "", "no")}
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    p = F.col("p")
    got = {r[0]: tuple(r)[1:] for r in df.select(p, changes.parent_folder(p), changes.source_group(p), files.extension(p), files.stem(p)).collect()}
    assert got == cases


def test_apply_changes(spark):
    docs = spark.createDataFrame([("a", "p/a", "h1", 1, "active"), ("b", "p/b", "h2", 3, "deleted"), ("c", "p/c", "h3", 1, "active"), ("d", "p/d", "h4", 1, "active")], "document_id string, source_path string, content_hash string, version int, status string")
    kinds = "change_type string, source_path string, content_hash string, document_id string, previous_path string, size_bytes long"
    moves = spark.createDataFrame([("modified", "p/a", "h9", "a", None, 1), ("created", "p/b", "h7", None, None, 1), ("renamed", "p/e", "h3", "c", "p/c", 1), ("deleted", "p/d", None, "d", None, None), ("created", "p/z", "h5", None, None, 1)], kinds)
    got = {r["source_path"]: (r["content_hash"], r["version"], r["status"]) for r in changes.apply_changes(docs, moves).collect()}
    assert got == {"p/a": ("h9", 2, "active"), "p/b": ("h7", 4, "active"), "p/e": ("h3", 1, "active"), "p/d": ("h4", 1, "deleted"), "p/z": ("h5", 1, "active")}


@pytest.mark.parametrize(
    "dirty, clean",
    [("a\r\nb\rc", "a\nb\nc\n"), ("", ""), ("\n\n", ""), ("x  \n\n\n\ny\t", "x\n\ny\n"), ("é", "é\n"), ("a\u0000b​c\td", "abc\td\n"), ("  indent", "  indent\n"), ("a\n \nb", "a\n\nb\n")],
)
def test_normalize_text(spark, dirty, clean):
    assert spark.createDataFrame([(dirty,)], "t string").select(X.normalize_text(F.col("t"))).first()[0] == clean


MARKDOWN = """---
title: "A \\"b\\""
language: de
---
intro

# One
text
more

| a | b |
|---|---|
| 1 | 2024-01-02 | x |

## Two
- item
  more
1. first
> Note: careful
> now
```py
x = 1
```
![alt](img.png)
#tag line
####### seven
# Three
"""


def test_markdown_blocks_and_sections():
    got = markdown.parse(MARKDOWN)
    assert got["front_matter"] == {"title": 'A "b"', "language": "de"}
    assert [(b["block_type"], b["section_id"]) for b in got["blocks"]] == [
        ("paragraph", None), ("heading", "SEC-1"), ("paragraph", "SEC-1"), ("table", "SEC-1"), ("heading", "SEC-2"), ("list", "SEC-2"), ("note", "SEC-2"),
        ("code", "SEC-2"), ("image", "SEC-2"), ("paragraph", "SEC-2"), ("paragraph", "SEC-2"), ("heading", "SEC-3"),
    ]
    assert [s["breadcrumb"] for s in got["sections"]] == ["One", "One > Two", "Three"]
    assert got["blocks"][3]["table_rows"] == [["a", "b"], ["1", "2024-01-02", "x"]]
    assert markdown.parse(None)["blocks"] == [] and markdown.parse("#tag")["blocks"][0]["text"] == "#tag"


def test_profile_of_a_document(spark):
    row = profile.profiled(markdown.with_structure(spark.createDataFrame([(MARKDOWN,), (None,)], "text string"))).collect()
    r = next(x for x in row if x["text"])
    assert (r["language"], r["primary_topic"], r["complexity"], r["structure_score"]) == ("de", 'A "b"', "low", 100)
    t = r["tables"][0]
    assert (t["rows"], t["columns"], t["header_confidence"], t["contains_dates"], t["contains_numeric"]) == (1, 3, 0.67, True, True)
    assert r["table_score"] == 75 and r["image_score"] == 100 and r["quality"] == 94
    assert r["code_blocks"][0]["language"] == "py" and r["figures"][0]["reference"] == "img.png"
    empty = next(x for x in row if x["text"] is None)
    assert (empty["token_count"], empty["content_score"], empty["structure_score"]) == (0, 0, 60)


def test_languages_and_categories(spark):
    one = lambda c, t: spark.createDataFrame([(t,)], "t string").select(c(F.col("t"))).first()[0]
    cases = {"the cat and the dog": "en", "der Hund und die Katze": "de", "le chat et la souris": "fr", "el gato con una rata": "es", "la": "fr", "123": "en", "слово the the": "ru", "漢字": "zh", "かな 漢字": "ja", "한국": "ko"}
    assert {t: one(profile.language, t) for t in cases} == cases
    names = {"The API policy": "api_documentation", "policies apply": "policy", "step 3": "procedure", "none": "general", "user handbook": "manual", "Lubrication": "general"}
    assert {t: one(profile.category, t) for t in names} == names


def test_sensitive_content(spark):
    text = "mail a.b@x.io, call +1 (555) 123-4567, card 4242 4242 4242 4242 not 1234 5678 9012 3456, id 123-45-6789, api_key=abc password: x"
    got = {f["finding_type"]: f["count"] for f in spark.createDataFrame([(text,)], "t string").select(profile.findings(F.col("t"))).first()[0]}
    assert got["email_address"] == 1 and got["credit_card"] == 1 and got["national_id"] == 1 and got["api_key"] == 1 and got["secret"] == 1


def chunk(spark, text, **policy):
    docs = markdown.with_structure(spark.createDataFrame([("d", text)], "document_id string, text string"))
    return chunking.draft_rows(docs, chunking.ChunkPolicy(**policy)).orderBy("position").collect()


def test_tables_and_code_stand_alone_after_their_heading(spark):
    text = "# Maintenance\n## Safety\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\none two three\n\nfour five\n\n```\ncode\n```"
    rows = chunk(spark, text)
    assert [r["content"].split("\n")[0] for r in rows] == ["> Context: Maintenance"] + ["> Context: Maintenance > Safety"] * 3
    assert [r["contains_table"] for r in rows] == [False, True, False, False] and rows[1]["content"].count("## Safety") == 1
    assert rows[2]["content"].endswith("one two three\n\nfour five") and rows[3]["contains_code"]


def test_budgets_and_failures(spark):
    paragraphs = "\n\n".join(" ".join(["w"] * 5) for _ in range(5))
    assert [r["token_count"] for r in chunk(spark, paragraphs, target_tokens=12, breadcrumb=False)] == [10, 10, 5]
    assert [r["token_count"] for r in chunk(spark, paragraphs, target_tokens=12, breadcrumb=False, strategy="token")] == [10, 10, 5]
    long = " ".join(["w"] * 30)
    assert chunk(spark, long, target_tokens=10, max_tokens=20)[0]["errors"] == ["exceeds_token_budget"]
    assert [r["errors"] for r in chunk(spark, long, target_tokens=10, max_tokens=20, oversize="split")] == [[]] * 3
    with pytest.raises(ValueError):
        chunk(spark, long, strategy="recursive", chars=10, overlap=10)


def test_recursive_windows_cover_the_text_and_overlap(spark):
    rng = random.Random(2)
    text = "\n\n".join(" ".join(f"w{rng.randrange(1000)}" for _ in range(rng.randrange(5, 80))) for _ in range(20))
    policy = chunking.ChunkPolicy(strategy="recursive", chars=120, overlap=30)
    parts = chunking.recursive(text, policy)
    assert max(map(len, parts)) <= 120
    words, seen = text.split(), []
    for p in parts:
        own = p.split()
        lap = next(k for k in range(min(len(seen), len(own)), -1, -1) if seen[len(seen) - k :] == own[:k])
        assert len(" ".join(own[:lap])) <= 30
        seen += own[lap:]
    assert seen == words
    assert chunking.recursive("x" * 250, policy) and all(len(p) <= 120 for p in chunking.recursive("x" * 250, policy))


def test_repeated_contents_and_numbers(spark):
    rows = chunking.chunks(chunking.split_failures(chunking.draft_rows(markdown.with_structure(spark.createDataFrame([("d", "# A\n\nx\n\n# A\n\nx\n\n# B\n\ny")], "document_id string, text string"))))[0])
    assert [r["chunk_id"] for r in rows.orderBy("sequence").collect()] == ["CHK-000001", "CHK-000002"]


def test_front_matter(spark):
    cases = {"plain": "plain", "a: b": '"a: b"', "": '""', " x": '" x"', 'q"': '"q\\""', "@at": '"@at"', "line\nend": '"line\\nend"'}
    df = spark.createDataFrame([(c,) for c in cases], "v string")
    assert {r[0]: r[1] for r in df.select("v", markdown.yaml_scalar(F.col("v"))).collect()} == cases
    values = {k: F.lit("x") for k in markdown.REQUIRED if k != "language"}
    assert df.limit(1).select(markdown.document_errors(values, F.lit(" "))).first()[0] == ["missing document body", "missing required metadata: language"]


def test_ingestion_from_texts_to_points(spark):
    rows = [("d1", "r", "guides/d1.md", "Hello world.\n\nMore text", "t", "public", None), ("d2", "r", "d2.md", "  ", "t", "public", "en"), ("d3", "r", "x/d3.md", "body", " ", "public", "en")]
    done = ingestion.ingest(spark.createDataFrame(rows, "document_id string, repository_id string, source_path string, text string, tenant_id string, classification_clearance string, language string"))
    assert {(r["document_id"], r["stage"]) for r in done.dead_letters.collect()} == {("d2", "transform"), ("d3", "publish")}
    point = done.points.first()
    assert point["vector_id"] == "documents::d1::CHK-000001::e1" and point["source_group"] == "guides" and len(point["vector"]) == 64
    assert [r["content"] for r in ingestion.searchable(done.points).collect()] == ["> Context: Introduction\n\nHello world.\n\nMore text"]


def test_assets_are_immutable_and_versioned(spark, tmp_path):
    store = stores.AssetStore(spark, str(tmp_path / "assets"))
    rows = lambda *x: spark.createDataFrame([(k, bytearray(c)) for k, c in x], "key string, content binary")
    store.put_next(rows(("a", b"1"), ("b", b"1")))
    store.put_changed(rows(("a", b"1"), ("b", b"2")))
    assert [(r["key"], r["version"]) for r in store.latest().orderBy("key").collect()] == [("a", 1), ("b", 2)]
    assert [r["version"] for r in store.versions("b").collect()] == [1, 2]
    with pytest.raises(ValueError):
        store.put(rows(("a", b"x")).withColumn("version", F.lit(1)))


def test_files_are_scanned_filtered_and_guarded(spark, tmp_path):
    for name, text in {"a.md": "# A", "sub dir/b.txt": "b", ".git/c.md": "c", "sub dir/~$d.md": "d"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r["source_path"]: r["content_hash"] for r in files.inventory(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.md", "sub dir/b.txt"}
    assert bytes(files.read_file(spark, str(tmp_path), "a.md").first()["content"]) == b"# A"
    with pytest.raises(ValueError):
        files.read_file(spark, str(tmp_path), "../x")
    with pytest.raises(KeyError):
        files.connector("s3")


def test_upsert_takes_the_last_and_refuses_other_dimensions(spark):
    kind = "vector_id string, vector array<double>, distance_metric string, position int"
    stored = spark.createDataFrame([("a", [1.0, 2.0], "cosine", 0)], kind)
    after = stores.upsert_vectors(stored, spark.createDataFrame([("a", [3.0, 4.0], "cosine", 1), ("a", [5.0, 6.0], "cosine", 2), ("b", [0.0, 1.0], "cosine", 1)], kind), 2)
    assert {r["vector_id"]: r["vector"] for r in after.collect()} == {"a": [5.0, 6.0], "b": [0.0, 1.0]}
    with pytest.raises(Exception, match="dimension or metric"):
        stores.upsert_vectors(stored, spark.createDataFrame([("c", [1.0], "cosine", 1)], kind), 2).collect()


def test_metrics(spark):
    judged = spark.createDataFrame([("q1", "a"), ("q2", "b"), ("q3", "a"), ("q3", "c"), ("q3", "x"), ("q4", "z")], "query_id string, item_id string")
    ranks = {"q1": "az", "q2": "zb", "q3": "abcd"}
    results = spark.createDataFrame([(q, i, n + 1) for q, items in ranks.items() for n, i in enumerate(items)], "query_id string, item_id string, rank int")
    m = {r["query_id"]: r for r in evaluation.query_metrics(judged, results, 4).collect()}
    assert m["q3"]["precision"] == 0.5 and m["q3"]["recall"] == pytest.approx(2 / 3) and m["q2"]["ndcg"] == pytest.approx(1 / 1.584962500721156)
    assert (m["q1"]["reciprocal_rank"] + m["q2"]["reciprocal_rank"]) / 2 == 0.75 and tuple(m["q4"])[1:] == (0.0, 0.0, 0.0, 0.0)
    assert evaluation.report(evaluation.query_metrics(judged, results, 4)).first()["passed"] is False


def test_publication_names(spark):
    df = spark.createDataFrame([(" BAAI/bge-m3 ", 1024)], "m string, d int")
    assert df.select(publishing.collection_name("kb", F.lit("hf"), F.col("m"), F.col("d"))).first()[0] == "kb__hf__baai_bge_m3__d1024"


def test_lines_open_blocks_and_runs_go_on():
    text = "---\ntitle: \"a \\\"b\\\"\"\n---\n# A\nfirst\n#no heading\n- x\n  y\n\n| a | b |\n|---|---|\n| 1 |\n> note: q\n>> r\n```py\n# code\n```\n## B\n![i](u)\ntail"
    found = markdown.parse(text)
    assert found["front_matter"] == {"title": 'a "b"'}
    assert [(b["block_type"], b["text"], b["section_id"]) for b in found["blocks"]] == [
        ("heading", "A", "SEC-1"), ("paragraph", "first", "SEC-1"), ("paragraph", "#no heading", "SEC-1"), ("list", "- x\n  y", "SEC-1"), ("table", "a b\n1", "SEC-1"), ("note", "note: q\nr", "SEC-1"),
        ("code", "# code", "SEC-1"), ("heading", "B", "SEC-2"), ("image", "i", "SEC-2"), ("paragraph", "tail", "SEC-2"),
    ]
    assert found["sections"][1]["breadcrumb"] == "A > B"
    assert markdown.parse("---\nopen: end") == {"front_matter": {"open": "end"}, "blocks": [], "sections": []} and markdown.parse("```\nopen")["blocks"][0]["text"] == "open"
