"""Chunks of documents under token budgets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quarryline.functions.text import is_blank, sha256, word_count
from quarryline.operators.markdown import blocks_of, render_block

PREAMBLE = "Introduction"
#: Documents of a batch that are Python objects at once.
SLICE = 128
_S, _I, _B = T.StringType(), T.IntegerType(), T.BooleanType()


@dataclass(frozen=True)
class ChunkPolicy:
    """``oversize`` tells what happens to a paragraph beyond ``max_tokens``: ``keep`` it whole
    (then its document fails validation) or ``split`` it at white space."""

    strategy: str = "semantic"
    target_tokens: int = 512
    max_tokens: int = 1024
    preserve_tables: bool = True
    preserve_code: bool = True
    breadcrumb: bool = True
    chars: int = 1000
    overlap: int = 200
    separators: tuple[str, ...] = ("\n\n", "\n", " ", "")
    oversize: str = "keep"


def views() -> Column:
    """Sections with their rendered blocks: what stands before the first heading, then every section."""
    shown = lambda blocks: F.transform(blocks, lambda b: F.struct(b["block_type"].alias("kind"), render_block(b).alias("text")))
    before = F.filter("blocks", lambda b: b["section_id"].isNull())
    first = F.struct(
        F.lit(None).cast("string").alias("section_id"), F.lit(PREAMBLE).alias("title"), F.lit(0).alias("level"), F.lit(PREAMBLE).alias("breadcrumb"), shown(before).alias("blocks")
    )
    rest = F.transform("sections", lambda s: F.struct(
        s["section_id"].alias("section_id"), s["title"].alias("title"), s["level"].alias("level"), s["breadcrumb"].alias("breadcrumb"), shown(blocks_of(s["section_id"])).alias("blocks"),
    ))
    return F.concat(F.filter(F.array(first), lambda v: F.size(v["blocks"]) > 0), rest)


def packed(blocks: list, policy: ChunkPolicy, atomic: bool) -> list[list]:
    """Blocks in groups of at most the target; with ``atomic`` tables and code stand alone,
    after nothing but the headings just before them."""
    groups: list[list] = []
    open_group, used = [], 0

    def close() -> None:
        nonlocal open_group, used
        if open_group:
            groups.append(open_group)
        open_group, used = [], 0

    for block in blocks:
        if atomic and ((block["kind"] == "table" and policy.preserve_tables) or (block["kind"] == "code" and policy.preserve_code)):
            if not all(b["kind"] == "heading" for b in open_group):
                close()
            open_group.append(block)
            close()
            continue
        size = len(block["text"].split())
        if used + size > policy.target_tokens:
            close()
        open_group.append(block)
        used += size
    close()
    return groups


def split_long(blocks: list, policy: ChunkPolicy) -> list:
    """Paragraphs and lists beyond the limit in pieces of the target size."""
    out = []
    for b in blocks:
        words = b["text"].split()
        if b["kind"] in ("table", "code") or len(words) <= policy.max_tokens:
            out.append(b)
        else:
            out += [{"kind": b["kind"], "text": " ".join(words[a : a + policy.target_tokens])} for a in range(0, len(words), policy.target_tokens)]
    return out


def pieces_at(text: str, separator: str) -> list[str]:
    """The text cut before every separator, which stays with what follows it."""
    if not separator:
        return list(text)
    head, *rest = text.split(separator)
    return [p for p in [head, *(separator + r for r in rest)] if p]


def windows(parts: list[str], size: int, overlap: int) -> list[str]:
    """Neighbouring parts joined up to ``size``; each window begins with at most ``overlap`` characters of the last."""
    out: list[str] = []
    held: list[str] = []
    used = 0
    for part in parts:
        if held and used + len(part) > size:
            out.append("".join(held))
            while held and (used > overlap or used + len(part) > size):
                used -= len(held.pop(0))
        held.append(part)
        used += len(part)
    if held:
        out.append("".join(held))
    return [w.strip() for w in out if w.strip()]


def recursive(text: str, policy: ChunkPolicy, separators: tuple[str, ...] | None = None) -> list[str]:
    """Split at the first separator that occurs; parts that are still too long at the next ones."""
    separators = policy.separators if separators is None else separators
    at = next((i for i, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    out: list[str] = []
    short: list[str] = []
    for part in pieces_at(text, separators[at]):
        if len(part) < policy.chars:
            short.append(part)
            continue
        out += windows(short, policy.chars, policy.overlap)
        short = []
        out += recursive(part, policy, separators[at + 1 :]) if separators[at + 1 :] else [part]
    return out + windows(short, policy.chars, policy.overlap)


def table_line(text: str) -> bool:
    return any(x.strip().startswith("|") and "-" in x and set(x.strip()) <= set("|-: ") for x in text.splitlines())


DRAFT = T.StructType([
    T.StructField("section_id", _S), T.StructField("section_title", _S), T.StructField("breadcrumb", _S), T.StructField("heading_level", _I), T.StructField("body", _S),
    T.StructField("contains_table", _B), T.StructField("contains_code", _B), T.StructField("contains_image", _B),
])


def section_drafts(view: dict, policy: ChunkPolicy) -> list[dict]:
    blocks = split_long(view["blocks"], policy) if policy.oversize == "split" else view["blocks"]
    place = {"section_id": view["section_id"], "section_title": view["title"], "breadcrumb": view["breadcrumb"], "heading_level": view["level"]}
    if policy.strategy == "recursive":
        body = "\n\n".join(b["text"] for b in blocks).strip()
        return [place | {"body": t, "contains_table": table_line(t), "contains_code": "```" in t, "contains_image": "![" in t} for t in (recursive(body, policy) if body else [])]
    groups = packed(blocks, policy, atomic=policy.strategy != "token")
    return [place | {"body": "\n\n".join(b["text"] for b in g)} | {f"contains_{k}": any(b["kind"] == k for b in g) for k in ("table", "code", "image")} for g in groups]


def cut_views(policy: ChunkPolicy, schema: pa.Schema):
    """Rows of (key, known_sections, views) as rows of drafts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, SLICE):
                part = batch.slice(a, SLICE)
                owners, made = [], []
                for i, views in enumerate(part.column("views").to_pylist()):
                    own = [d for v in views for d in section_drafts(v, policy)]
                    owners += [i] * len(own)
                    made += [d | {"position": n} for n, d in enumerate(own)]
                kept = [part.column(n).take(pa.array(owners, pa.int32())) for n in schema.names[:2]]
                yield pa.RecordBatch.from_arrays(kept + [pa.array([d[f.name] for d in made], f.type) for f in list(schema)[2:]], schema=schema)

    return run


def chunk_errors(policy: ChunkPolicy) -> Column:
    """Names of a draft's failures; tables and code may pass the limit."""
    known = F.array_contains("known_sections", F.col("section_id")) | F.col("section_id").isNull()
    return F.array_compact(F.array(
        F.when(is_blank(F.col("content")), "empty_content"),
        F.when(is_blank(F.col("section_title")) | is_blank(F.col("breadcrumb")), "missing_metadata"),
        F.when(~known, "broken_hierarchy"),
        F.when((F.col("token_count") > policy.max_tokens) & ~F.col("contains_table") & ~F.col("contains_code"), "exceeds_token_budget"),
    ))


def draft_rows(docs: DataFrame, policy: ChunkPolicy = ChunkPolicy(), key: str = "document_id") -> DataFrame:
    """One row per draft with content, token_count, content_hash and errors; ``docs`` carries structure; unknown strategies count as semantic."""
    if policy.strategy == "recursive" and policy.overlap >= policy.chars:
        raise ValueError("the overlap must be smaller than the chunk size")
    shown = docs.select(key, F.transform("sections", lambda s: s["section_id"]).alias("known_sections"), views().alias("views"))
    schema = T.StructType([shown.schema[key], T.StructField("known_sections", T.ArrayType(_S)), T.StructField("position", _I), *DRAFT.fields])
    rows = shown.mapInArrow(cut_views(policy, to_arrow_schema(schema)), schema)
    prefix = F.concat(F.lit("> Context: "), F.col("breadcrumb"), F.lit("\n\n")) if policy.breadcrumb else F.lit("")
    rows = rows.withColumn("content", F.concat(prefix, F.col("body"))).drop("body")
    rows = rows.withColumn("token_count", word_count(F.col("content"))).withColumn("content_hash", F.concat(F.lit("sha256:"), sha256(F.col("content"))))
    return rows.withColumn("errors", chunk_errors(policy)).drop("known_sections")


def split_failures(rows: DataFrame, key: str = "document_id") -> tuple[DataFrame, DataFrame]:
    """(drafts of valid documents, documents with a failed draft and why): one failure fails the document."""
    failed = rows.where(F.size("errors") > 0).groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("errors")))).alias("errors"))
    return rows.join(failed.select(key), key, "left_anti").drop("errors"), failed


def chunks(valid: DataFrame, key: str = "document_id") -> DataFrame:
    """Drafts without repeated contents of a document, numbered from CHK-000001."""
    copy = F.row_number().over(W.partitionBy(key, "content_hash").orderBy("position"))
    kept = valid.withColumn("__copy", copy).where("__copy = 1").drop("__copy")
    n = F.row_number().over(W.partitionBy(key).orderBy("position"))
    return kept.withColumn("sequence", n).withColumn("chunk_id", F.concat(F.lit("CHK-"), F.lpad(n.cast("string"), 6, "0")))


def chunk_totals(rows: DataFrame, key: str = "document_id") -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("chunk_count"), F.sum("token_count").alias("total_tokens"))


def content_copies(docs: DataFrame, text: str, order: str, *within: str) -> DataFrame:
    """``docs`` with the hash of the text and whether an earlier row (by ``order``, within the key) holds the same.

    First rows come from an aggregate and not a window, so a text with very many copies isn't one task.
    """
    hashed = docs.withColumn("content_hash", F.concat(F.lit("sha256:"), sha256(F.col(text))))
    first = hashed.groupBy(*within, "content_hash").agg(F.min(order).alias("first_seen"))
    joined = hashed.join(first, [*within, "content_hash"])
    return joined.withColumn("is_copy", F.col(order) > F.col("first_seen"))
