"""Document profiles from Markdown structure (see ``markdown.with_structure``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.text import first_of, is_blank, reading_seconds, word_count
from quarryline.functions.vectors import let
from quarryline.operators.markdown import blocks_of

#: Patterns of section flags and table cells.
WARNING = r"(?iU)\b(warning|caution|danger|important)\b"
ORDERED_ITEM = r"(?mU)^\s*\d+\.\s"
PROCEDURE = r"(?iU)\b(procedure|step\s+\d+|instructions)\b"
NUMBER_CELL = r"(?U)^-?\d[\d,.]*$"
DATE_CELL = r"(?U)\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}/\d{1,2}/\d{2,4}\b"
ID_CELL = r"(?U)\b[A-Z]{2,}-?\d+\b"

#: Frequent words by language, in order of preference, and scripts that settle the language at once.
LANGUAGE_WORDS = {
    "en": "the and of to in is for".split(),
    "de": "der die und das mit nicht ist".split(),
    "fr": "le la les des et une pour".split(),
    "es": "el la los las para con una".split(),
}
LETTER = r"[a-zA-ZÀ-ɏ]"
SCRIPTS = {"ja": r"[぀-ヿ]", "ko": r"[가-힣]", "zh": r"[一-鿿]", "ru": r"[Ѐ-ӿ]"}
SCRIPT = r"[぀-ヿ가-힣一-鿿Ѐ-ӿ]"

#: Categories by pattern, first match first.
CATEGORIES = {
    "api_documentation": r"\b(api|endpoint|request|response)\b",
    "architecture": r"\b(architecture|component diagram|system design)\b",
    "maintenance_guide": r"\b(maintenance|inspection|lubricat)\b",
    "meeting_notes": r"\b(agenda|attendees|minutes|action items)\b",
    "training_material": r"\b(training|lesson|exercise|course)\b",
    "policy": r"\bpolic(y|ies)\b",
    "procedure": r"\b(procedure|step\s+\d+|shutdown|startup)\b",
    "technical_specification": r"\b(specification|requirements|spec)\b",
    "manual": r"\b(manual|guide|handbook)\b",
}
CODE_SOURCES = ["py", "java", "js", "ts", "json", "xml", "yaml", "yml", "sql", "sh"]

#: Patterns of sensitive content.
SENSITIVE = {
    "email_address": r"(?U)\b[\w.+-]+@[\w-]+\.[\w.-]+\b",
    "phone_number": r"(?U)(?<!\w)\+?\d[\d\s().-]{8,}\d(?!\w)",
    "national_id": r"(?U)\b\d{3}-\d{2}-\d{4}\b",
    "api_key": r"(?iU)\b(?:api[_-]?key|access[_-]?token)\b\s*[:=]\s*\S+",
    "secret": r"(?iU)\b(?:password|passwd|secret|client[_-]?secret)\b\s*[:=]\s*\S+",
}
CARD = r"(?U)\b(?:\d[ -]?){13,19}\b"


def language(text: Column, default: str = "en") -> Column:
    """The first character of a settling script decides; else the language with most frequent words, the first of equals."""
    count = lambda words: F.regexp_count(F.lower(text), F.lit(f"(?<!{LETTER})(?:{'|'.join(words)})(?!{LETTER})"))
    counts = F.struct(*(count(words).alias(code) for code, words in LANGUAGE_WORDS.items()))

    def most_words(n: Column) -> Column:
        most = F.greatest(*(n[code] for code in LANGUAGE_WORDS))
        return first_of([(most == 0, default)] + [(n[code] == most, code) for code in LANGUAGE_WORDS], default)

    by_script = lambda c: first_of([(c.rlike(pattern), code) for code, pattern in SCRIPTS.items()], None)
    return F.coalesce(let(F.regexp_extract(text, f"({SCRIPT})", 1), by_script), let(counts, most_words))


def category(text: Column, source_type: Column | None = None) -> Column:
    code = [(F.lower(F.coalesce(source_type, F.lit(""))).isin(*CODE_SOURCES), "source_code")] if source_type is not None else []
    return first_of(code + [(text.rlike(f"(?iU){pattern}"), name) for name, pattern in CATEGORIES.items()], "general")


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def card_count(text: Column, shortest: int = 13, longest: int = 19) -> Column:
    """Card numbers that pass the Luhn check."""
    found = F.transform(F.regexp_extract_all(text, F.lit(CARD), F.lit(0)), digits_of)
    return F.size(F.filter(found, lambda d: F.length(d).between(shortest, longest) & F.call_function("luhn_check", d)))


def sensitive_counts(text: Column) -> dict[str, Column]:
    """Matches of each kind; 0 for a null text."""
    whole = F.coalesce(text, F.lit(""))
    counts = {name: F.regexp_count(whole, F.lit(pattern)) for name, pattern in SENSITIVE.items()}
    return counts | {"credit_card": card_count(whole)}


def findings(text: Column) -> Column:
    """Array of (finding_type, count) without zero counts."""
    order = ["email_address", "phone_number", "credit_card", "national_id", "api_key", "secret"]
    counts = sensitive_counts(text)
    pairs = F.array(*(F.struct(F.lit(k).alias("finding_type"), counts[k].alias("count")) for k in order))
    return F.filter(pairs, lambda p: p["count"] > 0)


def tables() -> Column:
    """Array of what the tables hold."""

    def info(block: Column, i: Column) -> Column:
        rows = block["table_rows"]
        header, columns = F.get(rows, F.lit(0)), F.array_max(F.transform(rows, F.size))
        cells = F.flatten(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))))
        return F.struct(
            F.concat(F.lit("TBL-"), (i + 1).cast("string")).alias("table_id"), block["section_id"].alias("section_id"),
            (F.size(rows) - 1).alias("rows"), columns.alias("columns"),
            F.when(columns > 0, F.bround(F.size(F.filter(header, lambda c: c != "")) / columns, 2)).otherwise(0.0).alias("header_confidence"),
            F.exists(cells, lambda c: c.rlike(NUMBER_CELL)).alias("contains_numeric"),
            F.exists(cells, lambda c: c.rlike(DATE_CELL)).alias("contains_dates"),
            F.exists(cells, lambda c: c.rlike(ID_CELL)).alias("contains_ids"),
        )

    return F.transform(F.filter("blocks", lambda b: (b["block_type"] == "table") & (F.size(b["table_rows"]) > 0)), info)


def figures() -> Column:
    one = lambda b, i: F.struct(
        F.concat(F.lit("FIG-"), (i + 1).cast("string")).alias("figure_id"), b["section_id"].alias("section_id"), b["text"].alias("caption"), b["language"].alias("reference")
    )
    return F.transform(F.filter("blocks", lambda b: b["block_type"] == "image"), one)


def code_blocks() -> Column:
    one = lambda b, i: F.struct(
        F.concat(F.lit("CODE-"), (i + 1).cast("string")).alias("block_id"), b["section_id"].alias("section_id"),
        F.when(b["language"] == "", "text").otherwise(b["language"]).alias("language"),
        F.when(b["text"] == "", 0).otherwise(F.size(F.split(b["text"], "\n", -1))).alias("line_count"),
    )
    return F.transform(F.filter("blocks", lambda b: b["block_type"] == "code"), one)


def block_tokens(blocks: Column) -> Column:
    return F.aggregate(blocks, F.lit(0), lambda acc, b: acc + word_count(b["text"]))


def section_stats() -> Column:
    """Array with the statistics of every section."""

    def one(s: Column) -> Column:
        own = blocks_of(s["section_id"])
        tokens = block_tokens(own)
        has = lambda kind: F.exists(own, lambda b: b["block_type"] == kind)
        return F.struct(
            s["section_id"].alias("section_id"), s["parent_id"].alias("parent_id"), s["level"].alias("heading_level"),
            tokens.alias("token_count"), reading_seconds(tokens).alias("reading_time_seconds"),
            has("table").alias("contains_table"), has("image").alias("contains_image"), has("code").alias("contains_code"),
            (s["title"].rlike(WARNING) | F.exists(own, lambda b: (b["block_type"] == "note") & b["text"].rlike(WARNING))).alias("contains_warning"),
            (s["title"].rlike(PROCEDURE) | F.exists(own, lambda b: b["text"].rlike(ORDERED_ITEM) | b["text"].rlike(PROCEDURE))).alias("contains_procedure"),
        )

    return F.transform("sections", one)


def primary_topic() -> Column:
    """The title, else the first top heading, else the first heading."""
    title = F.element_at("front_matter", F.lit("title"))
    top = F.get(F.filter("sections", lambda s: s["level"] == 1), F.lit(0))["title"]
    return F.coalesce(F.nullif(title, F.lit("")), top, F.get("sections", F.lit(0))["title"])


def complexity(high_sections: int = 12) -> Column:
    n, depth = F.size("sections"), F.coalesce(F.array_max(F.transform("sections", lambda s: s["level"])), F.lit(0))
    return F.when((n >= high_sections) | (depth >= 4), "high").when((n >= 4) | (depth >= 3), "medium").otherwise("low")


def quality() -> dict[str, Column]:
    """Scores of structure, content, tables and images, from the profile's other columns."""
    levels = F.array_sort(F.array_distinct(F.transform("sections", lambda s: s["level"])))
    contiguous = F.element_at(levels, -1) - F.get(levels, F.lit(0)) + 1 == F.size(levels)
    grids = F.filter("blocks", lambda b: b["block_type"] == "table")
    ragged = F.exists(grids, lambda b: F.size(F.array_distinct(F.transform(b["table_rows"], F.size))) > 1)
    unsure = F.exists("tables", lambda t: t["header_confidence"] < 0.5)
    captioned = F.size(F.filter("figures", lambda f: ~is_blank(f["caption"])))
    return {
        "structure_score": F.when(F.size("sections") == 0, 60).when(contiguous, 100).otherwise(85),
        "content_score": F.when(F.col("token_count") > 0, 100).otherwise(0),
        "table_score": F.when(F.size(grids) == 0, 100).otherwise(100 - F.when(ragged, 25).otherwise(0) - F.when(unsure, 15).otherwise(0)),
        "image_score": F.when(F.size("figures") == 0, 100).otherwise(F.bround(captioned / F.size("figures") * 100)).cast("int"),
    }


def profiled(docs: DataFrame, default_language: str = "en") -> DataFrame:
    """``docs`` with structure and the whole profile; one row per document."""
    texts = lambda keep: F.array_join(F.transform(F.filter("blocks", keep), lambda b: b["text"]), "\n")
    prose, whole = texts(lambda b: b["block_type"] != "code"), texts(lambda b: b["block_type"].isNotNull())
    title = F.coalesce(F.element_at("front_matter", F.lit("title")), F.lit(""))
    filled = F.size(F.filter("blocks", lambda b: ~is_blank(b["text"])))
    declared = F.nullif(F.element_at("front_matter", F.lit("language")), F.lit(""))
    out = docs.withColumns({
        "token_count": block_tokens(F.col("blocks")),
        "knowledge_density": F.when(F.size("blocks") > 0, F.bround(filled / F.size("blocks"), 3)).otherwise(0.0),
        "primary_topic": primary_topic(), "complexity": complexity(), "section_stats": section_stats(),
        "tables": tables(), "figures": figures(), "code_blocks": code_blocks(),
        "language": F.coalesce(declared, language(prose, default_language)),
        "category": category(F.concat(title, F.lit("\n"), whole), F.element_at("front_matter", F.lit("source_type"))),
        "findings": findings(whole),
    })
    out = out.withColumns(quality())
    parts = [F.col(c) for c in ("structure_score", "content_score", "table_score", "image_score")]
    return out.withColumn("quality", F.bround((parts[0] + parts[1] + parts[2] + parts[3]) / 4.0).cast("int"))
