"""Document files: scanning, inclusion policy, routing and conversion to Markdown."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions.text import first_of, sha256
from quarryline.operators.changes import file_name

#: The largest file, and kinds of files by extension.
MAX_FILE_BYTES = 524_288_000
MAX_CONVERT_BYTES = 1024 * 1024 * 1024
KINDS = {
    "document": ["pdf", "docx", "pptx", "html", "htm", "csv"],
    "image": ["png", "jpg", "jpeg", "tiff", "bmp", "webp", "gif"],
    "audio": ["mp3", "wav", "m4a", "flac", "ogg"],
    "video": ["mp4", "mkv", "mov", "avi", "webm"],
}
#: Parsers by extension, then by MIME type.
PARSERS = {"md": "markdown", "markdown": "markdown", "txt": "text", "text": "text", "log": "text"}
MIME_PARSERS = {"text/markdown": "markdown", "text/plain": "text"}


@dataclass(frozen=True)
class FilePolicy:
    ignore_hidden: bool = True
    ignore_temp: bool = True
    extensions: tuple[str, ...] = ()
    max_bytes: int = MAX_FILE_BYTES


def extension(path: Column) -> Column:
    """Lower-cased, without its dot; empty if there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def is_hidden(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda p: p.startswith(".") & (p != ".") & (p != ".."))


def is_temporary(path: Column) -> Column:
    name = F.lower(file_name(path))
    return name.startswith("~$") | name.endswith(".tmp") | name.endswith("~")


def scan(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """Every file below ``root``: path relative to it, extension, size, change time, hidden flag, and bytes on demand.

    Without ``content`` the column isn't selected, so files are listed and not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1]
    path = F.substring_index(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))), base + "/", -1)
    own = [F.col("content")] if content else []
    return files.select(
        path.alias("source_path"), extension(path).alias("extension"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), is_hidden(path).alias("hidden"), *own
    )


def included(policy: FilePolicy = FilePolicy(), path: str = "source_path", size: str = "size_bytes") -> Column:
    """Whether a scanned file passes the policy."""
    keep = F.col(size) <= policy.max_bytes
    keep = keep & ~is_hidden(F.col(path)) if policy.ignore_hidden else keep
    keep = keep & ~is_temporary(F.col(path)) if policy.ignore_temp else keep
    return keep & extension(F.col(path)).isin(*policy.extensions) if policy.extensions else keep


def inventory(spark: SparkSession, root: str, policy: FilePolicy = FilePolicy()) -> DataFrame:
    """Included files with content hashes, as ``changes.snapshot_diff`` reads them."""
    rows = scan(spark, root, content=True).where(included(policy))
    return rows.select("source_path", F.sha2("content", 256).alias("content_hash"), "size_bytes", F.col("source_path").alias("position"))


def read_file(spark: SparkSession, root: str, source_path: str) -> DataFrame:
    """One file's bytes; paths that leave the root are refused."""
    parts = source_path.split("/")
    if source_path.startswith("/") or ".." in parts:
        raise ValueError(f"path leaves the repository: {source_path}")
    return scan(spark, root, content=True).where(F.col("source_path") == source_path)


CONNECTORS: dict[str, Callable[..., DataFrame]] = {"local_fs": scan}


def connector(kind: str) -> Callable[..., DataFrame]:
    if kind not in CONNECTORS:
        raise KeyError(f"unknown connector {kind}; there are {sorted(CONNECTORS)}")
    return CONNECTORS[kind]


def file_kind(path: Column, size: Column) -> Column:
    """Route of a file: skipped when too large, by extension otherwise, text if unknown."""
    ext = extension(path)
    return first_of([(size > MAX_CONVERT_BYTES, "skipped")] + [(ext.isin(*exts), kind) for kind, exts in KINDS.items()], "text")


def parser_for(path: Column, mime: Column | None = None) -> Column:
    """markdown or text; null if unsupported."""
    by = lambda table, key: F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)
    named = by(PARSERS, extension(path))
    return F.coalesce(named, by(MIME_PARSERS, mime)) if mime is not None else named


def decoded(content: Column) -> Column:
    """UTF-8 text; malformed bytes become U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def fenced(content: Column, path: Column) -> Column:
    """A text file as a Markdown code block of its extension."""
    return F.concat(F.lit("```"), extension(path), F.lit("\n"), content, F.lit("\n```"))


def external_model(name: str) -> Column:
    """Stands where a conversion needs a model or tool that is not part of this library."""
    return F.raise_error(F.lit(f"{name} needs an external model; register one before routing files to it"))


def file_front_matter(files: DataFrame, path: str = "source_path") -> DataFrame:
    """``files`` (with content) with a front matter block of name, path, extension, size, time and hash."""
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v.cast("string"))
    text = F.array_join(F.array(
        F.lit("---"), line("file_name", file_name(F.col(path))), line("file_path", F.col(path)), line("extension", extension(F.col(path))),
        line("size_bytes", F.col("size_bytes")), line("modified_at", F.date_format("modified_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        line("sha256", F.sha2("content", 256)), F.lit("---"),
    ), "\n")
    return files.withColumn("front_matter", text)


IMAGE_LINK = r"!\[([^\]]*)\]\(([^)\s]+)\)"


def image_links(text: Column) -> Column:
    """Targets of image links in order, without repeats."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(IMAGE_LINK), F.lit(2)))


def describe_images(docs: DataFrame, descriptions: DataFrame, key: str = "document_id", text: str = "text") -> DataFrame:
    """``docs`` with the known description (image, description) of each linked image appended, in order of links."""
    links = docs.select(key, F.posexplode(image_links(F.col(text))).alias("n", "image"))
    found = links.join(descriptions, "image").withColumn("line", F.concat(F.lit("> Image "), F.col("image"), F.lit(": "), F.col("description")))
    lines = found.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("__notes"))
    return docs.join(lines, key, "left").withColumn(text, F.concat_ws("\n\n", text, "__notes")).drop("__notes")


def text_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), sha256(text))
