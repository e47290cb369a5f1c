"""Change detection, document lifecycle and cascading deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarryline.functions.text import squeeze, strip

#: Legal state changes.
REPOSITORY_EDGES = [
    ("registered", "connecting"), ("connecting", "discovering"), ("connecting", "error"), ("discovering", "synchronizing"),
    ("discovering", "error"), ("synchronizing", "active"), ("synchronizing", "error"), ("active", "synchronizing"),
    ("active", "reconciling"), ("active", "paused"), ("active", "disabled"), ("reconciling", "active"), ("reconciling", "error"),
    ("paused", "active"), ("paused", "disabled"), ("error", "connecting"), ("error", "disabled"), ("disabled", "archived"),
    ("disabled", "registered"),
]
DOCUMENT_EDGES = [
    ("new", "discovered"), ("discovered", "hash_verified"), ("hash_verified", "unchanged"), ("hash_verified", "changed"),
    ("hash_verified", "renamed"), ("hash_verified", "moved"), ("changed", "workflow_created"), ("renamed", "unchanged"),
    ("moved", "unchanged"), ("unchanged", "changed"), ("unchanged", "renamed"), ("unchanged", "moved"), ("unchanged", "deleted"),
    ("changed", "deleted"), ("workflow_created", "unchanged"), ("workflow_created", "failed"), ("failed", "waiting"),
    ("waiting", "hash_verified"),
]
CONVERSATION_EDGES = [
    ("created", "active"), ("active", "waiting"), ("active", "paused"), ("active", "completed"), ("active", "recovering"),
    ("waiting", "active"), ("waiting", "completed"), ("waiting", "recovering"), ("paused", "active"), ("paused", "completed"),
    ("completed", "archived"), ("completed", "active"), ("archived", "active"), ("recovering", "active"), ("recovering", "completed"),
]
WORKFLOW_EDGES = [
    ("created", "planned"), ("created", "failed"), ("planned", "executing"), ("planned", "paused"), ("planned", "failed"),
    ("executing", "waiting"), ("executing", "paused"), ("executing", "completed"), ("executing", "replanned"), ("executing", "failed"),
    ("waiting", "executing"), ("waiting", "completed"), ("waiting", "failed"), ("paused", "executing"), ("paused", "completed"),
    ("paused", "failed"), ("replanned", "executing"), ("replanned", "failed"), ("completed", "archived"),
]


def parent_folder(path: Column) -> Column:
    """The folder of a POSIX path; ``.`` for a bare name."""
    above = F.regexp_replace(path, r"/+[^/]*$", "")
    return F.when(~path.contains("/"), ".").when(above == "", "/").otherwise(above)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def source_group(path: Column, depth: int = 1, default: str = "") -> Column:
    """The first ``depth`` folders, lower-cased, white space as hyphens; ``default`` at the root."""
    parts = F.filter(F.split(strip(path), "/"), lambda p: (p != "") & (p != "."))
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    slugs = F.transform(F.slice(folders, F.lit(1), F.lit(max(1, depth))), lambda p: F.replace(squeeze(F.lower(p)), F.lit(" "), F.lit("-")))
    return F.when(F.size(folders) == 0, default).otherwise(F.array_join(slugs, "/"))


def snapshot_diff(inventory: DataFrame, twins: DataFrame, detect_renames: bool = True) -> DataFrame:
    """What changed between the known documents and an inventory.

    ``inventory`` has source_path, content_hash, size_bytes and position;
    ``twins`` has document_id, source_path, content_hash and position.  A path
    that is new and whose hash belongs to a vanished document is a rename (same
    folder) or a move: the first such item by position takes the last such
    document, others are created and deleted.  Hashes are compared by
    aggregates of one row each, so a hash that very many files share is no hot
    key of a join.
    """
    here = inventory.select("source_path", F.col("content_hash").alias("hash"), "size_bytes", F.col("position").alias("at"))
    known = twins.select("source_path", "document_id", F.col("content_hash").alias("old_hash"), F.col("position").alias("old_at"), F.lit(True).alias("known"))
    joined = here.withColumn("here", F.lit(True)).join(known, "source_path", "full_outer")
    none = F.lit(None).cast("string")
    columns = ["change_type", "source_path", "content_hash", "document_id", "previous_path", "size_bytes"]
    both = joined.where("here AND known").select(
        F.when(F.col("hash").eqNullSafe(F.col("old_hash")), "unchanged").otherwise("modified").alias("change_type"),
        "source_path", F.col("hash").alias("content_hash"), "document_id", none.alias("previous_path"), "size_bytes",
    )
    new, vanished = joined.where("known IS NULL"), joined.where("here IS NULL")
    first = new.where(F.lit(detect_renames)).groupBy("hash").agg(F.min_by("source_path", F.struct("at", "source_path")).alias("source_path"))
    last = vanished.groupBy(F.col("old_hash").alias("hash")).agg(F.max_by(F.struct("document_id", F.col("source_path").alias("path")), F.struct("old_at", "document_id")).alias("twin"))
    pairs = first.join(last, "hash").select("source_path", F.col("twin.document_id").alias("found_id"), F.col("twin.path").alias("previous_path"))
    kind = (
        F.when(F.col("found_id").isNull(), "created")
        .when(parent_folder(F.col("source_path")) == parent_folder(F.col("previous_path")), "renamed")
        .otherwise("moved")
    )
    added = new.join(pairs, "source_path", "left").select(
        kind.alias("change_type"), "source_path", F.col("hash").alias("content_hash"), F.col("found_id").alias("document_id"), "previous_path", "size_bytes"
    )
    gone = vanished.join(pairs, F.col("document_id") == F.col("found_id"), "left_anti").select(
        F.lit("deleted").alias("change_type"), "source_path", none.alias("content_hash"), "document_id", none.alias("previous_path"), F.lit(None).cast("long").alias("size_bytes")
    )
    return both.unionByName(added).unionByName(gone).select(*columns)


def change_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change_type").agg(F.count("*").alias("n"))


def apply_changes(documents: DataFrame, changes: DataFrame, propagate_deletes: bool = True) -> DataFrame:
    """The document table after the changes.

    Created paths become version 1, or revive a deleted document of that path
    with the next version; modified documents get the next version; renamed and
    moved ones a new path, and a deleted row that still holds this path goes;
    deleted ones are marked if ``propagate_deletes``.
    """
    kept = ["document_id", "source_path", "content_hash", "version", "status"]
    by_id = changes.where("document_id IS NOT NULL").select("document_id", "change_type", F.col("source_path").alias("new_path"), F.col("content_hash").alias("new_hash"))
    arrivals = changes.where("change_type IN ('created', 'renamed', 'moved')").select("source_path", F.col("change_type").alias("arrival"), F.col("content_hash").alias("arrived_hash"))
    rows = documents.select(*kept).join(by_id, "document_id", "left").join(arrivals, "source_path", "left")
    kind, revived = F.col("change_type"), (F.col("arrival") == "created") & (F.col("status") == "deleted")
    relocated = kind.isin("renamed", "moved")
    rows = rows.where(~F.coalesce(F.col("arrival").isin("renamed", "moved") & (F.col("status") == "deleted") & ~F.coalesce(relocated, F.lit(False)), F.lit(False)))
    revived = F.coalesce(revived, F.lit(False))
    updated = rows.select(
        "document_id",
        F.when(relocated, F.col("new_path")).otherwise(F.col("source_path")).alias("source_path"),
        F.when(revived, F.col("arrived_hash")).when(kind == "modified", F.col("new_hash")).otherwise(F.col("content_hash")).alias("content_hash"),
        F.when(revived | (kind == "modified"), F.col("version") + 1).otherwise(F.col("version")).alias("version"),
        F.when(revived, "active").when(F.lit(propagate_deletes) & (kind == "deleted"), "deleted").otherwise(F.col("status")).alias("status"),
    )
    created = changes.where("change_type = 'created'").join(documents.where("status = 'deleted'").select("source_path"), "source_path", "left_anti")
    created = created.select(F.concat(F.lit("doc-"), F.left(F.sha2(F.col("source_path").cast("binary"), 256), F.lit(16))).alias("document_id"), "source_path", "content_hash", F.lit(1).alias("version"), F.lit("active").alias("status"))
    return updated.unionByName(created.select(updated.columns))


def transitions(history: DataFrame, key: str, state: str = "state", order: str = "ts") -> DataFrame:
    """(key, from_state, to_state, order) of consecutive states."""
    before = F.lag(state).over(W.partitionBy(key).orderBy(order))
    return history.select(key, before.alias("from_state"), F.col(state).alias("to_state"), order).where("from_state IS NOT NULL")


def illegal_transitions(moves: DataFrame, edges: list[tuple[str, str]]) -> DataFrame:
    """Moves that no edge allows; the edges are a fixed table of a few rows."""
    legal = F.broadcast(moves.sparkSession.createDataFrame(edges, "from_state string, to_state string"))
    return moves.join(legal, ["from_state", "to_state"], "left_anti")


def version_conflicts(rows: DataFrame, key: str, version: str = "version") -> DataFrame:
    """(key, version) pairs that were written twice, or that don't follow the version before."""
    counted = rows.groupBy(key, version).agg(F.count("*").alias("writes"))
    before = F.lag(version).over(W.partitionBy(key).orderBy(version))
    return counted.withColumn("previous", before).where((F.col("writes") > 1) | (F.col("previous") + 1 != F.col(version)))


def latest(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The newest row of each key; ``order`` ends in something unique.

    An aggregate of one struct per key, combined before the shuffle, so that a
    key with very many versions isn't gathered in one task.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    best = rows.groupBy(*key).agg(F.max_by(whole, F.struct(*order)).alias("__row"))
    return best.select("__row.*")


def upsert(current: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """``current`` with rows of the same key replaced by ``incoming``."""
    return current.join(incoming.select(*key), key, "left_anti").unionByName(incoming, allowMissingColumns=True)


def without(rows: DataFrame, doomed: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(doomed.select(*on).distinct(), on, "left_anti")


def cascade_delete(tables: dict[str, DataFrame], doomed: DataFrame) -> dict[str, DataFrame]:
    """Tables without the doomed documents (document_id): vectors, jobs, staged sources and assets
    by document, lineage edges by either end, and the documents themselves."""
    out = {name: without(df, doomed, ["document_id"]) for name, df in tables.items() if name != "lineage"}
    if "lineage" in tables:
        dead = tables["assets"].join(doomed.select("document_id").distinct(), "document_id", "left_semi").select("asset_id")
        edges = tables["lineage"].join(dead, "asset_id", "left_anti")
        out["lineage"] = edges.join(dead.withColumnRenamed("asset_id", "parent_asset_id"), "parent_asset_id", "left_anti")
    return out


def purge_vectors(vectors: DataFrame, document: tuple[str, str], manifest: DataFrame | None) -> DataFrame:
    """Vectors without a document's: by the ids of its manifest, or by document and tenant without one."""
    if manifest is not None:
        return without(vectors, manifest, ["vector_id"])
    document_id, tenant_id = document
    return vectors.where(~((F.col("document_id") == document_id) & (F.col("tenant_id") == tenant_id)))


def to_purge(documents: DataFrame, repositories: DataFrame, tenant_id: str, target: str | None = None, repository: str | None = None, **equal: str) -> DataFrame:
    """A tenant's documents that a purge is for: by document_id, source_path or status (``equal``), by the repository's
    name, and with a ``target`` folder those whose repository lies elsewhere."""
    homes = repositories.where(F.col("tenant_id") == tenant_id).select("repository_id", F.col("name").alias("repository"), "uri")
    rows = documents.where(F.col("tenant_id") == tenant_id).join(homes, "repository_id")
    for name, value in equal.items():
        rows = rows.where(F.col(name) == value)
    if repository is not None:
        rows = rows.where(F.col("repository") == repository)
    if target is not None:
        folder = F.rtrim(F.coalesce("uri", F.lit("")), F.lit("\\/"))
        rows = rows.where(folder != target.rstrip("\\/"))
    return rows.select("document_id", "source_path", "repository")


def register_repositories(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Get or create by (tenant_id, name); the uri is refreshed, the id is kept."""
    joined = current.select("tenant_id", "name", F.col("repository_id").alias("old_id"), F.col("uri").alias("old_uri")).join(incoming.select("tenant_id", "name", "uri"), ["tenant_id", "name"], "full_outer")
    fresh = F.concat(F.lit("repo-"), F.left(F.sha2(F.concat_ws("\u0000", "tenant_id", "name").cast("binary"), 256), F.lit(16)))
    return joined.select(F.coalesce("old_id", fresh).alias("repository_id"), "tenant_id", "name", F.coalesce("uri", "old_uri").alias("uri"))


def repository_documents(documents: DataFrame, repository_id: str, ids: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Active documents of a repository by path, of a list of ids and at most ``limit`` if given."""
    rows = documents.where((F.col("repository_id") == repository_id) & (F.col("status") == "active"))
    rows = rows.where(F.col("document_id").isin(ids)) if ids else rows
    rows = rows.orderBy("source_path", "document_id")
    return rows.limit(limit) if limit else rows


def missing_from_store(published: DataFrame, stored: DataFrame) -> DataFrame:
    """Documents called published whose path the vector store doesn't have."""
    return published.join(stored.select("source_path").distinct(), "source_path", "left_anti")


def orphaned_repositories(repositories: DataFrame, documents: DataFrame) -> DataFrame:
    return repositories.join(documents.select("repository_id").distinct(), "repository_id", "left_anti")
