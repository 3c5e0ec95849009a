"""Shapes of results: what callers see of stored rows, and nothing internal (PRJ-02, PRJ-03, PRJ-05, PRJ-06, PRJ-09)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.operators.geo import point_or_default

# Fields of the store, the digest of a key, and the names of what has none.
INTERNAL, SECRET = ("_rid", "_self", "_attachments", "_ts"), "hash"
NO_PROJECT, NO_DOCUMENT, NO_TYPE = "Associated Project", "Untitled Document", "PDF Document"
NO_FILE, NO_DESCRIPTION = "document.pdf", "Official document extracted from central registry."


def strip_internals(rows: DataFrame) -> DataFrame:
    """Without the store's own fields."""
    return rows.drop(*INTERNAL)


def redact(keys: DataFrame) -> DataFrame:
    """Without the digest of the secret."""
    return keys.drop(SECRET)


def public_view(projects: DataFrame) -> DataFrame:
    """Of the struct ``sources`` only ``wildfire`` is public; where there is none, sources is null."""
    if "sources" not in projects.columns:
        return projects
    if "wildfire" not in projects.schema["sources"].dataType.names:
        return projects.drop("sources")
    fire = F.col("sources.wildfire")
    return projects.withColumn("sources", F.when(fire.isNotNull(), F.struct(fire.alias("wildfire"))))


def _or_else(column: str, other: str):
    """Empty text counts as missing."""
    return F.when(F.col(column) != "", F.col(column)).otherwise(F.lit(other))


def with_labels(rows: DataFrame, names: DataFrame, key: str, label: str, default: str) -> DataFrame:
    """``rows`` with the label of their key by ``names`` (key, label), or a default: a row isn't lost for want of a label."""
    known = names.select(F.col(key).alias("__key"), F.col(label).alias("__label"))
    return rows.join(known, F.col(key) == F.col("__key"), "left").withColumn(label, F.coalesce("__label", F.lit(default))).drop("__key", "__label")


def index_projection(rows: DataFrame, renames: dict[str, str], hidden: tuple[str, ...] = ("content", "text")) -> DataFrame:
    """Columns of an index under their names there; texts are searched in but never stored to be returned."""
    if shown := [new for new, old in renames.items() if old in hidden]:
        raise ValueError(f"texts are not part of an index: {', '.join(shown)}")
    return rows.select(*(F.col(old).alias(new) for new, old in renames.items()))


def reference(key: Column, name: Column) -> Column:
    """(_id, name) of something that has a name, else null."""
    return F.when(F.coalesce(name != "", F.lit(False)) & key.isNotNull(), F.struct(key.cast("string").alias("_id"), name.alias("name")))


def envelope(page: DataFrame, total: DataFrame, order: str) -> DataFrame:
    """One row: searchResults, the rows of a page (500 at most) in order, and count, of all rows; ``total`` is one row with count."""
    rows = page.agg(F.array_sort(F.collect_list(F.struct(order, *(c for c in page.columns if c != order)))).alias("searchResults"))
    return rows.join(F.broadcast(total.select("count")), F.lit(True))


def _labelled(rows: DataFrame, projects: DataFrame) -> DataFrame:
    """``rows`` with project_name and project, the reference (_id, name) that templates bind, in the project's other id space where it has one.

    ``projects`` (project_id, project_name, external_id) are the readable ones: a name must not outlive the visibility of its row. A row
    without one stays, under a general name and its own id.
    """
    own = projects.select(F.col("project_id").cast("string").alias("__pid"), F.col("project_name").alias("__name"), F.col("external_id").alias("__external"))
    shown = rows.join(own, F.col("project_id") == F.col("__pid"), "left")
    name = _or_else("__name", NO_PROJECT)
    ref = F.struct(F.when(F.col("__external") != "", F.col("__external")).otherwise(F.col("project_id")).alias("_id"), name.alias("name"))
    return shown.withColumns({"project_name": name, "project": F.when(F.col("project_id") != "", ref)}).drop("__pid", "__name", "__external")


def chunk_hits(hits: DataFrame, documents: DataFrame, projects: DataFrame) -> DataFrame:
    """Hits (chunk_id, document_id, project_id, page, snippet) as callers get them.

    A hit whose document is not among the readable ``documents`` (document_id, name, file, type) is left out; its file name stands in for its name. One whose project
    is not among the readable ``projects`` stays under a general name. The text itself is never returned.
    """
    shown = hits.join(documents.select("document_id", "name", "file", "type"), "document_id")
    name = F.coalesce(F.when(F.col("name") != "", F.col("name")), F.when(F.col("file") != "", F.col("file")), F.lit(NO_DOCUMENT))
    rows = shown.select(
        F.col("chunk_id").cast("string").alias("id"), F.col("document_id").cast("string").alias("document_id"), F.coalesce(F.col("project_id").cast("string"), F.lit("")).alias("project_id"),
        name.alias("document_name"), _or_else("type", NO_TYPE).alias("document_type"), F.coalesce("page", F.lit(0)).alias("page_number"), F.lit("").alias("content"), F.coalesce("snippet", F.lit("")).alias("snippet"),
    )
    return _labelled(rows, projects)


def document_hits(documents: DataFrame, projects: DataFrame) -> DataFrame:
    """Documents (id, name, file, type, project_id, read, description) as callers get them, with the name and reference of their project.

    A row is published if its list of roles says so, and where it has no list.
    """
    rows = documents.select(
        F.col("id").cast("string").alias("id"), _or_else("name", NO_DOCUMENT).alias("name"), _or_else("file", NO_FILE).alias("file"), _or_else("type", NO_TYPE).alias("type"),
        F.coalesce(F.col("project_id").cast("string"), F.lit("")).alias("project_id"), F.when(F.col("read").isNotNull(), F.array_contains("read", "public")).otherwise(True).alias("is_published"),
        _or_else("description", NO_DESCRIPTION).alias("description"),
    )
    return _labelled(rows, projects)


# What stands for a missing field of a project.
_PROJECT = {"name": "Unnamed Project", "sector": "Other", "status": "Active", "region": "British Columbia", "description": "No project description provided.", "proponent": "Proponent Organization"}


def project_hits(rows: DataFrame, stored: bool = False) -> DataFrame:
    """Projects as callers get them, from the index (external_id, name, display_name, status, ...) or ``stored`` (project_state and status, proponent_name, is_published).

    Empty text counts as missing. The id that links out is the other registry's, or the own one where there is none. An index row without a list of roles
    is published, a stored one without roles by its flag.
    """
    def first(field: str, *columns: str) -> Column:
        return F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in columns), F.lit(_PROJECT[field])).alias(field)

    own, other = F.col("id").cast("string"), F.nullif(F.col("external_id"), F.lit(""))
    public = F.array_contains("read", "public")
    shown = F.when(F.coalesce(F.size("read"), F.lit(0)) > 0, public).otherwise(F.coalesce("is_published", F.lit(False))) if stored else F.when(F.col("read").isNotNull(), public).otherwise(True)
    return rows.select(
        F.coalesce(other, own).alias("_id"), own.alias("id"), (F.coalesce(F.nullif(F.col("track_id").cast("string"), F.lit("")), own) if stored else own).alias("track_id"), F.coalesce(other, F.lit("")).alias("external_id"),
        first("name", "name") if stored else first("name", "name", "display_name"), first("sector", "sector"), first("status", "project_state", "status") if stored else first("status", "status"), point_or_default(F.col("centroid")).alias("centroid"),
        first("region", "region"), first("description", "description"), first("proponent", "proponent_name") if stored else first("proponent", "proponent"), shown.alias("is_published"),
    )


def overlay(defaults: DataFrame, stored: DataFrame, allowed: list[str], by: list[str] | None = None) -> DataFrame:
    """Settings (key, value as VARIANT, and the columns ``by`` of who has them) with stored values in place of defaults: only of ``allowed`` keys, never a null, and in place of a boolean only a boolean."""
    on = [*(by or []), "key"]
    given = stored.filter(F.col("key").isin(allowed)).select(*on, F.col("value").alias("__value"))
    boolean = lambda v: F.coalesce(F.schema_of_variant(v) == "BOOLEAN", F.lit(False))
    there = F.col("__value").isNotNull() & ~F.coalesce(F.is_variant_null("__value"), F.lit(True))
    joined = defaults.join(given, on, "left")
    value = F.when(there & (~boolean(F.col("value")) | boolean(F.col("__value"))), F.col("__value")).otherwise(F.col("value"))
    return joined.withColumn("value", value).select(defaults.columns)
