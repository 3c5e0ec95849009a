"""Writes as DataFrame plans (SNK-*): each takes the stored rows and a change and gives the new rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.operators.access import PUBLIC, SECURE_ROLES, document_acl


def upsert(stored: DataFrame, fresh: DataFrame, key: str = "id") -> DataFrame:
    """Whole rows replaced or added."""
    return stored.join(fresh.select(key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def one_change(changes: DataFrame, fields: list[str], key: str = "id", order: str | None = None) -> DataFrame:
    """One row of each key: the last by ``order``; of equal ones, and without order, the greatest by ``fields``."""
    ranked = F.struct(*([F.col(order).alias("__order")] if order else []), *fields)
    return changes.groupBy(key).agg(F.max(ranked).alias("__change")).select(key, *(F.col("__change")[f].alias(f) for f in fields))


def patch(stored: DataFrame, changes: DataFrame, fields: list[str], key: str = "id", most: int = 10, order: str | None = None) -> DataFrame:
    """Named fields replaced where a change has the row; at most ``most`` of them. Of several changes of a key one holds (``one_change``)."""
    if len(fields) > most:
        raise ValueError(f"a patch has at most {most} fields")
    c = one_change(changes, fields, key, order).select(F.col(key).alias("__key"), *(F.col(f).alias(f"__{f}") for f in fields))
    joined = stored.join(c, stored[key] == c["__key"], "left")
    hit = F.col("__key").isNotNull()
    return joined.select(*(F.when(hit, F.col(f"__{x}")).otherwise(F.col(x)).alias(x) if x in fields else F.col(x) for x in stored.columns))


def update(stored: DataFrame, changes: DataFrame, fixed: list[str], now: Column, key: str = "id", order: str | None = None) -> DataFrame:
    """Rows with the changes' columns, but for the key and the ``fixed`` ones, which no update may set; updated_at where there was a change."""
    fields = [c for c in changes.columns if c in stored.columns and c not in (key, order, "updated_at", *fixed)]
    marked = changes.withColumn("updated_at", now)
    base = stored if "updated_at" in stored.columns else stored.withColumn("updated_at", F.lit(None).cast(marked.schema["updated_at"].dataType))
    return patch(base, marked, [*fields, "updated_at"], key, most=len(fields) + 1, order=order)


def replace_if_unchanged(stored: DataFrame, changes: DataFrame, version: str = "etag", key: str = "id") -> DataFrame:
    """(key, status) of optimistic replacements: ok, conflict or missing."""
    now = stored.select(key, F.col(version).alias("__now"))
    status = F.when(F.col("__now").isNull(), "missing").when(F.col("__now") == F.col(version), "ok").otherwise("conflict")
    return changes.join(now, key, "left").select(key, status.alias("status"))


def delete(stored: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return stored.join(keys.select(key), key, "left_anti")


def surplus(stored: DataFrame, keep: DataFrame, document: str = "document_id") -> DataFrame:
    """Stored chunks of re-extracted documents whose id was not written again."""
    return stored.join(keep.select(document).distinct(), document, "left_semi").join(keep.select("id"), "id", "left_anti")


def require_acl(rows: DataFrame) -> DataFrame:
    """Rows without a role fail the job: nothing may become visible by an empty list."""
    ok = F.coalesce(F.size("read"), F.lit(0)) > 0
    return rows.withColumn("read", F.when(ok, F.col("read")).otherwise(F.raise_error(F.lit("a row has no access list"))))


def cascade_acl(children: DataFrame, parents: DataFrame, child_key: str, key: str = "id", order: str | None = None) -> DataFrame:
    """Children take the access of their changed parents; of several changes of a parent one holds."""
    p = one_change(parents, ["read", "is_published"], key, order).select(F.col(key).alias("__p"), F.col("read").alias("__read"), F.col("is_published").alias("__pub"))
    joined = children.join(p, children[child_key] == p["__p"], "left")
    hit = F.col("__p").isNotNull()
    return joined.withColumns({"read": F.when(hit, F.col("__read")).otherwise(F.col("read")), "is_published": F.when(hit, F.col("__pub")).otherwise(F.col("is_published"))}).drop("__p", "__read", "__pub")


def closed_projects(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """Projects that went from public to private; only these cascade."""
    a = after.select(key, F.col("is_published").alias("__after"))
    return before.join(a, key).filter(F.coalesce("is_published", F.lit(False)) & ~F.coalesce("__after", F.lit(False))).select(key)


def publish(documents: DataFrame, projects: DataFrame, wanted: Column, project: str = "project_id") -> DataFrame:
    """(id, status, is_published): refused where the parent is private."""
    p = projects.select(F.col("id").alias("__p"), F.coalesce("is_published", F.lit(False)).alias("__public"))
    joined = documents.join(p, F.col(project) == F.col("__p"), "left")
    refused = wanted & ~F.coalesce("__public", F.lit(False))
    return joined.select("id", F.when(refused, "conflict").otherwise("ok").alias("status"), F.when(refused, F.col("is_published")).otherwise(wanted).alias("is_published"))


def validated(rows: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with the fields that lack a value)."""
    lacking = F.array_compact(F.array(*[F.when(F.coalesce(F.trim(F.col(f).cast("string")), F.lit("")) == "", F.lit(f)) for f in required]))
    checked = rows.withColumn("lacking", lacking)
    return checked.filter(F.size("lacking") == 0).drop("lacking"), checked.filter(F.size("lacking") > 0)


def created(rows: DataFrame, published: str = "is_published") -> DataFrame:
    """New rows are private unless published, with their defaults written out."""
    shown = F.coalesce(F.col(published), F.lit(False))
    secure = list(map(F.lit, SECURE_ROLES))
    return rows.withColumns({"is_published": shown, "read": F.when(shown, F.array(F.lit(PUBLIC), *secure)).otherwise(F.array(*secure)), "content_extracted": F.lit(False)})


def batches(rows: DataFrame, order: Column, size: int = 100) -> DataFrame:
    """Rows with a batch number within each of the table's write tasks."""
    return rows.withColumn("batch", F.floor((order - 1) / size).cast("int"))


def write_report(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("status").agg(F.count("*").alias("n"))


def copy_counts(source: DataFrame, target: DataFrame, name: str) -> DataFrame:
    """(name, source_rows, target_rows, action) of tables that are copied by name: one that has as many rows there, or more, is skipped."""
    there = target.groupBy(name).agg(F.count("*").alias("target_rows"))
    both = source.groupBy(name).agg(F.count("*").alias("source_rows")).join(there, name, "left")
    n = F.coalesce("target_rows", F.lit(0).cast("long"))
    return both.select(F.col(name).alias("name"), "source_rows", n.alias("target_rows"), F.when(n >= F.col("source_rows"), "skip").otherwise("copy").alias("action"))


def deleted_documents(documents: DataFrame, chunks: DataFrame, document_index: DataFrame, chunk_index: DataFrame, ids: DataFrame, document: str = "document_id") -> dict[str, DataFrame]:
    """What stays in the four places after documents (``ids`` has id) are deleted, and a report with one row of how many went from each. The stored files stay."""
    places = {"documents": (documents, "id"), "chunks": (chunks, document), "document_index": (document_index, "id"), "chunk_index": (chunk_index, document)}
    gone = {name: rows.join(ids.select(F.col("id").alias(key)).distinct(), key, "left_semi").select(F.lit(name).alias("place")) for name, (rows, key) in places.items()}
    report = reduce(DataFrame.unionByName, gone.values()).agg(*(F.count_if(F.col("place") == name).alias(name) for name in places))
    return {name: rows.join(ids.select(F.col("id").alias(key)), key, "left_anti") for name, (rows, key) in places.items()} | {"report": report}


def new_documents(requests: DataFrame, parents: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(rows, refused) of documents to create (id, project_id, name, is_published): refused where the project isn't among the readable ``parents`` (id, read) or a name is missing. A document is published only if its project is."""
    public = F.coalesce(F.array_contains("__read", PUBLIC), F.lit(False))
    own = requests.join(parents.select(F.col("id").alias("__project"), F.col("read").alias("__read")), F.col("project_id") == F.col("__project"), "left")
    good = F.col("__project").isNotNull() & F.coalesce(F.trim("name") != "", F.lit(False))
    shown, read = document_acl(F.col("is_published"), public)
    rows = own.filter(good).select("id", "project_id", F.trim("name").alias("name"), shown.alias("is_published"), read.alias("read"), F.lit(False).alias("content_extracted"), now.alias("created_at"))
    return rows, own.filter(~good).select(requests.columns)


def copy_plan(source: DataFrame, target: DataFrame, key: str = "key") -> DataFrame:
    """(key, action): copy, skip when the sizes agree. Of repeated targets the greatest size counts."""
    t = target.groupBy(key).agg(F.max("size").alias("__size"))
    return source.join(t, key, "left").select(key, F.when(F.col("size").eqNullSafe(F.col("__size")), "skip").otherwise("copy").alias("action"))


def purge(documents: DataFrame, chunks: DataFrame, error_part: str, document: str = "document_id") -> dict[str, DataFrame]:
    """Documents whose extraction error holds a text: reset rows, chunks that stay, and a dry-run report."""
    hit = documents.filter(F.contains("extraction_error", F.lit(error_part)))
    gone = chunks.join(hit.select(F.col("id").alias(document)), document, "left_semi")
    report = hit.agg(F.count("*").alias("documents")).join(gone.agg(F.count("*").alias("chunks")), F.lit(True))
    reset = documents.withColumn("__hit", F.coalesce(F.contains("extraction_error", F.lit(error_part)), F.lit(False)))
    none = lambda c: F.when(~F.col("__hit"), F.col(c))
    reset = reset.withColumns({"content_extracted": F.col("content_extracted") & ~F.col("__hit"), "extraction_error": none("extraction_error")}).drop("__hit")
    return {"documents": reset, "chunks": chunks.join(hit.select(F.col("id").alias(document)), document, "left_anti"), "report": report}


def extraction_outcome(chunks: Column, error: Column, pages: Column, truncated: Column) -> Column:
    """What is recorded of an extraction."""
    failed = error.isNotNull()
    return F.struct(
        ((chunks > 0) & ~failed).alias("content_extracted"), F.when(failed, F.left(error, F.lit(500))).alias("extraction_error"),
        pages.alias("content_page_count"), (truncated & (chunks > 0)).alias("partial"),
    )


def export_key(document: Column, page: Column, index: Column) -> Column:
    return F.concat(document.cast("string"), F.lit("_p"), page.cast("string"), F.lit("_c"), index.cast("string"))


def index_key(id_: Column) -> Column:
    """URL-safe base64 whose padding is written as a digit."""
    raw = F.translate(F.base64(id_.cast("binary")), "+/", "-_")
    bare = F.rtrim(raw, F.lit("="))
    return F.concat(bare, (F.length(raw) - F.length(bare)).cast("string"))


def issue_keys(wanted: DataFrame, allowed: list[str], write_roles: list[str]) -> DataFrame:
    """(id, status): roles must be allowed, write roles confirmed, the expiry in the future."""
    known = F.size(F.array_except("roles", F.array(*map(F.lit, allowed)))) == 0
    writes = F.arrays_overlap("roles", F.array(*map(F.lit, write_roles)))
    status = F.when(~known, "unknown-role").when(writes & ~F.coalesce("confirmed", F.lit(False)), "unconfirmed").when(F.col("expires_at") <= F.col("now"), "expired").otherwise("ok")
    return wanted.select("id", status.alias("status"))


def definition_plan(wanted: list[tuple[str, str]], live: set[str], only: set[str] | None = None) -> list[tuple[str, str, str]]:
    """(kind, name, action) with indexes first; live names are refused."""
    order = {"index": 0, "datasource": 1, "indexer": 2}
    chosen = sorted((k, n) for k, n in wanted if only is None or n in only)
    return [(k, n, "refuse" if n in live else "apply") for k, n in sorted(chosen, key=lambda x: (order.get(x[0], 9), x[1]))]


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def _boundary_acl(published: Column) -> tuple[Column, Column]:
    """(is_published, read) of a boundary: public unless that is refused, as it has no parent."""
    shown = F.coalesce(published, F.lit(True))
    secure = list(map(F.lit, SECURE_ROLES))
    return shown, F.when(shown, F.array(F.lit(PUBLIC), *secure)).otherwise(F.array(*secure))


def created_boundaries(requests: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(rows, refused) of requests (type, name, code, geometry, is_published): one without type or name is refused; of several for an id one holds."""
    good = F.coalesce((F.col("type") != "") & (F.col("name") != ""), F.lit(False))
    shown, read = _boundary_acl(F.col("is_published"))
    rows = requests.filter(good).select(
        F.concat("type", F.lit("_"), "name").alias("id"), "type", "name", F.coalesce("code", F.lit("")).alias("code"), "geometry", shown.alias("is_published"), read.alias("read"), now.alias("updated_at")
    )
    return one_change(rows, [c for c in rows.columns if c != "id"]).select(rows.columns), requests.filter(~good)


def updated_boundaries(stored: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """``stored`` with changes (id and any of name, code, geometry, is_published). Id, type and read can't be set: the roles follow is_published, and stay where a change has none. A null leaves its field as it is."""
    fields = [f for f in ("name", "code", "geometry", "is_published") if f in changes.columns]
    c = one_change(changes, fields).select(F.col("id").alias("__id"), *(F.col(f).alias(f"__{f}") for f in fields))
    joined, hit = stored.join(c, F.col("id") == F.col("__id"), "left"), F.col("__id").isNotNull()
    out = {f: F.coalesce(F.col(f"__{f}"), F.col(f)) for f in fields} | {"updated_at": F.when(hit, now).otherwise(F.col("updated_at"))}
    if "is_published" in fields:
        out["read"] = F.when(F.col("__is_published").isNotNull(), _boundary_acl(F.col("__is_published"))[1]).otherwise(F.col("read"))
    return joined.select(*(out.get(x, F.col(x)).alias(x) for x in stored.columns))


def wildfires(points: DataFrame, perimeters: DataFrame, now: Column) -> DataFrame:
    """Rows to upsert of incident points (fire_number, fire_year, incident_name, geographic_description, fire_status, fire_cause, current_size, fire_url, fire_of_note, lng, lat) with the perimeter
    (fire_number, geometry) of their number. Empty values get their defaults; a number is one row. A point without a number is named by its place, so that it is the same row in the next run."""
    def text(name: str, *others: Column) -> Column:
        return F.coalesce(F.nullif(F.col(name), F.lit("")), *others)

    number = text("fire_number", F.concat(F.lit("UNKNOWN_"), F.sha2(F.concat_ws("|", "lng", "lat", "incident_name"), 256).substr(1, 16)))
    shapes = one_change(perimeters.filter("fire_number IS NOT NULL"), ["geometry"], "fire_number").select(F.col("fire_number").alias("__number"), F.col("geometry").alias("perimeter"))
    rows = points.select(
        number.alias("id"), F.coalesce(F.nullif(F.col("fire_year"), F.lit(0)), F.year(now)).alias("fire_year"), text("incident_name", text("geographic_description"), number).alias("incident_name"),
        text("geographic_description", F.lit("")).alias("geographic_description"), text("fire_status", F.lit("Unknown")).alias("fire_status"), text("fire_cause", F.lit("Unknown")).alias("fire_cause"),
        F.coalesce(F.col("current_size"), F.lit(0.0)).alias("size_ha"), text("fire_url", F.lit("")).alias("url"), F.coalesce(F.col("fire_of_note") == "Y", F.lit(False)).alias("of_note"), "lng", "lat", now.alias("synced_at"),
    )
    rows = one_change(rows, [c for c in rows.columns if c != "id"]).select(rows.columns)
    return rows.join(shapes, F.col("id") == F.col("__number"), "left").drop("__number")
