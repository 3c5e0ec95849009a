"""The library's entities over the star-schema tables, in Spark and in the same terms as SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.operators.inverted import TextIndex
from corpuslake.session import shared_folder
from corpuslake.sources.readers import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as the query of its name, with the SQL of the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = _with_views(sql)
        return f

    return add


def documents(spark: SparkSession, d: str) -> DataFrame:
    """id, project_id, type, text, n_chars, read, is_published, content_extracted."""
    marks = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    rows = table(spark, d, "documents").join(marks, "doc_id", "left")
    read = (
        F.when((F.col("q") == 1) & (F.col("t") == 0), F.array(F.lit("public"), F.lit("staff"))).when(F.col("q") == 0, F.array(F.lit("staff")))
        .when(F.col("q") == 1, F.array().cast("array<string>"))
    )
    return rows.select(
        F.col("doc_id").alias("id"), F.col("source").alias("project_id"), F.col("lang").alias("type"), "text", "n_chars",
        read.alias("read"), (F.col("doc_id") % 3 == 0).alias("is_published"), (F.col("doc_id") % 4 != 0).alias("content_extracted"),
    )


def projects(spark: SparkSession, d: str) -> DataFrame:
    """id, name (null for one), sector, region, lng, lat, is_published, read."""
    n = table(spark, d, "nation")
    return n.select(
        F.concat(F.lit("src"), (F.col("n_nationkey") - 1).cast("string")).alias("id"), F.when(F.col("n_nationkey") != 7, F.concat(F.lit("Project "), F.lower("n_name"))).alias("name"),
        F.concat(F.element_at(F.array(*map(F.lit, ("Mines", "Energy ", "Water", " ", "Energy"))), (F.col("n_nationkey") % 5 + 1).cast("int"))).alias("sector"),
        F.col("n_regionkey").cast("string").alias("region"), (F.lit(-139.0) + F.col("n_nationkey")).alias("lng"), (F.lit(48.0) + F.col("n_nationkey") * 0.5).alias("lat"),
        (F.col("n_nationkey") % 2 == 0).alias("is_published"),
        F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("public"), F.lit("staff"))).otherwise(F.array(F.lit("staff"))).alias("read"),
    )


def left_registry(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        k.alias("left_id"), F.when(k % 5 == 0, "").when(k % 7 == 0, F.concat(F.lit("x"), k)).otherwise(F.concat(F.lit("c"), k)).alias("guid"),
        F.when(k % 4 == 0, " ").otherwise(F.col("s_name")).alias("name"), F.lit(None).cast("string").alias("description"), (k % 2 == 0).alias("is_active"),
    )


def right_registry(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").filter("c_custkey % 3 <> 0")
    return c.select(
        F.concat(F.lit("c"), F.col("c_custkey")).alias("right_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("description"), F.col("c_mktsegment").alias("sector"),
        (F.col("c_acctbal") > 0).alias("active_status"), F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("public"))).alias("read"),
    )


def pieces(spark: SparkSession, d: str) -> DataFrame:
    """document_id, chunk_index, content: pieces of the texts with overlap."""
    from corpuslake.operators.chunk import split_pieces

    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(split_pieces(F.col("text"))))
    return docs.select("document_id", F.col("pos").cast("long").alias("chunk_index"), F.col("col").alias("content"))


_indexes: dict[tuple, TextIndex] = {}


def text_index(spark: SparkSession, d: str, name: str, key: str, fields: list[str]) -> TextIndex:
    """The stored index of a table: built from the whole table when a session first asks for it, and again when the table's files are others."""
    rows = table(spark, d, name)
    at = (spark.sparkContext.applicationId, name, key, *fields, *sorted(rows.inputFiles()))
    if at not in _indexes:
        index = TextIndex(spark, f"{shared_folder(spark)}/corpuslake/index-{name}-{uuid.uuid4().hex}")
        _indexes[at] = index.add(rows, key, fields)
    return _indexes[at]


def places(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), *point(F.col("s_suppkey")))


def fires(spark: SparkSession, d: str) -> DataFrame:
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    return c.select(*point(k * 3 + 1), F.when(k % 11 == 0, "Out").otherwise("Active").alias("status"), (k % 9 == 0).alias("of_note"))


def point(k):
    return (F.lit(-139.5) + (k * 7919 % 2600) / 100.0).alias("lng"), (F.lit(47.5) + (k * 104729 % 1300) / 100.0).alias("lat")


#: The views above as SQL, each with the views that it needs before it.
VIEWS = {
    "v_documents": """v_documents AS (SELECT d.doc_id AS id, d.source AS project_id, d.lang AS type, d.text, d.n_chars,
        CASE WHEN q = 1 AND t = 0 THEN ['public', 'staff'] WHEN q = 0 THEN ['staff'] WHEN q = 1 THEN []::VARCHAR[] END AS read,
        d.doc_id % 3 = 0 AS is_published, d.doc_id % 4 <> 0 AS content_extracted
        FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS q, max(toxic) AS t FROM labels GROUP BY doc_id) l USING (doc_id))""",
    "v_projects": """v_projects AS (SELECT 'src' || (n_nationkey - 1) AS id, CASE WHEN n_nationkey <> 7 THEN 'Project ' || lower(n_name) END AS name,
        ['Mines', 'Energy ', 'Water', ' ', 'Energy'][n_nationkey % 5 + 1] AS sector, n_regionkey::VARCHAR AS region, -139.0::DOUBLE + n_nationkey AS lng, 48.0::DOUBLE + n_nationkey * 0.5::DOUBLE AS lat,
        n_nationkey % 2 = 0 AS is_published, CASE WHEN n_nationkey % 2 = 0 THEN ['public', 'staff'] ELSE ['staff'] END AS read FROM nation)""",
    "v_left": """v_left AS (SELECT s_suppkey AS left_id, CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 7 = 0 THEN 'x' || s_suppkey ELSE 'c' || s_suppkey END AS guid,
        CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_name END AS name, s_suppkey % 2 = 0 AS is_active FROM supplier)""",
    "v_right": """v_right AS (SELECT 'c' || c_custkey AS right_id, c_name AS name, c_mktsegment AS description, c_mktsegment AS sector, c_acctbal > 0 AS active_status,
        c_custkey % 2 = 0 AS public FROM customer WHERE c_custkey % 3 <> 0)""",
    "v_classes": """v_classes AS (SELECT l.*, r.right_id, r.name AS r_name, r.description AS r_description, r.sector AS r_sector, r.active_status, r.public,
        CASE WHEN l.left_id IS NULL THEN 'right-only' WHEN r.right_id IS NOT NULL THEN 'matched' WHEN l.guid IS NULL THEN 'no-guid' ELSE 'dangling' END AS class
        FROM v_left l FULL JOIN v_right r ON l.guid = r.right_id)""",
    "v_pieces": """v_pieces AS (SELECT doc_id AS document_id, s // 3800 AS chunk_index, substr(text, s + 1, 4000) AS content
        FROM (SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) <= 4000 THEN 1 ELSE (ceil((length(text) - 4000) / 3800.0) * 3800 + 1)::BIGINT END, 3800)) AS s FROM documents))""",
    "v_places": """v_places AS (SELECT s_suppkey AS id, -139.5::DOUBLE + (s_suppkey * 7919 % 2600) / 100.0::DOUBLE AS lng, 47.5::DOUBLE + (s_suppkey * 104729 % 1300) / 100.0::DOUBLE AS lat FROM supplier)""",
    "v_fires": """v_fires AS (SELECT -139.5::DOUBLE + ((c_custkey * 3 + 1) * 7919 % 2600) / 100.0::DOUBLE AS lng, 47.5::DOUBLE + ((c_custkey * 3 + 1) * 104729 % 1300) / 100.0::DOUBLE AS lat,
        CASE WHEN c_custkey % 11 = 0 THEN 'Out' ELSE 'Active' END AS status, c_custkey % 9 = 0 AS of_note FROM customer)""",
    "v_terms": r"""v_terms AS (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents))""",
    "v_posts": """v_posts AS (SELECT doc_id, term, count(*) AS tf, max(len) AS len FROM v_terms GROUP BY doc_id, term)""",
}
_NEEDS = {"v_classes": ["v_left", "v_right"], "v_posts": ["v_terms"]}


def _with_views(sql: str) -> str:
    """The SQL with the views that it names put before it."""
    views, text = _used(sql), sql.lstrip()
    if not views:
        return sql
    return f"WITH {views},\n{text.removeprefix('WITH ')}" if text.startswith("WITH ") else f"WITH {views}\n{text}"


def _used(sql: str) -> str:
    names: list[str] = []
    for name in VIEWS:
        if name in sql:
            names += [*_NEEDS.get(name, []), name]
    return ",\n".join(VIEWS[n] for n in dict.fromkeys(names))
