"""Queries of result shapes and of search over several fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.operators import mutate, search, shape
from corpuslake.plans import views as v

from corpuslake.plans.views import query
from corpuslake.sources.readers import table

@query("""WITH t AS (SELECT p_partkey, field, len(w) AS len, unnest(w) AS term FROM (
      SELECT p_partkey, field, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w
      FROM (SELECT p_partkey, 'p_name' AS field, p_name AS text FROM part UNION ALL SELECT p_partkey, 'p_type', p_type FROM part))),
    p AS (SELECT p_partkey, field, term, count(*) AS tf, max(len) AS len FROM t GROUP BY ALL),
    s AS (SELECT field, sum(len) / (SELECT count(*) FROM part) AS avgl FROM (SELECT DISTINCT p_partkey, field, len FROM t) GROUP BY field),
    f AS (SELECT field, term, count(*) AS df FROM p GROUP BY ALL),
    n AS (SELECT count(*) AS n FROM part)
    SELECT p_partkey, round(sum(ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgl))), 6) AS score
    FROM p JOIN f USING (field, term) JOIN s USING (field), n WHERE term IN ('small', 'ring') GROUP BY p_partkey HAVING count(DISTINCT term) = 2""")
def rnk_02_fields(spark: SparkSession, d: str) -> DataFrame:
    clauses = search.compile_query("small ring", fuzzy=False)
    found = v.text_index(spark, d, "part", "p_partkey", ["p_name", "p_type"]).search(clauses)
    return found.select(F.col("key").alias("p_partkey"), F.round("score", 6).alias("score"))

@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 9 = 0 THEN 'F' || c_custkey END AS wildfire FROM customer""")
def prj_02_public_view(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    fire = F.when(k % 9 == 0, F.concat(F.lit("F"), k))
    shown = shape.public_view(table(spark, d, "customer").select(k.alias("id"), F.struct(fire.alias("wildfire"), F.col("c_name").alias("registry")).alias("sources")))
    return shown.select("id", *(F.col(f"sources.{n}") for n in shown.schema["sources"].dataType.names))

@query("SELECT n_nationkey AS id, n_name AS name FROM nation")
def prj_03_internals(spark: SparkSession, d: str) -> DataFrame:
    stored = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), *(F.lit("x").alias(c) for c in shape.INTERNAL))
    return shape.strip_internals(stored)

@query("SELECT s_suppkey AS id, s_name AS label FROM supplier")
def prj_09_redaction(spark: SparkSession, d: str) -> DataFrame:
    return shape.redact(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("label"), F.sha2("s_name", 256).alias("hash")))

@query("""SELECT l_orderkey || '-' || l_linenumber AS id, l_orderkey::VARCHAR AS document_id, l_suppkey::VARCHAR AS project_id, coalesce(s_name, 'Associated Project') AS project_name,
    CASE WHEN s_suppkey % 2 = 0 THEN 'x' || s_suppkey ELSE l_suppkey::VARCHAR END AS ref_id, coalesce(s_name, 'Associated Project') AS ref_name,
    CASE WHEN l_orderkey % 5 > 0 THEN 'order ' || l_orderkey WHEN l_orderkey % 2 = 0 THEN l_orderkey || '.pdf' ELSE 'Untitled Document' END AS document_name, CASE WHEN l_orderkey % 7 = 0 THEN 'PDF Document' ELSE o_orderstatus END AS document_type,
    CASE WHEN l_linenumber = 1 THEN 0 ELSE l_linenumber END AS page_number, '' AS content, CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE l_returnflag END AS snippet
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 3 > 0) s ON l_suppkey = s_suppkey WHERE l_orderkey % 4 > 0""")
def prj_06_chunk_hits(spark: SparkSession, d: str) -> DataFrame:
    o, n, s = F.col("l_orderkey"), F.col("l_linenumber"), F.col("s_suppkey")
    hits = table(spark, d, "lineitem").select(
        F.concat(o, F.lit("-"), n).alias("chunk_id"), o.alias("document_id"), F.col("l_suppkey").alias("project_id"), F.when(n > 1, n).alias("page"), F.when(n % 2 == 1, F.col("l_returnflag")).alias("snippet")
    )
    k = F.col("o_orderkey")
    documents = table(spark, d, "orders").filter(k % 4 > 0).select(
        k.alias("document_id"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("order "), k)).alias("name"), F.when(k % 2 == 0, F.concat(k, F.lit(".pdf"))).alias("file"), F.when(k % 7 > 0, F.col("o_orderstatus")).alias("type")
    )
    projects = table(spark, d, "supplier").filter("s_suppkey % 3 > 0").select(s.alias("project_id"), F.col("s_name").alias("project_name"), F.when(s % 2 == 0, F.concat(F.lit("x"), s)).alias("external_id"))
    return _flat(shape.chunk_hits(hits, documents, projects))


def _flat(hits: DataFrame) -> DataFrame:
    return hits.withColumns({"ref_id": F.col("project._id"), "ref_name": F.col("project.name")}).drop("project")


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 500")
def q_12_keyword_page(spark: SparkSession, d: str) -> DataFrame:
    return search.keyword_page(table(spark, d, "documents").select("doc_id"), [F.asc("doc_id")], top=500)



@query("""SELECT d.id::VARCHAR AS id, CASE WHEN d.id % 2 = 0 THEN 'Untitled Document' ELSE 'doc ' || d.id END AS name, CASE WHEN d.id % 3 = 2 THEN 'f' || d.id ELSE 'document.pdf' END AS file,
    coalesce(type, 'PDF Document') AS type, coalesce(project_id, '') AS project_id, coalesce(p.name, 'Associated Project') AS project_name, CASE WHEN project_id <> '' THEN CASE WHEN p.id IS NULL THEN project_id ELSE 'x' || p.id END END AS ref_id,
    CASE WHEN project_id <> '' THEN coalesce(p.name, 'Associated Project') END AS ref_name, CASE WHEN d.read IS NULL THEN true ELSE list_contains(d.read, 'public') END AS is_published, 'Official document extracted from central registry.' AS description
    FROM v_documents d LEFT JOIN (SELECT * FROM v_projects WHERE is_published) p ON p.id = project_id""")
def prj_05_document_hits(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    docs = v.documents(spark, d).withColumn("name", F.when(i % 2 == 1, F.concat(F.lit("doc "), i))).withColumn("description", F.lit("")).withColumn("file", F.when(i % 3 == 2, F.concat(F.lit("f"), i)))
    projects = v.projects(spark, d).filter("is_published").select(i.alias("project_id"), F.col("name").alias("project_name"), F.concat(F.lit("x"), i).alias("external_id"))
    return _flat(shape.document_hits(docs, projects))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN replace(p_name, ' ', '&amp;') ELSE '<mark>' || p_name || '</mark> … ' || p_type || ' &lt;' END AS html FROM part""")
def rnk_07_fragments(spark: SparkSession, d: str) -> DataFrame:
    first, second = F.concat(F.lit("\ue000"), "p_name"), F.concat("p_type", F.lit("\ue001 <"))
    parts = F.when(F.col("p_partkey") % 5 > 0, F.array(first, second))
    return table(spark, d, "part").select("p_partkey", search.snippet(parts, F.replace("p_name", F.lit(" "), F.lit("&"))).alias("html"))


@query("""SELECT o_orderkey AS id, 'p' || o_custkey AS project_id, CASE WHEN o_orderkey % 3 = 0 THEN 'new ' || (o_orderkey + 1) ELSE o_orderstatus END AS name,
    CASE WHEN o_orderkey % 3 = 0 THEN 'now' END AS updated_at FROM orders""")
def snk_23_document_update(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    orders = table(spark, d, "orders")
    stored = orders.select(k.alias("id"), F.concat(F.lit("p"), "o_custkey").alias("project_id"), F.col("o_orderstatus").alias("name"))
    changes = orders.filter(k % 3 == 0).select(k.alias("id"), F.lit("other").alias("project_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("at"))
    changes = changes.withColumn("name", F.concat(F.lit("new "), F.col("id") + F.col("at")))
    return mutate.update(stored, changes, ["project_id", "read", "is_published"], F.lit("now"), order="at")
