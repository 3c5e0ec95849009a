"""Queries of stored rows and what becomes of them: dumps, settings, references, boundaries, fires, ranks, routes, requests, summaries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.operators import evaluate, events, geo, mutate, registry, search, shape, summary, text
from corpuslake.plans import views as v
from corpuslake.plans.views import query
from corpuslake.session import shared_folder
from corpuslake.sources import jsonl, readers
from corpuslake.sources.readers import table

_SECURE = "['sysadmin', 'staff', 'admin', 'service']"


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def snk_12_dump(spark: SparkSession, d: str) -> DataFrame:
    """All documents as JSON lines, read back."""
    docs, folder = table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars"), f"{shared_folder(spark)}/corpuslake/dump-{uuid.uuid4().hex}"
    spark.dataSource.register(jsonl.JsonLines)
    docs.write.format("jsonl").mode("append").save(folder)
    return spark.read.schema(docs.schema).json(folder)


@query(r"""WITH q AS (SELECT item_id, CASE WHEN item_id % 7 = 3 THEN ' ' ELSE array_to_string(string_split(text, ' ')[2:6], ' ') END AS keywords, item_id % 5 > 0 AS enabled FROM benchmark),
          t AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(keywords), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS terms FROM q),
          h AS (SELECT item_id, content, row_number() OVER (PARTITION BY item_id ORDER BY document_id * 1000 + chunk_index) AS n FROM v_pieces JOIN (
              SELECT item_id, doc_id AS document_id FROM benchmark JOIN documents ON contains(documents.text, benchmark.text)) USING (document_id) WHERE content <> '' AND item_id % 2 = 1 QUALIFY n <= 8),
          s AS (SELECT item_id, n, i, list[i] AS sentence FROM (SELECT item_id, n, list, unnest(range(1, len(list) + 1)) AS i FROM (SELECT item_id, n, list_filter(list_transform(regexp_split_to_array(content, '[.!?]\s+'), lambda x: trim(x)), lambda x: x <> '') AS list FROM h))),
          w AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(sentence), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS words FROM s),
          k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, n, i) AS k FROM (SELECT w.*, len(list_intersect(words, terms)) AS score FROM w JOIN t USING (item_id) WHERE trim(keywords) <> '' AND enabled) WHERE score > 0 QUALIFY k <= 20),
          u AS (SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM k b WHERE b.item_id = k.item_id AND b.k < k.k AND len(list_intersect(k.words, b.words)) * 2 >= len(k.words)) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY k) <= 3),
          m AS (SELECT item_id, string_agg(sentence || ' [' || n || '].', ' ' ORDER BY n, i) AS summary, list_sort(list_distinct(list(n::INTEGER))) AS citations FROM u GROUP BY item_id)
          SELECT item_id AS question_id, summary, coalesce(citations, []) AS citations, CASE WHEN trim(keywords) = '' THEN 'no_query' WHEN item_id NOT IN (SELECT item_id FROM h) THEN 'no_results' WHEN NOT enabled THEN 'disabled' WHEN summary IS NULL THEN 'no_results' END AS reason
          FROM t LEFT JOIN m USING (item_id)""")
def sum_03_summaries(spark, d):
    """A question of some words of each benchmark text, answered by the pieces of the documents that hold it."""
    items = table(spark, d, "benchmark")
    i, own = F.col("item_id"), F.array_join(F.slice(F.split("text", " "), 2, 5), " ")
    questions = items.select(i.alias("question_id"), F.when(i % 7 == 3, " ").otherwise(own).alias("keywords"), (i % 5 > 0).alias("enabled"))
    held = registry.phrase_holders(items, table(spark, d, "documents")).filter("item_id % 2 = 1").select(i.alias("question_id"), F.col("doc_id").alias("document_id"))
    hits = v.pieces(spark, d).join(held, "document_id").select("question_id", (F.col("document_id") * 1000 + F.col("chunk_index")).alias("rank"), "content")
    return summary.summaries(questions, hits)


@query("""SELECT c_custkey, key, CASE WHEN key = 'closed' OR s IS NULL OR s = 'null' OR (w IN ('true', 'false') AND s NOT IN ('true', 'false')) THEN w ELSE s END AS value FROM (
          SELECT c_custkey, unnest(['flag', 'name', 'limit', 'closed']) AS key, unnest(['true', '"x"', '5', '1']) AS w,
            unnest([['false', '"false"', '0', 'null', NULL][c_custkey % 5 + 1], CASE WHEN c_custkey % 2 = 0 THEN '"' || c_mktsegment || '"' END, ['7', 'true', '{"a":1}'][c_custkey % 3 + 1], '2']) AS s FROM customer)""")
def prj_10_overlay(spark, d):
    k = F.col("c_custkey")
    pick = lambda *values: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    given = {"flag": pick("false", '"false"', "0", "null", None), "name": F.when(k % 2 == 0, F.concat(F.lit('"'), "c_mktsegment", F.lit('"'))), "limit": pick("7", "true", '{"a":1}'), "closed": F.lit("2")}
    ours = {"flag": "true", "name": '"x"', "limit": "5", "closed": "1"}
    rows = table(spark, d, "customer").select("c_custkey", F.explode(F.array(*(F.struct(F.lit(n).alias("key"), F.lit(ours[n]).alias("own"), given[n].alias("stored")) for n in ours))).alias("s")).select("c_custkey", "s.*")
    defaults = rows.select("c_custkey", "key", F.parse_json("own").alias("value"))
    stored = rows.filter("stored IS NOT NULL").select("c_custkey", "key", F.parse_json("stored").alias("value"))
    return shape.overlay(defaults, stored, ["flag", "name", "limit"], by=["c_custkey"]).withColumn("value", F.to_json("value"))


@query("""SELECT doc_id, 'both' AS asked FROM documents WHERE source IN ('src2', 'src5') UNION ALL SELECT doc_id, 'none' FROM documents""")
def q_10_project_ids(spark, d):
    """Documents of two projects, one of them named by its id in the other registry; of no project in particular; of one that can't be read, which gives none."""
    projects = v.projects(spark, d).select("id", F.lpad(F.lower(F.hex(F.substring("id", 4, 9).try_cast("long"))), 24, "0").alias("external_id")).filter("id <> 'src9'")
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("project_id"))
    other = lambda n: f"{n:024X}"
    found = lambda ids, name: search.of_projects(docs, ids, projects).select("doc_id", F.lit(name).alias("asked"))
    both = found(search.project_ids({"project": other(2), "and[project]": "src5, src5"}), "both")
    return both.unionByName(found([], "none")).unionByName(found(["src5", other(9)], "lost")).unionByName(found(["src5", other(77)], "lost"))


@query(f"""SELECT 'area_' || s_name AS id, 'area' AS type, CASE WHEN s_suppkey % 4 = 1 THEN 'new ' || s_name ELSE s_name END AS name, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'C' || s_suppkey END AS code,
          CASE WHEN s_suppkey % 4 = 2 THEN s_suppkey % 8 = 2 ELSE s_suppkey % 5 > 0 END AS is_published, CASE WHEN CASE WHEN s_suppkey % 4 = 2 THEN s_suppkey % 8 = 2 ELSE s_suppkey % 5 > 0 END THEN list_concat(['public'], {_SECURE}) ELSE {_SECURE} END AS read,
          CASE WHEN s_suppkey % 4 IN (1, 2) THEN 'later' ELSE 'now' END AS updated_at FROM supplier WHERE s_suppkey % 7 > 0""")
def snk_26_boundaries(spark, d):
    """Boundaries of suppliers: created, some refused, some renamed or hidden, some deleted."""
    k, name = F.col("s_suppkey"), F.col("s_name")
    asked = table(spark, d, "supplier").select("s_suppkey", F.lit("area").alias("type"), F.when(k % 11 > 100, "").otherwise(name).alias("name"), F.when(k % 3 > 0, F.concat(F.lit("C"), k)).alias("code"), F.lit(None).cast("string").alias("geometry"), F.when(k % 5 == 0, False).alias("is_published"))
    made, _ = mutate.created_boundaries(asked.unionByName(asked.limit(1).withColumn("name", F.lit(""))), F.lit("now"))
    named = table(spark, d, "supplier").select(F.concat(F.lit("area_"), name).alias("id"), F.when(k % 4 == 1, F.concat(F.lit("new "), name)).alias("name"), F.when(k % 4 == 2, k % 8 == 2).alias("is_published"), k.alias("k"))
    changed = mutate.updated_boundaries(made, named.filter("k % 4 IN (1, 2)"), F.lit("later"))
    return mutate.delete(changed, named.filter("k % 7 = 0")).drop("geometry")


@query("""SELECT CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE 'F' || c_custkey END AS number, coalesce(CASE WHEN c_custkey % 3 > 0 THEN c_name END, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, CASE WHEN c_custkey % 10 > 0 THEN 'F' || c_custkey END) AS incident_name,
          CASE WHEN c_custkey % 4 = 0 THEN 'Unknown' ELSE 'Out' END AS fire_status, CASE WHEN c_custkey % 6 = 0 THEN 2026 ELSE 2025 END AS fire_year, c_custkey % 9 = 0 AS of_note,
          CASE WHEN c_custkey % 10 > 0 THEN (SELECT max(o_orderkey)::VARCHAR FROM orders WHERE o_custkey = c_custkey) END AS perimeter FROM customer""")
def snk_27_wildfires(spark, d):
    k = F.col("c_custkey")
    points = table(spark, d, "customer").select(
        F.when(k % 10 > 0, F.concat(F.lit("F"), k)).alias("fire_number"), F.when(k % 6 > 0, 2025).alias("fire_year"), F.when(k % 3 > 0, F.col("c_name")).alias("incident_name"), F.when(k % 2 == 0, F.col("c_mktsegment")).otherwise("").alias("geographic_description"),
        F.when(k % 4 == 0, "").otherwise("Out").alias("fire_status"), F.lit(None).cast("string").alias("fire_cause"), F.lit(None).cast("double").alias("current_size"), F.lit("").alias("fire_url"), F.when(k % 9 == 0, "Y").alias("fire_of_note"), k.alias("lng"), k.alias("lat"),
    )
    shapes = table(spark, d, "orders").select(F.concat(F.lit("F"), "o_custkey").alias("fire_number"), F.col("o_orderkey").alias("geometry"))
    rows = mutate.wildfires(points, shapes, F.lit("2026-03-01 00:00:00").cast("timestamp"))
    unnamed = F.col("id").startswith("UNKNOWN_")
    return rows.select(F.when(~unnamed, F.col("id")).alias("number"), F.when(F.col("incident_name") != F.col("id"), F.col("incident_name")).when(~unnamed, F.col("id")).alias("incident_name"), "fire_status", F.col("fire_year").cast("int").alias("fire_year"), "of_note", F.col("perimeter").cast("string").alias("perimeter"))


@query("""WITH r AS (SELECT p_type AS document_id, p_brand AS phrase, arg_max(p_size, p_partkey) AS rank FROM part WHERE p_partkey % 3 > 0 GROUP BY ALL),
          c AS (SELECT p_type AS document_id, count(*) AS chunk_count, max(p_partkey::VARCHAR) AS newest FROM part WHERE p_size % 2 = 0 GROUP BY 1)
          SELECT DISTINCT p_type AS document_id, p_brand AS phrase, coalesce(rank, 0)::INTEGER AS rank, coalesce(chunk_count, 0) AS chunk_count, newest AS newest_extracted_at, coalesce(newest > '5', false) AS stale
          FROM part LEFT JOIN r ON document_id = p_type AND phrase = p_brand LEFT JOIN c ON c.document_id = p_type""")
def jon_11_ranks(spark, d):
    parts = table(spark, d, "part")
    entry = F.struct(F.col("p_partkey"), F.col("p_type").alias("documentId"), F.col("p_brand").alias("phrase"), F.col("p_size").alias("rank"))
    report = parts.filter("p_partkey % 3 > 0").agg(F.array_sort(F.collect_list(entry)).alias("all"))  # a report is one record
    bare = F.transform("all", lambda x: F.struct(x["documentId"].alias("documentId"), x["phrase"].alias("phrase"), x["rank"].alias("rank")))
    ranks = readers.scorecard_rows(report.select(F.lit("5").alias("started"), bare.alias("results")))
    chunks = parts.filter("p_size % 2 = 0").select(F.col("p_type").alias("document_id"), F.col("p_partkey").cast("string").alias("extracted_at"))
    ranked = evaluate.with_ranks(parts.select(F.col("p_type").alias("document_id"), F.col("p_brand").alias("phrase")).distinct(), ranks, chunks)
    return ranked.withColumn("rank", F.coalesce("rank", F.lit(0)))


@query("""SELECT page_id, CASE WHEN poor IS NULL THEN 'text' WHEN page_id % 5 = 0 THEN 'skip' WHEN page_id % 3 = 0 THEN 'ocr-empty' ELSE 'ocr' END AS route, CASE WHEN page_id % 5 > 0 AND page_id % 3 = 0 THEN poor || '; OCR found no text' ELSE poor END AS reason FROM (
          SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 'probe failed' WHEN page_id % 4 = 0 THEN 'probe says text-poor' WHEN c < 500 AND page_id % 2 = 0 THEN 'low yield (' || c || ' chars from 292 KB)' END AS poor
          FROM (SELECT page_id, length(regexp_replace(left(html, CASE WHEN page_id % 6 = 0 THEN 100 ELSE 100000 END), '\\s+', '', 'g')) AS c FROM pages))""".replace("\\\\", "\\"))
def rou_07_outcome(spark, d):
    i = F.col("page_id")
    layer = F.when(i % 6 == 0, F.left("html", F.lit(100))).otherwise(F.left("html", F.lit(100_000)))
    size = F.when(i % 2 == 0, F.lit(300_000)).otherwise(F.lit(100_000))
    made = text.outcome(F.when(i % 11 > 0, F.lit(10)), F.when(i % 4 == 0, F.lit(0.0)).otherwise(F.lit(900.0)), F.lit(0.9), size, layer, F.when(i % 3 == 0, F.lit(" ")).otherwise(F.lit("read")), i % 5 > 0)
    return table(spark, d, "pages").select("page_id", made.alias("o")).select("page_id", "o.route", "o.reason")


@query("""SELECT l_orderkey, n::INTEGER AS n, range(0, n, greatest(n // 20, 1))::INTEGER[] AS probed, list_sort(list_distinct(list_transform(CASE WHEN n > 20 THEN range(0, 20) ELSE range(0, n) END, lambda i: CASE WHEN n > 20 THEN round_even(i * (n - 1) / 19.0, 0)::INTEGER ELSE i END))) AS spaced
          FROM (SELECT l_orderkey, (sum(l_quantity))::BIGINT AS n FROM lineitem GROUP BY 1)""")
def rou_02_probed_pages(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("int").alias("n"))
    return n.select("l_orderkey", "n", text.probed_pages(F.col("n")).alias("probed"), F.array_sort(text.evenly_probed_pages(F.col("n"))).alias("spaced"))


@query("""SELECT 'request' AS evt, 'GET' AS method, '/e/' || event_type AS path, (200 + user_id % 4 * 100)::INTEGER AS status, value::DOUBLE AS duration_ms, event_id AS bytes, '10.0.0.' || user_id % 9 AS ip,
          CASE WHEN user_id % 3 = 0 THEN 'anonymous' ELSE 'u' || user_id END AS principal, CASE WHEN user_id % 2 = 0 THEN 'k' || user_id END AS key_id, 'web' AS client, CASE WHEN user_id % 4 = 3 THEN 'error' WHEN user_id % 4 = 2 THEN 'warn' ELSE 'info' END AS level,
          'GET /e/' || event_type || '?q=50%25off ' || 200 + user_id % 4 * 100 || ' - ' || event_id || ' B - 7ms (IP: 10.0.0.' || user_id % 9 || ', as: ' || CASE WHEN user_id % 3 = 0 THEN 'anonymous' ELSE 'u' || user_id END
            || CASE WHEN user_id % 2 = 0 THEN ' key=k' || user_id ELSE ' client=web' END || ')' AS message FROM (SELECT event_id, event_type, user_id, 7 AS value FROM events)""")
def snk_30_request_rows(spark, d):
    u = F.col("user_id")
    rows = table(spark, d, "events").select(
        F.lit("GET").alias("method"), F.concat(F.lit("/e/"), "event_type", F.lit("?q=50%off")).alias("url"), (200 + u % 4 * 100).cast("int").alias("status"), F.lit(7).alias("duration_ms"), F.col("event_id").alias("bytes"),
        F.concat(F.lit("1.1.1.1, 10.0.0."), u % 9, F.lit(":443")).alias("forwarded"), F.lit("r").alias("remote"), F.when(u % 3 > 0, F.concat(F.lit("u"), u)).otherwise("").alias("user"), F.when(u % 2 == 0, F.concat(F.lit("k"), u)).alias("key_id"), F.lit("web").alias("client"),
    )
    return events.request_rows(rows)


@query("""SELECT id, CASE WHEN id % 4 = 0 THEN -125.0::DOUBLE ELSE lng END AS lng, CASE WHEN id % 4 = 0 THEN 54.0::DOUBLE ELSE lat END AS lat FROM v_places""")
def geo_06_points(spark, d):
    p = v.places(spark, d)
    stored = F.when(F.col("id") % 8 == 0, F.array(F.lit("west"), F.col("lat").cast("string"))).when(F.col("id") % 4 > 0, F.array(F.col("lng").cast("string"), F.col("lat").cast("string")))
    return p.select("id", geo.point_or_default(stored).alias("c")).select("id", F.col("c")[0].alias("lng"), F.col("c")[1].alias("lat"))
