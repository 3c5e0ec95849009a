"""Queries of sources, writes, shapes, functions, evaluation and incremental rules that need no view of their own."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslake.functions import scalars as fn
from corpuslake.operators import access as acl
from corpuslake.operators import evaluate, events, geo, mutate, registry, search, shape, text
from corpuslake.plans import views as v
from corpuslake.plans.views import query
from corpuslake.session import shared_folder
from corpuslake.sources import readers
from corpuslake.sources.readers import table
from corpuslake.streaming import streams

_SECURE = "['sysadmin', 'staff', 'admin', 'service']"


# Sources


@query("SELECT n_nationkey AS id, n_name AS name FROM nation")
def src_12_envelope(spark: SparkSession, d: str) -> DataFrame:
    item = F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    body = F.to_json(F.array(F.struct(F.array(item).alias("searchResults"))))
    return readers.envelope(table(spark, d, "nation").select(body.alias("body")), "body", "id:int,name:string")


@query("SELECT c_custkey, coalesce(r_name, 'none') AS label FROM customer LEFT JOIN region ON c_nationkey = r_regionkey")
def src_14_list_lookup(spark, d):
    lists = table(spark, d, "region").select(F.col("r_regionkey").alias("c_nationkey"), F.col("r_name").alias("label"))
    return shape.with_labels(table(spark, d, "customer"), lists, "c_nationkey", "label", "none").select("c_custkey", "label")


@query("SELECT doc_id, coalesce(text, '') AS text FROM documents")
def src_18_ndjson_ingest(spark, d):
    """A text as ingest lines and back: blocks are split at blank lines, of which these texts have none."""
    docs = table(spark, d, "documents")
    blocks = readers.ndjson_blocks(readers.ndjson_body(docs, "doc_id", "text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "block"))), lambda b: b["block"]), "\n\n")
    back = blocks.groupBy("doc_id").agg(joined.alias("text"))
    return docs.select("doc_id").join(back, "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text, count(*) AS pages, count(*) FILTER (trim(text) = '') AS empty_pages FROM conversations GROUP BY conv_id")
def src_20_page_text(spark, d):
    return readers.page_text(table(spark, d, "conversations"), "conv_id", "turn", "text")


@query("SELECT o_orderkey, o_orderkey::VARCHAR AS document_id FROM orders")
def src_23_queue_message(spark, d):
    o = table(spark, d, "orders")
    key = F.col("o_orderkey").cast("string")
    value = F.when(F.col("o_orderkey") % 2 == 0, F.to_json(F.struct(key.alias("documentId")))).otherwise(F.concat(F.lit(" "), key))
    parsed = readers.queue_ids(o.select(value.alias("value")))
    return parsed.select(F.col("document_id").cast("long").alias("o_orderkey"), "document_id")


@query("SELECT DISTINCT source AS key FROM documents WHERE trim(source) <> ''")
def src_24_key_file(spark, d):
    folder = f"{shared_folder(spark)}/corpuslake/keys-{uuid.uuid4().hex}"
    table(spark, d, "documents").select(F.concat(F.coalesce("source", F.lit("")), F.lit(" ")).alias("value")).write.text(folder)
    return readers.keys_of(spark, folder)


# Writes


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'conflict' ELSE 'ok' END AS status FROM customer WHERE c_custkey % 2 = 0")
def snk_03_replace_if_unchanged(spark, d):
    stored = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("e1").alias("etag"))
    changes = stored.filter("id % 2 = 0").withColumn("etag", F.when(F.col("id") % 3 == 0, "e0").otherwise("e1"))
    return mutate.replace_if_unchanged(stored, changes)


@query("SELECT o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 100 AS batch FROM orders")
def snk_04_batches(spark, d):
    turn = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return mutate.batches(table(spark, d, "orders"), turn).select("o_orderkey", F.col("batch").cast("long").alias("batch"))


@query("SELECT id FROM (SELECT document_id, document_id || '::p0::c' || chunk_index AS id, chunk_index FROM v_pieces) WHERE document_id % 2 = 0 AND chunk_index > 0")
def snk_07_surplus(spark, d):
    from corpuslake.operators.chunk import chunk_id

    stored = v.pieces(spark, d).select("document_id", "chunk_index", chunk_id(F.col("document_id"), F.lit(0), F.col("chunk_index")).alias("id"))
    keep = stored.filter("document_id % 2 = 0 AND chunk_index = 0")
    return mutate.surplus(stored, keep).select("id")


@query("SELECT id, len(read) AS n FROM v_projects")
def snk_08_required_acl(spark, d):
    return mutate.require_acl(v.projects(spark, d)).select("id", F.size("read").cast("long").alias("n"))


@query("SELECT d.id, CASE WHEN p.id IS NULL THEN d.is_published ELSE p.is_published END AS is_published FROM v_documents d LEFT JOIN v_projects p ON d.project_id = p.id")
def snk_09_cascade_acl(spark, d):
    return mutate.cascade_acl(v.documents(spark, d), v.projects(spark, d), "project_id").select("id", "is_published")


@query("SELECT id FROM v_projects WHERE is_published AND id < 'src2'")
def snk_10_closed_projects(spark, d):
    before = v.projects(spark, d)
    after = before.withColumn("is_published", F.col("is_published") & (F.col("id") >= "src2"))
    return mutate.closed_projects(before, after)


@query("SELECT document_id || '_p0_c' || chunk_index AS key FROM v_pieces")
def snk_13_export_key(spark, d):
    return v.pieces(spark, d).select(mutate.export_key(F.col("document_id"), F.lit(0), F.col("chunk_index")).alias("key"))


@query("""SELECT source AS name, count(*) AS source_rows, count(*) FILTER (source IN ('src0', 'src4') OR doc_id % 10 <> 0 AND source <> 'src2') AS target_rows,
          CASE WHEN count(*) FILTER (source IN ('src0', 'src4') OR doc_id % 10 <> 0 AND source <> 'src2') = count(*) THEN 'skip' ELSE 'copy' END AS action FROM documents WHERE source IS NOT NULL GROUP BY source""")
def snk_14_copy_reconciliation(spark, d):
    docs = table(spark, d, "documents").filter("source IS NOT NULL")
    return mutate.copy_counts(docs, docs.filter("source IN ('src0', 'src4') OR doc_id % 10 <> 0 AND source <> 'src2'"), "source")


@query("SELECT document_id, count(*) AS n FROM v_pieces WHERE document_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY document_id")
def snk_16_index_delete(spark, d):
    gone = table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("document_id"))
    return mutate.delete(v.pieces(spark, d), gone, "document_id").groupBy("document_id").agg(F.count("*").alias("n"))


@query("SELECT (SELECT count(*) FROM documents WHERE doc_id % 9 = 0) AS documents, (SELECT count(*) FROM v_pieces WHERE document_id % 9 = 0) AS chunks")
def snk_17_purge_report(spark, d):
    docs = v.documents(spark, d).withColumn("extraction_error", F.when(F.col("id") % 9 == 0, "worker timed out"))
    return mutate.purge(docs, v.pieces(spark, d), "timed out")["report"]


@query("""SELECT doc_id, doc_id % 4 <> 0 AND n_chars > 100 AS content_extracted, CASE WHEN doc_id % 4 = 0 THEN 'broken' END AS extraction_error,
          doc_id % 3 = 0 AND n_chars > 100 AS partial FROM documents""")
def snk_18_outcome(spark, d):
    docs = table(spark, d, "documents")
    chunks, error = F.when(F.col("n_chars") > 100, 1).otherwise(0), F.when(F.col("doc_id") % 4 == 0, "broken")
    out = docs.withColumn("o", mutate.extraction_outcome(chunks, error, F.lit(1), F.col("doc_id") % 3 == 0))
    return out.select("doc_id", "o.content_extracted", "o.extraction_error", "o.partial")


@query(f"SELECT s_suppkey AS id, s_suppkey % 2 = 0 AS is_published, CASE WHEN s_suppkey % 2 = 0 THEN list_concat(['public'], {_SECURE}) ELSE {_SECURE} END AS read FROM supplier WHERE s_suppkey % 5 <> 0")
def snk_20_create(spark, d):
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 5 == 0, " ").otherwise(F.col("s_name")).alias("name"), (F.col("s_suppkey") % 2 == 0).alias("is_published"))
    accepted, _ = mutate.validated(rows, ["name"])
    return mutate.created(accepted).select("id", "is_published", "read")


@query("SELECT id, CASE WHEN id IN ('src1', 'src3') THEN 'renamed' ELSE name END AS name FROM v_projects")
def snk_21_update_project(spark, d):
    p = v.projects(spark, d)
    changes = p.filter(F.col("id").isin("src1", "src3")).select("id", F.lit("renamed").alias("name"))
    return mutate.patch(p, changes, ["name"]).select("id", "name")


@query("""SELECT (SELECT count(*) FROM documents WHERE doc_id % 8 = 0) AS documents, (SELECT count(*) FROM v_pieces WHERE document_id % 8 = 0) AS chunks,
          (SELECT count(*) FROM documents WHERE doc_id % 8 = 0 AND n_chars > 500) AS document_index, (SELECT count(*) FROM v_pieces WHERE document_id % 8 = 0 AND chunk_index = 0) AS chunk_index,
          (SELECT count(*) FROM v_pieces WHERE document_id % 8 > 0 AND chunk_index = 0) AS kept""")
def snk_24_delete_counts(spark, d):
    docs, chunks = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "n_chars"), v.pieces(spark, d)
    after = mutate.deleted_documents(docs, chunks, docs.filter("n_chars > 500"), chunks.filter("chunk_index = 0"), docs.filter("id % 8 = 0").select("id"))
    return after["report"].join(after["chunk_index"].agg(F.count("*").alias("kept")), F.lit(True))


@query(f"""SELECT l_orderkey || '-' || l_linenumber AS id, 'src' || (l_suppkey % 30) AS project_id, l_returnflag AS name, p.is_published AND l_linenumber % 2 = 0 AS is_published,
          CASE WHEN p.is_published AND l_linenumber % 2 = 0 THEN list_concat(['public'], {_SECURE}) ELSE {_SECURE} END AS read, false AS content_extracted, 'now' AS created_at
          FROM lineitem JOIN v_projects p ON p.id = 'src' || (l_suppkey % 30) WHERE l_linenumber % 3 > 0""")
def snk_22_new_documents(spark, d):
    n = F.col("l_linenumber")
    asked = table(spark, d, "lineitem").select(F.concat("l_orderkey", F.lit("-"), n).alias("id"), F.concat(F.lit("src"), F.col("l_suppkey") % 30).alias("project_id"), F.when(n % 3 > 0, F.col("l_returnflag")).otherwise(" ").alias("name"), (n % 2 == 0).alias("is_published"))
    rows, _ = mutate.new_documents(asked, v.projects(spark, d), F.lit("now"))
    return rows


@query("SELECT id, name FROM v_projects WHERE is_published IS NOT TRUE")
def snk_25_delete_projects(spark, d):
    p = v.projects(spark, d)
    return mutate.delete(p, p.filter("is_published")).select("id", "name")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'unknown-role' WHEN c_custkey % 3 = 0 THEN 'unconfirmed' WHEN c_custkey % 5 = 0 THEN 'expired' ELSE 'ok' END AS status FROM customer")
def snk_28_issue_keys(spark, d):
    k = F.col("c_custkey")
    role = F.when(k % 4 == 0, "owner").when(k % 3 == 0, "admin").otherwise("reader")
    wanted = table(spark, d, "customer").select(k.alias("id"), F.array(role).alias("roles"), F.lit(False).alias("confirmed"), F.when(k % 5 == 0, 0).otherwise(2).alias("expires_at"), F.lit(1).alias("now"))
    return mutate.issue_keys(wanted, ["reader", "admin"], ["admin"])


# Shapes


@query("SELECT id, name AS displayName, is_published AS status FROM v_projects")
def prj_01_index_projection(spark, d):
    return shape.index_projection(v.projects(spark, d), {"id": "id", "displayName": "name", "status": "is_published"})


@query("""SELECT s_suppkey::VARCHAR AS id, CASE WHEN s_suppkey % 3 > 0 THEN 'x' || s_suppkey ELSE s_suppkey::VARCHAR END AS _id, CASE WHEN stored AND s_suppkey % 2 = 0 THEN 't' || s_suppkey ELSE s_suppkey::VARCHAR END AS track_id,
          CASE WHEN s_suppkey % 3 > 0 THEN 'x' || s_suppkey ELSE '' END AS external_id, CASE WHEN s_suppkey % 5 > 0 THEN s_name WHEN stored THEN 'Unnamed Project' ELSE 'shown ' || s_suppkey END AS name, CASE WHEN s_suppkey % 4 > 0 THEN 'Mines' ELSE 'Other' END AS sector,
          CASE WHEN stored AND s_suppkey % 7 > 0 THEN 'Closed' WHEN s_suppkey % 2 = 0 THEN 'Open' ELSE 'Active' END AS status, CASE WHEN s_suppkey % 6 > 0 THEN s_suppkey::DOUBLE ELSE -125.0 END AS lng,
          'British Columbia' AS region, 'No project description provided.' AS description, CASE WHEN stored THEN 'Proponent Organization' ELSE s_name END AS proponent,
          CASE WHEN s_suppkey % 8 = 1 THEN true WHEN s_suppkey % 8 = 2 THEN false WHEN s_suppkey % 8 = 3 THEN stored AND s_suppkey % 2 = 1 ELSE NOT stored OR s_suppkey % 2 = 1 END AS is_published, stored FROM supplier, (VALUES (true), (false)) b(stored)""")
def prj_04_project_hit(spark, d):
    """Both shapes of a project: from the index, and as it is stored."""
    k, name = F.col("s_suppkey"), F.col("s_name")
    read = F.when(k % 8 == 1, F.array(F.lit("public"))).when(k % 8 == 2, F.array(F.lit("staff"))).when(k % 8 == 3, F.array().cast("array<string>"))
    rows = table(spark, d, "supplier").select(
        k.alias("id"), F.when(k % 3 > 0, F.concat(F.lit("x"), k)).otherwise("").alias("external_id"), F.when(k % 2 == 0, F.concat(F.lit("t"), k)).alias("track_id"), F.when(k % 5 > 0, name).otherwise("").alias("name"), F.concat(F.lit("shown "), k).alias("display_name"),
        F.when(k % 4 > 0, "Mines").alias("sector"), F.when(k % 7 > 0, "Closed").otherwise("").alias("project_state"), F.when(k % 2 == 0, "Open").alias("status"), F.when(k % 6 > 0, F.array(k.cast("double"), F.lit(50.0))).alias("centroid"),
        F.lit("").alias("region"), F.lit(None).cast("string").alias("description"), name.alias("proponent"), F.lit("").alias("proponent_name"), read.alias("read"), (k % 2 == 1).alias("is_published"),
    )
    both = [shape.project_hits(rows, stored).withColumn("stored", F.lit(stored)) for stored in (True, False)]
    return both[0].unionByName(both[1]).withColumn("lng", F.col("centroid")[0]).drop("centroid")


@query("SELECT id, CASE WHEN name IS NOT NULL THEN name || '/' || id END AS ref FROM v_projects")
def prj_07_reference(spark, d):
    return v.projects(spark, d).withColumn("r", shape.reference(F.col("id"), F.col("name"))).select("id", F.concat("r.name", F.lit("/"), "r._id").alias("ref"))


@query("SELECT i.doc_id, i.lang, (SELECT count(*) FROM documents) AS count FROM (SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 500) i")
def prj_08_envelope(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    one = shape.envelope(search.keyword_page(docs, [F.asc("doc_id")], top=500), docs.agg(F.count("*").alias("count")), "doc_id")
    return one.select(F.explode("searchResults").alias("r"), "count").select("r.*", "count")


@query("SELECT doc_id, 'Scan Of ' || upper(source[1]) || source[2:] || ' Document' AS title FROM documents")
def prj_12_title(spark, d):
    return table(spark, d, "documents").select("doc_id", fn.title_from_file(F.concat(F.lit("scan-of_"), "source", F.lit(".pdf"))).alias("title"))


# Visibility and filters


@query("SELECT id, read IS NULL OR len(read) = 0 OR list_contains(read, 'public') AS public FROM v_documents")
def acl_15_merge_acl(spark, d):
    return v.documents(spark, d).select("id", F.array_contains(acl.merge_acl(F.col("read")), "public").alias("public"))


@query("SELECT c_custkey, c_custkey % 3 = 0 AS writes FROM customer")
def acl_16_write_gate(spark, d):
    roles = F.array(F.when(F.col("c_custkey") % 3 == 0, "staff").otherwise("public"))
    return table(spark, d, "customer").select("c_custkey", acl.can_write(roles).alias("writes"))


@query("SELECT c_custkey, c_custkey % 2 = 0 AND c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 AS valid FROM customer")
def acl_18_key_verify(spark, d):
    k = F.col("c_custkey")
    stored = F.sha2(F.when(k % 2 == 0, "secret").otherwise("other").cast("binary"), 256)
    revoked = F.when(k % 3 == 0, F.lit("2024-01-01"))
    expires = F.when(k % 5 == 0, "junk").otherwise("2030-01-01")
    return table(spark, d, "customer").select("c_custkey", acl.key_valid(F.lit("secret"), stored, revoked, expires, F.to_timestamp(F.lit("2024-06-01"))).alias("valid"))


@query("SELECT c_custkey, 'id' || c_custkey AS id, 'se_cret' AS secret FROM customer")
def acl_19_key_parse(spark, d):
    key = F.concat(F.lit("app_test_id"), F.col("c_custkey").cast("string"), F.lit("_se_cret"))
    return table(spark, d, "customer").withColumn("k", acl.parse_key(key)).select("c_custkey", "k.id", "k.secret")


@query("SELECT c_custkey AS id, c_nationkey::VARCHAR AS municipality FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 7")
def flt_02_project_criteria(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("source_system"), F.col("c_nationkey").cast("string").alias("municipality"))
    return rows.filter(search.project_criteria("BUILDING", municipality="7", regional_district=None)).select("id", "municipality")


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS flag FROM orders")
def flt_04_strict_boolean(spark, d):
    raw = F.when(F.col("o_orderkey") % 3 == 0, "true").when(F.col("o_orderkey") % 3 == 1, "false").otherwise("TRUE")
    return table(spark, d, "orders").select("o_orderkey", fn.strict_boolean(raw).alias("flag"))


# Ranking and evaluation


@query("SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50")
def rnk_05_rerank_set(spark, d):
    """A rerank permutes the first page: its set is what the first order gives."""
    ranked = table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    first = ranked.orderBy(F.desc("score"), "doc_id").limit(60)
    return search.rerank(first, -F.col("score"), "doc_id").limit(50).select("doc_id")


@query("SELECT item_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS html FROM benchmark")
def rnk_08_escaped(spark, d):
    return table(spark, d, "benchmark").select("item_id", search.balanced(F.col("text")).alias("html"))


@query("""SELECT source, greatest(count(*) - count(*) FILTER (doc_id % 3 = 0), least(count(*), 20)) AS total FROM documents WHERE source IS NOT NULL GROUP BY source""")
def agg_05_net_total(spark, d):
    """Per project: all hits, those that the gate withholds, and the rows of the first page."""
    hits = table(spark, d, "documents").filter("source IS NOT NULL").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("doc_id") % 3 == 0).alias("withheld"))
    return hits.select("source", search.net_total(F.col("n"), F.col("withheld"), F.least("n", F.lit(20).cast("long"))).alias("total"))


@query("""SELECT item_id, round(len(list_filter(w, lambda x: contains(t, x))) * 1.0 / len(w), 4) AS coverage FROM (SELECT item_id, lower(d.text) AS t,
          list_distinct(list_filter(regexp_split_to_array(lower(b.text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')[1:16]) AS w FROM benchmark b JOIN documents d ON item_id = doc_id) WHERE len(w) > 0""")
def agg_19_coverage(spark, d):
    """Terms of an item in the document of its number."""
    own = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.lower("text").alias("t"))
    words = F.array_distinct(text.tokenize(F.lower("text")))
    rows = table(spark, d, "benchmark").select("item_id", words.alias("w")).filter(F.size("w") > 0).join(own, "item_id")
    return rows.select("item_id", F.round(F.size(F.filter("w", lambda x: F.contains(F.col("t"), x))) / F.size("w"), 4).alias("coverage"))


@query("SELECT o_orderkey, o_custkey, max(o_orderdate) OVER (PARTITION BY o_custkey) > o_orderdate AS stale FROM orders")
def win_08_stale(spark, d):
    o = table(spark, d, "orders")
    made = o.select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("scored_at"))
    return evaluate.stale(made, o.select("o_custkey", F.col("o_orderdate").alias("extracted_at")), "o_custkey").select("o_orderkey", "o_custkey", "stale")


@query("SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 100")
def srt_03_newest_first(spark, d):
    return search.listing(table(spark, d, "customer"), "newest", "c_acctbal", "c_custkey", top=100).select("c_custkey")


@query("SELECT n_name AS name FROM nation ORDER BY n_name")
def srt_07_binary_name_order(spark, d):
    return search.listing(table(spark, d, "nation"), "name", "n_name", "n_nationkey").select(F.col("n_name").alias("name"))


# Routing and functions


@query("SELECT page_id, length(regexp_replace(regexp_replace(html, '(?i)<!--\\s*image\\s*-->', '', 'g'), '\\s+', '', 'g')) AS chars FROM pages")
def rou_04_real_chars(spark, d):
    return table(spark, d, "pages").select("page_id", text.real_chars(F.col("html")).alias("chars"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'image' WHEN 1 THEN 'other' WHEN 2 THEN 'unsupported' WHEN 3 THEN 'document' WHEN 4 THEN 'other' ELSE 'other' END AS kind FROM part""")
def rou_05_extension_class(spark, d):
    names = [".PNG", "pdf", "exe", "Md", "webp", "txt"]
    ext = F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", text.extension_class(ext).alias("kind"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 1 THEN 'source' WHEN 2 THEN 'document' WHEN 4 THEN 'document' ELSE 'runner' END AS fault FROM part")
def rou_06_fault_class(spark, d):
    messages = ["CUDA out of memory", "HTTP 404", "bad xref", "A process in the Process Pool was terminated abruptly", "timed out"]
    message = F.element_at(F.array(*map(F.lit, messages)), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", fn.fault_class(message).alias("fault"))


@query("""SELECT p_partkey, k::INTEGER AS tile, greatest(trunc((k % 3) * w / 3.0 - w / 3.0 * 0.06), 0)::INTEGER AS left, greatest(trunc((k // 3) * 500.0 - 500.0 * 0.06), 0)::INTEGER AS top,
            least(trunc((k % 3 + 1) * w / 3.0 + w / 3.0 * 0.06), w)::INTEGER AS right, least(trunc((k // 3 + 1) * 500.0 + 500.0 * 0.06), 1500)::INTEGER AS bottom
          FROM (SELECT p_partkey, p_size * 30 + 1005 AS w, unnest(range(9)) AS k FROM part)""")
def rou_08_tiles(spark, d):
    return table(spark, d, "part").select("p_partkey", F.posexplode(text.tiles(F.col("p_size") * 30 + 1005, F.lit(1500), 3)).alias("tile", "box")).select("p_partkey", "tile", "box.*")


@query("SELECT doc_id, 'store/' || source AS key FROM documents")
def fn_05_object_key(spark, d):
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("//"), "source")).otherwise(F.concat(F.lit("store/"), "source"))
    return table(spark, d, "documents").select("doc_id", fn.object_key(raw, "store/").alias("key"))


@query("SELECT c_custkey, '10.0.' || c_nationkey || '.7' AS ip, '10.0.x.x' AS masked FROM customer")
def fn_09_caller_ip(spark, d):
    own = F.concat(F.lit("10.0."), F.col("c_nationkey").cast("string"), F.lit(".7"))
    ip = fn.caller_ip(F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("1.2.3.4, "), own, F.lit(":443"))), own)
    return table(spark, d, "customer").select("c_custkey", ip.alias("ip"), fn.masked_ip(ip).alias("masked"))


@query("SELECT p_partkey, levenshtein(p_name, p_type) AS edits FROM part")
def fn_11_levenshtein(spark, d):
    return table(spark, d, "part").select("p_partkey", F.levenshtein("p_name", "p_type").cast("long").alias("edits"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def fn_16_day_key(spark, d):
    return table(spark, d, "events").select("event_id", events.day_key(F.col("ts")).alias("day"))


@query("SELECT o_orderkey, o_orderdate + INTERVAL 90 DAY AS expires FROM orders")
def fn_17_expiry(spark, d):
    return table(spark, d, "orders").select("o_orderkey", fn.expiry(F.col("o_orderdate")).alias("expires"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS price FROM orders")
def fn_19_to_number(spark, d):
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice").cast("string")).when(F.col("o_orderkey") % 3 == 0, " ").otherwise("1,5x")
    return table(spark, d, "orders").select("o_orderkey", fn.to_number(raw).alias("price"))


@query("SELECT user_id, CASE user_id % 4 WHEN 0 THEN 'api-key' WHEN 1 THEN 'service' WHEN 2 THEN 'user' ELSE 'anonymous' END AS actor, count(*) AS n FROM events GROUP BY ALL")
def fn_27_actor(spark, d):
    u = F.col("user_id") % 4
    actor = events.actor_class(u == 0, u <= 1, F.lit(False), u == 2, F.lit(None).cast("boolean"))
    return table(spark, d, "events").groupBy("user_id", actor.alias("actor")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'mobile' ELSE 'desktop' END AS device FROM customer")
def fn_28_device(spark, d):
    agent = F.when(F.col("c_custkey") % 2 == 0, "Mozilla (iPhone)").otherwise("Mozilla (X11)")
    return table(spark, d, "customer").select("c_custkey", events.device_class(agent).alias("device"))


@query("SELECT c_custkey, c_custkey % 3 = 1 AS has FROM customer")
def fn_29_has_value(spark, d):
    raw = F.when(F.col("c_custkey") % 3 == 0, " ").when(F.col("c_custkey") % 3 == 1, "x")
    return table(spark, d, "customer").select("c_custkey", registry.has_value(raw).alias("has"))


@query("SELECT id, CASE WHEN lng BETWEEN -139.5 AND -113.5 AND lat BETWEEN 47.5 AND 60.5 THEN lng ELSE -125.0 END AS lng FROM v_places")
def geo_05_parse_centroid(spark, d):
    p = v.places(spark, d)
    swapped = F.col("id") % 2 == 0
    a, b = F.when(swapped, F.col("lat")).otherwise(F.col("lng")), F.when(swapped, -F.col("lng")).otherwise(F.col("lat"))
    return p.withColumn("c", geo.parse_centroid(a.cast("string"), b.cast("string"))).select("id", "c.lng")


# Incremental rules on what is there; their streaming forms are in corpuslake.streaming


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'")
def str_01_high_water_mark(spark, d):
    return streams.since(table(spark, d, "events"), "2024-01-15 00:00:00", "ts").select("event_id")


@query("SELECT count(*) AS n FROM events WHERE ts > TIMESTAMP '2024-01-24 00:00:00'")
def str_03_time_to_live(spark, d):
    return streams.expired(table(spark, d, "events"), "2024-01-31 00:00:00", 7).agg(F.count("*").alias("n"))


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT CASE WHEN hour(ts) >= 3 THEN user_id || ':' || (day(ts) % 2 = 0 AND hour(ts) >= 12)::VARCHAR END) AS users,
          count(*) FILTER (hour(ts) < 3) AS unnamed FROM events GROUP BY 1""")
def str_08_daily_pseudonyms(spark, d):
    """Users counted by a pseudonym under the salt in force: one a day from three o'clock on, on even days another one from noon on."""
    rows, day = table(spark, d, "events"), F.date_trunc("day", "ts")
    hours = F.when(F.dayofmonth("day") % 2 == 0, F.array(F.lit(3), F.lit(12))).otherwise(F.array(F.lit(3)))
    salts = rows.select(day.alias("day")).distinct().select("day", F.explode(hours).alias("hour")).select((F.col("day") + F.make_dt_interval(F.lit(0), F.col("hour"))).alias("since"))
    named = events.with_pseudonyms(rows, salts.withColumn("salt", F.sha2(F.col("since").cast("string").cast("binary"), 256).cast("binary")))
    return named.groupBy(events.day_key(F.col("ts")).alias("day")).agg(F.countDistinct("pseudonym").alias("users"), F.count_if(F.col("pseudonym").isNull()).alias("unnamed"))
