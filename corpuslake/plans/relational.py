"""Queries of scans, visibility, joins, aggregations, sets and sorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslake.functions import scalars as fn
from corpuslake.operators import access as acl
from corpuslake.operators import chunk, evaluate, events, geo, mutate, registry, search, shape, text
from corpuslake.plans import views as v
from corpuslake.plans.views import query
from corpuslake.sources import readers

ANYONE = acl.Access()
SCOPED = acl.resolve_access(["project:src3", "project:src5"])
#: The visibility of ANYONE in SQL.
SEEN = "(coalesce(list_has_any(read, ['public']), false) OR ((read IS NULL OR len(read) = 0) AND is_published))"


def _t(name: str):
    return lambda spark, d: readers.table(spark, d, name)


@query(f"SELECT id, project_id, n_chars FROM v_documents WHERE {SEEN} AND n_chars > 500")
def src_01_container_scan(spark: SparkSession, d: str) -> DataFrame:
    return readers.scan(v.documents(spark, d), ANYONE, F.col("n_chars") > 500).select("id", "project_id", "n_chars")


@query(f"SELECT id FROM v_documents WHERE {SEEN} AND id > 100 ORDER BY id LIMIT 50")
def src_02_keyset_page(spark, d):
    return readers.keyset_page(readers.scan(v.documents(spark, d), ANYONE).select("id"), "id", 100, 50)


@query("SELECT doc_id, lang FROM documents WHERE lang = 'de' AND n_chars > 1000")
def src_03_parameterised(spark, d):
    _t("documents")(spark, d).createOrReplaceTempView("src_03_documents")
    return readers.parameterised(spark, "SELECT doc_id, lang FROM src_03_documents WHERE lang = :lang AND n_chars > :least", {"lang": "de", "least": 1000})


@query("SELECT doc_id, n_chars FROM documents WHERE source = 'src3'")
def src_04_partition_scan(spark, d):
    return _t("documents")(spark, d).filter(F.col("source") == "src3").select("doc_id", "n_chars")


@query(f"SELECT id, project_id FROM v_documents WHERE id = 63 AND {SEEN}")
def src_05_point_read(spark, d):
    return readers.scan(v.documents(spark, d), ANYONE, F.col("id") == 63).select("id", "project_id")


@query("SELECT id, name FROM v_projects WHERE lower(name) = 'project nation_3' LIMIT 1")
def src_06_alternate_key(spark, d):
    return v.projects(spark, d).filter(F.lower("name") == "project nation_3").limit(1).select("id", "name")


@query("SELECT DISTINCT doc_id AS id, source FROM documents WHERE doc_id IN (SELECT o_custkey FROM orders)")
def src_07_bulk_lookup(spark, d):
    ids = _t("orders")(spark, d).select(F.col("o_custkey").alias("id"))
    return readers.by_ids(_t("documents")(spark, d).select(F.col("doc_id").alias("id"), "source"), ids)


@query("SELECT id, lng, lat FROM v_projects WHERE lng BETWEEN -139.5 AND -113.5 AND lat BETWEEN 47.5 AND 60.5")
def src_08_with_centroid(spark, d):
    p = v.projects(spark, d).withColumn("c", geo.repaired(F.col("lng").cast("string"), F.col("lat").cast("string")))
    return p.filter("c IS NOT NULL").select("id", "c.lng", "c.lat")


@query("SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_regionkey = 1 ORDER BY name")
def src_09_by_type(spark, d):
    return _t("nation")(spark, d).filter("n_regionkey = 1").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")).orderBy("name")


@query("SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_name = 'FRANCE'")
def src_10_id_then_name(spark, d):
    n = _t("nation")(spark, d).select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return readers.first_of(n, [F.col("id").cast("string") == "FRANCE", F.col("name") == "FRANCE"], "id")


@query("SELECT id FROM v_documents WHERE NOT content_extracted AND id NOT IN (SELECT page_id FROM pages WHERE page_id IS NOT NULL)")
def src_22_worklist(spark, d):
    done = _t("pages")(spark, d).select(F.col("page_id").alias("id"))
    return readers.worklist(v.documents(spark, d).select("id", "content_extracted"), done).select("id")


@query(f"SELECT project_id, count(*) AS n FROM v_documents WHERE {SEEN} GROUP BY project_id")
def acl_04_read_clause(spark, d):
    return v.documents(spark, d).filter(acl.read_clause(ANYONE)).groupBy("project_id").agg(F.count("*").alias("n"))


@query("SELECT id FROM v_documents WHERE coalesce(list_has_any(read, ['public']), false) OR read IS NULL OR len(read) = 0")
def acl_05_unset_is_public(spark, d):
    return v.documents(spark, d).filter(acl.read_clause(ANYONE, unset_is_public=True)).select("id")


@query(f"SELECT id, project_id FROM v_documents WHERE {SEEN} AND project_id IN ('src3', 'src5')")
def acl_08_visibility(spark, d):
    return v.documents(spark, d).filter(acl.visible(SCOPED)).select("id", "project_id")


@query("SELECT id FROM v_documents WHERE list_has_any(read, ['public'])")
def acl_10_search_visibility(spark, d):
    return v.documents(spark, d).filter(acl.search_visible(ANYONE)).select("id")


@query("SELECT id FROM v_documents WHERE false")
def acl_06_empty_scope(spark, d):
    return v.documents(spark, d).filter(acl.visible(acl.resolve_access(["staff"], explicit=[]))).select("id")


@query(f"SELECT document_id, count(*) AS n FROM v_pieces WHERE document_id IN (SELECT id FROM v_documents WHERE {SEEN}) GROUP BY document_id")
def acl_12_parent_gate(spark, d):
    return acl.gate_by_parent(v.pieces(spark, d), v.documents(spark, d), "document_id", "id", ANYONE).groupBy("document_id").agg(F.count("*").alias("n"))


@query("""SELECT d.id, d.is_published AND p.is_published AS is_published, CASE WHEN d.is_published AND p.is_published THEN 5 ELSE 4 END AS roles
          FROM v_documents d JOIN v_projects p ON d.project_id = p.id""")
def acl_13_document_acl(spark, d):
    p = v.projects(spark, d).select(F.col("id").alias("project_id"), F.col("is_published").alias("parent"))
    shown, read = acl.document_acl(F.col("is_published"), F.col("parent"))
    return v.documents(spark, d).join(p, "project_id").select("id", shown.alias("is_published"), F.size(read).alias("roles"))


@query("SELECT id, CASE WHEN read IS NULL OR len(read) = 0 THEN 4 ELSE len(read) END AS n FROM v_documents")
def acl_14_seed_acl(spark, d):
    return v.documents(spark, d).select("id", F.size(acl.seed_acl(F.col("read"))).cast("long").alias("n"))


@query("SELECT count(*) AS n FROM documents WHERE lang IN ('de', 'fr') AND source IS NOT NULL AND n_chars = n_chars")
def flt_01_predicates(spark, d):
    return _t("documents")(spark, d).filter(acl.any_of(F.col("lang"), ["de", "fr"]) & F.col("source").isNotNull()).agg(F.count("*").alias("n"))


@query("SELECT id FROM v_documents WHERE project_id IN ('src0', 'src2') AND content_extracted = false")
def flt_03_document_criteria(spark, d):
    return v.documents(spark, d).filter(acl.any_of(F.col("project_id"), ["src0", "src2"]) & (F.col("content_extracted") == F.lit(False))).select("id")


@query("""SELECT p_partkey FROM part WHERE contains(lower(p_name), 'smll rig') OR list_bool_and([
            len(list_filter(regexp_split_to_array(lower(p_name), '\\s+'), lambda w: w <> '' AND (starts_with(w, t) OR levenshtein(w, t) <= CASE WHEN length(t) >= 5 THEN 2 ELSE 1 END))) > 0 FOR t IN ['smll', 'rig']])""")
def flt_07_fuzzy_match(spark, d):
    return _t("part")(spark, d).filter(search.fuzzy_match(F.col("p_name"), F.lit("smll rig"))).select("p_partkey")


@query("SELECT id FROM v_places WHERE lng BETWEEN -130 AND -120 AND lat BETWEEN 50 AND 55")
def flt_08_viewport(spark, d):
    return v.places(spark, d).filter(geo.in_view(F.col("lng"), F.col("lat"), -130, 50, -120, 55)).select("id")


@query("SELECT id FROM v_documents WHERE project_id IN (SELECT id FROM v_projects WHERE trim(sector) = 'Energy') AND content_extracted")
def flt_06_documents_of_matches(spark, d):
    wanted = v.projects(spark, d).filter(F.trim("sector") == "Energy").select(F.col("id").alias("project_id"))
    return v.documents(spark, d).filter("content_extracted").join(wanted, "project_id", "left_semi").select("id")


@query("SELECT id, name FROM v_projects WHERE contains(lower(name), 'n_1') OR contains(lower(id), 'n_1')")
def flt_09_typeahead(spark, d):
    return search.typeahead(v.projects(spark, d), " N_1 ").select("id", "name")


@query("SELECT time_bucket(INTERVAL 60 seconds, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def flt_10_rate_limit(spark, d):
    return events.rate_limited(_t("events")(spark, d), "event_type", limit=1)


@query("SELECT class, count(*) AS n FROM v_classes GROUP BY class")
def jon_01_registry_classes(spark, d):
    return registry.match_classes(v.left_registry(spark, d), v.right_registry(spark, d)).groupBy("class").agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN class = 'right-only' THEN 'right-' || right_id ELSE left_id::VARCHAR END AS id, class, coalesce(name, r_name) AS name, r_description AS description,
            coalesce(is_active, active_status) AS is_active, coalesce(public, true) OR public IS NULL OR NOT public AS is_published, r_sector AS sector FROM v_classes""")
def jon_01_registry_merge(spark, d):
    merged = registry.merge(v.left_registry(spark, d), v.right_registry(spark, d), fill=("sector",))
    return merged.select("id", "class", "name", "description", "is_active", "is_published", "sector")


@query("SELECT d.id, coalesce(p.name, 'Associated Project') AS project_name FROM v_documents d LEFT JOIN v_projects p ON d.project_id = p.id")
def jon_02_label_hydrate(spark, d):
    names = v.projects(spark, d).select(F.col("id").alias("project_id"), F.col("name").alias("project_name"))
    return shape.with_labels(v.documents(spark, d), names, "project_id", "project_name", shape.NO_PROJECT).select("id", "project_name")


@query(f"""SELECT c.document_id, c.chunk_index, d.type, p.name AS project_name FROM v_pieces c JOIN v_documents d ON c.document_id = d.id
           LEFT JOIN v_projects p ON d.project_id = p.id WHERE {SEEN.replace('read', 'd.read').replace('is_published', 'd.is_published')}""")
def jon_03_gated_chunks(spark, d):
    docs = readers.scan(v.documents(spark, d), ANYONE).select(F.col("id").alias("document_id"), "type", "project_id")
    names = v.projects(spark, d).select(F.col("id").alias("project_id"), F.col("name").alias("project_name"))
    chunks = v.pieces(spark, d).select("document_id", "chunk_index").join(docs, "document_id").join(names, "project_id", "left")
    return chunks.select("document_id", "chunk_index", "type", "project_name")


@query("""SELECT id, project_id FROM v_documents WHERE project_id IN (SELECT id FROM v_projects WHERE contains(name, 'n_') ORDER BY id LIMIT 25)""")
def jon_04_fanout(spark, d):
    return search.fan_out(v.documents(spark, d), v.projects(spark, d).filter(F.contains("name", F.lit("n_"))), [F.asc("id")]).select("id", "project_id")


@query("""SELECT p.id, count(f.lat) AS fires, round(min(km), 1) AS nearest_km, count(*) FILTER (f.of_note) AS of_note FROM v_places p LEFT JOIN (
            SELECT p.id, f.*, 2 * 6371.0 * atan2(sqrt(a), sqrt(1.0 - a)) AS km FROM (SELECT p.id, f.*, pow(sin(radians(f.lat - p.lat) / 2), 2)
              + cos(radians(p.lat)) * cos(radians(f.lat)) * pow(sin(radians(f.lng - p.lng) / 2), 2) AS a FROM v_places p, v_fires f WHERE status <> 'Out') f JOIN v_places p USING (id)) f
          ON p.id = f.id AND km <= 50 GROUP BY p.id""")
def jon_05_proximity(spark, d):
    return geo.near(v.places(spark, d), v.fires(spark, d))


@query("""SELECT id, CASE WHEN lng > -131 AND lng < -125 AND lat > 50 AND lat < 53 THEN 'west' ELSE 'north' END AS area FROM v_places
          WHERE (lng > -131 AND lng < -125 AND lat > 50 AND lat < 53) OR (lng > -124 AND lng < -118 AND lat > 54 AND lat < 58)""")
def jon_06_containment(spark, d):
    box = lambda a, b, c, e: [[a, c], [b, c], [b, e], [a, e], [a, c]]
    areas = spark.createDataFrame([("west", box(-131.001, -125.001, 50.001, 52.999)), ("north", box(-123.999, -118.001, 54.001, 57.999))], "area string, ring array<array<double>>")
    return geo.within(v.places(spark, d), areas)


@query("""SELECT o_orderkey, coalesce(a.id, b.id) AS project FROM orders LEFT JOIN v_projects a ON 'src' || (o_custkey % 40) = a.id
          LEFT JOIN (SELECT id, name FROM v_projects WHERE name IS NOT NULL) b ON 'src' || (o_custkey % 40) = b.name""")
def jon_07_resolve_either(spark, d):
    refs = _t("orders")(spark, d).select("o_orderkey", F.concat(F.lit("src"), F.col("o_custkey") % 40).alias("ref"))
    p = v.projects(spark, d).withColumn("key", F.col("id"))
    return registry.resolve_either(refs, p, "ref", "key", "name").select("o_orderkey", "project")


@query("SELECT count(*) AS n FROM documents WHERE source NOT IN (SELECT id FROM v_projects)")
def jon_08_unresolvable(spark, d):
    p = v.projects(spark, d).select(F.col("id").alias("source"))
    return _t("documents")(spark, d).join(p, "source", "left_anti").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, coalesce(n_name, c_nationkey::VARCHAR) AS label FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) ON c_nationkey = n_nationkey")
def jon_09_decode(spark, d):
    lookup = _t("nation")(spark, d).filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label"))
    return registry.decoded(_t("customer")(spark, d), lookup, "c_nationkey", "label").select("c_custkey", "label")


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def jon_10_last_wins(spark, d):
    return registry.last_wins(_t("orders")(spark, d), "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey")


@query("SELECT item_id, count(doc_id) AS documents, coalesce(min(doc_id), -1) AS first_document FROM benchmark LEFT JOIN documents ON contains(documents.text, benchmark.text) GROUP BY item_id")
def jon_12_phrase_containment(spark, d):
    items = _t("benchmark")(spark, d)
    hits = registry.phrase_holders(items, _t("documents")(spark, d))
    found = hits.groupBy("item_id").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_document"))
    out = items.select("item_id").join(found, "item_id", "left")
    return out.select("item_id", F.coalesce("documents", F.lit(0).cast("long")).alias("documents"), F.coalesce("first_document", F.lit(-1).cast("long")).alias("first_document"))


@query(f"SELECT (SELECT count(*) FROM v_documents WHERE {SEEN}) AS documents, (SELECT count(*) FROM v_projects WHERE is_published) AS projects, (SELECT count(*) FROM events) AS events")
def agg_02_counts(spark, d):
    rows = [readers.scan(v.documents(spark, d), ANYONE).agg(F.count("*").alias("documents")), v.projects(spark, d).filter("is_published").agg(F.count("*").alias("projects")), _t("events")(spark, d).agg(F.count("*").alias("events"))]
    return rows[0].join(rows[1], F.lit(True)).join(rows[2], F.lit(True))


@query("""SELECT trim(sector) AS value, count(*) AS n FROM v_projects WHERE trim(sector) <> '' GROUP BY 1 UNION ALL SELECT 'Forestry', 0 UNION ALL SELECT 'all', count(*) FROM v_projects""")
def agg_03_facets(spark, d):
    return search.facet(v.projects(spark, d), "sector", selected=["Energy", "Forestry"])


@query("""WITH a AS (SELECT doc_id FROM documents WHERE contains(text, 'the')), b AS (SELECT doc_id FROM documents WHERE source IN ('src1', 'src2'))
          SELECT (SELECT count(*) FROM a)::BIGINT AS direct, (SELECT count(*) FROM b)::BIGINT AS by_project, (SELECT count(*) FROM a JOIN b USING (doc_id)) AS overlap,
                 (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS total""")
def agg_04_two_leg_total(spark, d):
    docs = _t("documents")(spark, d)
    return search.total_of(docs.filter(F.contains("text", F.lit("the"))).select("doc_id"), docs.filter(F.col("source").isin("src1", "src2")).select("doc_id"), "doc_id")


@query("""WITH p AS (SELECT doc_id % 7 AS label, doc_id, row_number() OVER (PARTITION BY doc_id % 7 ORDER BY n_chars DESC, doc_id) AS pos FROM documents),
          r AS (SELECT label, CASE WHEN max(pos) <= 50 THEN max(pos) ELSE 0 END AS rank FROM p WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY label)
          SELECT count(*) AS scored, 0::BIGINT AS errored, round(avg(CASE WHEN rank BETWEEN 1 AND 1 THEN 1.0 ELSE 0.0 END), 4) AS recall_1, round(avg(CASE WHEN rank BETWEEN 1 AND 5 THEN 1.0 ELSE 0.0 END), 4) AS recall_5,
            round(avg(CASE WHEN rank BETWEEN 1 AND 10 THEN 1.0 ELSE 0.0 END), 4) AS recall_10, round(avg(CASE WHEN rank BETWEEN 1 AND 20 THEN 1.0 ELSE 0.0 END), 4) AS recall_20,
            round(avg(CASE WHEN rank BETWEEN 1 AND 50 THEN 1.0 ELSE 0.0 END), 4) AS recall_50, round(avg(CASE WHEN rank > 0 THEN 1.0 / rank ELSE 0 END), 4) AS mrr FROM r""")
def agg_07_recall_mrr(spark, d):
    turn = Window.partitionBy("label").orderBy(F.desc("n_chars"), "doc_id")
    ranked = _t("documents")(spark, d).withColumn("label", F.col("doc_id") % 7).withColumn("pos", F.row_number().over(turn)).select("label", "doc_id", "pos")
    toxic = _t("labels")(spark, d).filter("toxic = 1").select("doc_id")
    last = ranked.join(toxic, "doc_id", "left_semi").groupBy("label").agg(F.max("pos").alias("pos"))
    return evaluate.summarize(last.select("label", F.when(F.col("pos") <= 50, F.col("pos")).otherwise(0).alias("rank"), F.lit(None).cast("string").alias("error")))


@query("""SELECT item_id, doc_id, coalesce(rank, 0)::INTEGER AS rank FROM (SELECT item_id, item_id * 3 AS doc_id FROM benchmark) l LEFT JOIN
          (SELECT doc_id % 10 AS g, doc_id, row_number() OVER (PARTITION BY doc_id % 10 ORDER BY n_chars, doc_id) AS rank FROM documents) r USING (doc_id)""")
def agg_08_document_rank(spark, d):
    items = search.rank_in(_t("documents")(spark, d).select((F.col("doc_id") % 10).alias("g"), "doc_id", "n_chars"), "g", [F.col("n_chars"), F.col("doc_id")])
    own = items.select((F.col("doc_id") / 3).cast("long").alias("item_id"), "doc_id", "rank").filter("doc_id % 3 = 0")
    wanted = _t("benchmark")(spark, d).select("item_id", (F.col("item_id") * 3).alias("doc_id"))
    return evaluate.document_rank(own, wanted, "item_id", "doc_id", "rank")


@query("SELECT lang, count(*) FILTER (quality = 1) AS hit, count(*) FILTER (quality = 0) AS miss, count(*) FILTER (quality IS NULL) AS unknown FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def agg_10_cross_tab(spark, d):
    kind = F.when(F.col("quality") == 1, "hit").when(F.col("quality") == 0, "miss").otherwise("unknown")
    rows = _t("documents")(spark, d).select("doc_id", "lang").join(_t("labels")(spark, d), "doc_id", "left").withColumn("kind", kind)
    return evaluate.cross_tab(rows, "lang", "kind", ["hit", "miss", "unknown"])


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS events, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL")
def agg_11_hourly_rollup(spark, d):
    return events.hourly_rollup(_t("events")(spark, d), ["event_type"])


@query("""WITH h AS (SELECT date_trunc('hour', ts) AS hour, sum(value) AS used FROM events GROUP BY 1), w AS (SELECT hour - to_hours(k) AS start, used FROM h, range(24) t(k))
          SELECT start, start + INTERVAL 1 DAY AS stop, round(sum(used), 4) AS used FROM w GROUP BY start HAVING round(sum(used), 4) > 0.8 * 20000""")
def agg_12_quota_alert(spark, d):
    return events.quota_alert(_t("events")(spark, d), quota=20000)


@query("SELECT time_bucket(INTERVAL 15 minutes, ts) AS start, count(*) AS n FROM events WHERE contains(event_type, 'error') GROUP BY 1")
def agg_13_log_alert(spark, d):
    return events.log_alert(_t("events")(spark, d), F.contains("event_type", F.lit("error")))


@query("""SELECT count(*) FILTER (class = 'matched') AS matched, count(*) FILTER (class = 'no-guid') AS no_guid, count(*) FILTER (class = 'dangling') AS dangling,
          count(*) FILTER (class = 'right-only') AS right_only, count(*) AS total, (SELECT list(guid ORDER BY guid) FROM (SELECT guid FROM v_classes WHERE class = 'dangling' ORDER BY guid LIMIT 20)) AS dangling_guids FROM v_classes""")
def agg_14_reconciliation(spark, d):
    return registry.reconciliation(registry.match_classes(v.left_registry(spark, d), v.right_registry(spark, d)))


@query("""SELECT 'synthetic-ids' AS rule, count(*) FILTER (c_custkey >= 1000) AS broken FROM customer UNION ALL SELECT 'duplicate-names', count(*) FILTER (n > 20) FROM (SELECT count(*) AS n FROM customer GROUP BY c_mktsegment)
          UNION ALL SELECT 'duplicate-ids', coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey) UNION ALL SELECT 'missing-acl', count(*) FILTER (c_custkey % 6 = 0) FROM customer
          UNION ALL SELECT 'mirror-drift', count(*) FILTER ((c_custkey % 6 <> 0) <> (c_custkey % 2 = 0)) FROM customer""")
def agg_15_gates(spark, d):
    c = _t("customer")(spark, d)
    read = F.when(F.col("c_custkey") % 6 != 0, F.array(F.lit("public")))
    rows = c.select(F.col("c_nationkey").alias("id"), F.col("c_mktsegment").alias("name"), F.col("c_custkey").alias("number"), read.alias("read"), (F.col("c_custkey") % 2 == 0).alias("is_published"))
    return registry.gates(rows, synthetic=1000)


@query("SELECT l_suppkey, round(median(l_quantity), 3) AS median_chars, round(avg((l_quantity > 25)::INTEGER), 3) AS share FROM lineitem GROUP BY l_suppkey")
def agg_16_probe_stats(spark, d):
    return evaluate.probe_stats(_t("lineitem")(spark, d), "l_suppkey", "l_quantity", floor=25)


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def agg_17_write_report(spark, d):
    return mutate.write_report(_t("orders")(spark, d).select(F.col("o_orderstatus").alias("status")))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN round((o_orderkey * 0.15 + o_custkey * 0.6) / 1e6, 9) END AS cost FROM orders")
def agg_18_cost(spark, d):
    prompt = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey"))
    return _t("orders")(spark, d).select("o_orderkey", F.round(events.cost(prompt, F.col("o_custkey"), 0.15, 0.6), 9).alias("cost"))


@query("SELECT coalesce(sum(n - 1), 0)::BIGINT AS duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey)")
def agg_20_duplicates(spark, d):
    return evaluate.duplicates(_t("lineitem")(spark, d), ["l_orderkey", "l_partkey"])


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders")
def win_01_rank(spark, d):
    return search.rank_in(_t("orders")(spark, d), "o_custkey", [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"))


@query("""SELECT document_id, chunk_index, right(lag(content) OVER (PARTITION BY document_id ORDER BY chunk_index), 200) AS carry FROM v_pieces""")
def win_03_carry(spark, d):
    return chunk.with_carry(v.pieces(spark, d)).select("document_id", "chunk_index", "carry")


@query("SELECT document_id, chunk_index FROM v_pieces QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) <= 2")
def win_04_first_chunks(spark, d):
    return evaluate.first_chunks(v.pieces(spark, d), "document_id", 2).select("document_id", "chunk_index")


@query("""WITH l AS (SELECT source, doc_id, i, trim(list[i]) AS line FROM (SELECT source, doc_id, list, unnest(range(1, len(list) + 1)) AS i FROM (SELECT source, doc_id, string_split(text, chr(10)) AS list FROM documents))),
          f AS (SELECT source, line, min(doc_id * 100000 + i) AS pos FROM l WHERE line <> '' GROUP BY ALL) SELECT source, sha256(string_agg(line, chr(10) || chr(10) ORDER BY pos)) AS digest, count(*) AS n_lines FROM f GROUP BY source""")
def win_06_distinct_lines(spark, d):
    """Documents as overlapping tiles of their source: every line once, where it came first."""
    tiles = _t("documents")(spark, d).select("source", "doc_id", "text")
    made = text.tiled_text(tiles, "source", "doc_id")
    return made.select("source", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.size(F.split("text", "\n\n")).cast("long").alias("n_lines"))


@query("""WITH i AS (SELECT *, sum((event_type <> 'error')::INTEGER) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM events)
          SELECT event_id, CASE WHEN event_type = 'error' THEN sum((event_type = 'error')::INTEGER) OVER (PARTITION BY user_id, island ORDER BY event_id) ELSE 0 END::BIGINT AS streak FROM i""")
def win_07_streaks(spark, d):
    e = evaluate.streaks(_t("events")(spark, d), F.col("event_type") == "error", "event_id", "user_id")
    return e.select("event_id", F.col("streak").cast("long").alias("streak"))


@query("SELECT id, name FROM v_projects WHERE name IS NOT NULL ORDER BY name, id")
def srt_01_name_order(spark, d):
    return search.listing(v.projects(spark, d).select("id", "name"), "name", "name", "id")


@query("SELECT user_id, avg((event_type = 'error')::INTEGER) AS garbage_share FROM events GROUP BY user_id ORDER BY garbage_share DESC, user_id LIMIT 40")
def srt_05_worst(spark, d):
    audited = _t("events")(spark, d).groupBy("user_id").agg(F.avg((F.col("event_type") == "error").cast("int")).alias("garbage_share"))
    return evaluate.worst(audited, "user_id", 40)


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber % 3, l_linenumber)::INTEGER AS place FROM lineitem")
def srt_04_reading_order(spark, d):
    rows = _t("lineitem")(spark, d).select("l_orderkey", "l_linenumber", (F.col("l_linenumber") % 3).alias("chunk_index"), F.col("l_linenumber").alias("page_number"))
    return chunk.reading_order(rows, "l_orderkey").select("l_orderkey", "l_linenumber", "place")


@query("SELECT doc_id, lang FROM documents WHERE (lang = 'de') AND (n_chars > 1000 OR source = 'src3')")
def acl_07_joined_conditions(spark, d):
    _t("documents")(spark, d).createOrReplaceTempView("acl_07_documents")
    both = acl.joined(acl.Fragment("lang = :lang", {"lang": "de"}), acl.Fragment("true"), None, acl.Fragment("n_chars > :least OR source = :own", {"least": 1000, "own": "src3"}))
    return readers.parameterised(spark, f"SELECT doc_id, lang FROM acl_07_documents WHERE {both.clause}", both.params)


@query("SELECT doc_id FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 1000) ORDER BY doc_id LIMIT 1000 OFFSET 950")
def q_13_list_page(spark, d):
    return search.list_page(_t("documents")(spark, d).select("doc_id"), [F.asc("doc_id")], size=200, skip=950)


@query("""SELECT field, value, count(*) AS n FROM (SELECT 'lang' AS field, lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents) WHERE value <> '' GROUP BY ALL""")
def q_15_facets(spark, d):
    fields = {"lang": search.FieldSpec("lang", facetable=True), "source": search.FieldSpec("source", facetable=True), "text": search.FieldSpec("text")}
    return search.facets(_t("documents")(spark, d), fields, ["lang", "source"])


@query("SELECT doc_id, lang FROM documents WHERE doc_id % 7 = 1 AND doc_id < 400 AND source IN ('src1', 'src3')")
def q_07_aliases(spark, d):
    """Fields by their names on the wire."""
    fields = {"id": search.FieldSpec("doc_id", "int"), "project_id": search.FieldSpec("source")}
    asked = {"_id": ",".join(map(str, range(1, 400, 7))), "project": ["src1", "src3"]}
    return _t("documents")(spark, d).filter(search.build_filter(asked, fields, F.lit(True), search.ALIASES["Document"]).predicate).select("doc_id", "lang")


@query("""WITH s AS (SELECT o_orderkey, (1 + o_orderkey * 1831565813) % 4294967296 AS v FROM orders),
          m AS (SELECT o_orderkey, v, xor(v, v >> 15) AS x, v | 1 AS y FROM s), a AS (SELECT o_orderkey, ((x & 65535) * y + (((x >> 16) * (y & 65535)) & 65535) * 65536) & 4294967295 AS t FROM m),
          b AS (SELECT o_orderkey, t, xor(t, t >> 7) AS x, t | 61 AS y FROM a),
          c AS (SELECT o_orderkey, xor(t, (t + (((x & 65535) * y + (((x >> 16) * (y & 65535)) & 65535) * 65536) & 4294967295)) & 4294967295) AS t FROM b)
          SELECT o_orderkey, round(xor(t, t >> 14) / 4294967296.0, 9) AS draw FROM c""")
def srt_06_seeded_draw(spark, d):
    return _t("orders")(spark, d).select("o_orderkey", F.round(evaluate.draw(F.col("o_orderkey"), 1), 9).alias("draw"))


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def srt_08_offset_page(spark, d):
    return search.page(_t("orders")(spark, d), [F.desc("o_totalprice"), F.asc("o_orderkey")], 20, 40).select("o_orderkey")


@query("""SELECT doc_id, min(leg)::INTEGER AS leg FROM (SELECT doc_id, 0 AS leg FROM documents WHERE contains(text, 'the') UNION ALL SELECT doc_id, 1 FROM documents WHERE source IN ('src1', 'src2')) GROUP BY doc_id""")
def set_01_two_legs(spark, d):
    docs = _t("documents")(spark, d)
    return search.two_legs(docs.filter(F.contains("text", F.lit("the"))).select("doc_id"), docs.filter(F.col("source").isin("src1", "src2")).select("doc_id"), "doc_id")


@query("SELECT source, min(doc_id) AS first FROM documents GROUP BY source")
def set_02_distinct(spark, d):
    return search.first_seen(_t("documents")(spark, d), "source", "doc_id")


@query("SELECT s_suppkey AS id FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 45 AND l_suppkey % 4 > 0)")
def set_04_difference(spark, d):
    keep = _t("lineitem")(spark, d).filter("l_quantity > 45 AND l_suppkey % 4 > 0").select(F.col("l_suppkey").alias("id"))
    return mutate.delete(_t("supplier")(spark, d).select(F.col("s_suppkey").alias("id")), keep)


@query("SELECT c_custkey AS id, CASE WHEN o.k IS NULL THEN c_name ELSE upper(c_name) END AS name FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders) o ON k = c_custkey")
def snk_01_upsert(spark, d):
    old = _t("customer")(spark, d).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    fresh = old.join(_t("orders")(spark, d).select(F.col("o_custkey").alias("id")), "id", "left_semi").withColumn("name", F.upper("name"))
    return mutate.upsert(old, fresh)


@query("SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN 0.0 ELSE s_acctbal END AS balance FROM supplier")
def snk_02_patch(spark, d):
    old = _t("supplier")(spark, d).select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return mutate.patch(old, old.filter("id % 3 = 0").select("id", F.lit(0.0).alias("balance")), ["balance"])


@query("""SELECT document_id, document_id || '::p0::c' || chunk_index AS id, CASE WHEN document_id % 5 = 0 THEN CASE WHEN chunk_index > 0 THEN 'delete' ELSE 'noop' END WHEN document_id % 5 = 1 THEN 'upsert' ELSE 'noop' END AS op
          FROM v_pieces WHERE document_id % 5 < 3""")
def snk_06_replace_plan(spark, d):
    from corpuslake.operators.chunk import chunk_id, replace_plan

    stored = v.pieces(spark, d).withColumn("id", chunk_id(F.col("document_id"), F.lit(0), F.col("chunk_index")))
    fresh = stored.filter("document_id % 5 < 3 AND NOT (document_id % 5 = 0 AND chunk_index > 0)")
    fresh = fresh.withColumn("content", F.when(F.col("document_id") % 5 == 1, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return replace_plan(stored, fresh)


@query("SELECT d.id, CASE WHEN NOT coalesce(p.is_published, false) THEN 'conflict' ELSE 'ok' END AS status, CASE WHEN NOT coalesce(p.is_published, false) THEN d.is_published ELSE true END AS is_published FROM v_documents d LEFT JOIN v_projects p ON d.project_id = p.id")
def snk_11_publish(spark, d):
    return mutate.publish(v.documents(spark, d), v.projects(spark, d), F.lit(True))


@query("SELECT p_partkey AS key, CASE WHEN p_partkey % 2 = 0 THEN 'skip' ELSE 'copy' END AS action FROM part")
def snk_15_copy_plan(spark, d):
    src = _t("part")(spark, d).select(F.col("p_partkey").alias("key"), F.col("p_size").alias("size"))
    return mutate.copy_plan(src, src.filter("key % 4 <> 3").withColumn("size", F.when(F.col("key") % 2 == 0, F.col("size")).otherwise(F.col("size") + 1)))


@query("SELECT c_custkey, rtrim(translate(base64(encode(c_name)), '+/', '-_'), '=') || (length(base64(encode(c_name))) - length(rtrim(base64(encode(c_name)), '='))) AS key FROM customer")
def snk_19_index_key(spark, d):
    return _t("customer")(spark, d).select("c_custkey", mutate.index_key(F.col("c_name")).alias("key"))


@query("SELECT page_id, split_part(url, '?', 1) AS path FROM pages")
def fn_08_path(spark, d):
    return _t("pages")(spark, d).select("page_id", fn.log_path(F.col("url")).alias("path"))


@query("SELECT doc_id, sha256(source) AS digest FROM documents")
def fn_25_sha256(spark, d):
    return _t("documents")(spark, d).select("doc_id", F.sha2(F.col("source").cast("binary"), 256).alias("digest"))


@query("SELECT c_custkey, greatest(1, least(1000, c_nationkey * 60)) AS size FROM customer")
def fn_20_clamp(spark, d):
    return _t("customer")(spark, d).select("c_custkey", fn.clamp(F.col("c_nationkey") * 60, 1, 1000, 1000).alias("size"))


@query("SELECT id, CASE WHEN lng BETWEEN -139.5 AND -113.5 AND lat BETWEEN 47.5 AND 60.5 THEN lng END AS lng, CASE WHEN lng BETWEEN -139.5 AND -113.5 AND lat BETWEEN 47.5 AND 60.5 THEN lat END AS lat FROM v_places")
def geo_01_repair(spark, d):
    flipped = v.places(spark, d).withColumn("x", F.when(F.col("id") % 2 == 0, -F.col("lng")).otherwise(F.col("lng")).cast("string"))
    return flipped.withColumn("c", geo.repaired(F.col("x"), F.col("lat").cast("string"))).select("id", "c.lng", "c.lat")


@query("""SELECT id, round(2 * 6371.0 * atan2(sqrt(a), sqrt(1.0 - a)), 3) AS km FROM (SELECT id, pow(sin(radians(49.0::DOUBLE - lat) / 2), 2) + cos(radians(lat)) * cos(radians(49.0::DOUBLE)) * pow(sin(radians(-123.0::DOUBLE - lng) / 2), 2) AS a FROM v_places)""")
def geo_04_haversine(spark, d):
    return v.places(spark, d).select("id", F.round(geo.haversine(F.col("lat"), F.col("lng"), F.lit(49.0), F.lit(-123.0)), 3).alias("km"))
