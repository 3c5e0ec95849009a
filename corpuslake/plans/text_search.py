"""Queries of search, ranking, text quality, chunking and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslake.operators import access as acl
from corpuslake.operators import chunk, evaluate, registry, search, text
from corpuslake.plans import views as v
from corpuslake.plans.relational import ANYONE, SEEN, _t
from corpuslake.plans.views import query
from corpuslake.sources import readers

#: Conjunctive BM25 of two terms in SQL.
_BM25 = """s AS (SELECT count(*) AS n, avg(len) AS avgl FROM (SELECT doc_id, max(len) AS len FROM v_terms GROUP BY doc_id)), f AS (SELECT term, count(*) AS df FROM v_posts GROUP BY term),
    w AS (SELECT {clause} AS clause, term, {weight} AS weight, df FROM f WHERE {match}),
    h AS (SELECT doc_id, sum(weight * ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgl))) AS score, count(DISTINCT clause) AS met
          FROM v_posts JOIN w USING (term), s GROUP BY doc_id)"""


def _ranked(spark, d, keywords, fuzzy=False, prefix=False, **options):
    index = v.text_index(spark, d, "documents", "doc_id", ["text"])
    return index.search(search.compile_query(keywords, fuzzy, prefix), **options).withColumnRenamed("key", "doc_id")


_EXACT = _BM25.format(clause="term", weight="1.0", match="term IN ('the', 'thin')")


@query(f"""SELECT doc_id, round(score, 6) AS score, project_id FROM (WITH {_EXACT} SELECT doc_id, score, project_id FROM h JOIN v_documents ON id = doc_id WHERE met = 2 AND {SEEN}) ORDER BY score DESC, doc_id LIMIT 20""")
def flagship_search(spark, d):
    """The first page of a ranked conjunctive search that only sees what its caller may see."""
    seen = readers.scan(v.documents(spark, d), ANYONE).select(F.col("id").alias("doc_id"), "project_id")
    hits = _ranked(spark, d, "the thin").join(seen, "doc_id").select("doc_id", F.round("score", 6).alias("score"), "project_id")
    return search.page(hits, [F.desc("score"), F.asc("doc_id")])


@query(f"WITH {_EXACT} SELECT doc_id, round(score, 6) AS score FROM h WHERE met = 2")
def rnk_01_bm25(spark, d):
    return _ranked(spark, d, "the thin").select("doc_id", F.round("score", 6).alias("score"))


@query(f"""WITH {_BM25.format(clause="CASE WHEN term = 'the' THEN 0 ELSE 1 END", weight="CASE WHEN term IN ('the', 'oning') OR starts_with(term, 'oning') THEN 1.0 ELSE 0.5 END",
             match="term = 'the' OR starts_with(term, 'oning') OR levenshtein(term, 'oning') = 1")} SELECT doc_id, round(score, 6) AS score FROM h WHERE met = 2""")
def q_02_fuzzy_prefix(spark, d):
    return _ranked(spark, d, "the oning", fuzzy=True, prefix=True).select("doc_id", F.round("score", 6).alias("score"))


@query("SELECT doc_id, 0.0::DOUBLE AS score FROM documents")
def q_14_match_all(spark, d):
    """Without a term everything is found where that is asked for, and nothing otherwise."""
    return _ranked(spark, d, "- . -", match_all=True).unionByName(_ranked(spark, d, "- . -"))


@query(r"SELECT doc_id, list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}]+'), lambda x: x <> '')[1:16] AS terms FROM documents")
def q_01_tokenize(spark, d):
    return _t("documents")(spark, d).select("doc_id", search.tokenize(F.col("text")).alias("terms"))


@query(f"SELECT id FROM v_documents WHERE type IN ('de', 'fr') AND n_chars = 999 AND {SEEN}")
def q_05_filter_gate(spark, d):
    fields = {"type": search.FieldSpec("type"), "size": search.FieldSpec("n_chars", "int"), "where": search.FieldSpec("place", "point")}
    made = search.build_filter({"type": "de, fr", "size": "999", "where": "1,2", "nope": "x"}, fields, acl.visible(ANYONE))
    return v.documents(spark, d).filter(made.predicate).select("id")


@query("SELECT doc_id FROM documents ORDER BY lang DESC, n_chars, doc_id LIMIT 30")
def q_08_sort(spark, d):
    fields = {"lang": search.FieldSpec("lang", sortable=True), "size": search.FieldSpec("n_chars", sortable=True), "text": search.FieldSpec("text")}
    order = search.build_order("-lang,+size,text,-lang", fields, keywords=False, default="doc_id")
    return search.page(_t("documents")(spark, d), order, top=30).select("doc_id")


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 500 OFFSET 10")
def q_11_page_clamp(spark, d):
    return search.page(_t("documents")(spark, d), [F.asc("doc_id")], top=9999, skip=10).select("doc_id")


@query("SELECT item_id, regexp_replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;'), '(the|an)', '<mark>\\1</mark>', 'gi') AS html FROM benchmark")
def rnk_09_highlight(spark, d):
    return _t("benchmark")(spark, d).select("item_id", search.highlight(F.col("text"), ["the", "an"]).alias("html"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?i)<!--\s*image\s*-->', ' ', 'g'), '[ \t]+', ' ', 'g'), '\n[ \t]*\n[ \t]*\n+', E'\n\n', 'g'), E' \t\n\r\f\v') AS text FROM pages""")
def txt_01_strip(spark, d):
    return _t("pages")(spark, d).select("page_id", text.strip_placeholders(F.col("html")).alias("text"))


_MEASURE = r"""WITH b AS (SELECT doc_id, text AS body, length(text) AS length, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS tokens,
      list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '\s', '', 'g') <> '') AS lines, greatest(length(regexp_replace(text, '\s', '', 'g')), 1) AS denom,
      length(trim(text, E' \t\n\r\f\v')) AS trimmed FROM documents),
    w AS (SELECT *, list_filter(list_transform(tokens, lambda t: regexp_replace(t, '[^A-Za-z0-9]', '', 'g')), lambda x: regexp_matches(x, '^[A-Za-z]{3,}$')) AS words FROM b),
    m AS (SELECT doc_id, floor((CASE WHEN length > 0 THEN (length - trimmed) / length ELSE 0 END) * 1000 + 0.5) / 1000 AS placeholder_ratio, floor((length(regexp_replace(body, '[^A-Za-z]', '', 'g')) / denom) * 1000 + 0.5) / 1000 AS alpha_ratio,
      floor((length(regexp_replace(body, '[^0-9]', '', 'g')) / denom) * 1000 + 0.5) / 1000 AS digit_ratio, floor((length(regexp_replace(body, '[\x20-\x7E\s]', '', 'g')) / denom) * 1000 + 0.5) / 1000 AS non_ascii_ratio,
      len(tokens) AS token_count, len(words) AS word_count,
      len(lines) > 0 AND 2 * (len(list_filter(lines, lambda x: length(x) - length(replace(x, '|', '')) >= 2))
        + len(list_filter(lines, lambda x: len(regexp_extract_all(regexp_replace(x, '(\s)', '\1\1', 'g'), '(^|\s)-?\d+(\.\d+)?(\s|$)')) >= 3))) >= len(lines) AS tabular,
      floor((CASE WHEN len(tokens) > 0 THEN length(array_to_string(tokens, '')) / len(tokens) ELSE 0 END) * 1000 + 0.5) / 1000 AS mean_token_length,
      floor((CASE WHEN len(tokens) > 0 THEN len(list_filter(tokens, lambda t: length(regexp_replace(t, '[^A-Za-z0-9]', '', 'g')) <= 2)) / len(tokens) ELSE 0 END) * 1000 + 0.5) / 1000 AS short_token_ratio,
      floor((CASE WHEN len(words) > 0 THEN len(list_filter(words, lambda x: NOT regexp_matches(x, '[aeiouyAEIOUY]'))) / len(words) ELSE 0 END) * 1000 + 0.5) / 1000 AS vowelless_ratio,
      floor((length(array_to_string(regexp_extract_all(body, '[.\-_=·•*]{4,}'), '')) / denom) * 1000 + 0.5) / 1000 AS separator_ratio FROM w)"""


@query(_MEASURE + """, ch AS (SELECT doc_id, i, list[i] AS c FROM (SELECT doc_id, list, unnest(range(1, len(list) + 1)) AS i FROM (SELECT doc_id, string_split(text, '') AS list FROM documents))),
    g AS (SELECT doc_id, c, i - row_number() OVER (PARTITION BY doc_id, c ORDER BY i) AS run FROM ch WHERE c NOT IN (chr(10), chr(13), chr(8232), chr(8233))),
    r AS (SELECT doc_id, max(n) AS max_repeat FROM (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id, c, run HAVING count(*) >= 4) GROUP BY doc_id)
    SELECT m.*, coalesce(max_repeat, 0) AS max_repeat FROM m LEFT JOIN r USING (doc_id)""")
def txt_02_measure(spark, d):
    docs = _t("documents")(spark, d).select("doc_id", "text")
    return text.measure(docs).drop("text", "length", "placeholders")


@query(_MEASURE + """ SELECT doc_id, CASE WHEN placeholder_ratio > 0.5 OR (word_count >= 5 AND vowelless_ratio > 0.2) OR non_ascii_ratio > 0.15 OR (separator_ratio > 0.3 AND alpha_ratio < 0.35)
      OR (NOT tabular AND short_token_ratio > 0.5) OR (NOT tabular AND alpha_ratio < 0.5 AND digit_ratio < 0.3) THEN 'garbage'
      WHEN placeholder_ratio > 0.2 OR separator_ratio > 0.1 OR (word_count >= 5 AND vowelless_ratio > 0.1) OR (NOT tabular AND short_token_ratio > 0.35) OR (NOT tabular AND mean_token_length > 0 AND mean_token_length < 3)
      THEN 'marginal' ELSE 'clean' END AS verdict FROM m""")
def txt_03_verdict(spark, d):
    return text.classify(text.measure(_t("documents")(spark, d).select("doc_id", "text"))).select("doc_id", "verdict")


@query(_MEASURE + """, r AS (SELECT unnest(list_filter([CASE WHEN placeholder_ratio > 0.5 THEN 'mostly-image-placeholders' END, CASE WHEN word_count >= 5 AND vowelless_ratio > 0.2 THEN 'vowelless-tokens' END,
      CASE WHEN non_ascii_ratio > 0.15 THEN 'non-ascii-noise' END, CASE WHEN separator_ratio > 0.3 AND alpha_ratio < 0.35 THEN 'mostly-separator-furniture' END,
      CASE WHEN NOT tabular AND short_token_ratio > 0.5 THEN 'fragmented-tokens' END, CASE WHEN NOT tabular AND alpha_ratio < 0.5 AND digit_ratio < 0.3 THEN 'low-letter-density' END], lambda x: x IS NOT NULL)) AS reason FROM m)
      SELECT reason, count(*) AS n FROM r GROUP BY reason""")
def agg_09_garbage_reasons(spark, d):
    judged = text.classify(text.measure(_t("documents")(spark, d).select("doc_id", "text")))
    # No filter on the verdict: it would be pushed below the measures and compute them again.
    return evaluate.reason_counts(judged.select(F.when(F.col("verdict") == "garbage", F.col("reasons")).alias("reasons")))


@query("SELECT document_id, chunk_index, content FROM v_pieces")
def chk_02_split(spark, d):
    return v.pieces(spark, d)


@query("SELECT document_id || '::p' || chunk_index || '::c' || chunk_index AS id, length(content) AS n FROM v_pieces")
def chk_03_chunk_id(spark, d):
    p = v.pieces(spark, d)
    return p.select(chunk.chunk_id(F.col("document_id"), F.col("chunk_index"), F.col("chunk_index")).alias("id"), F.length("content").cast("long").alias("n"))


#: Chunks of all documents, whose lines are the sections.
CHUNKS = r"""WITH RECURSIVE sections AS (SELECT doc_id, unnest(range(1, len(list) + 1)) AS pos, list FROM (
            SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(regexp_replace(x, '(?i)<!--\s*image\s*-->', ' ', 'g'), '[ \t]+', ' ', 'g'), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')), lambda x: x != '') AS list FROM documents)),
          s AS (SELECT doc_id, pos, list[pos] AS section, length(list[pos]) AS n FROM sections),
          fold AS (SELECT doc_id, pos, n AS size, 0 AS block FROM s WHERE pos = 1
            UNION ALL SELECT s.doc_id, s.pos, CASE WHEN size >= 2500 THEN s.n ELSE size + 2 + s.n END, CASE WHEN size >= 2500 THEN block + 1 ELSE block END FROM fold JOIN s ON s.doc_id = fold.doc_id AND s.pos = fold.pos + 1),
          ends AS (SELECT doc_id, arg_max(size, pos) AS size, max(block) AS block FROM fold GROUP BY 1),
          blocks AS (SELECT f.doc_id, CASE WHEN f.block = e.block AND f.block > 0 AND e.size < 100 THEN f.block - 1 ELSE f.block END AS page, string_agg(section, chr(10) || chr(10) ORDER BY f.pos) AS block
            FROM fold f JOIN s USING (doc_id, pos) JOIN ends e USING (doc_id) GROUP BY 1, 2),
          pieces AS (SELECT doc_id, page, off, trim(substr(block, off + 1, 4000), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS own FROM (
            SELECT *, unnest(range(0, CASE WHEN length(block) <= 4000 THEN 1 ELSE ceil((length(block) - 4000) / 3800.0)::BIGINT * 3800 + 1 END, 3800)) AS off FROM blocks)),
          rules AS (SELECT *, greatest(length(regexp_replace(own, '\s', '', 'g')), 1) AS dense, row_number() OVER (PARTITION BY doc_id ORDER BY page, off) AS k FROM pieces WHERE own != ''),
          kept AS (SELECT doc_id, page, off, own, row_number() OVER w - 1 AS i, lag(own) OVER w AS before FROM rules WHERE k = 1 OR length(own) >= 100 AND NOT
            (round((length(own) - length(regexp_replace(own, '[.\-_=·•*]{4,}', '', 'g'))) / dense, 3) > 0.3 AND round(length(regexp_replace(own, '[^A-Za-z]', '', 'g')) / dense, 3) < 0.35) WINDOW w AS (PARTITION BY doc_id ORDER BY page, off))
          SELECT doc_id || '::p' || page || '::c' || i AS id, doc_id AS document_id, page::INTEGER AS page_number, i::INTEGER AS chunk_index, CASE WHEN off = 0 AND i > 0 THEN right(before, 200) || chr(10) || chr(10) ELSE '' END || own AS content FROM kept"""


@query(CHUNKS)
def chk_01_chunks(spark, d):
    docs = _t("documents")(spark, d).select(F.col("doc_id").alias("document_id"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return chunk.chunk_documents(docs)


@query("""WITH p AS (SELECT l_suppkey AS id, count(*) AS n, median(l_quantity * 10) AS med, avg((l_quantity > 25)::INTEGER) AS share FROM lineitem GROUP BY 1)
          SELECT id, CASE WHEN n = 0 THEN 'ocr' WHEN med >= 200 AND share >= 0.8 THEN 'text' WHEN id * 4000 < 200000 AND med > 0 THEN 'text' ELSE 'ocr' END AS route FROM p""")
def rou_01_route(spark, d):
    p = _t("lineitem")(spark, d).groupBy(F.col("l_suppkey").alias("id")).agg(F.count("*").alias("n"), F.median(F.col("l_quantity") * 10).alias("med"), F.avg((F.col("l_quantity") > 25).cast("int")).alias("share"))
    return p.select("id", text.route(F.col("n"), F.col("med"), F.col("share"), F.col("id") * 4000).alias("route"))


@query(r"""SELECT page_id, CASE WHEN c < 32 THEN 'tile' WHEN c < 5000 AND false THEN 'x' WHEN c < 500 AND page_id * 1000 > 200000 THEN 'force' ELSE 'keep' END AS action, c AS chars FROM (
          SELECT page_id, length(regexp_replace(regexp_replace(html, '(?i)<!--\s*image\s*-->', '', 'g'), '\s+', '', 'g')) AS c FROM pages)""")
def rou_03_escalation(spark, d):
    chars = text.real_chars(F.col("html"))
    return _t("pages")(spark, d).select("page_id", text.escalation(chars, F.col("page_id") * 1000).alias("action"), chars.cast("long").alias("chars"))


@query("SELECT l_orderkey, (l_linenumber // 3)::INTEGER AS batch, count(*) AS pages FROM lineitem GROUP BY 1, 2")
def rou_09_page_batches(spark, d):
    return _t("lineitem")(spark, d).groupBy("l_orderkey", text.page_batches(F.col("l_linenumber"), 3).alias("batch")).agg(F.count("*").alias("pages"))


@query("""SELECT item_id AS label_id, document_id, ['exact', 'whitespace', 'punct', 'despaced'][item_id % 4 + 1] AS class, min(chunk_index) AS matched_chunk, CASE WHEN item_id % 4 = 3 THEN 'split' END AS despaced_kind
          FROM v_pieces JOIN benchmark ON contains(content, benchmark.text) GROUP BY item_id, document_id""")
def phr_03_presence(spark, d):
    """Where each benchmark text, with spaces doubled, as hyphens or left out, stands in each document that holds it, chunk by chunk."""
    items = _t("benchmark")(spark, d)
    held = registry.phrase_holders(items, _t("documents")(spark, d)).select("item_id", F.col("doc_id").alias("document_id"))
    fault, space = F.col("item_id") % 4, F.lit(" ")
    phrase = F.when(fault == 1, F.replace("text", space, F.lit("  "))).when(fault == 2, F.replace("text", space, F.lit(" - "))).when(fault == 3, F.replace("text", space)).otherwise(F.col("text"))
    labels = items.join(held, "item_id").select(F.col("item_id").alias("label_id"), "document_id", phrase.alias("phrase"))
    found = text.presence(labels, v.pieces(spark, d).join(labels.select("document_id").distinct(), "document_id", "left_semi"))
    return found.filter("matched_chunk IS NOT NULL").select("label_id", "document_id", "class", "matched_chunk", "despaced_kind")


@query("""SELECT c_custkey, list_sort(list_distinct(list_filter([c_custkey % 7, c_custkey % 5, c_custkey % 7], lambda k: k BETWEEN 1 AND 4))) AS cited FROM customer""")
def sum_02_citations(spark, d):
    from corpuslake.functions.scalars import citations

    k = F.col("c_custkey")
    said = F.concat(F.lit("as ["), k % 7, F.lit("] and ["), k % 5, F.lit("], ["), k % 7, F.lit("]"))
    return _t("customer")(spark, d).select("c_custkey", F.transform(citations(said, 4), lambda i: (i + 1).cast("long")).alias("cited"))
