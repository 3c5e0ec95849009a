"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.llm.centroids import cluster
from corpuslake.llm.chat import format_chats, read_back, text_parts
from corpuslake.llm.decontamination import contaminations
from corpuslake.llm.exact_dedup import exact_groups
from corpuslake.llm.hard_negatives import hard_negatives
from corpuslake.llm.html_text import extract_text
from corpuslake.llm.language import bucket, fit_languages, identify
from corpuslake.llm.near_dedup import near_duplicates
from corpuslake.llm.packing import pack_documents
from corpuslake.llm.quality import fit_quality, score_quality
from corpuslake.llm.sentencepiece_lattice import PieceTable, decode, default_model, encode
from corpuslake.llm.substring_dedup import drop_repeated_windows
from corpuslake.llm.url_filter import Rule, judge_urls
from corpuslake.llm.vectors import usable, whole

#: The rules of op7: host, path, verdict.
RULES = [
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = bucket(F.col("doc_id"), 5) == 0
    model = fit_quality(docs, _table(spark, sf_dir, "labels").filter(~held_out))
    return score_quality(docs, model, threshold=0.3).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_groups(_table(spark, sf_dir, "documents"), keep="largest")
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_windows(_table(spark, sf_dir, "documents"), size=20)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: how many items it contains, the smallest of them, the longest overlap."""
    docs = _table(spark, sf_dir, "documents")
    found = contaminations(docs, _table(spark, sf_dir, "benchmark"))
    by_doc = found.groupBy("doc_id").agg(F.count("*").alias("n_items"), F.min("item_id").alias("item_id"), F.max("overlap").alias("overlap"))
    out = docs.select("doc_id").join(by_doc, "doc_id", "left")
    return out.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), "item_id", "overlap")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = bucket(F.col("doc_id"), 4) == 2
    model = fit_languages(docs.filter(~held_out))
    return identify(docs.drop("lang"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(own)
    chats = read_back(format_chats(rows.withColumn("parts", text_parts(F.col("text"))).drop("text")))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return chats.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), digest(lines).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        digest(F.col("loss_text")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), size=4, percent=80)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ids of every document, and whether they decode to its text again."""
    table, digest = PieceTable.read(default_model()), lambda text: F.sha2(text.cast("binary"), 256)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", digest(F.coalesce("text", F.lit(""))).alias("sha256"))
    coded = decode(encode(docs, table, keep_text=False), table)
    return coded.select("doc_id", "n_tokens", "ids", (digest(F.col("decoded")) == F.col("sha256")).alias("exact"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), length=1024, end=2)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    v = F.when(usable(F.col("embedding")), whole(F.col("embedding")))
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), v.alias("v"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0, positives=5, negatives=5, percent=80)


def op13_hamerly_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(_table(spark, sf_dir, "embeddings"), k=40, rounds=5, dims=64, salt="2")


#: One round of op13: every vector to its nearest centroid, then exact floors of the means.
_ROUND = """
        a{n} AS MATERIALIZED (SELECT row, v, arg_min(c.cluster, (list_sum(list_transform(list_zip(v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c.cluster)) AS cluster,
                  min(list_sum(list_transform(list_zip(v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS distance FROM k CROSS JOIN c{n} c GROUP BY row, v),
        s{n} AS (SELECT cluster, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM (SELECT cluster, v, unnest(range(1, 65)) AS i FROM a{n}) GROUP BY cluster, i),
        m{n} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{n} GROUP BY cluster),
        c{next} AS MATERIALIZED (SELECT cluster, coalesce(m{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN m{n} USING (cluster)),"""


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_html_extraction": op4_html_extraction,
    "op5_decontamination": op5_decontamination,
    "op6_language_id": op6_language_id,
    "op7_url_filter": op7_url_filter,
    "op8_chat_format": op8_chat_format,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_best_fit_packing": op11_best_fit_packing,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_hamerly_centroids": op13_hamerly_centroids,
}

ORACLES = {
    "op2_exact_dedup": """
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
        FROM t""",
    "op3_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        win AS (SELECT doc_id, unnest(range(1, len(words) - 18)) AS s, words FROM w),
        keyed AS (SELECT doc_id, s, array_to_string(words[s:s+19], ' ') AS k FROM win),
        late AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM keyed) WHERE n > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM late),
        pos AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS p, unnest(words) AS word FROM w),
        kept AS (SELECT pos.doc_id, pos.p, pos.word FROM pos ANTI JOIN gone ON pos.doc_id = gone.doc_id AND pos.p = gone.p),
        joined AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept_text, count(*) AS n FROM kept GROUP BY doc_id)
        SELECT w.doc_id, len(w.words)::BIGINT AS n_words, (len(w.words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept_text, '')) AS kept_sha256
        FROM w LEFT JOIN joined USING (doc_id)""",
    "op7_url_filter": """
        WITH u AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
        r(rhost, rpath, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
        fit AS (SELECT page_id, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(verdict, length(rhost || rpath)) AS verdict
                FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
        SELECT h.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM h LEFT JOIN fit USING (page_id)""",
    "op8_chat_format": """
        WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
                   UNION ALL VALUES (-7, 0, 'user', '\\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\\### Assistant: </turn> ok')),
        e AS (SELECT *, length(text) + length(text) - length(replace(text, '\\', ''))
                     + (length(text) - length(replace(text, '### ', ''))) // 4 + (length(text) - length(replace(text, ': ', ''))) // 2
                     + (length(text) - length(replace(text, '</turn>', ''))) // 7 + (length(text) - length(replace(text, '<|', ''))) // 2 AS escaped FROM c)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(escaped + length(role) + 15)::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op12_hard_negatives": """
        WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
                   FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)),
        s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
              FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
        SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, other_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY row_number() OVER w <= 5""",
    "op13_hamerly_centroids": """
        WITH k AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
                   WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
        c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, v) - 1)::INTEGER AS cluster, v AS c FROM (SELECT sha256('2:' || vec_id) AS h, v FROM k WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT 40)),"""
    + "".join(_ROUND.format(n=n, next=n + 1) for n in range(6))
    + """
        o AS (SELECT cluster, sum(distance)::BIGINT AS cluster_inertia FROM a5 GROUP BY cluster)
        SELECT vec_id, cluster, distance::BIGINT AS distance, cluster_inertia, (SELECT sum(distance) FROM a5)::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a5 JOIN k USING (row) JOIN o USING (cluster) JOIN c5 USING (cluster)""",
}
