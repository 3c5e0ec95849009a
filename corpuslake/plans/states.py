"""Queries of stateful operators, run over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.plans.text_search import CHUNKS
from corpuslake.plans.views import query
from corpuslake.sources.readers import spread, table
from corpuslake.streaming import stateful


@query(CHUNKS.replace("doc_id AS document_id", "doc_id::VARCHAR AS document_id"))
def chk_04_section_stream(spark: SparkSession, d: str) -> DataFrame:
    """Every document fed line by line through the incremental chunker: the chunks of chk_01."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    lines = docs.select(F.col("doc_id").alias("document_id"), F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    # A column of its own below the explosion: else every line would carry its whole document to find whether it is the last one.
    lines = lines.select("document_id", F.size("lines").alias("n"), "lines").select("document_id", "n", F.posexplode("lines"))
    return stateful.chunk_sections(lines.select("document_id", F.col("pos").alias("seq"), F.col("col").alias("section"), (F.col("pos") == F.col("n") - 1).alias("last")))


@query("""WITH RECURSIVE r AS (SELECT user_id, event_id, length(event_type || ':' || user_id) + 1 AS own, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
          f AS (SELECT user_id, event_id, k, 0 AS batch, 1 AS n, 2 + own AS size FROM r WHERE k = 1
            UNION ALL SELECT r.user_id, r.event_id, r.k, CASE WHEN n >= 10 OR size + own > 90 THEN batch + 1 ELSE batch END, CASE WHEN n >= 10 OR size + own > 90 THEN 1 ELSE n + 1 END,
              CASE WHEN n >= 10 OR size + own > 90 THEN 2 + own ELSE size + own END FROM f JOIN r ON r.user_id = f.user_id AND r.k = f.k + 1)
          SELECT user_id::VARCHAR AS stream, batch::BIGINT AS batch, event_id AS seq FROM f""")
def str_04_buffer(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_id", F.concat("event_type", F.lit(":"), F.col("user_id").cast("string")).alias("row"))
    return stateful.buffered(rows, "user_id", "event_id", "row", most_rows=10, most_bytes=90).select("stream", "batch", "seq")
