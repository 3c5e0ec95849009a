"""Incremental processing with Structured Streaming (STR-*).

Each function takes a streaming DataFrame and gives a transformed one or a started query; ``drain``
runs a query to the end of what is there, the form in which an incremental job is scheduled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.sources.readers import queue_ids


def read_changes(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100, kind: str = "json") -> DataFrame:
    """New files of a folder; the number of files a trigger bounds what is in flight."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(kind).load(path)


def since(rows: DataFrame, mark, ts: str = "_ts") -> DataFrame:
    """A pull from a high-water mark: inclusive, so that it may repeat rows, which an upsert absorbs."""
    return rows.filter(F.col(ts) >= F.lit(mark))


def upsert_stream(changes: DataFrame, target: str, checkpoint: str, key: str = "id", version: str = "_ts"):
    """Write the latest version of each changed key, and removals (deleted = true), to a table of versions.

    Batches are appended under their own folder, overwritten when a batch runs again, and ``current`` picks the newest version: a batch
    costs what changed, not what is stored.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        newest = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), version).alias("r")).select("r.*")
        newest.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str, key: str = "id", version: str = "_ts") -> DataFrame:
    """The newest version of every key that is not removed."""
    rows = spark.read.parquet(target)
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(version, "batch")).alias("r")).select("r.*")
    return newest.filter(~F.coalesce("deleted", F.lit(False))).drop("deleted", "batch")


def compact(spark: SparkSession, target: str, into: str, key: str = "id", version: str = "_ts") -> None:
    current(spark, target, key, version).write.mode("overwrite").parquet(into)


def expired(rows: DataFrame, now, days: int, ts: str = "ts") -> DataFrame:
    """Rows still within their time to live."""
    return rows.filter(F.col(ts) > F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days)))


def deduplicated(events: DataFrame, id_: str = "event_id", ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Replayed events once; state is dropped behind the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([id_])


def rollup_stream(events: DataFrame, by: list[str], ts: str = "ts", value: str = "value", late: str = "1 hour") -> DataFrame:
    windows = events.withWatermark(ts, late).groupBy(F.window(ts, "1 hour").alias("w"), *by)
    out = windows.agg(F.count("*").alias("events"), F.approx_count_distinct("user_id").alias("users"), F.avg(value).alias("mean_value"))
    return out.select(F.col("w.start").alias("hour"), *by, "events", "users", "mean_value")


def rate_stream(requests: DataFrame, caller: str, limit: int = 300, ts: str = "ts", late: str = "1 minute") -> DataFrame:
    counted = requests.withWatermark(ts, late).groupBy(F.window(ts, "60 seconds").alias("w"), caller).agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") > limit).select(F.col("w.start").alias("start"), caller, "n")


def usage_stream(events: DataFrame, quota: float, share: float = 0.8, ts: str = "ts", value: str = "value") -> DataFrame:
    wide = events.withWatermark(ts, "1 hour").groupBy(F.window(ts, "1 day", "1 hour").alias("w")).agg(F.sum(value).alias("used"))
    return wide.filter(F.col("used") > quota * share).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "used")


def queue_stream(messages: DataFrame) -> DataFrame:
    return queue_ids(messages)


def drain(out: DataFrame, path: str, checkpoint: str, mode: str = "append", kind: str = "parquet") -> None:
    """Run a stream to the end of what is there."""
    query = out.writeStream.format(kind).outputMode(mode).option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()
    query.awaitTermination()
