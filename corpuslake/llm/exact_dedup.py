"""Exact deduplication through a log-structured merge index of digests (native).

Texts are equal when they are identical after lower-casing A-Z. Each batch of
entries is a memtable: it is aggregated by digest and flushed as a run, a Parquet
folder whose rows are sorted by digest and whose row groups carry a Bloom filter
and the smallest and largest digest. Compaction merges all runs of the lower
levels into one sorted run of the next level and keeps, of each digest, the
smallest identifier and the number of rows. Digests that were met more than once
are hits: their texts are grouped by their own bytes, so that a digest shared by
different texts never merges them.

Only DataFrame functions run on this path. A hot digest costs one row per task
after partial aggregation; the last join is a plain left join, of which adaptive
execution splits a hot partition.

Nulls and odd input: a null text counts as empty; empty texts form one group.
Rows that repeat a doc_id are separate rows of their group. A row without doc_id
is grouped like the others but stays only if no row of its group has one. An
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.llm.common import remove, semi_by_size, without, work_path, written

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalised(text: Column) -> Column:
    """A-Z lower-cased, nothing else. ``lower`` is the faster form of it for ASCII texts."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


class DigestIndex:
    """Runs of (digest, id, n): id is the smallest identifier of the digest's rows."""

    def __init__(self, spark: SparkSession, path: str | None = None, fan_in: int = 4):
        self.spark, self.path, self.fan_in = spark, path or work_path(spark, "digests"), fan_in
        self.runs: list[tuple[int, str]] = []
        self.written = 0

    def _write(self, entries: DataFrame, level: int) -> None:
        path = f"{self.path}/level={level}/run={self.written}"
        self.written += 1
        merged = entries.groupBy("digest").agg(F.min("id").alias("id"), F.sum("n").alias("n"))
        (
            merged.sortWithinPartitions("digest")
            .write.option("parquet.bloom.filter.enabled#digest", "true")
            .option("parquet.bloom.filter.adaptive.enabled", "true")
            .option("parquet.bloom.filter.max.bytes", "32768")
            .parquet(path)
        )
        self.runs.append((level, path))

    def flush(self, memtable: DataFrame) -> None:
        """Add the rows (digest, id) of one batch as a run of level 0."""
        self._write(memtable.select("digest", "id", F.lit(1).cast("long").alias("n")), 0)
        if sum(level == 0 for level, _ in self.runs) >= self.fan_in:
            self.compact()

    def compact(self) -> None:
        """Merge all runs into one of the next level."""
        if len(self.runs) > 1:
            level, old = max(x for x, _ in self.runs) + 1, list(self.runs)
            self._write(self.entries(), level)
            self.runs = self.runs[-1:]
            for _, path in old:
                remove(self.spark, path)

    def entries(self) -> DataFrame:
        schema = "digest binary, id long, n long"
        if not self.runs:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(p for _, p in self.runs))


def exact_groups(
    docs: DataFrame, keep: str = "largest", digest=sha256, batches: int = 2
) -> DataFrame:
    """One row per row of ``docs``: doc_id, digest, keep_id, group_size, kept.

    ``keep`` says which doc_id of equal texts stays; the index always keeps the
    smallest identifier, which is the negated doc_id for "largest". ``batches``
    memtables are flushed; the number changes no result.
    """
    spark, sign = docs.sparkSession, -1 if keep == "largest" else 1
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("text"))
    entries = docs.select("doc_id", digest(F.col("text")).alias("digest"), (F.col("doc_id") * sign).alias("id"))
    entries = entries.withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)))
    entries = written(entries, "entries", ["batch"])

    index = DigestIndex(spark)
    for b in range(batches):
        index.flush(entries.filter(F.col("batch") == b))
    index.compact()
    hits = index.entries().filter("n > 1")

    # Byte verification: hits are grouped by their own text, not by its digest alone.
    read = docs.withColumn("digest", digest(F.col("text"))).withColumn("id", F.col("doc_id") * sign)
    same = semi_by_size(read, hits, ["digest"]).groupBy("digest", "text").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    same = written(same, "variants")
    clash = written(same.groupBy("digest").agg(F.count("*").alias("v")).filter("v > 1").select("digest"), "clashes")
    verified = same.join(clash, "digest", "left_anti").filter("n > 1").select("digest", "id", "n")

    out = entries.select("doc_id", "digest").join(clash, "digest", "left_anti").join(verified, "digest", "left")
    if not clash.isEmpty():  # different texts under one digest: these rows meet by their text
        mixed = semi_by_size(read, clash, ["digest"]).select("doc_id", "digest", "text")
        found = same.join(clash, "digest", "left_semi").select("digest", "text", "id", "n")
        out = out.unionByName(mixed.join(found, ["digest", "text"], "left").drop("text"))
    keep_id = F.coalesce(F.col("id") * sign, F.col("doc_id"))
    return out.select(
        "doc_id", "digest", keep_id.alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("doc_id") == keep_id, F.col("id").isNull()).alias("kept"),
    )


def drop_exact_copies(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """``docs`` without the rows whose text another row keeps (columns unchanged).

    Rows are told apart by doc_id and text, so that of rows that repeat a doc_id only those go whose own text is kept elsewhere.
    """
    gone = exact_groups(docs, keep).filter(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("__gone"), F.col("digest").alias("__digest"))
    gone = written(gone, "copies")
    return without(docs, gone, (docs["doc_id"] == gone["__gone"]) & (sha256(normalised(docs["text"])) == gone["__digest"]))
