"""What the operators of this subpackage share: work tables, word hashing and n-gram hashes.

Work tables are Parquet folders under ``spark.checkpoint.dir``, the one place that
the driver and all executors share, so a lost executor never takes the only copy
of an intermediate result with it.
"""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.session import shared_folder

#: Bytes of text that one slice of a batch holds at most (one long text may exceed it).
SLICE_BYTES = 2 << 20
#: Distinct words whose hash a task keeps; the cache starts again when it is full.
WORD_CACHE = 150_000

_P1, _P2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_MASK = (1 << 64) - 1


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/corpuslake/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` as a work table: written once, read wherever it is used again."""
    spark, path = df.sparkSession, work_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _places[id(out)] = (weakref.ref(out), path)
    return out


#: Work tables by the object that reads them.
_places: dict[int, tuple] = {}


def discard(*tables: DataFrame) -> None:
    """Remove work tables (as ``written`` returned them) that nothing reads any more: whatever was made from them is written itself."""
    for table in tables:
        held = _places.pop(id(table), None)
        if held is not None and held[0]() is table:
            remove(table.sparkSession, held[1])


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder of any file system that Spark writes to."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of ``rows`` rows at most, unless the session has a setting of its own: rows here are whole texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":  # the default
        spark.conf.set(name, rows)


def sorted_groups(spark: SparkSession) -> None:
    """Groups of rows that are dealt and sorted by their key are aggregated in one pass, not partially and then again."""
    spark.conf.set("spark.sql.execution.replaceHashWithSortAgg", "true")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def semi_by_size(big: DataFrame, keys: DataFrame, on: list[str], limit: int = 1_000_000) -> DataFrame:
    """Rows of ``big`` whose key is in ``keys``: the keys are broadcast only when they
    were counted and are at most ``limit``; beyond that both sides are shuffled."""
    return big.join(_by_size(keys.select(*on), limit), on, "left_semi")


def without(big: DataFrame, keys: DataFrame, on, limit: int = 1_000_000) -> DataFrame:
    """Rows of ``big`` that no key matches; broadcast as in ``semi_by_size``."""
    return big.join(_by_size(keys, limit), on, "left_anti")


def _by_size(keys: DataFrame, limit: int) -> DataFrame:
    """``keys`` for a join that asks whether there is one; they are dealt out to be distinct only where they are many rows."""
    if keys.limit(limit + 1).count() <= limit:
        return F.broadcast(keys)
    keys = keys.distinct()
    return F.broadcast(keys) if keys.limit(limit + 1).count() <= limit else keys


def one_row_each(docs: DataFrame) -> DataFrame:
    """``docs`` with the rows that repeat a doc_id joined; of the others only the ids are dealt out."""
    again = written(docs.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1").select(F.col("doc_id").alias("__again")), "again")
    if again.isEmpty():
        return docs
    own = semi_by_size(docs, again.withColumnRenamed("__again", "doc_id"), ["doc_id"])
    joined = own.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("text")), " ").alias("text"))
    return without(docs, again, docs["doc_id"] == again["__again"]).unionByName(written(joined, "joined"))


class WordHashes(dict):
    """Word (bytes) to its 64-bit hash, remembered for the frequent ones."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    r"""The words ``[^\x20\x09-\x0D]+``: bytes.split() parts at exactly these six characters."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def row_slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in slices of at most ``limit`` bytes of text."""
    for batch in batches:
        column = batch.column(text)
        sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < len(sizes):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def hashed_words(slice_: pa.RecordBatch, cache: WordHashes, lower: bool = False, text: str = "text"):
    """(hashes of all words of the slice in order, number of words of each row)."""
    arrays = [cache.of(words_of(t, lower)) for t in slice_.column(text).to_pylist()]
    lens = np.fromiter(map(len, arrays), np.int64, len(arrays))
    return (np.concatenate(arrays) if arrays else np.empty(0, np.uint64)), lens


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngram_hashes(x: np.ndarray, n: int, second: bool = False) -> np.ndarray:
    """Hash of x[i:i+n] for every i, by doubling: log2(n) passes instead of n."""
    if len(x) < n:
        return np.empty(0, np.uint64)
    base = _P2 if second else _P1
    block, size, out, covered = (mix(x) if second else x), 1, None, 0
    while size <= n:
        if n & size:
            if out is None:
                out = block
            else:
                m = len(x) - covered - size + 1
                out = out[:m] * np.uint64(pow(base, size, 1 << 64)) + block[covered : covered + m]
            covered += size
        if size * 2 <= n:
            m = len(x) - 2 * size + 1
            block = block[:m] * np.uint64(pow(base, size, 1 << 64)) + block[size : size + m]
        size *= 2
    return mix(out[: len(x) - n + 1])


def gram_starts(lens: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of ``lens`` words put end to end: the index of every n-gram that stays
    within its row, the row, and its start within the row."""
    counts = np.maximum(lens - n + 1, 0)
    rows = np.repeat(np.arange(len(lens)), counts)
    first = np.cumsum(counts) - counts
    starts = np.arange(counts.sum()) - np.repeat(first, counts)
    offsets = np.cumsum(lens) - lens
    return offsets[rows] + starts, rows, starts
