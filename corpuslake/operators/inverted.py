"""A stored inverted index: postings dealt by term, added to by batches, read by the terms of a query only.

Layout below a folder, each table with a subfolder a batch:

- ``postings``: bucket, term, field, key, tf, len; a folder a bucket, rows of a file sorted by term, so that a query prunes buckets and
  row groups; bucket -1 has a row without term a document and field;
- ``terms``: bucket, field, term, df: the vocabulary with document frequencies of the batch;
- ``lengths``: key, field, len: the documents, also those without a term.

Frequencies, counts and lengths of batches add up, so that adding a batch gives the scores of a rebuild. A batch that runs again replaces
its own folders and appends nothing twice. ``merge`` joins batches and leaves out documents that were removed or replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.operators.search import Clause, bm25, matched_terms
from corpuslake.sources.readers import spread

#: Terms of a query (a row a field and clause) up to which they are part of the scan's filter; beyond it the buckets alone are.
_NAMED = 1000
#: Such rows up to which they are broadcast.
_BROADCAST = 1_000_000


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


#: The bucket of the rows that tell documents' lengths.
_LENGTHS = -1
#: A term, of lower-cased text, as ``words`` has them.
_TERM = re.compile(r"[^\W_]+")
#: Documents whose terms are one batch of Arrow.
_DOCUMENTS = 250


def _counted(fields: list[str]):
    """For each document and field a row of its length, and one of each term with its number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, _DOCUMENTS) for i in range(0, batch.num_rows, _DOCUMENTS)):
                for name in fields:
                    found = [Counter(_TERM.findall((text or "").lower())) for text in part.column(name).to_pylist()]
                    times = np.fromiter((len(c) + 1 for c in found), np.int64, len(found))
                    of = np.repeat(np.arange(len(found)), times)
                    terms = pa.array(list(chain.from_iterable((None, *c) for c in found)), pa.string())
                    tf = pa.array(list(chain.from_iterable((0, *c.values()) for c in found)), pa.int64())
                    length = np.fromiter((c.total() for c in found), np.int64, len(found))[of]
                    yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(of)), pa.repeat(name, len(of)), terms, tf, pa.array(length)], names=["key", "field", "term", "tf", "len"])

    return run


def _one_each(docs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``docs`` with the rows of a key that repeats joined; of the others only the keys are dealt out."""
    again = docs.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(F.col(key).alias("__key"))
    if again.isEmpty():
        return docs
    same = F.col(key).eqNullSafe(F.col("__key"))
    joined = docs.join(again, same, "left_semi").groupBy(key).agg(*(F.array_join(F.collect_list(f), " ").alias(f) for f in fields))
    return docs.join(again, same, "left_anti").unionByName(joined)


class TextIndex:
    """An index at ``path``; ``buckets`` is fixed when its first batch is added, ``slices`` is in how many files at least a batch spreads a bucket, so that a frequent term isn't one task."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, slices: int = 4) -> None:
        self.spark, self.path, self.buckets, self.slices = spark, path.rstrip("/"), buckets, slices

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")

    def add(self, docs: DataFrame, key: str, fields: list[str], batch: int = 0) -> TextIndex:
        """Adds the documents of a batch; a key that repeats within it is one document of all its texts.

        A document's terms are counted where it is read, so that postings are dealt out once. The row that tells a document's length goes with them, in a bucket of its own.
        """
        rows = spread(_one_each(docs.select(key, *fields), key, fields)).withColumnRenamed(key, "key")
        kind = rows.schema["key"].dataType.simpleString()
        counted = rows.mapInArrow(_counted(fields), f"key {kind}, field string, term string, tf long, len long")
        self._post(counted.withColumn("bucket", F.when(F.col("term").isNull(), _LENGTHS).otherwise(self._bucket())), batch, kind)
        return self

    def _post(self, rows: DataFrame, batch: int, kind: str) -> None:
        """Rows by bucket and slice, and the lengths and the vocabulary that they make; the more partitions a shuffle has, the more slices, so that they fill evenly."""
        slices = max(self.slices, 8 * int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.buckets)
        # Rebalanced, so that a task sorts what the advisory size of a partition allows, however large the input is: larger sorts would spill all their rows.
        dealt = rows.withColumn("slice", F.pmod(F.xxhash64("key"), F.lit(slices))).hint("rebalance", "bucket", "slice").drop("slice")
        self._write(dealt.sortWithinPartitions("bucket", "term"), "postings", batch, ["bucket"])
        lengths = self._stored(kind).filter((F.col("batch") == batch) & (F.col("bucket") == _LENGTHS))
        self._write(lengths.select("key", "field", "len"), "lengths", batch)
        self._count(batch)

    def _write(self, rows: DataFrame, name: str, batch: int, by: list[str] | None = None) -> None:
        writer = rows.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(*by) if by else writer).parquet(f"{self.path}/{name}/batch={batch}")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _stored(self, kind: str) -> DataFrame:
        return self.spark.read.schema(f"key {kind}, field string, term string, tf long, len long, batch int, bucket int").parquet(f"{self.path}/postings")

    def _postings(self) -> DataFrame:
        """All postings; their schema is given, as a batch without a document has no file."""
        return self._stored(self._read("lengths").schema["key"].dataType.simpleString()).filter(F.col("bucket") != _LENGTHS)

    def _count(self, batch: int) -> None:
        df = self._postings().filter(F.col("batch") == batch).groupBy("bucket", "field", "term").agg(F.count("*").alias("df"))
        self._write(df.sortWithinPartitions("term"), "terms", batch)

    def vocabulary(self) -> DataFrame:
        """(bucket, field, term, df) over all batches."""
        return self._read("terms").groupBy("bucket", "field", "term").agg(F.sum("df").alias("df"))

    def stats(self) -> DataFrame:
        """(field, n_docs, avg_len): a row a field."""
        return self._read("lengths").groupBy("field").agg(F.count("*").alias("n_docs"), (F.sum("len") / F.count("*")).alias("avg_len"))

    def postings(self, terms: list[tuple[int, str]] | None = None, buckets: list[int] | None = None) -> DataFrame:
        """Postings of (bucket, term) pairs, or of buckets; nothing else is read."""
        rows = self._postings()
        if terms is not None:
            return rows.filter(F.col("bucket").isin(sorted({b for b, _ in terms})) & F.col("term").isin(sorted({t for _, t in terms})))
        return rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))

    def all_documents(self) -> DataFrame:
        return self._read("lengths").select("key").distinct()

    def search(self, clauses: list[Clause], match_all: bool = False, fields: list[str] | None = None) -> DataFrame:
        """(key, score) of documents that satisfy every clause in one field or another; scores of fields, each with its own lengths and frequencies, are summed.

        Without a clause nothing is found, or with ``match_all`` every document, with score 0.
        """
        if not clauses:
            every = self.all_documents().select("key", F.lit(0.0).alias("score"))
            return every if match_all else every.limit(0)
        terms = self._read("terms")
        if fields is not None:
            terms = terms.filter(F.col("field").isin(fields))
        if not any(c.fuzzy or c.prefix for c in clauses):
            terms = terms.filter(F.col("term").isin(sorted({c.term for c in clauses})))
        # Terms are matched as they are stored, and only what matches is added up over batches.
        wanted = matched_terms(terms, clauses, ["bucket", "field", "df"]).groupBy("clause", "term", "weight", "bucket", "field").agg(F.sum("df").alias("df"))
        few = wanted.limit(_NAMED + 1).collect()
        if len(few) <= _NAMED:
            hits, wanted = self.postings(terms=[(r["bucket"], r["term"]) for r in few]), F.broadcast(self.spark.createDataFrame(few, wanted.schema))  # a row a field, term and clause
        else:
            hits = self.postings(buckets=[r[0] for r in wanted.select("bucket").distinct().collect()])  # `buckets` at most
            if wanted.limit(_BROADCAST + 1).count() <= _BROADCAST:  # else postings are dealt out by term
                wanted = F.broadcast(wanted)
        hits = hits.join(wanted.drop("bucket"), ["field", "term"]).join(F.broadcast(self.stats()), "field")
        score = F.col("weight") * bm25(F.col("tf"), F.col("len"), F.col("df"), F.col("n_docs"), F.col("avg_len"))
        met = F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("clause")))
        found = hits.groupBy("key").agg(F.sum(score).alias("score"), met.alias("met"))
        return found.filter(F.col("met") == (1 << len(clauses)) - 1).select("key", "score")

    def merge(self, into: str, without: DataFrame | None = None) -> TextIndex:
        """All batches as one, at another place; documents whose ``key`` is in ``without`` go."""
        target = TextIndex(self.spark, into, self.buckets, self.slices)
        keep = (lambda rows: rows.join(without.select("key").distinct(), "key", "left_anti")) if without is not None else (lambda rows: rows)
        kind = self._read("lengths").schema["key"].dataType.simpleString()
        target._post(keep(self._stored(kind)).drop("batch"), 0, kind)
        return target
