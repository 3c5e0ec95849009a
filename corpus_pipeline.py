"""The corpus pipeline: language, exact copies, near copies, benchmark leaks, tokens.

Every stage takes (spark, docs, sf_dir) and works on all documents that the stage before kept;
its result is written as Parquet and read again as the next one's docs. All stages but
the last return the columns of documents.

Nulls and odd input are treated as the stages' operators say: a document without text or letter is
rejected by the language stage; a document without doc_id passes the stages on pairs,
which can't name it. Empty tables pass as empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.llm.common import without, written
from corpuslake.llm.decontamination import decontaminate
from corpuslake.llm.exact_dedup import drop_exact_copies
from corpuslake.llm.language import bucket, fit_languages, identify
from corpuslake.llm.near_dedup import near_duplicates
from corpuslake.llm.sentencepiece_lattice import PieceTable, decode, default_model, encode

#: The columns of documents.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told by a margin."""
    model = fit_languages(docs.filter(bucket(F.col("doc_id"), 4) != 2))
    return identify(docs, model).filter(~F.col("rejected")).select(COLUMNS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id."""
    return drop_exact_copies(docs, keep="largest").select(COLUMNS)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    gone = near_duplicates(docs, size=5, percent=80).filter("NOT kept").select(F.col("doc_id").alias("gone"))
    gone = written(gone, "near-copies")
    return without(docs, gone, docs["doc_id"] == gone["gone"]).select(COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(COLUMNS)


def sentencepiece_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document, and whether they decode to its text again."""
    table, digest = PieceTable.read(default_model()), lambda text: F.sha2(text.cast("binary"), 256)
    docs = docs.select("doc_id", "text", "lang", "source", digest(F.coalesce("text", F.lit(""))).alias("sha256"))
    coded = decode(encode(docs, table, keep_text=False), table)
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", (digest(F.col("decoded")) == F.col("sha256")).alias("exact"))


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("MinHash near-dedup", minhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding and decoding", sentencepiece_tokens),
]

#: SQL can't express the language model and the sketches; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
