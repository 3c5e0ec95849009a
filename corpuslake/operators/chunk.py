"""Chunking with overlap (CHK-*) and its reconciliation with stored chunks (SNK-06, SNK-07)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.sources.readers import spread

# Characters of a chunk.
MOST, TARGET, LEAST, OVERLAP = 4000, 2500, 100, 200

# A placeholder that stands for an image, and runs of separators.
_IMAGE = r"(?i)<!--\s*image\s*-->"
SEPARATORS = r"[.\-_=·•*]{4,}"


def split_pieces(text: Column, most: int = MOST, overlap: int = OVERLAP) -> Column:
    """Pieces of at most ``most`` characters that start every ``most - overlap``; the last one reaches the end."""
    size, step = F.length(text), most - overlap
    last = F.when(size <= most, F.lit(0)).otherwise(F.ceil((size - most) / step).cast("int") * step)
    return F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda at: F.substr(text, at + 1, F.lit(most)))


def chunk_id(document: Column, page: Column, index: Column) -> Column:
    return F.concat(document.cast("string"), F.lit("::p"), page.cast("string"), F.lit("::c"), index.cast("string"))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def cleaned(section: Column) -> Column:
    """A section without placeholders and superfluous blanks."""
    out = F.regexp_replace(F.regexp_replace(section, _IMAGE, " "), r"[ \t]{2,}|\t", " ")  # a single blank stays as it is
    return _stripped(F.regexp_replace(out, r"\n[ \t]*\n[ \t]*\n+", "\n\n"))


def furniture(text: Column) -> Column:
    """Whether a text is rules, dot leaders and form lines instead of words (TXT-04)."""
    body = F.regexp_replace(text, _IMAGE, " ")
    dense = F.greatest(F.length(F.regexp_replace(body, r"(?U)\s", "")), F.lit(1))
    ruled = F.length(body) - F.length(F.regexp_replace(body, SEPARATORS, ""))
    letters = F.length(F.regexp_replace(body, "[^A-Za-z]", ""))
    return (F.round(ruled / dense, 3) > 0.3) & (F.round(letters / dense, 3) < 0.35)


def _block_starts(sizes: Column) -> Column:
    """The sections (from 1) at which blocks start: a block ends with the section that brings it to ``TARGET`` characters.

    The fold sees lengths only. A last block of under ``LEAST`` characters belongs to the one before it.
    """
    none = F.struct(F.lit(TARGET).alias("size"), F.array().cast("array<int>").alias("starts"), F.lit(0).alias("seen"))

    def add(block: Column, size: Column) -> Column:
        at, full = block["seen"] + 1, block["size"] >= TARGET
        return F.struct(
            F.when(full, size).otherwise(block["size"] + 2 + size).alias("size"),
            F.when(full, F.array_append(block["starts"], at)).otherwise(block["starts"]).alias("starts"), at.alias("seen"),
        )

    def settle(block: Column) -> Column:
        several = F.size(block["starts"]) > 1
        return F.when(several & (block["size"] < LEAST), F.slice(block["starts"], 1, F.size(block["starts"]) - 1)).otherwise(block["starts"])

    return F.aggregate(sizes, none, add, settle)


def with_chunks(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with chunks (page_number, chunk_index, content); a text without a word has none.

    Sections are gathered to blocks and blocks are split into pieces, whose page is the number of their block. The
    first piece that isn't blank stays in any case, others if they are long enough and no furniture. The first piece of a
    block is preceded by the end of the chunk before it.
    """
    sections = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n{2,}"), cleaned), lambda s: s != "")
    cut = docs.withColumn("__sections", sections)
    cut = cut.withColumn("__starts", _block_starts(F.transform("__sections", F.length)))
    stops = lambda k: F.coalesce(F.get("__starts", k + 1), F.size("__sections") + 1)
    cut = cut.withColumn("__blocks", F.transform("__starts", lambda at, k: F.array_join(F.slice("__sections", at, stops(k) - at), "\n\n")))
    piece = lambda page: lambda own, part: F.struct(page.alias("page"), part.alias("part"), _stripped(own).alias("own"))
    pieces = F.flatten(F.transform("__blocks", lambda block, page: F.transform(split_pieces(block), piece(page))))
    cut = cut.withColumn("__pieces", F.filter(pieces, lambda p: p["own"] != ""))
    cut = cut.withColumn("__kept", F.filter("__pieces", lambda p, k: (k == 0) | ((F.length(p["own"]) >= LEAST) & ~furniture(p["own"]))))
    before = lambda k: F.concat(F.right(F.get("__kept", k - 1)["own"], F.lit(OVERLAP)), F.lit("\n\n"))
    content = lambda p, k: F.concat(F.when((p["part"] == 0) & (k > 0), before(k)).otherwise(""), p["own"])
    chunks = F.transform("__kept", lambda p, k: F.struct(p["page"].alias("page_number"), k.alias("chunk_index"), content(p, k).alias("content")))
    return cut.withColumn("chunks", chunks).drop("__sections", "__starts", "__blocks", "__pieces", "__kept")


def chunk_documents(docs: DataFrame, key: str = "document_id", text: str = "text") -> DataFrame:
    """One row for each chunk: id, key, page_number, chunk_index, content.

    The outer form of ``explode``: for the other one Catalyst tests the array's size before, and computes all chunks for that again.
    """
    rows = with_chunks(spread(docs.select(key, text)), text).select(key, F.explode_outer("chunks").alias("c")).filter("c IS NOT NULL").select(key, "c.*")
    return rows.select(chunk_id(F.col(key), F.col("page_number"), F.col("chunk_index")).alias("id"), key, "page_number", "chunk_index", "content")


def with_carry(chunks: DataFrame, document: str = "document_id", most: int = OVERLAP) -> DataFrame:
    """``chunks`` with carry: the end of the chunk before in the same document; null for the first."""
    return chunks.withColumn("carry", F.right(F.lag("content").over(Window.partitionBy(document).orderBy("chunk_index")), F.lit(most)))


def reading_order(chunks: DataFrame, document: str = "document_id") -> DataFrame:
    """``chunks`` with place: where a chunk stands in its document, by index and then by page."""
    return chunks.withColumn("place", F.row_number().over(Window.partitionBy(document).orderBy("chunk_index", "page_number")))


def replace_plan(stored: DataFrame, fresh: DataFrame, document: str = "document_id") -> DataFrame:
    """What a new extraction does to the stored chunks of its documents: (document, id, op)."""
    own = fresh.select(document).distinct()
    old = stored.join(own, document, "left_semi").select(document, "id", F.col("content").alias("was"))
    both = old.join(fresh.select(document, "id", F.col("content").alias("now")), [document, "id"], "full")
    op = F.when(F.col("now").isNull(), "delete").when(F.col("was").eqNullSafe(F.col("now")), "noop").otherwise("upsert")
    return both.select(document, "id", op.alias("op"))
