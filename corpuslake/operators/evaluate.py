"""Retrieval and quality evaluation (AGG-07..10, SRT-05, SRT-06, WIN-01, WIN-04, WIN-07, WIN-08)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranks up to which a hit counts.
CUTOFFS = (1, 5, 10, 20, 50)


def document_rank(items: DataFrame, labels: DataFrame, label: str, document: str, position: str = "position") -> DataFrame:
    """(label, rank): the first position of the label's own document, 0 where it isn't in the list."""
    first = items.groupBy(label, document).agg(F.min(position).alias("rank"))
    return labels.join(first, [label, document], "left").select(label, document, F.coalesce("rank", F.lit(0)).cast("int").alias("rank"))


def summarize(ranks: DataFrame, top: int = 50) -> DataFrame:
    """One row: scored, errored, recall at each cutoff up to ``top``, mrr; null without a scored label."""
    scored = F.col("error").isNull()
    hit = lambda k: F.round(F.avg(F.when(scored, F.col("rank").between(1, k).cast("double"))), 4).alias(f"recall_{k}")
    mrr = F.avg(F.when(scored, F.when(F.col("rank") > 0, F.lit(1.0) / F.col("rank")).otherwise(0.0)))
    return ranks.agg(F.count_if(scored).alias("scored"), F.count_if(~scored).alias("errored"), *(hit(k) for k in CUTOFFS if k <= top), F.round(mrr, 4).alias("mrr"))


def audit(classified: DataFrame, document: str) -> DataFrame:
    """For each document: chunks by verdict, and the shares of garbage and usable ones."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    return classified.groupBy(document).agg(
        F.count("*").alias("chunks"), n("clean").alias("clean"), n("marginal").alias("marginal"), n("garbage").alias("garbage"),
        F.round(n("garbage") / F.count("*"), 3).alias("garbage_share"), F.round((n("clean") + n("marginal")) / F.count("*"), 3).alias("usable_share"),
    )


def reason_counts(classified: DataFrame) -> DataFrame:
    # explode would infer a filter on the reasons, whose push-down computes all measures twice; explode_outer does not.
    rows = classified.select(F.explode_outer("reasons").alias("reason")).filter("reason IS NOT NULL")
    return rows.groupBy("reason").agg(F.count("*").alias("n"))


def probe_stats(pages: DataFrame, document: str, chars: str, floor: float = 50) -> DataFrame:
    """(document, median_chars, share): what a probe of a document's pages says, the share of pages with more than ``floor`` characters."""
    more = F.avg((F.col(chars) > floor).cast("int"))
    return pages.groupBy(document).agg(F.round(F.median(chars), 3).alias("median_chars"), F.round(more, 3).alias("share"))


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row: how many rows there are beyond the first of each key."""
    per = rows.groupBy(*key).agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0).cast("long")).alias("duplicates"))


def worst(audited: DataFrame, document: str, top: int = 40) -> DataFrame:
    return audited.orderBy(F.desc("garbage_share"), document).limit(top)


def first_chunks(chunks: DataFrame, document: str, n: int = 5, order: str = "chunk_index") -> DataFrame:
    turn = Window.partitionBy(document).orderBy(order)
    return chunks.withColumn("__n", F.row_number().over(turn)).filter(F.col("__n") <= n).drop("__n")


def cross_tab(rows: DataFrame, by: str, columns: str, values: list[str]) -> DataFrame:
    return rows.groupBy(by).pivot(columns, values).count().na.fill(0)


def draw(n: Column, seed: int = 1) -> Column:
    """The n-th draw of a 32-bit counter-based generator, as a pure function of n: 0 <= draw < 1.

    The state before draw n is seed + n * 0x6D2B79F5 modulo 2**32, so that rows are drawn in parallel.
    """
    s = F.pmod(F.lit(seed) + n.cast("long") * F.lit(0x6D2B79F5), F.lit(1 << 32))
    mixed = F.transform(F.array(s), lambda v: _times(v.bitwiseXOR(F.shiftrightunsigned(v, 15)), v.bitwiseOR(F.lit(1))))
    last = F.transform(mixed, lambda v: v.bitwiseXOR((v + _times(v.bitwiseXOR(F.shiftrightunsigned(v, 7)), v.bitwiseOR(F.lit(61)))).bitwiseAND(F.lit(0xFFFFFFFF))))
    out = F.transform(last, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 14)))
    return F.get(out, F.lit(0)) / F.lit(float(1 << 32))


def _times(x: Column, y: Column) -> Column:
    """Product of two 32-bit words modulo 2**32, without leaving a long."""
    low, high = x.bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(x, 16)
    top = (high * y.bitwiseAND(F.lit(0xFFFF))).bitwiseAND(F.lit(0xFFFF)) * F.lit(1 << 16)
    return (low * y + top).bitwiseAND(F.lit(0xFFFFFFFF))


def shuffled_sample(rows: DataFrame, key: str, n: int, seed: int = 1) -> DataFrame:
    """``n`` rows by their draw, whose number is a hash of the row's key: a rank by key would need all rows in one order."""
    return rows.withColumn("draw", draw(F.xxhash64(key).bitwiseAND(F.lit(0x7FFFFFFF)), seed)).orderBy("draw", key).limit(n)


def streaks(rows: DataFrame, fault: Column, order: str, group: str) -> DataFrame:
    """``rows`` with streak: how many faults of a group in a row end here, 0 at a success."""
    island = F.sum(F.when(fault, 0).otherwise(1)).over(Window.partitionBy(group).orderBy(order))
    numbered = rows.withColumns({"__island": island, "__fault": fault.cast("int")})
    inner = Window.partitionBy(group, "__island").orderBy(order)
    return numbered.withColumn("streak", F.when(fault, F.sum("__fault").over(inner)).otherwise(0)).drop("__island", "__fault")


def stale(scorecards: DataFrame, chunks: DataFrame, document: str) -> DataFrame:
    """Scorecards whose document was extracted after they were made."""
    newest = chunks.groupBy(document).agg(F.max("extracted_at").alias("newest"))
    return scorecards.join(newest, document, "left").withColumn("stale", F.coalesce(F.col("newest") > F.col("scored_at"), F.lit(False)))


def with_ranks(labels: DataFrame, ranks: DataFrame, chunks: DataFrame) -> DataFrame:
    """Labels (document_id, phrase) with their rank in a scorecard (document_id, phrase, rank, started), their document's chunks counted and its newest
    extraction, and ``stale``: the document was extracted anew after the scorecard was made, so that both tell of different texts."""
    newest = chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"), F.max("extracted_at").alias("newest_extracted_at"))
    started = ranks.agg(F.max("started").alias("started"))  # one report, one time
    rows = labels.join(ranks.select("document_id", "phrase", "rank"), ["document_id", "phrase"], "left").join(newest, "document_id", "left").join(F.broadcast(started), F.lit(True), "left")
    stale = F.coalesce(F.col("newest_extracted_at") > F.col("started"), F.lit(False))
    return rows.withColumns({"chunk_count": F.coalesce("chunk_count", F.lit(0).cast("long")), "stale": stale}).drop("started")
