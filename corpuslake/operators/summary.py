"""Extractive summaries of search results with citations, and why there is none (SUM-03)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.operators.inverted import words

# Passages of a summary, its sentences, and terms of a query.
PASSAGES, SENTENCES, TERMS = 8, 3, 16
#: Sentences of a question that are compared with one another: the best ones.
_CANDIDATES = 20


def _sentences(content: Column) -> Column:
    return F.filter(F.transform(F.split(content, r"[.!?]\s+"), lambda x: F.trim(x)), lambda s: s != "")


def extractive(asked: DataFrame) -> DataFrame:
    """(question_id, summary, citations) of questions (question_id, terms, passages: array of (n, content)).

    A sentence scores by how many of the query's terms it has; equal ones stand in order of passages. One that shares half of its words or more with a better one is
    left out. The first sentences left make the summary, in their order in the passages, each with the number of its passage.
    """
    cut = asked.select("question_id", "terms", F.explode("passages").alias("p")).select("question_id", "terms", F.col("p.n").alias("n"), F.posexplode(_sentences(F.col("p.content"))).alias("at", "sentence"))
    told = cut.withColumn("words", F.array_distinct(words(F.col("sentence")))).withColumn("score", F.size(F.array_intersect("words", "terms"))).filter("score > 0")
    best = Window.partitionBy("question_id").orderBy(F.desc("score"), "n", "at")
    ranked = told.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= _CANDIDATES)
    row = F.struct("k", "n", "at", "sentence", "words")
    per = ranked.groupBy("question_id").agg(F.array_sort(F.collect_list(row)).alias("c"))  # _CANDIDATES at most
    new = lambda x: ~F.exists(F.col("c"), lambda y: (y["k"] < x["k"]) & (F.size(F.array_intersect(x["words"], y["words"])) * 2 >= F.size(x["words"])))
    first = F.slice(F.filter("c", new), 1, SENTENCES)
    in_order = F.array_sort(F.transform(first, lambda x: F.struct(x["n"].alias("n"), x["at"].alias("at"), x["sentence"].alias("sentence"))))
    said = F.array_join(F.transform(in_order, lambda x: F.concat(x["sentence"], F.lit(" ["), x["n"].cast("string"), F.lit("]."))), " ")
    return per.select("question_id", said.alias("summary"), F.array_sort(F.array_distinct(F.transform(first, lambda x: x["n"]))).alias("citations"))


def summaries(questions: DataFrame, hits: DataFrame, summarise: Callable[[DataFrame], DataFrame] = extractive) -> DataFrame:
    """(question_id, summary, citations, reason), a row a question.

    ``questions`` are (question_id, keywords, enabled), ``hits`` the readable chunks that a search found for each (question_id, rank, content). ``summarise`` is where
    another summariser goes in. Where there is no summary the reason says why, the first of no_query, no_results and disabled that holds.
    """
    asked = questions.withColumn("terms", F.slice(F.array_distinct(words(F.col("keywords"))), 1, TERMS))
    order = Window.partitionBy("question_id").orderBy("rank")
    top = hits.filter("content <> ''").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= PASSAGES)
    found = top.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("n", "content"))).alias("passages"))
    asked = asked.join(found, "question_id", "left")
    why = (
        F.when(F.trim(F.coalesce("keywords", F.lit(""))) == "", "no_query").when(F.col("passages").isNull(), "no_results")
        .when(~F.coalesce("enabled", F.lit(False)), "disabled")
    )
    asked = asked.withColumn("why", why)
    made = summarise(asked.filter("why IS NULL").select("question_id", "terms", "passages"))
    out = asked.select("question_id", "why").join(made, "question_id", "left")
    reason = F.coalesce("why", F.when(F.col("summary").isNull(), "no_results"))
    return out.select("question_id", "summary", F.coalesce("citations", F.array().cast("array<int>")).alias("citations"), reason.alias("reason"))
