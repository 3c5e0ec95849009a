"""URL rules answered by a Bloom filter cascade (native).

A rule is a host, a path prefix and a verdict. It fits the host and all its
subdomains when the url's path starts with the rule's path; the longest rule wins.
A url's candidate keys are its host suffixes joined with the path prefixes whose
lengths occur among the rules. The universe is the set of all distinct candidate
keys of the corpus. Level 0 of the cascade encodes the listed keys; each further
level encodes the keys of the other side that the level before let through, until
none is left. A key's depth of acceptance then says exactly, for every key of the
universe, whether it is listed: no join with the rules is needed. Two cascades
answer "is there a rule" and "does it block".

Filters are arrays of longs in the plan. Their size follows the number of rules and
the logarithm of the universe: level 0 is sized so that it lets through about as
many keys as are listed. Everything is a DataFrame expression.

Nulls and odd input: a null url, or one without ``://``, has an empty host and path and
no rule. Repeated rows are judged alike; a repeated rule counts once, and of a key listed
with both verdicts the block holds. Without rules every url is allowed. Rules of equal length: the longer host wins.
Columns of the same name as a result column are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.llm.common import without, written

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def key(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Host suffixes at label bounds x path prefixes of the given lengths, longest key first."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda p: p.isNotNull())
    keys = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.struct(F.length(h).alias("h"), F.concat(h, p).alias("key")))))
    order = lambda a, b: F.coalesce(F.nullif(F.length(b["key"]) - F.length(a["key"]), F.lit(0)), b["h"] - a["h"])
    return F.transform(F.array_sort(F.when(host == "", F.array().cast("array<struct<h:int,key:string>>")).otherwise(keys), order), lambda k: k["key"])


@dataclass
class Level:
    words: list[int]
    hashes: int
    salt: int

    def contains(self, key: Column) -> Column:
        """All bits of the key are set; the words are one literal of the plan."""
        bits = len(self.words) * 64
        words = F.from_json(F.lit(str(self.words)), "array<bigint>")
        tests = []
        for place in _places(key, self.hashes, self.salt, bits):
            tests.append(F.getbit(F.get(words, (place / 64).cast("int")), (place % 64).cast("int")) == 1)
        out = tests[0]
        for test in tests[1:]:
            out = out & test
        return out


def _places(key: Column, hashes: int, salt: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(salt * 64 + i)), F.lit(bits)) for i in range(hashes)]


def _encode(keys: DataFrame, n: int, rate: float, salt: int) -> Level:
    """A filter of ``n`` keys with the given rate of false positives, built by aggregation."""
    size = max(1, math.ceil(-n * math.log(rate) / math.log(2) ** 2 / 64))
    hashes = max(1, round(-math.log2(rate)))
    place = F.explode(F.array(*_places(F.col("key"), hashes, salt, size * 64)))
    bit = F.expr("shiftleft(1L, CAST(place % 64 AS INT))")
    words = keys.select(place.alias("place")).groupBy((F.col("place") / 64).cast("int").alias("w")).agg(F.bit_or(bit).alias("bits"))
    out = [0] * size
    for row in words.collect():  # at most `size` words
        out[row["w"]] = row["bits"]
    return Level(out, hashes, salt)


class Cascade:
    """Exact membership of ``listed`` within ``universe`` (DataFrames of column key, the universe's distinct and written once, as every level reads it)."""

    def __init__(self, listed: DataFrame, universe: DataFrame, salt: int = 0):
        self.levels: list[Level] = []
        inside = listed.select("key").distinct()
        outside = without(universe.select("key"), inside, "key")
        n, rest = inside.count(), outside.count()
        if not n:
            return
        rate = max(min(0.5, math.sqrt(0.5) * n / max(rest, 1)), 1e-9)
        while n:
            level = _encode(inside, n, rate, salt + len(self.levels))
            self.levels.append(level)
            outside, inside, rate = inside, outside.filter(level.contains(F.col("key"))), 0.5
            n = inside.count()

    def contains(self, key: Column) -> Column:
        """The first level that turns a key away decides: an even level says no."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i, level in reversed(list(enumerate(self.levels))):
            out = F.when(~level.contains(key), F.lit(i % 2 == 1)).otherwise(out)
        return out


def _literals(spark: SparkSession, keys: set[str]) -> DataFrame:
    """The keys as literals of the plan: no Python worker makes them."""
    values = F.array(*map(F.lit, sorted(keys))) if keys else F.array().cast("array<string>")
    return spark.range(1).select(F.explode_outer(values).alias("key")).filter("key IS NOT NULL")


def judge_urls(pages: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule (the key of the rule that decides, or null) and verdict."""
    spark: SparkSession = pages.sparkSession
    pages = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    if not rules:
        return pages.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit("allow")})
    lengths = sorted({len(r.path) for r in rules}, reverse=True)
    keys = candidate_keys(F.col("host"), F.col("path"), lengths)
    listed, blocked = _literals(spark, {r.key for r in rules}), _literals(spark, {r.key for r in rules if r.verdict == "block"})
    found = pages.select(F.explode_outer(keys).alias("key")).filter("key IS NOT NULL")
    universe = written(found.unionByName(listed).distinct(), "universe")
    has_rule, blocks = Cascade(listed, universe), Cascade(blocked, listed, salt=32)
    rule = F.get(F.filter(keys, has_rule.contains), F.lit(0))
    pages = pages.withColumn("rule", rule)
    verdict = F.when(F.col("rule").isNotNull() & blocks.contains(F.col("rule")), "block").otherwise("allow")
    return pages.withColumn("verdict", verdict)
