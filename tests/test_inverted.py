"""The stored inverted index: scores of a plain version, batches, merges, pruned scans."""

import contextlib
import io
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from corpuslake.operators import search
from corpuslake.operators.inverted import TextIndex

ROWS = "id int, name string, kind string"


def drawn(n, seed=1):
    draw, words = random.Random(seed), ["red", "Ring", "rings", "small", "the", "thé", "a1", "wing", "ringing"]
    text = lambda: None if draw.random() < 0.1 else " ".join(draw.choice(words) for _ in range(draw.randrange(0, 12)))
    return [(i, text(), text()) for i in range(n)]


def near(a, b):
    """Edit distance of one."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def plain(rows, clauses):
    out = {}
    met = {}
    for f in (1, 2):
        texts = {r[0]: re.findall(r"\w+", (r[f] or "").lower()) for r in rows}
        n, avg = len(texts), sum(map(len, texts.values())) / len(texts)
        df = {}
        for w in texts.values():
            for t in set(w):
                df[t] = df.get(t, 0) + 1
        for i, w in texts.items():
            for k, c in enumerate(clauses):
                for t in set(w):
                    weight = 1.0 if t == c.term or c.prefix and t.startswith(c.term) else 0.5 if c.fuzzy and near(t, c.term) else 0
                    if weight:
                        tf = w.count(t)
                        idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                        out[i] = out.get(i, 0) + weight * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / avg))
                        met.setdefault(i, set()).add(k)
    return {i: round(s, 9) for i, s in out.items() if len(met[i]) == len(clauses)}


def found(index, *query, **options):
    return {r["key"]: round(r["score"], 9) for r in index.search(search.compile_query(*query), **options).collect()}


@pytest.mark.parametrize("query", [("red ring", False, False), ("red ring", True, False), ("small ring", True, True), ("the thé", False, False), ("nothing here", False, False)])
def test_batches_and_merges_score_as_a_rebuild_and_as_a_plain_version(spark, tmp_path, query):
    rows = drawn(120)
    frame = lambda part: spark.createDataFrame(part, ROWS)
    at = lambda name: TextIndex(spark, str(tmp_path / name), buckets=8)
    rebuilt = at("whole").add(frame(rows), "id", ["name", "kind"])
    batched = at("batches").add(frame(rows[:70]), "id", ["name", "kind"])
    for _ in range(2):  # the second batch runs twice
        batched.add(frame(rows[70:]), "id", ["name", "kind"], batch=1)
    want = plain(rows, search.compile_query(*query))
    assert found(rebuilt, *query) == found(batched, *query) == want
    merged = batched.merge(str(tmp_path / "merged"))
    assert found(merged, *query) == want
    fewer = batched.merge(str(tmp_path / "fewer"), without=frame(rows[:10]).select(F.col("id").alias("key")))
    assert found(fewer, *query) == plain(rows[10:], search.compile_query(*query))


def test_a_query_reads_the_files_of_its_terms_only(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "i"), buckets=16).add(spark.createDataFrame(drawn(60), ROWS), "id", ["name"])
    hits = index.search(search.compile_query("red small", False))
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        hits.explain("formatted")
    scan = next(part for part in out.getvalue().split("\n\n") if "/postings" in part and "Scan" in part)
    assert re.search(r"PartitionFilters: .*bucket#?\d* (IN|=)", scan) and re.search(r"PushedFilters: .*In\(term, \[red,\s?small\]\)", scan)
    assert hits.count() > 0


def test_clauses_hold_across_fields(spark, tmp_path):
    rows = [(1, "Red ring", None), (2, "red", "RING small"), (3, "ring", "ring"), (4, None, ""), (4, None, "red"), (4, "ring", None)]
    index = TextIndex(spark, str(tmp_path / "i")).add(spark.createDataFrame(rows, ROWS), "id", ["name", "kind"])
    assert sorted(found(index, "red ring", False)) == [1, 2, 4]
    assert sorted(found(index, "red ring", False, fields=["name"])) == [1]
    assert found(index, "") == {} and set(found(index, "", match_all=True).values()) == {0.0} and sorted(found(index, "", match_all=True)) == [1, 2, 3, 4]


def test_an_empty_table_is_an_empty_index(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "i"))
    index.add(spark.createDataFrame([], ROWS), "id", ["name"]).add(spark.createDataFrame([(1, "a b", None)], ROWS), "id", ["name"], batch=1)
    assert list(found(index, "a", False)) == [1]
