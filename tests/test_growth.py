"""Work that must not grow faster than the input: what is dealt out, joined and computed, and how often."""

import contextlib
import hashlib
import hmac
import io
import re

import pytest
from pyspark.sql import functions as F

from corpuslake.operators import chunk, events, geo, inverted, search, text
from corpuslake.operators.inverted import TextIndex
from corpuslake.streaming import stateful


def plan_of(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.fixture
def never_broadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


TEXTS = [(1, "red ring red"), (2, "ringing ring"), (None, "red ring"), (None, "red"), (3, None), (4, "— ")]


def test_postings_are_dealt_out_once(spark, tmp_path, monkeypatch):
    plans, write = {}, TextIndex._write
    monkeypatch.setattr(TextIndex, "_write", lambda self, rows, name, *a: (plans.update({name: plan_of(rows)}), write(self, rows, name, *a))[1])
    index = TextIndex(spark, str(tmp_path / "i")).add(spark.createDataFrame(TEXTS[:3] + TEXTS[4:], "id int, text string").repartition(4), "id", ["text"])
    assert plans["postings"].count("hashpartitioning(") == 1 and "Join" not in plans["postings"]
    stored = sorted((r.key or 0, r.term, r.tf, r.len) for r in index.postings().collect())
    assert stored == [(0, "red", 1, 2), (0, "ring", 1, 2), (1, "red", 2, 3), (1, "ring", 1, 3), (2, "ring", 1, 2), (2, "ringing", 1, 2)]


def test_rows_without_key_are_one_document(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "i")).add(spark.createDataFrame(TEXTS, "id int, text string"), "id", ["text"])
    assert {r.key for r in index.search(search.compile_query("red ring", False)).collect()} == {1, None}
    assert sorted((r.key or 0, r.len) for r in index._read("lengths").collect()) == [(0, 3), (1, 3), (2, 2), (3, 0), (4, 0)]


def test_many_terms_of_a_query_deal_out_no_postings(spark, tmp_path, monkeypatch, never_broadcast):
    index = TextIndex(spark, str(tmp_path / "i")).add(spark.createDataFrame(TEXTS, "id int, text string"), "id", ["text"])
    query = search.compile_query("red ring", True, True)
    few = {(r.key, round(r.score, 9)) for r in index.search(query).collect()}
    monkeypatch.setattr(inverted, "_NAMED", 0)
    many = index.search(query)
    assert {(r.key, round(r.score, 9)) for r in many.collect()} == few and len(few) == 2
    assert "SortMergeJoin" not in plan_of(many)


def test_places_and_fires_of_one_point_are_compared_once(spark, monkeypatch):
    compared, plain = spark.sparkContext.accumulator(0), geo.haversine
    count = F.udf(lambda x: (compared.add(1), x)[1], "double").asNondeterministic()
    monkeypatch.setattr(geo, "haversine", lambda *a: count(plain(*a)))
    places = spark.range(60).select("id", F.lit(50.0).alias("lat"), F.lit(-120.0).alias("lng"))
    fires = spark.range(70).select(F.lit(50.1).alias("lat"), F.lit(-120.0).alias("lng"), F.when(F.col("id") < 5, "Out").otherwise("Active").alias("status"), (F.col("id") % 7 == 0).alias("of_note"))
    got = {tuple(r)[1:] for r in geo.near(places, fires).collect()}
    assert got == {(65, 11.1, 9)} and compared.value <= 4


def test_a_buffered_table_needs_no_state_store(spark):
    rows = spark.range(200).select((F.col("id") % 3).alias("who"), "id", F.repeat(F.lit("é"), (F.col("id") % 9).cast("int")).alias("row"))
    made = stateful.buffered(rows, "who", "id", "row", most_rows=4, most_bytes=30)
    assert "TransformWithState" not in plan_of(made)
    sizes = {}
    for r in made.collect():
        sizes.setdefault((r.stream, r.batch), []).append(len(r.row.encode()) + 1)
    assert sum(map(len, sizes.values())) == 200 and all(len(x) <= 4 and (sum(x) + 2 <= 30 or len(x) == 1) for x in sizes.values())


def test_sections_of_a_table_need_no_state_store(spark):
    rows = [(d, i, d * 900, i == 9) for d in "abc" for i in range(10)]
    made = stateful.chunk_sections(spark.createDataFrame(rows, "document_id string, seq long, section string, last boolean"))
    assert "TransformWithState" not in plan_of(made)
    assert {(r.document_id, r.page_number) for r in made.collect()} == {(d, p) for d in "abc" for p in range(4)}


def test_pads_of_a_salt_are_made_before_the_join(spark, never_broadcast):
    rows = spark.createDataFrame([("2024-01-02 05:00:00", i) for i in range(5)] + [("2024-01-02 01:00:00", 9)], "at string, user_id long").withColumn("ts", F.to_timestamp("at"))
    salts = spark.createDataFrame([("2024-01-02 03:00:00", b"x" * 70)], "at string, salt binary").select(F.to_timestamp("at").alias("since"), "salt")
    made = events.with_pseudonyms(rows, salts)
    key, plan = b"x" * 70, plan_of(made)
    assert {r.user_id: r.pseudonym for r in made.collect()} == {9: None} | {i: hmac.new(key, str(i).encode(), hashlib.sha256).hexdigest()[:32] for i in range(5)}
    assert "BroadcastHashJoin" in plan and plan.rindex("BroadcastHashJoin") < plan.index("rpad(")


def test_tokens_are_stripped_and_runs_found_without_a_pattern(spark):
    rows = [(0, "a-b 😀😀😀😀😀 -- x.y.z 'tis 12,5\n\n\n\n\n\u2028\u2028\u2028\u2028\u2028"), (1, None), (2, ""), (3, "aaa=== ·····é·"), (4, "ébcd éé1 ---"), (5, "plain words only")]
    made = text.measure(spark.createDataFrame(rows, "i int, text string").repartition(1))
    got = {r.i: (r.max_repeat, r.word_count, r.short_token_ratio, r.non_ascii_ratio, r.digit_ratio) for r in made.collect()}
    assert got == {0: (5, 2, 0.5, 0.217, 0.13), 1: (0, 0, 0.0, 0.0, 0.0), 2: (0, 0, 0.0, 0.0, 0.0), 3: (5, 1, 0.5, 0.538, 0.0), 4: (0, 1, 0.667, 0.3, 0.1), 5: (0, 3, 0.0, 0.0, 0.0)}
    plan = plan_of(made)
    assert "[^A-Za-z0-9]" not in plan and "{3,})" not in plan


def test_sorts_of_postings_stay_small_however_few_partitions_are_set(spark, tmp_path):
    settings = {"spark.sql.shuffle.partitions": "2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        docs = spark.range(4000).select("id", F.concat_ws(" ", *(F.sha2((F.col("id") * 8 + i).cast("string"), 256) for i in range(8))).alias("text")).repartition(8)
        index = TextIndex(spark, str(tmp_path / "i"), buckets=2).add(docs, "id", ["text"])
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    files = index.postings().groupBy("bucket", F.input_file_name()).count().groupBy("bucket").agg(F.count("*").alias("files"), F.sum("count").alias("n")).collect()
    assert sum(r.n for r in files) == 32_000 and all(r.files >= 8 for r in files)


def test_exploded_lines_do_not_carry_their_document(spark, sf_dir):
    from corpuslake.plans.states import chk_04_section_stream

    plan = plan_of(chk_04_section_stream(spark, sf_dir))
    kept = re.findall(r"Generate posexplode\(\w+#\d+\), \[([^\]]*)\]", plan)
    assert len(kept) == 2 and not any(re.search("text|lines|parts|section", k) for k in kept)


def test_blanks_of_a_section_are_cleaned_as_before(spark):
    texts = ["a b", "a  b", "a\tb", "\t a \t\tb ", "a \t", " ", "a\n \n\t\n b", "x <!-- image -->  y", None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    pattern = r"[ \t]+"
    plain = F.regexp_replace(F.regexp_replace("t", r"(?i)<!--\s*image\s*-->", " "), pattern, " ")
    plain = F.regexp_replace(F.regexp_replace(plain, r"\n[ \t]*\n[ \t]*\n+", "\n\n"), r"(?U)^\s+|\s+$", "")
    assert all(r.a == r.b for r in rows.select(chunk.cleaned(F.col("t")).alias("a"), plain.alias("b")).collect())
