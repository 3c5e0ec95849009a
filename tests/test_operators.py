"""Boundary cases of the operators."""

import datetime as dt
import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuslake.functions import scalars as fn
from corpuslake.operators import access, chunk, evaluate, events, geo, mutate, registry, search, text
from corpuslake.sources import readers


def one(df, column="x"):
    return df.select(column).first()[0]


def test_access_resolution():
    assert access.resolve_access(None).tier == "role"
    assert access.resolve_access(["staff"]).tier == "privileged"
    assert access.resolve_access(["staff", "project:p1"]).tier == "scoped"
    assert access.resolve_access(["staff"], explicit=[]).scope == ()
    assert access.roles_for(["project:p1", "x"]) == ("public", "x")
    assert access.client_roles(["staff", "x"], []) == ["x"]


@pytest.mark.parametrize("who", [access.Access(), access.resolve_access(["staff"]), access.resolve_access(["project:a"]), access.resolve_access([], explicit=[])])
def test_visibility_matrix(spark, who):
    reads, flags = [None, [], ["public"], ["other"]], [None, False, True]
    data = [(i, p, r, f) for i, (p, r, f) in enumerate((p, r, f) for p in "ab" for r in reads for f in flags)]
    df = spark.createDataFrame(data, "id int, project_id string, read array<string>, is_published boolean")
    got = {r.id for r in df.filter(access.visible(who)).collect()}

    def expected(p, r, f):
        ok = who.privileged or bool(set(r or []) & set(who.roles)) or (not r and f is True)
        return ok and (who.scope is None or p in who.scope)

    assert got == {i for i, p, r, f in data if expected(p, r, f)}


def test_keys(spark):
    h = hashlib.sha256(b"se_cret").hexdigest()
    df = spark.createDataFrame([("k_dev_7_se_cret", h, None, "junk"), ("k_dev_7_se_cret", h, None, "2999-01-01"), ("k_dev", h, None, None)], "key string, h string, r string, e string")
    parsed = df.withColumn("p", access.parse_key(F.col("key")))
    ok = access.key_valid(F.col("p.secret"), F.col("h"), F.col("r"), F.col("e"), F.current_timestamp())
    assert [r[0] for r in parsed.select(ok).collect()] == [False, True, False]


def measures(spark, value):
    return text.classify(text.measure(spark.createDataFrame([(value,)], "text string"))).first()


@pytest.mark.parametrize(
    "value, verdict",
    [
        ("The quick brown fox jumps over the lazy dog and runs away again.", "clean"),
        ("bcdfg hjklm npqrs tvwxz bcdfg qrstv lmnpq words", "garbage"),
        ("<!-- image -->\n" * 4, "garbage"),
        ("| a | 12 | 3.5 |\n| b | 14 | 2.5 |\n| c | 19 | 9.5 |", None),
        ("-" * 80, "garbage"),
        ("", None),
    ],
)
def test_quality(spark, value, verdict):
    row = measures(spark, value)
    if verdict:
        assert row.verdict == verdict
    if "|" in value:
        assert row.tabular and "fragmented-tokens" not in row.reasons
    if "image" in value:
        assert row.placeholders == 4


@pytest.mark.parametrize(
    "key, prefix, wanted",
    [("a/b", "docs/", "docs/a/b"), ("docs/x", "docs", "docs/x"), ("docs", "/docs/", "docs"), ("docsy/x", "docs", "docs/docsy/x"), ("//x", "docs", "docs/x"), ("x", "", "x"), ("", "docs", ""), (None, "docs", None)],
)
def test_object_keys_carry_their_prefix_once(spark, key, prefix, wanted):
    assert one(spark.createDataFrame([(key,)], "k string").select(fn.object_key(F.col("k"), prefix).alias("x"))) == wanted


def test_tiles_are_equal_and_widened(spark):
    boxes = [tuple(b) for b in one(spark.range(1).select(text.tiles(F.lit(1000), F.lit(500), 2).alias("x")))]
    assert boxes == [(0, 0, 530, 265), (470, 0, 1000, 265), (0, 235, 530, 500), (470, 235, 1000, 500)]


def test_chunk_cases(spark):
    join = "\n\n".join
    draw = random.Random(4)
    mixed = [[chr(97 + i % 26) * draw.choice([1, 50, 99, 100, 900, 2600, 5000]) for i in range(draw.randrange(1, 9))] for _ in range(30)]
    texts = {
        "none": None, "blank": " \n ", "short": join(["short one", "short two", "short three"]), "many": join(["a" * 300] * 20), "long": "b" * 9000,
        "two": join(["c" * 2600, "d" * 2600]), "tail": join(["e" * 2600, "tiny"]), "rule": join(["f" * 2600, "-" * 2600, "g" * 2600]), "image": "a <!-- Image --> b", "edge": "h" * 4000,
    } | {f"mixed{i}": join(m) for i, m in enumerate(mixed)}
    rows = chunk.with_chunks(spark.createDataFrame(list(texts.items()), "name string, text string")).collect()
    got = {r["name"]: [(c.page_number, c.chunk_index, c.content) for c in r["chunks"]] for r in rows}
    assert got["none"] == got["blank"] == [] and got["image"] == [(0, 0, "a b")] and len(got["short"]) == 1 and 2 <= len(got["many"]) <= 4
    assert [len(c[2]) for c in got["long"]] == [4000, 4000, 1400] and len(got["edge"]) == 1
    assert got["two"][1][2].startswith("c" * 200 + "\n\n") and [c[0] for c in got["two"]] == [0, 1]
    assert len(got["tail"]) == 1 and got["tail"][0][2].endswith("tiny")
    assert [(c[0], c[1]) for c in got["rule"]] == [(0, 0), (2, 1)] and got["rule"][1][2].startswith("f" * 200 + "\n\n")
    for i, sections in enumerate(mixed):  # every section is in some chunk, but for what is left of a block that is split
        chunks = got[f"mixed{i}"]
        assert [c[1] for c in chunks] == list(range(len(chunks))) and all(len(c[2]) <= 4202 for c in chunks)
        whole = [s for s in sections if len(s) == 900]
        assert all(any(s in c[2] for c in chunks) or sum(map(len, sections)) > 4000 for s in whole)


def test_ladder(spark):
    cases = [
        ("exact", "the old mill stands", "old mill"), ("whitespace", "the old\n mill", "old mill"), ("punct", "air – quality", "air-quality"),
        ("despaced", "airquality report", "air quality"), ("absent", "nothing here", "water quality"),
    ]
    labels = spark.createDataFrame([(i, i, p) for i, (_, _, p) in enumerate(cases)] + [(8, 8, "ends here now"), (9, 9, "x")], "label_id int, document_id int, phrase string")
    chunks = spark.createDataFrame([(i, 0, t) for i, (_, t, _) in enumerate(cases)] + [(8, 0, "it ends"), (8, 1, "here now")], "document_id int, chunk_index int, content string")
    got = {r.label_id: r for r in text.presence(labels, chunks).collect()}
    assert [got[i]["class"] for i in range(5)] == [c[0] for c in cases]
    assert got[8]["class"] == "straddle-whitespace" and got[9]["class"] == "no-chunks"
    assert got[4].coverage == 0.0 and sorted(got[4].missing_tokens) == ["quality", "water"]


def test_routing(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0, 10), (5, 300.0, 0.9, 10**7), (5, 10.0, 0.1, 1000), (5, 10.0, 0.1, 10**7)], "n int, m double, s double, b long")
    assert [r[0] for r in df.select(text.route(F.col("n"), F.col("m"), F.col("s"), F.col("b"))).collect()] == ["ocr", "text", "text", "ocr"]
    assert text.sampled_pages(3) == [0, 1, 2]
    pages = text.sampled_pages(100)
    assert pages[0] == 0 and pages[-1] == 99 and len(pages) == 20


def test_query_text():
    clauses = search.compile_query("NOT these Bridges wate", fuzzy=True, prefix=True)
    assert search.clauses_text(clauses) == "not AND (bridges OR bridges~1^0.5) AND (wate OR wate~1^0.5 OR wate*)"
    assert search.compile_query("") == []
    assert len(search.terms_of("a " * 40)) == 16


def test_filters():
    fields = {"n": search.FieldSpec("n", "int"), "b": search.FieldSpec("b", "boolean")}
    for bad in ({"n": "1e21"}, {"n": "2147483648"}, {"b": "yes"}, {"z": "1"}):
        assert search.build_filter(bad, fields, F.lit(True)).dropped == list(bad)
    assert search.and_params({"and[a]": "1", "and": {"b": "2"}}) == {"a": "1", "b": "2"}
    with pytest.raises(ValueError):
        search.check_params({"nope": 1}, {"keywords"})


def test_marks(spark):
    df = spark.createDataFrame([("a <b> c",)], "x string")
    assert one(df.select(search.balanced(F.col("x"), "", "").alias("x"))) == "a <mark>&lt;b&gt;<mark> c</mark></mark>"
    assert one(df.select(search.only_marks(F.lit("<mark>a</mark><i>")).alias("x"))) == "<mark>a</mark>&lt;i&gt;"


def test_registry_edges(spark):
    left = spark.createDataFrame([(1, "g1", " ", "5"), (2, None, "n", None), (3, "zz", "n", None), (4, "g1", "n", None)], "left_id int, guid string, name string, address string")
    right = spark.createDataFrame([("g1", "R", ["public"]), ("g2", "S", None)], "right_id string, name string, read array<string>")
    got = {r.id: r for r in registry.merge(left, right).collect()}
    assert {k: v["class"] for k, v in got.items()} == {"1": "matched", "2": "no-guid", "3": "dangling", "4": "matched", "right-g2": "right-only"}
    assert got["1"].name == "R" and got["right-g2"].is_published


def test_geometry(spark):
    square = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.0]]
    df = spark.createDataFrame([(1.0, 1.0, square), (5.0, 1.0, square), (1.0, 1.0, None)], "x double, y double, ring array<array<double>>")
    assert [r[0] for r in df.select(geo.in_ring(F.col("x"), F.col("y"), F.col("ring"))).collect()] == [True, False, False]
    simple = df.limit(1).select(geo.simplify(0.5)(F.array(*[F.array(F.lit(float(a)), F.lit(float(b))) for a, b in [(0, 0), (2, 0.01), (4, 0), (4, 4), (0, 0)]])).alias("x"))
    assert one(simple) == [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 0.0]]
    pair = spark.createDataFrame([("120.5", "50.1"), ("50.1", "-120.5"), ("x", None)], "a string, b string")
    got = [tuple(r[0]) for r in pair.select(geo.parse_centroid(F.col("a"), F.col("b"))).collect()]
    assert got == [(-120.5, 50.1), (-120.5, 50.1), (-125.0, 54.0)]


def test_near_is_brute_force(spark):
    r = random.Random(3)
    p = [(i, r.uniform(48, 60), r.uniform(-139, -114)) for i in range(40)]
    f = [(r.uniform(48, 60), r.uniform(-139, -114), "Active", i % 3 == 0) for i in range(200)]
    places = spark.createDataFrame(p, "id int, lat double, lng double")
    fires = spark.createDataFrame(f, "lat double, lng double, status string, of_note boolean")
    got = {x.id: x.fires for x in geo.near(places, fires).collect()}
    cross = places.crossJoin(fires.select(F.col("lat").alias("a"), F.col("lng").alias("b")))
    want = {x.id: x.n for x in cross.groupBy("id").agg(F.count_if(geo.haversine(F.col("lat"), F.col("lng"), F.col("a"), F.col("b")) <= 50).alias("n")).collect()}
    assert got == want


def test_recall(spark):
    ranks = spark.createDataFrame([(1, None), (3, None), (9, None), (0, None), (1, "timeout")], "rank int, error string")
    row = evaluate.summarize(ranks, top=10).first()
    assert (row.recall_1, row.recall_5, row.recall_10, row.scored, row.errored) == (0.25, 0.5, 0.75, 4, 1) and "recall_20" not in row.asDict()
    assert evaluate.summarize(ranks.limit(0)).first().mrr is None


def test_draw(spark):
    def word(seed, n):
        s = (seed + n * 0x6D2B79F5) & 0xFFFFFFFF
        t = ((s ^ s >> 15) * (s | 1)) & 0xFFFFFFFF
        t ^= (t + ((t ^ t >> 7) * (t | 61) & 0xFFFFFFFF)) & 0xFFFFFFFF
        return ((t ^ t >> 14) & 0xFFFFFFFF) / 2**32

    got = [r[0] for r in spark.range(1, 9).select(evaluate.draw(F.col("id"), 5)).collect()]
    assert got == [word(5, n) for n in range(1, 9)]


def test_mutations(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, etag int")
    new = spark.createDataFrame([(2, "B", 1), (3, "C", 9)], "id int, v string, etag int")
    assert {(r.id, r.v) for r in mutate.upsert(old, new).collect()} == {(1, "a"), (2, "B"), (3, "C")}
    assert {(r.id, r.v, r.etag) for r in mutate.patch(old, new, ["v"]).collect()} == {(1, "a", 1), (2, "B", 1)}
    assert dict(mutate.replace_if_unchanged(old, new).collect()) == {2: "ok", 3: "missing"}
    with pytest.raises(ValueError):
        mutate.patch(old, new, [f"f{i}" for i in range(11)])
    bad = spark.createDataFrame([(1, [])], "id int, read array<string>")
    with pytest.raises(Exception, match="access list"):
        mutate.require_acl(bad).collect()
    assert mutate.definition_plan([("indexer", "a"), ("index", "b")], {"b"}) == [("index", "b", "refuse"), ("indexer", "a", "apply")]


def test_purge(spark):
    docs = spark.createDataFrame([(1, True, "out of memory"), (2, True, None)], "id int, content_extracted boolean, extraction_error string")
    chunks = spark.createDataFrame([(1, "x"), (2, "y")], "document_id int, c string")
    out = mutate.purge(docs, chunks, "memory")
    assert out["report"].first().asDict() == {"documents": 1, "chunks": 1}
    assert [r.document_id for r in out["chunks"].collect()] == [2]
    assert {r.id: (r.content_extracted, r.extraction_error) for r in out["documents"].collect()} == {1: (False, None), 2: (True, None)}


def test_scalars(spark):
    df = spark.createDataFrame([("1.2.3.4, 5.6.7.8:99", "a-b_cD.pdf", "one two three [2] [9] [2] [1]")], "ip string, name string, t string")
    row = df.select(
        fn.caller_ip(F.col("ip"), F.lit("r")).alias("ip"), fn.masked_ip(F.lit("9.8.7.6")).alias("mask"), fn.title_from_file(F.col("name")).alias("title"),
        fn.truncate(F.col("t"), 9).alias("cut"), fn.citations(F.col("t"), 3).alias("cites"), fn.strict_boolean(F.lit("yes")).alias("flag"), fn.to_number(F.lit(" 4.5 ")).alias("num"),
        fn.object_key(F.lit("/x"), "docs/").alias("key"), fn.fault_class(F.lit("CUDA error")).alias("fault"), fn.regex_escape(F.lit("a.b(c)")).alias("rx"),
    ).first()
    assert row.asDict() == {
        "ip": "5.6.7.8", "mask": "9.8.x.x", "title": "A B CD Document", "cut": "one two…", "cites": [0, 1], "flag": None, "num": 4.5, "key": "docs/x", "fault": "runner", "rx": r"a\.b\(c\)",
    }


def test_identities(spark):
    df = spark.createDataFrame([(True, True, None, None, None), (None, None, None, True, True), (None,) * 5], "a boolean, s boolean, b boolean, u boolean, t boolean")
    assert [r[0] for r in df.select(events.actor_class(*map(F.col, "asbut"))).collect()] == ["api-key", "user", "anonymous"]


def test_sources(spark, tmp_path):
    good = tmp_path / "l.jsonl"
    good.write_text('# c\n{"documentId":"1","phrase":"p"}\n\n{"documentId":"2","phrase":"q","note":"n"}\n')
    assert [(r.line, r.document_id) for r in readers.labels(spark, str(good)).orderBy("line").collect()] == [(2, "1"), (4, "2")]
    good.write_text('{"documentId":"1","phrase":"p"}\n{oops\n')
    with pytest.raises(Exception, match="line 2"):
        readers.labels(spark, str(good)).collect()
    docs = spark.createDataFrame([(1, 'a "q"\n\nb')], "id int, text string")
    back = readers.ndjson_blocks(readers.ndjson_body(docs, "id", "text")).orderBy("block_no").collect()
    assert [r.block for r in back] == ['a "q"', "b"]
    magic = spark.createDataFrame([(bytearray(b"%PDF-1.7"),), (bytearray(b"zz"),)], "c binary")
    assert [r[0] for r in magic.select(readers.sniff(F.col("c"))).collect()] == ["pdf", "unknown"]
    body = spark.createDataFrame([('[{"meta":1,"searchResults":[{"id":"a"}]}]',)], "b string")
    assert readers.envelope(body, "b", "id:string").collect()[0].id == "a"
    with pytest.raises(Exception, match="searchResults"):
        readers.envelope(spark.createDataFrame([("[{}]",)], "b string"), "b", "id:string").collect()
    with pytest.raises(ValueError):
        readers.counted(docs, 2)
    with pytest.raises(ValueError):
        readers.parameterised(spark, "SELECT 1", {})
    queue = spark.createDataFrame([("7",), ('{"documentId":"8"}',)], "value string")
    assert [r[0] for r in readers.queue_ids(queue).collect()] == ["7", "8"]


def test_streams(spark, tmp_path):
    from corpuslake.streaming import streams

    source, target = tmp_path / "in", str(tmp_path / "t")
    source.mkdir()
    schema = "id string, v int, _ts long, deleted boolean"
    write = lambda name, rows: (source / name).write_text("\n".join(rows))
    write("a.json", ['{"id":"1","v":1,"_ts":1}', '{"id":"2","v":1,"_ts":1}'])
    run = lambda: streams.upsert_stream(streams.read_changes(spark, str(source), schema), target, str(tmp_path / "c")).awaitTermination()
    run()
    write("b.json", ['{"id":"2","v":5,"_ts":2}', '{"id":"1","_ts":3,"deleted":true}', '{"id":"2","v":5,"_ts":2}'])
    run()
    assert [(r.id, r.v) for r in streams.current(spark, target).collect()] == [("2", 5)]

    events_in, out = tmp_path / "e", str(tmp_path / "o")
    base = dt.datetime(2024, 1, 1)
    data = [(i % 50, base + dt.timedelta(minutes=7 * (i % 50)), i % 3, "view", 1.0) for i in range(60)]
    spark.createDataFrame(data, "event_id long, ts timestamp, user_id long, event_type string, value double").coalesce(1).write.parquet(str(events_in))
    live = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double").parquet(str(events_in))
    streams.drain(streams.deduplicated(live, late="2 days"), out, str(tmp_path / "c2"))
    assert spark.read.parquet(out).count() == 50
    rolled = str(tmp_path / "r")
    streams.drain(streams.rollup_stream(live, ["event_type"], late="0 seconds"), rolled, str(tmp_path / "c3"))
    # The last event is at 5:43, so that the hours 0 to 4 are closed: 43 of the 50 events, ten of them twice.
    assert spark.read.parquet(rolled).agg(F.sum("events")).first()[0] == 53


def test_shapes_hide_what_is_internal(spark):
    from corpuslake.operators import shape

    rows = spark.createDataFrame([(1, ("f", "x")), (2, (None, "x")), (3, None)], "id int, sources struct<wildfire:string,registry:string>")
    assert [r["sources"] and r["sources"].asDict() for r in shape.public_view(rows).orderBy("id").collect()] == [{"wildfire": "f"}, None, None]
    assert shape.public_view(rows.select("id", F.struct(F.lit(1).alias("registry")).alias("sources"))).columns == ["id"]
    assert shape.redact(spark.createDataFrame([(1, "h")], "id int, hash string")).columns == ["id"]


def test_an_oversized_keyword_page_is_refused(spark):
    with pytest.raises(ValueError, match="500"):
        search.keyword_page(spark.range(3), [F.asc("id")], top=501)


def test_several_changes_of_a_key_multiply_nothing(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    changes = spark.createDataFrame([(1, "x", 2), (1, "z", 1), (3, "new", 1)], "id int, name string, at int")
    assert sorted(map(tuple, mutate.patch(stored, changes, ["name"], order="at").collect())) == [(1, "x"), (2, "b")]
    assert sorted(map(tuple, mutate.patch(stored, changes, ["name"]).collect())) == [(1, "z"), (2, "b")]
