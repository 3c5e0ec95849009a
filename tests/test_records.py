"""Sources, sinks and rules of records: retries and truncation, failing tasks, keyed digests, faults of phrases, routes, writes."""

import datetime as dt
import hashlib
import hmac
import http.server
import json
import random
import threading
import unicodedata

import pytest
from pyspark.sql import functions as F

from corpuslake.operators import access as acl
from corpuslake.operators import evaluate, events, geo, mutate, search, shape, summary, text
from corpuslake.sources import jsonl, readers
from corpuslake.sources.paged import PagedSource


def answers(total, size, items=None):
    rows = items if items is not None else [{"id": f"r{i}", "v": i} for i in range(total)]
    return lambda page: json.dumps([{"meta": [{"searchResultsTotal": total}], "searchResults": rows[page * size : page * size + size]}])


@pytest.fixture
def server():
    """A server whose pages and failures a test sets."""
    state = {"page": answers(0, 1), "fail": {}, "asked": []}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            page = int(self.path.split("page=")[1].split("&")[0])
            state["asked"].append(page)
            left = state["fail"].get(page, 0)
            state["fail"][page] = left - 1
            body = state["page"](page).encode()
            self.send_response(503 if left > 0 else 200)
            self.end_headers()
            self.wfile.write(b"busy" if left > 0 else body)

        def log_message(self, *args):
            pass

    running = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=running.serve_forever, daemon=True).start()
    state["url"] = f"http://127.0.0.1:{running.server_port}/search?page={{page}}&size={{size}}"
    yield state
    running.shutdown()


def paged(spark, url, **options):
    spark.dataSource.register(PagedSource)
    return spark.read.format("paged").option("url", url).options(**options).load()


def test_pages_are_planned_from_the_first_answer(spark, server):
    server["page"], server["fail"] = answers(23, 10), {1: 2}
    rows = paged(spark, server["url"], size="10")
    assert rows.rdd.getNumPartitions() == 3
    assert sorted((r["id"], r["page"], r["total"]) for r in rows.collect()) == sorted((f"r{i}", i // 10, 23) for i in range(23))
    assert server["asked"].count(1) >= 3  # two failures were asked again
    for total in (0, 10, 20):
        server["page"] = answers(total, 10)
        assert paged(spark, server["url"], size="10").count() == total


def test_a_truncated_page_fails_the_read(spark, server):
    server["page"] = answers(25, 10, [{"id": f"r{i}"} for i in range(24)])
    with pytest.raises(Exception, match="page 2 .* has 4 rows where the total of 25 leaves 5"):
        paged(spark, server["url"], size="10").collect()
    server["page"] = lambda page: "{}"
    with pytest.raises(Exception, match="no list of results"):
        paged(spark, server["url"], size="10").collect()
    server["page"], server["fail"] = answers(20, 10), {1: 99}
    with pytest.raises(Exception, match="503"):
        paged(spark, server["url"], size="10", retries="1").collect()


def test_without_a_total_pages_are_read_to_a_short_one(spark, server):
    server["page"] = lambda page: json.dumps({"searchResults": [{"id": page * 10 + i} for i in range(10 if page < 2 else 3)]})
    rows = paged(spark, server["url"], size="10")
    assert rows.rdd.getNumPartitions() == 1 and sorted(int(r["id"]) for r in rows.collect()) == list(range(23))


def test_pages_of_files(spark, tmp_path):
    for page in range(3):
        (tmp_path / f"p{page}.json").write_text(answers(25, 10)(page))
    assert paged(spark, f"{tmp_path}/p{{page}}.json", size="10").count() == 25


def dumped(folder):
    return sorted(line for f in folder.iterdir() if f.name.startswith("part-") for line in f.read_text().splitlines())


def test_a_dump_keeps_whole_rows_and_appends(spark, tmp_path):
    spark.dataSource.register(jsonl.JsonLines)
    rows = spark.createDataFrame([(1, 'a "q"\né', None, dt.date(2024, 1, 2), bytearray(b"\x01"), [1, None], {"k": 1.5})], "id int, t string, n string, d date, b binary, l array<int>, m map<string,double>")
    for n in (1, 2):
        rows.write.format("jsonl").mode("append").save(str(tmp_path))
        assert len(dumped(tmp_path)) == n
    got = json.loads(dumped(tmp_path)[0])
    assert got == {"id": 1, "t": 'a "q"\né', "n": None, "d": "2024-01-02", "b": "01", "l": [1, None], "m": [["k", 1.5]]} or got["m"] == {"k": 1.5}
    rows.write.format("jsonl").mode("overwrite").save(str(tmp_path))
    assert len(dumped(tmp_path)) == 1 and all(f.name.startswith("part-") for f in tmp_path.iterdir())


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(jsonl.JsonLines)
    good = spark.range(0, 100, 1, 4).select("id")
    good.write.format("jsonl").mode("append").save(str(tmp_path))
    bad = good.select(F.when(F.col("id") == 99, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="broken"):
        bad.write.format("jsonl").mode("append").save(str(tmp_path))
    assert len(dumped(tmp_path)) == 100 and all(f.name.startswith("part-") for f in tmp_path.iterdir())


def test_an_attempt_that_was_lost_is_not_committed(tmp_path):
    """Two attempts of a task wrote; the driver heard of one."""
    import pyarrow as pa

    writer = jsonl.JsonLinesWriter(str(tmp_path), False)
    batch = pa.RecordBatch.from_pydict({"id": [1, 2]})
    writer.write(iter([batch]))
    kept = writer.write(iter([batch]))
    writer.commit([kept, None])
    assert dumped(tmp_path) == ['{"id": 1}', '{"id": 2}'] and len(list(tmp_path.iterdir())) == 1


def test_digests_equal_the_standard_ones(spark):
    draw = random.Random(3)
    pairs = [(bytes(draw.randrange(256) for _ in range(n)), bytes(draw.randrange(256) for _ in range(m))) for n in (0, 1, 31, 32, 63, 64, 65, 200) for m in (0, 1, 100)]
    df = spark.createDataFrame([(bytearray(k), bytearray(m)) for k, m in pairs] + [(None, bytearray(b"x")), (bytearray(b"x"), None)], "k binary, m binary")
    made = df.select("k", "m", events.hmac_sha256(F.col("k"), F.col("m")).alias("h"))
    assert [r["h"] for r in made.collect()] == [hmac.new(k, m, hashlib.sha256).hexdigest() for k, m in pairs] + [None, None]
    assert "Python" not in made._jdf.queryExecution().executedPlan().toString()


def test_pseudonyms_live_for_a_day(spark):
    at = lambda day, hour: dt.datetime(2024, 1, day, hour)
    salts = spark.createDataFrame([(at(1, 2), bytearray(b"a")), (at(1, 12), bytearray(b"b")), (at(2, 0), bytearray(b"c"))], "since timestamp, salt binary")
    rows = spark.createDataFrame([(1, at(1, 1)), (1, at(1, 2)), (1, at(1, 11)), (1, at(1, 12)), (1, at(2, 5)), (1, at(3, 5)), (None, at(1, 3))], "user_id int, ts timestamp")
    got = [r["pseudonym"] for r in events.with_pseudonyms(rows, salts).orderBy(F.col("user_id").isNull(), "ts").collect()]
    digest = lambda k: hmac.new(k, b"1", hashlib.sha256).hexdigest()[:32]
    assert got == [None, digest(b"a"), digest(b"a"), digest(b"b"), digest(b"c"), None, None]


def place_by_hand(text_, phrase):
    """The fold, sign by sign: positions of letters, and separators that stand between two of them."""
    def parts(t):
        form = unicodedata.normalize("NFKD", t)
        kind = lambda c: unicodedata.category(c)[0]
        return form, [(i, c.lower()) for i, c in enumerate(form) if kind(c) not in "MPSZ" and not c.isspace()], lambda a, b: sum(1 for x, y in zip(range(a, b), range(a + 1, b + 1), strict=True) if (kind(form[x]) in "PSZ" or form[x].isspace()) and not (kind(form[y]) in "PSZM" or form[y].isspace()))

    form, letters, gaps = parts(text_)
    _, needle, own = parts(phrase)
    at = "".join(c for _, c in letters).find("".join(c for _, c in needle))
    first, last = letters[at][0], letters[at + len(needle) - 1][0]
    more = gaps(first, last) - own(needle[0][0], needle[-1][0])
    return ("joined" if more < 0 else "split" if more > 0 else "other", " ".join(form[max(0, first - 40) : last + 41].split()))


def test_kinds_and_evidence_of_generated_faults(spark):
    draw = random.Random(6)
    words = ["Tumbler", "ridge", "café", "12", "naïve", "to", "voice", "ﬁre", "Ünder"]
    rows = []
    for i in range(150):
        phrase = [draw.choice(words) for _ in range(draw.randrange(2, 5))]
        kind = draw.choice(["joined", "split", "other"])
        if kind == "joined":
            shown = "".join(phrase)
        elif kind == "split":
            shown = " ".join(" ".join(w) if k == 0 else w for k, w in enumerate(phrase))
        else:
            shown = "".join(phrase[:2]) + " " + " ".join([*phrase[2:], ""]).strip() if len(phrase) > 2 else phrase[0][:1] + " " + phrase[0][1:] + phrase[1]
        around = lambda: " ".join(draw.choice(["zz", "–", "y y", "q.q", "\n"]) for _ in range(draw.randrange(0, 25)))
        rows.append((i, f"{around()} {shown} {around()}", " ".join(phrase)))
    df = spark.createDataFrame([*rows, (900, "nothing here", "absent"), (901, None, "x"), (902, "x", None)], "i int, t string, p string")
    got = {r["i"]: (r["e"]["kind"], r["e"]["evidence"]) for r in df.select("i", text.fault_evidence(F.col("t"), F.col("p")).alias("e")).collect()}
    assert all(got[i] == place_by_hand(t, p) for i, t, p in rows) and {got[i][0] for i in range(150)} == {"joined", "split", "other"}
    assert all(got[i] == (None, None) for i in (900, 901, 902))
    long = "a" * 100 + " to voicemy " + "b" * 100
    one = spark.createDataFrame([(long, "tovoice my")], "t string, p string").select(text.fault_evidence(F.col("t"), F.col("p")).alias("e")).first()["e"]
    assert one["evidence"] == "a" * 39 + " to voicemy " + "b" * 39 and one["kind"] == "other"


def test_presence_tells_the_kind_and_the_place(spark):
    labels = spark.createDataFrame([(1, 1, "to voice my"), (2, 2, "Tumbler Ridge"), (3, 3, "seam here")], "label_id int, document_id int, phrase string")
    chunks = spark.createDataFrame([(1, 0, "x"), (1, 1, "before tovoicemy after"), (2, 0, "the Tum ble r Ridge town"), (3, 0, "a se"), (3, 1, "amhere b")], "document_id int, chunk_index int, content string")
    got = {r["label_id"]: (r["class"], r["despaced_kind"], r["evidence"]) for r in text.presence(labels, chunks).collect()}
    assert got == {1: ("despaced", "joined", "before tovoicemy after"), 2: ("despaced", "split", "the Tum ble r Ridge town"), 3: ("straddle-despaced", "other", None)}


def test_measures_know_all_white_space_and_the_longest_run(spark):
    rows = [("a b c",), ("xxxx yyyyyy\nzzzz",), ("a\n\n\n\n\nb",), ("ab" * 9,), (None,)]
    got = text.measure(spark.createDataFrame(rows, "text string")).collect()
    assert [r["token_count"] for r in got] == [3, 3, 2, 1, 0] and [r["max_repeat"] for r in got] == [0, 6, 0, 0, 0]
    assert got[0]["alpha_ratio"] == 1.0 and got[0]["non_ascii_ratio"] == 0.0


def test_projects_are_asked_for_in_either_id_space(spark):
    hex24 = "0123456789abcdefABCDEF01"
    assert search.project_ids({"project": "1, 2,1", "and[project]": "3", "and": {"project": ["2", hex24]}}) in (["1", "2", "3"], ["1", "2", hex24])
    rows = spark.createDataFrame([(1, "10"), (2, "11"), (3, None)], "id int, project_id string")
    projects = spark.createDataFrame([("10", hex24.lower()), ("11", None)], "id string, external_id string")
    ask = lambda *ids: sorted(r["id"] for r in search.of_projects(rows, list(ids), projects).collect())
    assert ask() == [1, 2, 3] and ask("10") == [1] and ask(hex24) == [1] and ask(hex24, "11") == [1, 2]
    assert ask("99") == [] and ask(hex24, "f" * 24) == [] and ask("10", "f" * 24) == []


def test_overlays_replace_booleans_by_booleans_only(spark):
    frame = lambda rows: spark.createDataFrame(rows, "key string, j string").select("key", F.parse_json("j").alias("value"))
    defaults = frame([("a", "true"), ("b", "false"), ("c", '"x"'), ("d", "1"), ("e", "2"), ("f", "null"), ("g", "true")])
    stored = frame([("a", '"false"'), ("b", "true"), ("c", "false"), ("d", "null"), ("e", '{"k":[1]}'), ("f", "5"), ("h", "1")])
    got = {r["key"]: r["v"] for r in shape.overlay(defaults, stored, list("abcdefh")).select("key", F.to_json("value").alias("v")).collect()}
    assert got == {"a": "true", "b": "true", "c": "false", "d": "1", "e": '{"k":[1]}', "f": "5", "g": "true"}


def test_boundaries(spark):
    asked = spark.createDataFrame([("t", "n", None, "g", None), ("t", "hidden", "c", None, False), (None, "x", None, None, None), ("t", "", None, None, None)], "type string, name string, code string, geometry string, is_published boolean")
    rows, refused = mutate.created_boundaries(asked, F.lit("now"))
    public = ["public", *acl.SECURE_ROLES]
    assert refused.count() == 2
    assert sorted((r["id"], r["code"], r["is_published"], r["read"]) for r in rows.collect()) == [("t_hidden", "c", False, list(acl.SECURE_ROLES)), ("t_n", "", True, public)]
    changes = spark.createDataFrame([("t_n", None, False), ("t_hidden", "new", None), ("t_none", "x", None)], "id string, name string, is_published boolean")
    got = {r["id"]: (r["name"], r["type"], r["is_published"], r["read"], r["geometry"]) for r in mutate.updated_boundaries(rows, changes, F.lit("later")).collect()}
    assert got == {"t_n": ("n", "t", False, list(acl.SECURE_ROLES), "g"), "t_hidden": ("new", "t", False, list(acl.SECURE_ROLES), None)}


def test_points_and_probed_pages(spark):
    rows = [(["-120.5", "50"],), (["x", "1"],), (["1"],), (["1", "2", "3"],), (None,), (["NaN", "1"],), (["Infinity", "1"],)]
    got = [r[0] for r in spark.createDataFrame(rows, "c array<string>").select(geo.point_or_default(F.col("c"))).collect()]
    assert got == [[-120.5, 50.0]] + [[-125.0, 54.0]] * 6
    n = spark.createDataFrame([(i,) for i in (0, 1, 19, 20, 21, 39, 40, 100, 3001)], "n int")
    probed = {r["n"]: (r["a"], r["b"]) for r in n.select("n", text.probed_pages(F.col("n")).alias("a"), text.evenly_probed_pages(F.col("n")).alias("b")).collect()}
    assert all(a == list(range(0, i, max(1, i // 20))) and sorted(b) == text.sampled_pages(i) for i, (a, b) in probed.items())


def test_routes(spark):
    case = "n int, m double, s double, size int, layer string, read string, open boolean"
    rows = [(9, 900.0, 0.9, 10, "x", None, None), (9, 0.0, 0.0, 10**6, "x", "found", True), (9, 0.0, 0.0, 10**6, "x", "<!-- image --> ", True), (None, None, None, 5, None, "found", True), (None, None, None, 5, None, None, False), (9, 900.0, 0.9, 300_000, "little", "more", True)]
    df = spark.createDataFrame(rows, case)
    made = lambda on: [tuple(r[0]) for r in df.select(text.outcome(*map(F.col, ("n", "m", "s", "size", "layer", "read", "open")), enabled=on)).collect()]
    assert made(True) == [("text", None), ("ocr", "probe says text-poor"), ("ocr-empty", "probe says text-poor; OCR found no text"), ("ocr", "probe failed"), ("skip", "probe failed"), ("ocr", "low yield (6 chars from 292 KB)")]
    assert [r[0] for r in made(False)] == ["text", "skip", "skip", "skip", "skip", "skip"] and made(False)[3][1] == "probe failed; OCR disabled"


def test_summaries_and_their_reasons(spark):
    questions = spark.createDataFrame([(1, "water quality", True), (2, " ", True), (3, "water", True), (4, "water", False), (5, "lava", True)], "question_id int, keywords string, enabled boolean")
    hits = spark.createDataFrame([(1, 2, "Water quality is good. Nothing here! Quality of water is good"), (1, 1, "The water was tested. Water tests took a year"), (4, 1, "water"), (5, 1, "Snow. Ice"), (2, 1, "x")], "question_id int, rank int, content string")
    got = {r["question_id"]: (r["summary"], r["citations"], r["reason"]) for r in summary.summaries(questions, hits).collect()}
    assert got[2] == (None, [], "no_query") and got[3] == (None, [], "no_results") and got[4] == (None, [], "disabled") and got[5] == (None, [], "no_results")
    assert got[1] == ("The water was tested [1]. Water tests took a year [1]. Water quality is good [2].", [1, 2], None)
    other = lambda asked: asked.select("question_id", F.lit("said").alias("summary"), F.array(F.lit(1)).alias("citations"))
    assert {r["question_id"]: r["summary"] for r in summary.summaries(questions, hits, other).collect()} == {1: "said", 2: None, 3: None, 4: None, 5: "said"}


def test_scorecards(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"started": "2024-02-01", "results": [{"documentId": "a", "phrase": "p", "rank": 3}, {"documentId": "a", "phrase": "p", "rank": 1}, {"documentId": "b", "phrase": "q", "rank": None}]}))
    ranks = readers.scorecard(spark, str(tmp_path / "s.json"))
    labels = spark.createDataFrame([("a", "p"), ("b", "q"), ("c", "r")], "document_id string, phrase string")
    chunks = spark.createDataFrame([("a", "2024-01-01"), ("a", "2024-03-01"), ("b", None)], "document_id string, extracted_at string")
    got = {r["document_id"]: (r["rank"], r["chunk_count"], r["newest_extracted_at"], r["stale"]) for r in evaluate.with_ranks(labels, ranks, chunks).collect()}
    assert got == {"a": (1, 2, "2024-03-01", True), "b": (None, 1, None, False), "c": (None, 0, None, False)}


def test_fires_keep_their_row_over_runs(spark):
    schema = "fire_number string, fire_year int, incident_name string, geographic_description string, fire_status string, fire_cause string, current_size double, fire_url string, fire_of_note string, lng double, lat double"
    points = spark.createDataFrame([("F1", None, None, "Hill", None, "", None, None, "Y", 1.0, 2.0), (None, 2024, None, None, "Out", None, 3.5, "u", "N", 5.0, 6.0), ("F1", None, None, "Hill", None, "", None, None, "Y", 1.0, 2.0)], schema)
    shapes = spark.createDataFrame([("F1", "old"), ("F1", "shape"), (None, "z")], "fire_number string, geometry string")
    run = lambda: mutate.wildfires(points, shapes, F.lit("2026-01-01").cast("timestamp")).orderBy("lng").collect()
    first, second = run()
    assert (first["id"], first["fire_year"], first["incident_name"], first["fire_status"], first["fire_cause"], first["size_ha"], first["of_note"], first["perimeter"]) == ("F1", 2026, "Hill", "Unknown", "Unknown", 0.0, True, "shape")
    assert second["id"].startswith("UNKNOWN_") and second["incident_name"] == second["id"] and second["perimeter"] is None and [r["id"] for r in run()] == [first["id"], second["id"]]


def test_conditions_are_joined_and_their_names_kept_apart():
    a, b = acl.Fragment("x = :x", {"x": 1}), acl.Fragment("y = :y", {"y": 2})
    assert acl.joined(a, None, acl.Fragment("true"), b) == acl.Fragment("(x = :x) AND (y = :y)", {"x": 1, "y": 2})
    assert acl.joined() == acl.Fragment("true") and acl.joined(a, acl.Fragment("false", {"z": 1})) == acl.Fragment("false")
    with pytest.raises(ValueError, match="one name: x"):
        acl.joined(a, acl.Fragment("z = :x", {"x": 3}))


def test_what_may_be_logged(spark):
    row = spark.createDataFrame([("t", "search", "p", "dev", "1.2.3.4", "words")], "time_generated string, event_name string, project_id string, env string, source_ip string, search_term string")
    assert events.redact(row, "audit").columns == ["time_generated", "event_name", "project_id", "env", "search_term"]
    assert events.redact(row, "events").columns == ["time_generated", "event_name", "project_id", "env"]


def test_requests_are_rows_with_an_escaped_line(spark):
    schema = "method string, url string, status int, duration_ms double, bytes long, forwarded string, remote string, user string, key_id string, client string"
    rows = spark.createDataFrame([("GET", "/s?q=50%off", 200, 1.5, 10, None, "9.9.9.9", None, None, None), ("POST", "/x%y", 503, 2.0, None, "1.1.1.1, 2.2.2.2:80", "r", "ann", "k1", "web")], schema)
    first, second = events.request_rows(rows).orderBy("status").collect()
    assert (first["path"], first["level"], first["principal"], first["message"]) == ("/s", "info", "anonymous", "GET /s?q=50%25off 200 - 10 B - 1.5ms (IP: 9.9.9.9, as: anonymous)")
    assert (second["path"], second["level"], second["ip"], second["message"]) == ("/x%y", "error", "2.2.2.2", "POST /x%25y 503 - - B - 2.0ms (IP: 2.2.2.2, as: ann key=k1)")


def test_tiles_give_each_line_once(spark):
    rows = [(1, 1, "b\nc\n<!-- image -->"), (1, 0, "a\n b \n\n"), (2, 0, "<!-- image -->"), (2, 1, None)]
    got = {r["p"]: r["text"] for r in text.tiled_text(spark.createDataFrame(rows, "p int, t int, text string"), "p", "t").collect()}
    assert got == {1: "a\n\nb\n\nc", 2: ""}


def test_the_second_source_stands_in_for_an_unusable_first(spark):
    rows = [("-120", "50", ["1", "2"]), ("120", "50", None), ("x", "50", ["-121", "51"]), (" ", None, ["-121", "51"]), (None, None, ["-121"]), ("1", "2", ["3", "4"])]
    got = [r[0] and tuple(r[0]) for r in spark.createDataFrame(rows, "x string, y string, o array<string>").select(geo.centroid(F.col("x"), F.col("y"), F.col("o"))).collect()]
    assert got == [(-120.0, 50.0), (-120.0, 50.0), (-121.0, 51.0), (-121.0, 51.0), None, None]


def test_documents_are_created_below_a_readable_project(spark):
    parents = spark.createDataFrame([("p", ["public", "staff"]), ("q", ["staff"])], "id string, read array<string>")
    asked = spark.createDataFrame([("1", "p", " a ", True), ("2", "q", "b", True), ("3", "none", "c", True), ("4", "p", " ", True), ("5", "p", "d", None)], "id string, project_id string, name string, is_published boolean")
    rows, refused = mutate.new_documents(asked, parents, F.lit("now"))
    assert sorted((r["id"], r["name"], r["is_published"], "public" in r["read"]) for r in rows.collect()) == [("1", "a", True, True), ("2", "b", False, False), ("5", "d", False, False)]
    assert sorted(r["id"] for r in refused.collect()) == ["3", "4"] and refused.columns == asked.columns


def test_repeated_parents_and_targets_multiply_nothing(spark):
    children = spark.createDataFrame([(1, "p", ["x"], True), (2, "q", ["x"], True)], "id int, project_id string, read array<string>, is_published boolean")
    parents = spark.createDataFrame([("p", ["a"], False, 1), ("p", ["b"], False, 2)], "id string, read array<string>, is_published boolean, at int")
    assert sorted((r["id"], r["read"], r["is_published"]) for r in mutate.cascade_acl(children, parents, "project_id", order="at").collect()) == [(1, ["b"], False), (2, ["x"], True)]
    files = spark.createDataFrame([("k", 1), ("k", 2), ("m", 1)], "key string, size int")
    assert sorted(map(tuple, mutate.copy_plan(files.filter("size = 2 OR key = 'm'"), files).collect())) == [("k", "skip"), ("m", "skip")]


def test_lists_and_facets(spark):
    rows = spark.createDataFrame([(i, " a " if i % 2 else None) for i in range(1200)], "id int, kind string")
    assert [r["id"] for r in search.list_page(rows, [F.asc("id")], 500, 900).collect()] == list(range(900, 1000))
    fields = {"kind": search.FieldSpec("kind", facetable=True), "id": search.FieldSpec("id")}
    assert [tuple(r) for r in search.facets(rows, fields, ["kind"]).collect()] == [("kind", "a", 600)]
    with pytest.raises(ValueError, match="no facets: id"):
        search.facets(rows, fields, ["kind", "id"])


def test_windows_of_streams(spark, tmp_path):
    """The sliding day and the tumbling minute over a stream give the windows that are closed, as over a table."""
    from corpuslake.streaming import streams

    base = dt.datetime(2024, 1, 1)
    rows = [(i % 3, base + dt.timedelta(seconds=20 * i), 1.0) for i in range(600)] + [(9, base + dt.timedelta(days=3), 0.0)]
    spark.createDataFrame(rows, "user_id int, ts timestamp, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema("user_id int, ts timestamp, value double").parquet(str(tmp_path / "in"))
    streams.drain(streams.rate_stream(live, "user_id", limit=0), str(tmp_path / "rate"), str(tmp_path / "c1"))
    got = spark.read.parquet(str(tmp_path / "rate"))
    assert got.agg(F.sum("n")).first()[0] == 600 and got.filter("n != 1").count() == 0
    streams.drain(streams.usage_stream(live, quota=700, share=0.8), str(tmp_path / "use"), str(tmp_path / "c2"))
    used = {(r["start"], r["used"]) for r in spark.read.parquet(str(tmp_path / "use")).collect()}
    assert used == {(base - dt.timedelta(hours=h), 600.0) for h in range(20, -1, -1)} | {x for x in used if x[1] < 600} and all(560 < n <= 600 for _, n in used)
