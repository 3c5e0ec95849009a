"""The incremental chunker and the bounded buffer: as tables, as streams, over restarts."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from corpuslake.operators import chunk
from corpuslake.streaming import stateful

SECTIONS = "document_id string, seq long, section string, last boolean"


@pytest.fixture
def store(spark):
    name, value = stateful.STORE
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    yield
    spark.conf.set(name, before)


def sections_of(seed):
    """{document: sections}: the cases at which blocks, tails, splits and furniture meet."""
    draw = random.Random(seed)
    para = lambda n, ch="x": (ch * 7 + " ") * (n // 8)
    docs = {
        "tiny": ["Tiny."], "head": ["# Heading", "Short line.", "Another short one."], "many": [para(300, chr(97 + i)) for i in range(20)],
        "huge": [para(10_000)], "tail": [*[para(2400)] * 5, "tail"], "tail2": [*[para(2600)] * 3, para(500)], "tail3": [*[para(2600)] * 3, "tail"],
        "blank": ["", "  \n ", "a", None, "b"], "none": [""], "image": ["<!-- image -->", "a <!-- Image --> b"], "rule": [para(2600), "-" * 2600, para(2600)], "nbsp": ["  word  ", "x"],
        "inner": ["one\n\n\ntwo", "three\n\nfour"],
    }
    for i in range(12):
        docs[f"mixed{i}"] = [draw.choice("abc.-") * draw.choice([1, 50, 99, 100, 900, 2600, 5000]) for _ in range(draw.randrange(1, 12))]
    return docs


def whole(spark, docs):
    rows = [(d, "\n\n".join(s or "" for s in parts)) for d, parts in docs.items()]
    return sorted(map(tuple, chunk.chunk_documents(spark.createDataFrame(rows, "document_id string, text string")).collect()))


def test_sections_of_a_table_give_the_chunks_of_the_whole(spark, store):
    docs = sections_of(1)
    rows = [(d, i, s, i == len(parts) - 1) for d, parts in docs.items() for i, s in enumerate(parts)]
    random.Random(5).shuffle(rows)
    got = stateful.chunk_sections(spark.createDataFrame(rows, SECTIONS).repartition(3))
    assert sorted(map(tuple, got.collect())) == whole(spark, docs)


@pytest.mark.parametrize("seed", [2, 3])
def test_any_split_over_triggers_and_restarts_gives_the_same_chunks(spark, store, tmp_path, seed):
    docs, draw = sections_of(seed), random.Random(seed)
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    left = {d: [(d, i, s, i == len(parts) - 1) for i, s in enumerate(parts)] for d, parts in docs.items()}
    n = 0
    while any(left.values()):
        for _ in range(2):  # two triggers a run, then a restart
            lines = []
            for d, rows in left.items():
                take = draw.choice([0, 1, 1, 2, 5])
                now, left[d] = rows[:take], rows[take:]
                again = now[:1] if draw.random() < 0.3 and not (now and now[-1][3]) else []  # a repeated section of an open document
                lines += [json.dumps(dict(zip(("document_id", "seq", "section", "last"), r, strict=True))) for r in [*now[::-1], *again]]
            (source / f"{n:03}.json").write_text("\n".join(lines))
            os.utime(source / f"{n:03}.json", (time.time() + n, time.time() + n))  # files are taken by their time
            n += 1
        live = spark.readStream.schema(SECTIONS).option("maxFilesPerTrigger", 1).json(str(source))
        query = stateful.chunk_sections(live).writeStream.format("parquet").option("checkpointLocation", state).option("path", out).trigger(availableNow=True).start()
        query.awaitTermination()
    assert n > 4
    assert sorted(map(tuple, spark.read.parquet(out).select("id", "document_id", "page_number", "chunk_index", "content").collect())) == whole(spark, docs)


def test_the_chunker_holds_two_blocks_at_most():
    chunker = stateful._Chunker(None)
    for _ in range(500):
        list(chunker.section("word " * 300))
        assert sum(len(x or "") for x in chunker.state if isinstance(x, str)) < 2 * (chunk.TARGET + 1502) + chunk.OVERLAP


def test_both_furniture_rules_agree(spark):
    draw = random.Random(8)
    texts = ["".join(draw.choice(["....", "____", "abc ", " ", "12 ", "·····", "é", "-"]) for _ in range(draw.randrange(1, 30))) for _ in range(300)]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(chunk.furniture(F.col("t"))).collect()]
    assert got == [stateful._furniture(t) for t in texts] and 0 < sum(got) < 300


def batches(rows, most_rows, most_bytes):
    """A plain version of the buffer: [[seq]]."""
    out, now, size = [], [], 2
    for seq, row in rows:
        own = len(row.encode()) + 1
        if now and (len(now) >= most_rows or size + own > most_bytes):
            out.append(now)
            now, size = [], 2
        now.append(seq)
        size += own
    return [*out, now] if now else out


def drawn(seed, n=400):
    draw = random.Random(seed)
    return {s: [(i, draw.choice("aé") * draw.randrange(0, 30)) for i in range(n)] for s in ("s", "t")}


def grouped(rows):
    out = {}
    for r in rows:
        out.setdefault((r["stream"], r["batch"]), []).append(r["seq"])
    return {s: [sorted(v) for (own, _), v in sorted(out.items()) if own == s] for s in {k[0] for k in out}}


def test_a_table_is_batched_as_the_plain_version(spark, store):
    rows = drawn(1)
    df = spark.createDataFrame([(s, i, t) for s, own in rows.items() for i, t in own], "stream string, seq long, row string").repartition(4)
    got = grouped(stateful.buffered(df, "stream", "seq", "row", most_rows=10, most_bytes=150).collect())
    assert got == {s: batches(own, 10, 150) for s, own in rows.items()}


def test_a_stream_is_batched_alike_and_loses_nothing_on_restart(spark, store, tmp_path):
    rows, source, out, state = drawn(2), tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()

    def live(wait_ms):
        files = spark.readStream.schema("stream string, seq long, row string").option("maxFilesPerTrigger", 1).json(str(source))
        made = stateful.buffered(files, "stream", "seq", "row", most_rows=10, most_bytes=150, wait_ms=wait_ms)
        return made.writeStream.format("parquet").option("checkpointLocation", state).option("path", out)

    for n in range(4):
        lines = [json.dumps({"stream": s, "seq": i, "row": t}) for s, own in rows.items() for i, t in own[n * 100 : n * 100 + 100]]
        (source / f"{n}.json").write_text("\n".join(lines))
        os.utime(source / f"{n}.json", (time.time() + n, time.time() + n))
        if n % 2:
            query = live(3_600_000).start()  # timers of processing time keep a query going, so that it is stopped when all rows were read
            try:
                seen, until = 0, time.time() + 60
                while seen < 400 and time.time() < until:
                    seen = sum(p["numInputRows"] for p in query.recentProgress)
                    time.sleep(0.2)
            finally:
                query.stop()
    want = {s: batches(own, 10, 150) for s, own in rows.items()}
    got = grouped(spark.read.parquet(out).collect())
    open_ = {s: b if len(got[s]) == len(b) else b[:-1] for s, b in want.items()}
    assert got == open_ and any(len(got[s]) < len(want[s]) for s in want)


def test_a_waiting_row_is_released_by_its_timer(spark, store, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "0.json").write_text("\n".join(json.dumps({"stream": "s", "seq": i, "row": "x"}) for i in range(3)))
    files = spark.readStream.schema("stream string, seq long, row string").json(str(source))
    query = stateful.buffered(files, "stream", "seq", "row", wait_ms=300).writeStream.format("memory").queryName("released").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(100):
            if spark.table("released").count() == 3:
                break
            time.sleep(0.3)
        assert [tuple(r) for r in spark.table("released").orderBy("seq").select("stream", "batch", "seq").collect()] == [("s", 0, i) for i in range(3)]
    finally:
        query.stop()
