"""Chat formatting round trips; url rules against a plain version."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuslake.llm.chat import PARTS, Flattener, escape, format_chats, parse, read_back, text_parts, unescape
from corpuslake.llm.queries import RULES
from corpuslake.llm.url_filter import Cascade, Rule, judge_urls

PIECES = st.lists(st.sampled_from(["\\", "### ", ": ", "</turn>", " </turn>\n", "<|", "|>", "#", " ", "\n", "a", "é", "🙂"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES), max_size=5))
def test_any_text_is_read_back(turns):
    text = "".join(f"### {escape(r)}: {escape(c)} </turn>\n" for r, c in turns)
    assert [(r, unescape(c)) for r, c in parse(text)] == turns


EDGES = st.lists(st.sampled_from([":", "###", "##", "\\", "### ", ": ", "</turn>", " </turn>\n", "</tu", "rn>", "<", "|", " ", "a"]), max_size=8).map("".join)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(EDGES, st.lists(EDGES, max_size=3)), max_size=4))
def test_texts_that_end_like_a_mark_are_read_back(turns):
    """Contents of several text parts, too: no control string forms where they meet."""
    made = [(r, Flattener().content([{"type": "text", "text": t, "ref": None, "size": None} for t in texts])) for r, texts in turns]
    text = "".join(f"### {escape(r)}: {c} </turn>\n" for r, c in made)
    assert [(r, unescape(c)) for r, c in parse(text)] == [(r, "".join(texts)) for r, texts in turns]


def test_turns_that_end_in_a_colon(spark):
    rows = [(1, 1, "user", "Write this:"), (1, 2, "assistant", "yes"), (2, 1, "user", "###"), (2, 2, "assistant", "no:")]
    got = plain(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert [tuple(t) for t in got[1]["turns"]] == [("user", "Write this:"), ("assistant", "yes")] and got[1]["loss_text"] == "yes"
    assert [tuple(t) for t in got[2]["turns"]] == [("user", "###"), ("assistant", "no:")] and got[2]["loss_text"] == "no:"


def plain(rows):
    df = rows.withColumn("parts", text_parts(F.col("text"))).drop("text")
    return {r["conv_id"]: r for r in read_back(format_chats(df)).collect()}


def test_turns_and_loss(spark):
    rows = [(1, 2, "assistant", "two"), (1, 1, "user", "one"), (2, 1, None, None), (1, 3, "assistant", " </turn>\n### user: no\\"), (None, 1, "assistant", "x"), (None, 1, "assistant", "x")]
    got = plain(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert [tuple(t) for t in got[1]["turns"]] == [("user", "one"), ("assistant", "two"), ("assistant", " </turn>\n### user: no\\")]
    assert got[1]["loss_text"] == "two </turn>\n### user: no\\" and got[1]["n_turns"] == 3
    assert [tuple(t) for t in got[2]["turns"]] == [("", "")] and got[2]["loss_text"] == ""
    assert got[None]["n_turns"] == 2 and got[None]["loss_text"] == "xx"
    assert plain(spark.createDataFrame([], "conv_id long, turn long, role string, text string")) == {}


def test_attachments_are_ordered_placeholders(spark):
    parts = [
        {"type": "text", "text": "see <|image:1|>", "ref": None, "size": None},
        {"type": "image", "text": None, "ref": "a.png", "size": [28, 15]},
        {"type": "AUDIO", "text": None, "ref": None, "size": [2000]},
        {"type": "document", "text": None, "ref": "b.pdf", "size": None},
        {"type": "video", "text": "unknown kinds are text", "ref": None, "size": None},
    ]
    rows = spark.createDataFrame([(1, 1, "user", parts), (1, 2, "assistant", None)], f"conv_id long, turn long, role string, parts {PARTS}")
    got = read_back(format_chats(rows)).first()
    assert [tuple(a) for a in got["attachments"]] == [(1, "image", "a.png", 4), (2, "audio", None, 50), (3, "document", "b.pdf", 256)]
    assert got["attachment_tokens"] == 310
    assert got["formatted"] == "### user: see \\<|image:1|><|image:1|><|audio:2|><|document:3|>unknown kinds are text </turn>\n### assistant:  </turn>\n"


def test_a_visitor_for_each_kind():
    flat = Flattener()
    part = {"type": None, "text": "a: b", "ref": None, "size": None}
    assert flat.visit(part) == "a\\: b" and not flat.attachments


def judged(url, rules):
    rest = url.partition("://")[2] if url and "://" in url else ""
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host, tail = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
    path = tail[: min([i for i in map(tail.find, "?#") if i >= 0], default=len(tail))]
    fit = [r for r in rules if host and (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: (len(r.key), len(r.host)), default=None)
    return host, path, best.key if best else None, best.verdict if best else "allow"


ODD = [None, "", "example.com/en/7", "http://", "http:///en/", "HTTP://WWW.Example.COM/en/7x?q#f", "http://com/en/", "https://a.net/de/8", "https://www.example.net/de/8?x=://org/es/",
       "ftp://x.org/es/#/", "http://x.org?/es/", "http://É.org/es/é", "http://xcom/en/", "http://a.com./en/", "http://a..com/en/1", "a://b://c.com/en/", "http://x.org/es/\n/two"]


def test_urls_equal_the_plain_version(spark):
    draw = random.Random(4)
    hosts = ["example.com", "www.example.com", "com", "a.b.net", "example.net", "x.example.net", "org", "b.org", "other.io", "notexample.com"]
    urls = ODD + [f"http{draw.choice(['', 's'])}://{draw.choice(hosts)}/{draw.choice(['en', 'de', 'es', 'EN'])}/{draw.randrange(10)}" for _ in range(300)]
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(pages, RULES).collect()}
    assert got == {i: judged(u, RULES) for i, u in enumerate(urls)}


def test_url_rules_of_odd_input(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    assert judge_urls(pages, []).first()["verdict"] == "allow"
    assert judge_urls(pages.limit(0), RULES).count() == 0
    twice = [Rule("com", "/", "allow"), Rule("com", "/", "block"), Rule("com", "/", "block")]
    assert judge_urls(pages, twice).first()["verdict"] == "block"


def test_the_cascade_is_exact(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.filter("key LIKE '%7'")
    cascade = Cascade(listed, universe)
    assert len(cascade.levels) > 1
    wrong = universe.filter(cascade.contains(F.col("key")) != F.col("key").like("%7"))
    assert wrong.count() == 0
    assert Cascade(listed.limit(0), universe).levels == []
    assert universe.filter(Cascade(universe, universe).contains(F.col("key"))).count() == 20_000
