"""Html text, decontamination and SentencePiece against plain versions, round trips and odd input."""

import html
import itertools
import random
import re
from collections import Counter

import brute
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from corpuslake.llm import decontamination
from corpuslake.llm.decontamination import MASKS, contaminations, decontaminate
from corpuslake.llm.html_text import _strip, extract_text, main_text
from corpuslake.llm.sentencepiece_lattice import LONGEST, PieceTable, _count_units, _units, decode, default_model, encode, encode_units, merge

SCHEMA = "doc_id long, text string"
LONG = "This paragraph belongs to the article and is long enough to make the sum of its window surge over the limit."


def test_main_text_keeps_the_article_alone():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p {{ }}</style><script>if (a < b) "</p>"</script></head><body>
    <header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice"><p>{LONG}</p></div>
    <article><h1>Head &amp; line</h1><p>{LONG}<br>next&nbsp;line</p><!-- <p>gone</p> --><div class="ad-slot"><p>Buy</p></div><p>Short &lt;end&gt;</p>
    <form><label>Mail</label></form></article><aside>{LONG}</aside><section id="comments"><p>{LONG}</p></section><footer>Foot</footer></body></html>"""
    assert main_text(page) == f"Head & line\n\n{LONG} next line\n\nShort <end>"


def test_surge_and_dive_without_article_element():
    links = "".join(f'<li><a href="/{i}">Item number {i} of the list</a></li>' for i in range(12))
    page = f"<body><ul>{links}</ul><p>{LONG}</p><p>Middle.</p><p>{LONG}</p><ul>{links}</ul></body>"
    assert main_text(page) == f"{LONG}\n\nMiddle.\n\n{LONG}"


@pytest.mark.parametrize("wrapper", ["div class='has-sidebar'", "div class='page no-sidebar'", "div class='sidebar-left'", "form id=all", "div"])
def test_an_article_inside_any_wrapper_is_read(wrapper):
    tag = wrapper.split()[0]
    page = f"<body><nav><a href=/>Home</a></nav><{wrapper}><div class=menu>Menu</div><article><h1>Head</h1><div>{LONG}</div></article><div class=ads>Buy</div></{tag}><footer>Foot</footer></body>"
    assert main_text(page) == f"Head\n\n{LONG}"


def test_cards_inside_an_aside_stay_out():
    cards = f"<section class='related'><article><p>{LONG}</p></article></section>"
    assert main_text(f"<body><p>{LONG} one</p>{cards}</body>") == f"{LONG} one"
    assert main_text(f"<body><article><p>Short.</p></article>{cards}</body>") == "Short."
    assert main_text(f"<body class='x'><div class='has-sidebar'><p>{LONG}</p></div></body>") == LONG


@pytest.mark.parametrize(
    "inner",
    [
        f"<div class='article-header'><h1>Title</h1><p>{LONG}</p></div><p>Body</p>",
        f"<p>Body</p><section id='related-work'><h2>Related</h2><p>{LONG}</p></section>",
        "<p class='search-result'>Short</p><p>More</p>",
        "<p><a href=/>only a link</a></p><ul><li><a href=/>a</a></li><li>b</li></ul>",
        "<p>Where <math><mi>x</mi></math> is.</p>",
        "<p>One</p>" + "<div class='ad'><p>Buy</p><p>Now</p><p>Here</p><p>!</p></div>" + f"<p>{LONG}</p>" * 9,
    ],
)
def test_nothing_of_an_article_is_dropped(inner):
    page = f"<body><nav><a href=/>Home</a></nav><article>{inner}</article><footer>Foot</footer></body>"
    plain = re.sub(r"<div class='ad'>.*?</div>", "", inner)
    blocks = [html.unescape(re.sub(r"<[^>]*>", "", b)) for b in re.split(r"</?(?:p|div|h1|h2|section|ul|li)\b[^>]*>", plain)]
    assert main_text(page) == "\n\n".join(" ".join(b.split()) for b in blocks if b.strip())


def plain_ranges(lines, window, surge, share):
    """Surge and dive by hand: ``lines`` are (text, weight); the texts that are kept."""
    k, groups = 0, []
    while k < len(lines):
        if lines[k][1] and sum(w for _, w in lines[k : k + window]) >= surge:
            first = k
            while k < len(lines) and any(w for _, w in lines[k : k + window]):
                k += 1
            groups.append([t for t, w in lines[first:k] if w])
        else:
            k += 1
    most = max((sum(map(len, g)) for g in groups), default=0)
    groups = [g for g in groups if sum(map(len, g)) >= share * most] or [[t for t, w in lines if w]]
    return "\n\n".join(t for g in groups for t in g)


@pytest.mark.parametrize(("window", "surge", "share"), [(6, 80, 0.1), (1, 30, 0.5), (3, 100, 0.0), (2, 1, 1.0), (4, 10**6, 0.1)])
def test_the_sums_decide_on_a_page_without_article(window, surge, share):
    draw = random.Random(3)
    for _ in range(60):
        lines = [("x" * draw.choice([3, 10, 30, 90]), draw.random() < 0.5) for _ in range(draw.randrange(1, 40))]
        page = "<body>" + "".join(f"<p class=menu>{t}</p>" if boiler else f"<p>{t}</p>" for t, boiler in lines) + "</body>"
        assert main_text(page, window, surge, share) == plain_ranges([(t, 0 if boiler else len(t)) for t, boiler in lines], window, surge, share)


def test_ranges_of_equal_text_all_count():
    block = "<p>" + "y" * 100 + "</p>"
    page = "<body>" + block + "<p class=menu>m</p>" * 9 + block + "</body>"
    assert main_text(page, share=1.0) == "\n\n".join(["y" * 100] * 2)


def test_the_sums_decide_on_the_pages_of_the_table(sf_dir):
    """All pages against a plain version over the article's lines; other limits give other texts."""
    import pyarrow.parquet as pq

    pages = pq.read_table(f"{sf_dir}/pages.parquet", columns=["html"]).column("html").to_pylist()
    assert len(pages) >= 50
    for page in pages:
        lines = [(t, 4 * w if inside else 0) for t, w, inside in _strip(page)]
        assert any(w for _, w in lines)  # all mark their article
        for window, surge, share in ((6, 80, 0.1), (1, 500, 0.9)):
            assert main_text(page, window, surge, share) == plain_ranges(lines, window, surge, share)
    changed = [sum(main_text(p, **limits) != main_text(p) for p in pages) for limits in ({"window": 1}, {"surge": 4000}, {"window": 1, "surge": 500, "share": 0.9})]
    assert changed[2] > 0.5 * len(pages) and changed[0] + changed[1] > 0


@pytest.mark.parametrize("inner", ["<p class='alert'>Mind the gap</p>", "<section class='related'><h2>Related work</h2><p>Some of it</p></section>", "<div class='header'><h1>Title</h1></div>", "<p class='notice'>Note well</p>", "<h2 class='search'>Search</h2>"])
def test_an_article_keeps_its_own_headers_alerts_and_sections(inner):
    page = f"<body><nav><a href=/>Home</a></nav><article>{inner}<p>{'Words and words. ' * 9}</p><div class=ad>Buy</div><div class='comments'><p>First!</p></div></article><footer>Foot</footer></body>"
    text = main_text(page)
    assert all(w in text for w in html.unescape(re.sub(r"<[^>]*>", " ", inner)).split()) and not any(w in text for w in ("Buy", "First!", "Home", "Foot"))


def test_a_very_long_page():
    assert main_text("<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>").count(LONG) == 20_000


@pytest.mark.parametrize("page, text", [(None, ""), ("", ""), ("<p>", ""), ("plain", "plain"), ("<p>a  b\n c<p>d", "a b c\n\nd"), ("<p>x<script>never closed", "x"), ("a < b", "a < b"), ("<b>a</b>b", "ab")])
def test_main_text_of_odd_pages(page, text):
    assert main_text(page) == text


def test_extraction_on_the_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("n_chars", F.lit("old"))
    rows = extract_text(pages).collect()
    assert len(rows) == pages.count() and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert sum(r["n_chars"] > 0 for r in rows) > 0.9 * len(rows)
    assert not any(mark in r["text"] for r in rows for mark in ("<div", "</p>", "<!--", "&amp;", "&nbsp;"))
    assert extract_text(pages.limit(0)).count() == 0


def leak_fixture():
    draw = random.Random(9)
    vocabulary = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(draw.choice(vocabulary) for _ in range(n))) for i, n in enumerate((40, 25, 14, 12, 6, 1, 0))] + [(7, None), (8, "Twice over it goes and then some more words follow up to thirteen"), (9, "Twice over it goes and then some more words follow up to thirteen")]
    docs = []
    for k in range(60):
        own = [f"d{draw.randrange(2000)}" for _ in range(draw.randrange(20, 60))]
        passage = (items[k % len(items)][1] or "").split()
        if k % 3 == 1 and len(passage) > 12:
            for at in range(3, len(passage), 6):
                passage[at] = "changed"
        if k % 3 != 2:
            at = draw.randrange(len(own))
            own[at:at] = passage
        docs.append((k, " ".join(own).upper() if k % 4 == 0 else ", ".join(own)))
    return [*docs, (100, None), (101, ""), (None, items[0][1])], items


def test_leaks_equal_brute_force(spark):
    docs, items = leak_fixture()
    got = contaminations(spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute.contaminated([d for d in docs if d[0] is not None], items, MASKS, 13, 0.7)
    assert {(r["doc_id"], r["item_id"]): r["overlap"] for r in got} == want and len(got) == len(want)
    whole = {d for d in range(60) if d % 3 == 0 and items[d % len(items)][1]}
    changed = {d for d in range(60) if d % 3 == 1 and d % len(items) in (0, 1)}
    assert whole | changed <= {d for d, _ in want}


def test_decontaminate_keeps_clean_documents(spark):
    docs, items = leak_fixture()
    table = spark.createDataFrame([(*d, i) for i, d in enumerate(docs)], "doc_id long, text string, item_id int")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    dirty = {d for d, _ in brute.contaminated([d for d in docs if d[0] is not None], items, MASKS, 13, 0.7)}
    kept = decontaminate(table, benchmark).collect()
    assert {r["doc_id"] for r in kept} == {d for d, _ in docs} - dirty and kept[0].asDict().keys() == {"doc_id", "text", "item_id"}
    assert decontaminate(table, benchmark.limit(0)).count() == len(docs)
    assert decontaminate(table.limit(0), benchmark).count() == 0
    with pytest.raises(ValueError):
        contaminations(table, benchmark, masks=("11", "101"))


@pytest.mark.parametrize("n", range(1, 18))
def test_masks_lie_in_every_overlap_that_is_accepted(n):
    masks = MASKS if n >= 13 else decontamination._SHORT[n]
    wrong = n - next(m for m in range(n + 1) if 10 * m >= 7 * n)
    for gone in itertools.combinations(range(1, n - 1), wrong):
        same = "".join("0" if i in gone else "1" for i in range(n))
        assert any(all(same[at + k] == "1" for k, bit in enumerate(m) if bit == "1") for m in masks for at in range(n - len(m) + 1)), same
    assert decontamination.complete(masks, n, 0.7, exact=True)


def test_masks_are_proved_for_all_lengths():
    assert decontamination.complete(MASKS, 13, 0.7)
    assert not decontamination.complete(("110110110111", "101101101101", "111000111011"), 13, 0.7)
    assert not decontamination.complete(("11011", "10111"), 13, 0.7)
    assert not decontamination.complete(MASKS, 13, 0.5)


def test_leaks_with_many_substitutions_equal_all_diagonals(spark):
    draw = random.Random(12)
    items = [(i, " ".join(f"i{i}w{k}" if k % 5 else f"c{draw.randrange(9)}" for k in range(n))) for i, n in enumerate((40, 24, 20, 16, 14, 13, 12, 10, 9, 8, 7, 6, 5, 4, 3, 2, 1))]
    docs = []
    for d in range(170):
        passage = items[d % len(items)][1].split()
        if d >= 102:
            passage[3::4] = ["changed"] * len(passage[3::4])
        else:
            for at in draw.sample(range(1, len(passage) - 1), len(passage) * 3 // 10) if len(passage) > 2 else ():
                passage[at] = "changed"
        own = [f"c{draw.randrange(9)}" if draw.random() < 0.2 else f"d{draw.randrange(500)}" for _ in range(draw.randrange(0, 30))]
        at = draw.randrange(len(own) + 1)
        docs.append((d, " ".join([*own[:at], *passage, *own[at:]])))
    got = contaminations(spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute.contaminated_on_any_diagonal(docs, items, 13, 0.7)
    assert {(r["doc_id"], r["item_id"]): r["overlap"] for r in got} == want and len(got) == len(want)
    assert all((d, d % len(items)) in want for d in range(102))


@pytest.fixture(scope="module")
def table():
    return PieceTable.read(default_model())


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=default_model())


ODD = [None, "", " ", "  two  spaces ", "a\nb\n\n c", "\t tab", "äöü ß é", "日本語 text", "🙂🙂 x", "a" * 200, "x" * 61, "http://a.b/c?d=e&f=g", "▁", "-" * 150, "0123456789" * 20, "ab\u0000c"]


@pytest.mark.parametrize("vocabulary", [1 << 21, 40])
def test_ids_equal_the_library(spark, sf_dir, table, model, vocabulary):
    """40: most units lie beyond the broadcast part of the vocabulary."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(120)
    docs = docs.unionByName(spark.createDataFrame([(-i - 1, t) for i, t in enumerate(ODD)], SCHEMA))
    rows = decode(encode(docs.withColumn("n_tokens", F.lit("mine")), table, vocabulary=vocabulary), table).collect()
    assert len(rows) == 120 + len(ODD)
    for r in rows:
        want = model.encode(r["text"]) if r["text"] else []
        assert list(r["ids"]) == want and r["n_tokens"] == len(want)
        assert r["decoded"] == (r["text"] or "").replace("▁", " ")


def test_ids_of_an_empty_table(spark, table):
    assert encode(spark.createDataFrame([], SCHEMA), table).count() == 0


@pytest.mark.parametrize("vocabulary", [1 << 21, 3])
def test_encoding_of_repeated_rows_clashing_names_and_long_texts(spark, table, model, vocabulary):
    long = " ".join(f"wort{i}{'x' * (i % 7)}" for i in range(20_000))
    rows = [(1, "same text here", 2, 3), (1, "same text here", 2, 3), (1, "same text here", 2, 3), (1, "other text", 2, 3), (None, None, None, None), (2, long, 0, 0)]
    docs = spark.createDataFrame(rows, "key long, text string, unit long, extra long").repartition(3)
    docs = docs.withColumns({"n": F.lit(1), "__k1": F.lit("k"), "__row": F.lit(1), "ids": F.lit("mine"), "hash": F.lit(0), "facts": F.create_map(F.lit("a"), F.lit(1))})
    got = decode(encode(docs, table, vocabulary=vocabulary), table)
    assert got.columns == [c for c in docs.columns if c != "ids"] + ["ids", "n_tokens", "decoded"]
    out = got.collect()
    key = lambda r: (r["key"] or 0, r["text"] or "")
    assert sorted(map(key, out)) == sorted((k or 0, t or "") for k, t, _, _ in rows)
    for r in out:
        assert list(r["ids"]) == model.encode(r["text"] or "") and r["decoded"] == (r["text"] or "") and r["n_tokens"] == len(r["ids"]) and r["facts"] == {"a": 1}
    assert encode(docs.limit(0), table, vocabulary=vocabulary).count() == 0


def test_the_vocabulary_comes_to_the_driver_a_partition_at_a_time(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one two"), (2, "two three")], SCHEMA).repartition(3)
    table, model = PieceTable.read(default_model()), sentencepiece.SentencePieceProcessor(model_file=default_model())
    with monkeypatch.context() as held:
        for name in ("collect", "toArrow", "toPandas"):
            held.setattr(type(docs), name, lambda *_: pytest.fail("fetched at once"))
        rows = encode(docs, table)
    assert {r["doc_id"]: list(r["ids"]) for r in rows.collect()} == {1: model.encode("one two"), 2: model.encode("two three")}


def unigram():
    pieces = {"▁": -3.0, "a": -2.0, "b": -2.5, "c": -2.2, "ab": -2.1, "bc": -2.6, "abc": -5.9, "▁a": -2.4, "▁ab": -3.9, "ca": -2.0, "cab": -4.5}
    return PieceTable([(i + 1, p, s) for i, (p, s) in enumerate(pieces.items())], {}, kind="unigram")


def best_score(unit, table, worst):
    if not unit:
        return 0.0
    options = [table.index[unit[:k]][1] + best_score(unit[k:], table, worst) for k in range(1, len(unit) + 1) if unit[:k] in table.index]
    return max([*options, worst + best_score(unit[1:], table, worst)])


def test_the_viterbi_fold_finds_the_best_path(spark):
    table, draw = unigram(), random.Random(1)
    units = sorted({"▁" * draw.randrange(2) + "".join(draw.choice("abcx") for _ in range(draw.randrange(1, 9))) for _ in range(60)})
    spelled = {i: (p, s) for i, p, s in table.rows}
    worst = min(s for _, _, s in table.rows) - 10
    for r in encode_units(spark.createDataFrame([(u,) for u in units], "unit string"), table).collect():
        score = sum(spelled[i][1] if i in spelled else worst for i in r["ids"])
        assert score == pytest.approx(best_score(r["unit"], table, worst))
        assert score == pytest.approx(sum(spelled[i][1] if i in spelled else worst for i in merge(r["unit"], table)))


def test_the_fold_equals_the_helper(spark, table):
    draw = random.Random(6)
    units = sorted({"▁" + "".join(draw.choice("aeinrst") for _ in range(draw.randrange(1, 20))) for _ in range(80)} | {"▁" + "ab" * 28, "▁(", "é", "🙂a"})
    got = {r["unit"]: list(r["ids"]) for r in encode_units(spark.createDataFrame([(u,) for u in units], "unit string"), table).collect()}
    assert got == {u: merge(u, table) for u in units}


@pytest.mark.parametrize("pieces", [None, ["a", "\u2581a"], ["a\n", "a."], ["-.", "]]", "\\\\", "a"]])
def test_texts_split_at_their_spaces_have_the_units_of_the_pattern(pieces):
    table = PieceTable([(i, p, -float(i)) for i, p in enumerate(pieces)], {}) if pieces else PieceTable.read(default_model())
    draw = random.Random(2)
    texts = ["".join(draw.choice(" \n\0\u2581a.\u00e9\u2013\u00a3\t\r-]\\b ") for _ in range(draw.randrange(14))) for _ in range(3000)] + [None, "", "a" * 100]
    assert [_units(pa.array(table.keys(t), pa.string())).to_pylist() for t in texts] == [table.cut(t) for t in texts]
    got: Counter = Counter()
    for batch in _count_units(table)(iter([pa.record_batch({"text": pa.array(texts, pa.string())})])):
        got.update(dict(zip(batch.column("unit").to_pylist(), batch.column("n").to_pylist(), strict=True)))
    assert got == Counter(u for t in texts for u in table.cut(t) if len(u) <= LONGEST)


def test_plain_texts_are_cut_without_the_pattern():
    table = PieceTable.read(default_model())
    table.units = None
    texts = ["one two, three.\n\nfour \u00e9t\u00e9 five\n", "\u00e9t\u00e9"]
    assert _units(pa.array(table.keys(texts[0]))).to_pylist() == ["\u2581one", "\u2581two,", "\u2581three.", "\n", "\n", "four", "\u2581\u00e9t\u00e9", "\u2581five", "\n"]
    (batch,) = _count_units(table)(iter([pa.record_batch({"text": texts})]))
    assert dict(zip(batch.column("unit").to_pylist(), batch.column("n").to_pylist(), strict=True))["\u2581\u00e9t\u00e9"] == 2
