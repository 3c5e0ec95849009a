"""Exact, near and substring copies against plain versions; nulls, ties, empty tables, clashing names."""

import hashlib
import random

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuslake.llm import common, components, near_dedup
from corpuslake.llm.components import connected_components
from corpuslake.llm.exact_dedup import DigestIndex, drop_exact_copies, exact_groups
from corpuslake.llm.near_dedup import near_duplicates, sketches
from corpuslake.llm.substring_dedup import drop_repeated_windows

SCHEMA = "doc_id long, text string"


def near_fixture(seed=5):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = ["", None, " \t\n", "one", "One", "two words", "a b c d", "A b c d\n"]
    for n in (5, 12, 60, 200):
        base = [draw.choice(vocabulary) for _ in range(n)]
        texts += [" ".join(base), " ".join(base).upper(), "  ".join(base)]
        for _ in range(6):  # a chain: each is near the one before it
            base = list(base)
            base[draw.randrange(n)] = draw.choice(vocabulary)
            texts.append(" ".join(base))
    texts += [" ".join(draw.choice(vocabulary) for _ in range(80)) for _ in range(30)]
    common = " ".join(draw.choice(vocabulary) for _ in range(100))
    texts += [f"{common} tail{i} end{i}" for i in range(25)]
    draw.shuffle(texts)
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("size", [4, 5])
def test_near_copies_equal_brute_force(spark, size):
    rows = near_fixture()
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5), size=size).collect()
    want = brute.components(rows, size, 80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got) and len(got) == len(rows)


def test_near_copies_on_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute.components([(r["doc_id"], r["text"]) for r in docs.collect()], 4, 80)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(docs, size=4).collect()}
    assert got == want


def test_the_cross_round_alone_finds_all_links(spark, monkeypatch):
    """No star round has met anything but the chains' first links: components of several members are joined by the cross round."""
    star = near_dedup._star_pairs
    monkeypatch.setattr(near_dedup, "_star_pairs", lambda members, turn, percent: star(members, turn, percent).filter("a % 2 = 0"))
    rows = near_fixture(11)
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA), size=4, star_rounds=1).collect()
    want = brute.components(rows, 4, 80)
    assert max(sum(c == x for _, c in want.values()) for _, x in want.values()) >= 7
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


@pytest.mark.parametrize("own", [60, 48, 30])
def test_a_template_makes_no_pairs_of_documents_that_are_no_links(spark, monkeypatch, own):
    """Documents around one template of 300 words with ``own`` words each: 0.71, 0.75 and 0.83 alike."""
    made, cross = [], near_dedup._cross_pairs
    monkeypatch.setattr(near_dedup, "_cross_pairs", lambda members, percent: made.append(cross(members, percent).count()) or cross(members, percent))
    template = " ".join(f"t{i}" for i in range(300))
    rows = [(i, template + " " + " ".join(f"d{i}w{k}" for k in range(own))) for i in range(60)]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA), size=4).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute.components(rows, 4, 80)
    assert made[0] <= 60


def test_near_copies_of_odd_input(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (None, "a b c d e f", "z"), (2, None, None), (3, None, None)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component_id string"), size=4).collect()
    assert {r["component_id"] for r in got if r["doc_id"] == 1} == {1}
    assert {(r["doc_id"], r["component_id"], r["n_shingles"]) for r in got if r["doc_id"] != 1} == {(2, 2, 0), (3, 3, 0)}


def test_sets_of_near_copies_are_made_once(spark, monkeypatch):
    """All rounds compare the same sets, each in one table: every job costs the driver memory."""
    names, real = [], near_dedup.written
    monkeypatch.setattr(near_dedup, "written", lambda df, name: names.append(name) or real(df, name))
    rows = near_fixture(11)
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5), size=4).collect()
    assert names.count("sets") == 1 and names.count("verified") == 3 and len(names) <= 10
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute.components(rows, 4, 80)


def test_a_long_chain_is_one_component(spark):
    edges = spark.range(1, 300).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    got = connected_components(edges.union(spark.createDataFrame([(1000, 1001), (7, 7)], "a long, b long"))).collect()
    assert {(r["id"], r["component"]) for r in got} == {(i, 0) for i in range(1, 300)} | {(1001, 1000)}


def test_stars_are_settled_by_one_aggregation(spark, monkeypatch):
    """Each job and plan costs the driver memory: no round after the last link, no join where one aggregation tells the end."""
    names, real = [], components.written
    monkeypatch.setattr(components, "written", lambda df, name: names.append(name) or real(df, name))
    star = spark.range(1, 50).select(F.col("id").alias("a"), (F.col("id") % 3 - 3).alias("b"))
    got = connected_components(star).collect()
    assert {(r["id"], r["component"]) for r in got} == {(i, i % 3 - 3) for i in range(1, 50)} and names == ["edges", "near"]


@pytest.mark.parametrize("most", [0, 100_000])
def test_components_of_random_graphs(spark, monkeypatch, most):
    monkeypatch.setattr(components, "_BROADCAST", most)
    draw = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in draw.integers(0, 150, (110, 2))]
    root = list(range(150))
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r["id"], r["component"]) for r in got) == [(i, x) for i, x in enumerate(root) if i != x]


def test_few_keys_are_not_dealt_out(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "keys"))
    keys, rows = spark.read.parquet(str(tmp_path / "keys")), spark.range(20)
    for got in (common.semi_by_size(rows, keys, ["id"]), common.without(rows, keys.toDF("gone"), F.col("id") == F.col("gone"))):
        assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    repeated = keys.union(keys).union(keys)
    assert common.semi_by_size(rows, repeated, ["id"], limit=6).count() == 5 and common.semi_by_size(rows, repeated, ["id"], limit=3).count() == 5


def test_sketches_fill_and_estimate_similarity():
    draw = np.random.default_rng(3)
    grams = draw.integers(0, 1 << 63, 1500).astype(np.uint64)
    rows = np.repeat([0, 1], [1000, 1000])
    with np.errstate(over="ignore"):
        made = sketches(rows, np.concatenate([grams[:1000], grams[250:1250]]), 3, 240)
    assert (made[:2] != near_dedup._NONE).all() and (made[2] == near_dedup._NONE).all()
    assert abs((made[0] == made[1]).mean() - 750 / 1250) < 0.12


def normal(text):
    return (text or "").translate(brute.UPPER)


def expect_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(normal(t), []).append(i)
    return sorted((i, max(groups[normal(t)]), len(groups[normal(t)]), i == max(groups[normal(t)])) for i, t in rows)


EXACT = [(1, "Same"), (2, "same"), (3, "SAME "), (4, None), (5, ""), (6, "É"), (7, "é"), (8, "x" * 70_000), (9, "X" * 70_000), (10, "ünder A"), (11, "ünder a")]


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(spark, weak):
    """``weak``: digests of one byte of the length, so that different texts meet under one digest."""
    docs = spark.createDataFrame(EXACT, SCHEMA)
    digest = {"digest": lambda t: F.unhex(F.lpad(F.hex(F.length(t) % 3), 2, "0"))} if weak else {}
    got = exact_groups(docs, **digest).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == expect_exact(EXACT)
    if not weak:
        assert {bytes(r["digest"]).hex() for r in got} == {hashlib.sha256(normal(t).encode()).hexdigest() for _, t in EXACT}


@settings(max_examples=4, deadline=None)
@given(st.lists(st.sampled_from(["a", "A", "b", "", None, "Ä", "ä", "a "]), min_size=1, max_size=12), st.integers(1, 5))
def test_exact_groups_any_batches(spark, texts, batches):
    rows = list(enumerate(texts))
    got = exact_groups(spark.createDataFrame(rows, SCHEMA), batches=batches).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == expect_exact(rows)


def test_exact_dedup_of_odd_input(spark):
    assert exact_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(1, "a", "p", 0), (2, "A", "q", 1), (None, "a", "r", 2), (None, "z", "s", 3)], "doc_id long, text string, digest string, n int")
    kept = drop_exact_copies(docs).collect()
    assert kept[0].asDict().keys() == {"doc_id", "text", "digest", "n"}
    assert sorted(r["n"] for r in kept) == [1, 2, 3]  # rows without doc_id can't be named, so they are not dropped
    assert {r["doc_id"] for r in drop_exact_copies(docs, keep="smallest").collect()} == {1, None}


def test_a_text_under_a_repeated_id_is_not_lost(spark):
    docs = spark.createDataFrame([(1, "x"), (1, "y"), (5, "X")], SCHEMA)
    assert sorted((r["doc_id"], r["text"]) for r in drop_exact_copies(docs).collect()) == [(1, "y"), (5, "X")]


def test_the_index_merges_its_runs(spark, tmp_path):
    index = DigestIndex(spark, str(tmp_path / "index"), fan_in=3)
    for b in range(5):
        index.flush(spark.range(b * 10, b * 10 + 20).select(F.unhex(F.sha2(F.col("id").cast("string").cast("binary"), 256)).alias("digest"), F.col("id")))
    index.compact()
    assert len(index.runs) == 1
    rows = index.entries().collect()
    assert len(rows) == 60 and sum(r["n"] for r in rows) == 100 and {r["id"] for r in rows} == set(range(60))


@pytest.mark.parametrize("cells", [16, 27])
def test_repeated_windows_equal_brute_force(spark, cells):
    draw = random.Random(2)
    passage = [f"p{i}" for i in range(45)]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "x " * 90), (5, " ".join(passage)), (6, " ".join(passage[:20])), (7, " ".join(passage[:19]))]
    for i in range(40):
        own = [f"w{draw.randrange(60)}" for _ in range(draw.randrange(0, 80))]
        at = draw.randrange(0, len(own) + 1)
        cut = sorted(draw.sample(range(46), 2))
        rows.append((100 - i, " ".join([*own[:at], *passage[cut[0] : cut[1]], *own[at:]])))
    got = drop_repeated_windows(spark.createDataFrame(rows, SCHEMA).repartition(4), size=20, cells=cells, with_text=True).collect()
    want = brute.kept_words(rows, 20)
    assert {r["doc_id"]: (r["n_words"], r["kept_text"].split()) for r in got} == want
    assert all(r["n_removed"] == r["n_words"] - len(want[r["doc_id"]][1]) and r["kept_sha256"] == hashlib.sha256(r["kept_text"].encode()).hexdigest() for r in got)


def test_repeated_windows_of_odd_input(spark):
    assert drop_repeated_windows(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a " * 50, "k"), (1, "a b", "k")]
    got = drop_repeated_windows(spark.createDataFrame(rows, "doc_id long, text string, runs string")).collect()
    assert [(r["doc_id"], r["n_words"], r["n_removed"]) for r in got] == [(1, 2, 0)]
    with pytest.raises(ValueError):
        drop_repeated_windows(spark.createDataFrame([], SCHEMA), cells=40)


def test_windows_need_no_more_than_their_length(spark):
    rows = [(1, "a b c d e"), (2, "z b c d y"), (3, "b c d"), (3, "b c d")]
    got = drop_repeated_windows(spark.createDataFrame(rows[:3], SCHEMA), size=3, gram=2, with_text=True).collect()
    assert {r["doc_id"]: r["kept_text"] for r in got} == {1: "a b c d e", 2: "z y", 3: ""}


@pytest.mark.parametrize("parts", [1, 5])
def test_rows_that_repeat_a_doc_id_are_one_document(spark, parts):
    """Equal, different and shorter texts under one id, wherever the rows lie."""
    rows = [(1, "a b c d e"), (2, "z b c d y"), (3, "b c d"), (3, "b c d"), (4, "q r s t u v w x q r s"), (4, "p"), (4, None), (5, "m n o"), (5, "k l p q r s t"), (6, "p")]
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t or "")
    want = brute.kept_words([(i, " ".join(sorted(t))) for i, t in texts.items()], 3)
    got = drop_repeated_windows(spark.createDataFrame(rows, SCHEMA).repartition(parts), size=3, gram=2, with_text=True).collect()
    assert len(got) == len(want) and {r["doc_id"]: (r["n_words"], r["kept_text"].split()) for r in got} == want
