"""Packing, hard negatives and centroid clustering against plain versions."""

import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpuslake.llm import centroids, hard_negatives, packing, queries, vectors

FILE = public_tokenizers.path("byte_bpe_50k.json")
NAN, INF = float("nan"), float("inf")


def ids_of(texts, tokenizer=Tokenizer.from_file(FILE)):
    return [e.ids + [2] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


ODD = ["", None, " ", "\n\n\n  x", "don't  stop\t\tit's 12,5 !!", "café straße", "日本語 text 混ぜ", "a b c\x1cd", "<|endoftext|> in a text", "''s ''''re 'S", "Ünder ٣٤ ½ x²", "word " * 3000, "x" * 5000, "\U0001f600 ok"]


def test_words_are_coded_as_whole_texts():
    coder = packing.WordCoder(FILE, cached=5)
    for part in (ODD, ODD[::-1]):
        assert [np.frombuffer(b, "<u4").tolist() for b in coder.code([t or "" for t in part])] == [i[:-1] for i in ids_of(part)]


@settings(deadline=None, max_examples=150)
@given(st.text(st.one_of(st.sampled_from(" '\t\nsdtrevml019.,! É"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text_is_coded_alike(text):
    assert np.frombuffer(packing.WordCoder(FILE).code([text])[0], "<u4").tolist() == ids_of([text])[0][:-1]


def check_packing(rows, texts, length):
    """Every id once and in order, right checksums, no gap and nothing over the length; returns how many sequences."""
    by_doc, fills = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        fills.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for (doc, _), ids in zip(texts, ids_of([t for _, t in texts]), strict=True):
        own = sorted(by_doc[doc], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) == list(range(-(-len(ids) // length)))
        assert all(r["length"] == length for r in own[1:]) and own[0]["start"] == 0
        for r in own:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert len(part) == r["length"] and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
        assert sum(r["length"] for r in own) == len(ids)
    for pieces in fills.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= length
    return len(fills)


def test_packing_of_the_table(spark, sf_dir):
    rows = queries.op11_best_fit_packing(spark, sf_dir).collect()
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    n = check_packing(rows, texts, 1024)
    assert n <= math.ceil(sum(r["length"] for r in rows) / 1024) + 2


def test_packing_of_odd_texts_in_several_blocks(spark):
    draw = random.Random(2)
    texts = list(enumerate(ODD + [" ".join(["word"] * draw.randint(0, 45)) for _ in range(400)]))
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in texts], "doc_id long, text string, length int, sequence_id string").repartition(5)
    rows = packing.pack_documents(docs, FILE, length=40, block=100).collect()
    n = check_packing(rows, texts, 40)
    assert n <= 1.02 * sum(r["length"] for r in rows) / 40 + 3
    assert packing.pack_documents(docs.limit(0), FILE).count() == 0
    twice = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None), (1, None)], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["length"]) for r in packing.pack_documents(twice, FILE).collect()) == [("1", 1), ("1", 1), ("None", 3), ("None", 3)]


def squares(bins, sizes):
    return sum(sum(sizes[i] for i in b) ** 2 for b in bins)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(1, 63), min_size=1, max_size=120))
def test_exchanges_keep_all_items_and_raise_squares(sizes):
    before = packing.best_fit(sizes, 64)
    after = packing.pack(sizes, 64)
    for bins in (before, after):
        assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and all(0 < sum(sizes[i] for i in b) <= 64 for b in bins)
    assert len(after) <= len(before) and squares(after, sizes) >= squares(before, sizes)


def test_best_fit_takes_the_fullest_bin():
    sizes = [6, 5, 4, 3]
    assert sorted(map(sorted, packing.best_fit(sizes, 10))) == [[0, 2], [1, 3]]


@pytest.mark.parametrize(("bins", "sizes"), [([[0], [1]], [6, 4]), ([[0, 1], [2, 3]], [5, 3, 7, 2]), ([[0, 1], [2, 3]], [6, 3, 2, 5]), ([[0, 1], [2, 3]], [4, 4, 9, 1])])
def test_each_kind_of_exchange(bins, sizes):
    """A move, one for one, two for one, one for two: the fuller bin is full afterwards."""
    bins = [list(b) for b in bins]
    search = packing.Exchanges(sizes, bins, 10, most=50)
    search.search()
    assert max(sum(sizes[i] for i in b) for b in bins) == 10 and sorted(i for b in bins for i in b) == list(range(len(sizes)))


def test_the_search_empties_bins_that_best_fit_leaves():
    draw = random.Random(4)
    sizes = [draw.randint(100, 600) for _ in range(3000)]
    assert len(packing.pack(sizes, 1024)) < len(packing.best_fit(sizes, 1024))


# ---- vectors


def floors(v):
    return None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(256 * x) for x in v]


def brute_negatives(rows):
    """op12 over (vec_id, vector, label) as the contract has it."""
    kept = {}
    for i, v, label in rows:
        w = floors(v)
        if label is not None and w is not None:
            kept[i] = ((label + 1) % 10 if i % 7 == 0 else label, w)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a, (label, v) in kept.items():
        if a % 100:
            continue
        scored = sorted(((-dot(v, w), i, other == label) for i, (other, w) in kept.items() if i != a))
        for s, p, _ in [x for x in scored if x[2]][:5]:
            fit = [(n, i) for n, i, same in scored if not same and 80 * -s <= 100 * -n <= 100 * -s][:5]
            out += [(a, p, k + 1, i, -s, -n) for k, (n, i) in enumerate(fit)]
    return sorted(out)


def vector_rows(n, dims, seed, groups=6, noise=0.15, labels=4):
    draw = np.random.default_rng(seed)
    middles = draw.normal(size=(groups, dims)) / np.sqrt(dims)
    made = [(middles[draw.integers(groups)] + draw.normal(size=dims) * noise / np.sqrt(dims)).astype(np.float32) for _ in range(n)]
    return [(i * 5, [float(x) for x in v], int(draw.integers(labels))) for i, v in enumerate(made)]


VECTORS = "vec_id long, embedding array<float>, label int"
ODD_VECTORS = [(100_001, None, 1), (100_002, [], 2), (100_003, [NAN] * 8, 1), (100_004, [INF] + [0.0] * 7, 1), (100_005, [None] + [1.0] * 7, 1), (100_006, [1.0] * 8, None), (100_100, [0.0] * 8, 3), (100_200, [0.5], 2)]


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    df = df.select("vec_id", label.alias("label"), F.when(vectors.usable(F.col("embedding")), vectors.whole(F.col("embedding"))).alias("v"), F.lit(1).alias("rank"), F.lit("x").alias("score"))
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, **options).collect())


def test_negatives_equal_brute_force(spark):
    rows = vector_rows(700, 8, 3) + [(300_000 + i, [0.25] * 8, i % 3) for i in range(0, 900, 10)] + ODD_VECTORS
    want = brute_negatives(rows)
    assert len(want) > 200
    assert mined(spark, rows, tree_rows=64, leaf=8) == want
    assert mined(spark, rows, tree_rows=200, leaf=16, block=8) == want  # several blocks of anchors


def test_negatives_of_odd_input(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 1)]) == []
    same = [(i, [1.0, 2.0], i % 2) for i in range(50)]
    assert mined(spark, same) == brute_negatives(same)
    assert mined(spark, same + same[:7]) == brute_negatives(same)  # repeated rows count once


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**18 + i % 3), -float(2**17 + i % 5)], i % 2) for i in range(220)]
    assert mined(spark, rows) == brute_negatives(rows)


def test_trees_prune_by_both_bounds():
    """In clusters most leaves are never scored, and both searches stay exact."""
    rows = vector_rows(4000, 16, 7, groups=40, noise=0.05, labels=6)
    v = np.array([floors(x) for _, x, _ in rows])
    ids, labels = np.arange(4000), np.array([x[2] for x in rows])
    t = hard_negatives.plant(ids, labels, v, 32)
    order = t["order"]
    assert sorted(order) == list(range(4000))
    for a, b, low, high, radius, centre in zip(t["first"], t["last"], t["low"], t["high"], t["radius"], t["centres"], strict=True):
        own = order[a:b]
        assert {labels[own].min(), labels[own].max()} == {low, high} and np.sqrt(((v[own] - centre) ** 2).sum(axis=1)).max() <= radius + 1e-9
    row = {k: list(t[k]) for k in ("first", "last", "child", "low", "high", "radius")} | {"ids": ids[order], "labels": labels[order], "dims": 16, "vectors": v[order].astype("<i4").tobytes(), "centres": t["centres"].tobytes()}
    block = {"id": ids[:50], "label": labels[:50], "v": v[:50]}
    best = hard_negatives.Best(50, 5)
    assert hard_negatives.find_positives(row, block, best) < 0.1 * 50 * 4000
    wide = hard_negatives._with_windows(block, [{"anchor_id": a, "rank": k + 1, "score": s} for a, own in enumerate(best.score.tolist()) for k, s in enumerate(own)], 5, 80)
    far = hard_negatives.Best(250, 5)
    assert hard_negatives.find_negatives(row, wide, far) < 0.5 * 50 * 4000
    score = v[:50] @ v.T
    for a in range(50):
        mine = sorted((-score[a, i], i) for i in ids if labels[i] == labels[a] and i != a)[:5]
        assert [(-s, i) for s, i in mine] == list(zip(best.score[a], best.id[a], strict=True))


def brute_clusters(rows, k, rounds, dims):
    kept = [(i, w) for i, v, _ in rows if v is not None and len(v) == dims and (w := floors(v)) is not None]
    start = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), w) for i, w in kept)[:k]
    now = [w for _, w in start]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda w: min((far(w, c), j) for j, c in enumerate(now))
    for _ in range(rounds):
        own = {}
        for _, w in kept:
            own.setdefault(nearest(w)[1], []).append(w)
        now = [[sum(x) // len(own[j]) for x in zip(*own[j], strict=True)] if j in own else c for j, c in enumerate(now)]
    found = [(i, *nearest(w)[::-1]) for i, w in kept]
    each = {j: sum(d for _, c, d in found if c == j) for j in range(len(now))}
    return sorted((i, j, d, each[j], sum(each.values()), hashlib.sha256(",".join(map(str, now[j])).encode()).hexdigest()) for i, j, d in found)


def clustered(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x") for r in rows], VECTORS + ", cluster string").repartition(3)
    return sorted(tuple(r) for r in centroids.cluster(df, **options).collect())


@pytest.mark.parametrize("k", [1, 7, 30])
def test_clusters_equal_brute_force(spark, k):
    rows = vector_rows(300, 8, 11) + [(400_000 + i, [0.25] * 8, 0) for i in range(80)] + ODD_VECTORS
    assert clustered(spark, rows, k=k, rounds=4, dims=8) == brute_clusters(rows, k, 4, 8)


def test_clusters_of_odd_input(spark):
    assert clustered(spark, []) == []
    few = [(i, [float(i % 2)] * 4, 0) for i in range(5)]  # ties, repeated vectors, fewer than k
    assert clustered(spark, few, k=40, dims=4) == brute_clusters(few, 40, 5, 4)
    again = few + few[:2]
    assert clustered(spark, again, k=3, dims=4) == brute_clusters(again, 3, 5, 4)


def test_bounds_spare_scans_and_stay_exact():
    draw = np.random.default_rng(1)
    middles = draw.integers(-200, 200, (20, 16))
    v = middles[draw.integers(20, size=3000)] + draw.integers(-15, 15, (3000, 16))
    old = v[:20].copy()
    at, near, second = centroids.scanned(v, old)
    upper, lower = centroids._up(np.sqrt(near.astype(float))), centroids._down(np.sqrt(second.astype(float)))
    scans = 0
    for _ in range(6):
        new = np.array([v[at == j].sum(axis=0) // max((at == j).sum(), 1) if (at == j).any() else old[j] for j in range(20)])
        at, upper, lower, n = centroids.assign(v, at, upper, lower, new, *centroids.drifts(old, new), centroids.half_ways(new))
        scans, old = scans + n, new
        distance = ((v[:, None] - new[None]) ** 2).sum(axis=2)
        assert (at == distance.argmin(axis=1)).all()
        assert (upper >= np.sqrt(distance[np.arange(3000), at])).all() and (lower <= np.sqrt(np.partition(distance, 1, axis=1)[:, 1]) + 1e-6).all()
    assert scans < 0.5 * 6 * 3000
