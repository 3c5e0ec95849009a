"""Quality and language models: held-out accuracy, the identity of the machine, odd input."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from corpuslake.llm.language import UNKNOWN, LanguageModel, bucket, fit_languages, identify
from corpuslake.llm.quality import _STATS, FactorisationMachine, Features, _statistics, fit_quality, score_quality

LARGER = "/root/testdata/sf0.01"


def test_interactions_equal_all_pairs():
    machine = FactorisationMachine(bits=6, rank=3, seed=1)
    machine.w[:] = np.random.default_rng(0).normal(0, 1, len(machine.w))
    slots, x, lengths = Features(6).of(["the cat sat on the mat", "", "a"])
    got, at = machine.score(slots, x, lengths), 0
    for k, n in enumerate(lengths):
        s, v = slots[at : at + n], x[at : at + n]
        y = machine.b + sum(machine.w[i] * a for i, a in zip(s, v, strict=True))
        y += sum(float(machine.v[i] @ machine.v[j]) * a * b for (i, a), (j, b) in itertools.combinations(zip(s, v, strict=True), 2))
        assert got[k] == pytest.approx(1 / (1 + np.exp(-y)), abs=1e-4)
        at += n


def test_features_do_not_depend_on_the_batch():
    texts = ["one two two", "", "x\ny\nx", "12 AB | é"]
    together = Features(8).of(texts)
    alone = [Features(8).of([t]) for t in texts]
    for k in range(3):
        assert np.array_equal(together[k], np.concatenate([a[k] for a in alone]))
    assert set(together[0][:_STATS]) == set(range(_STATS))


def test_quality_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{LARGER}/{t}.parquet") for t in ("documents", "labels"))
    held_out = bucket(F.col("doc_id"), 5) == 0
    scored = score_quality(docs, fit_quality(docs, labels.filter(~held_out)))
    rows = scored.filter(held_out).join(labels.select("doc_id", "quality"), "doc_id").select("score", "quality", "predicted").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    ranked = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert len(bad) > 5 and ranked > 0.85
    assert np.mean([r["predicted"] for r in rows if r["quality"] == 1]) > 0.95


def test_quality_of_odd_input(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.1), (3, "w " * 50_000, 0.2), (3, "w", 0.2), (None, "x", None)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (99, 1), (3, 0)], "doc_id long, quality int")
    rows = score_quality(docs, fit_quality(docs, labels)).collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    none = fit_quality(docs, labels.limit(0))
    assert score_quality(docs.limit(0), none).count() == 0
    assert [type(r["score"]) for r in score_quality(docs.limit(1), none).collect()] == [float]


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    held_out = bucket(F.col("doc_id"), 4) == 2
    judged = identify(docs, fit_languages(docs.filter(~held_out))).filter(held_out & F.col("lang").isNotNull())
    right, n, rejected = judged.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.avg(F.col("rejected").cast("int"))).first()
    assert n > 200 and right > 0.95 and rejected < 0.01


def test_languages_of_odd_input(spark):
    train = spark.createDataFrame(
        [(i, t, k) for i, (t, k) in enumerate([("the house and the garden of the king", "en"), ("das haus und der garten von dem könig", "de")] * 20)] + [(98, None, "en"), (99, "text", None)],
        "doc_id long, text string, lang string",
    )
    model = fit_languages(train)
    rows = [(1, None, 9), (2, "", 9), (3, "12 34 -- !", 9), (4, "the garden and the king", 9), (4, "the garden and the king", 9), (5, "DER GARTEN UND DAS HAUS", 9), (6, "das haus und der garten " * 20_000, 9)]
    got = identify(spark.createDataFrame(rows, "doc_id long, text string, score int"), model).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 7 and [by[i]["lang_pred"] for i in (1, 2, 3)] == [UNKNOWN] * 3 and all(by[i]["rejected"] and by[i]["score"] == 0 for i in (1, 2, 3))
    assert (by[4]["lang_pred"], by[5]["lang_pred"], by[6]["lang_pred"]) == ("en", "de", "de") and all(0 <= r["score"] <= 1 for r in got)
    assert identify(train.limit(0), model).count() == 0
    assert identify(train.limit(1), fit_languages(train.limit(0))).first()["lang_pred"] == UNKNOWN


def test_a_narrow_margin_is_rejected(spark):
    same = LanguageModel({"aa": b"the same words in both", "bb": b"the same words in both"})
    row = identify(spark.createDataFrame([(1, "the same words")], "doc_id long, text string"), same).first()
    assert row["lang_pred"] == "aa" and row["score"] == 0 and row["rejected"]


def test_noise_and_unlearned_languages_are_rejected(spark):
    """Random letters of any length, and texts of a language that wasn't learned, against a model of the table."""
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "text", "lang")
    model, draw = fit_languages(docs), random.Random(2)
    noise = [(k * 100 + i, "".join(draw.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(n))) for k, n in enumerate((20, 45, 90, 200, 600, 2000)) for i in range(50)]
    got = identify(spark.createDataFrame(noise, "doc_id long, text string"), model).groupBy(F.floor(F.col("doc_id") / 100).alias("k")).agg(F.avg(F.col("rejected").cast("int")).alias("share")).collect()
    assert len(got) == 6 and all(r["share"] >= 0.8 for r in got)
    without = fit_languages(docs.filter("lang <> 'fr'"))
    parts = docs.filter("lang = 'fr' AND length(text) > 2000").limit(60).select("doc_id", F.substring("text", 1, 200).alias("text"))
    share = lambda m: identify(parts, m).agg(F.avg(F.col("rejected").cast("int"))).first()[0]
    assert share(model) == 0 and share(without) > 0.5


def made_up(lang, n, seed):
    """Words of a vocabulary of the language's own."""
    own, draw = random.Random(lang), random.Random(f"{lang}{seed}")
    words = ["".join(own.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(own.randrange(2, 9))) for _ in range(40)]
    return " ".join(draw.choice(words) for _ in range(n))


def test_every_language_is_learned(spark):
    """More than 64 languages of 2 to 3 rows each, and two with more."""
    names = [f"l{i:02}" for i in range(70)]
    rows = [(k * 100 + i, made_up(lang, 150, k), lang) for k in range(3) for i, lang in enumerate(names) if k < 2 or i < 2]
    model = fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5))
    assert sorted(model.dictionaries) == names
    held = spark.createDataFrame([(i, made_up(lang, 60, "held"), lang) for i, lang in enumerate(names)], "doc_id long, text string, lang string")
    assert identify(held, model).filter("lang_pred = lang").count() >= 66
    few = fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=1, languages=2)
    assert sorted(few.dictionaries) == names[:2] and all(few.dictionaries.values())


def test_ids_that_repeat_teach_no_more_than_others(spark):
    rows = [(7, made_up("aa", 5, k), "aa") for k in range(20)]
    model = fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=4)
    assert len(model.dictionaries["aa"].split()) == 20


def test_a_rare_language_shortens_no_dictionary(spark):
    rows = [(i, made_up(lang, 600, i), lang) for i, lang in enumerate(["aa", "bb"] * 40)] + [(1000, "eine kurze zeile", "cc")]
    rows += [(2000 + k, made_up("dd", 600, k), "dd") for k in range(4)]
    model = fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {k: len(v) for k, v in model.dictionaries.items() if k in ("aa", "bb")} == {"aa": 96 << 10, "bb": 96 << 10}
    assert [(size, len(places)) for size, places in model.rounds()] == [(8 << 10, 4), (96 << 10, 2)]
    held = spark.createDataFrame([(i, made_up(lang, 80, "held"), lang) for i, lang in enumerate(["aa", "bb", "dd"])] + [(9, "eine kurze zeile", "cc")], "doc_id long, text string, lang string")
    assert identify(held, model).filter("lang_pred = lang").count() == 4


def test_signs_that_are_no_letters_have_no_language():
    model = LanguageModel({"aa": b" lorem ipsum " * 9, "bb": b" dolor sit " * 9})
    assert all(model.classify(t, model.encoders()) == (UNKNOWN, 0.0) for t in ("\u00b2 \u00bd", "\u2462", "12 + 3", ""))
    assert model.classify("\u00b2 lorem", model.encoders())[0] == "aa"


def test_the_choice_equals_plain_compression(spark):
    """Short and long texts against one compressor a language made here."""
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "text", "lang")
    model = fit_languages(docs, per_language=20)
    assert len({len(d) for d in model.dictionaries.values()}) >= 1 and len(model.rounds()) == 1
    size = model.rounds()[0][0]
    for text in [r["text"] for r in docs.filter("length(text) > 0").limit(60).collect()]:
        raw = re.sub(r"[\W\d_]+", " ", text.lower()).strip()
        raw = f" {raw} ".encode()
        totals = {}
        for lang, d in model.dictionaries.items():
            made = zstandard.ZstdCompressor(level=12, dict_data=zstandard.ZstdCompressionDict(d[-size:], dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False)
            totals[lang] = sum(len(made.compress(raw[i : i + 1000])) for i in range(0, len(raw), 1000))
        least = min(totals.values())
        lang, score = model.classify(text, model.encoders())
        if lang != UNKNOWN:
            second = sorted(totals.values())[1]
            assert abs(totals[lang] - least) <= len(raw) // 1000 * 2 + 2 and abs(score - (second - least) / second) < 0.05


def test_parts_come_from_the_ends_of_texts_too(spark):
    rows = [(i, "\u00e4 " * 4000 + "qqq " * 4000, "aa") for i in range(40)]
    model = fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=30)
    assert b"qqq" in model.dictionaries["aa"] and "\u00e4".encode() in model.dictionaries["aa"]


@pytest.mark.parametrize("times", [1, 5000])
def test_the_share_of_letters_does_not_depend_on_the_length(times):
    text = "\u2167\u00b2a" * times
    assert _statistics(text, Counter(), 1)[3] == _statistics(text[:3], Counter(), 1)[3]
