"""Language identification by compression.

Each language has a raw-content zstandard dictionary, cut from a bounded sample of
its labelled texts. A text is encoded in pieces of a fixed size with every
dictionary, and the language of the smallest total is chosen; pieces keep the
dictionary's share of the evidence the same at the end of a long text as at its
start. The score is the margin, the share by which the smallest total lies below
the next one; a document is rejected when it has no letter, or its margin is below ``narrow`` + ``short`` / sqrt(characters): margins of noise
and of languages that weren't learned shrink with the length, those of learned languages hardly do. By the tables' held-out rows that rejects nine in ten texts of random letters, at any length,
and two in a thousand documents, which mix languages.

Fit: labelled texts are cut into parts of ``piece`` * 4 characters, from the first to the last one, at most ``per_language`` parts of each
language are drawn by a hash of id and place, and the last ``dictionary`` bytes (96 KiB) of them are its dictionary. A part passes a threshold from its language's count first, so that no task gets a whole language. Prediction reads every whole text.

A larger dictionary must not win by its size. Each language has the largest of a few sizes that its
rows fill (the smallest, if none). All are compared at the smallest size first; where the best one has
no longer dictionary it is the answer, otherwise those with longer ones are compared again at the
next size. So a language with few rows is judged at its size and shortens no other's dictionary.

Nulls and odd input: a null text or one without a letter is ``und`` with score 0 and
is rejected. Equal totals go to the language with more labelled rows, then by name. Rows that repeat
are judged alike. Without any labelled row all texts are ``und``. Other columns pass through;
one with the name of a result column is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
#: Sizes at which dictionaries are compared; beyond the last one only the longest of a fit.
_SIZES = tuple(k << 10 for k in (8, 16, 32, 64, 96))
#: What may be a letter; of these, signs like the superscript two are none.
_LETTER = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]+")


def _letters(text: str) -> str:
    """Lower-cased words with one space around each: signs and digits say little about a language."""
    return f" {_OTHER.sub(' ', text.lower()).strip()} "


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


class LanguageModel:
    """Dictionaries by language, the most frequent language first."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = 12, piece: int = 1000):
        self.dictionaries, self.level, self.piece = dictionaries, level, piece

    def rounds(self) -> list[tuple[int, list[int]]]:
        """(dictionary size, places of the languages compared at it), from the smallest size on."""
        lengths = [len(raw) for raw in self.dictionaries.values()]
        sizes = sorted({*_SIZES, *[max(lengths)] * (max(lengths) > _SIZES[-1])}) if lengths else []
        own = [max([s for s in sizes if s <= n], default=sizes[0]) for n in lengths]
        return [(s, [i for i, o in enumerate(own) if o >= s]) for s in sorted(set(own))]

    def encoders(self) -> list[dict[int, zstandard.ZstdCompressor]]:
        """Those of each round, by place of the language."""
        out, raws = [], list(self.dictionaries.values())
        for size, places in self.rounds():
            out.append({})
            for i in places:
                d = zstandard.ZstdCompressionDict(raws[i][-size:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=self.level)
                out[-1][i] = zstandard.ZstdCompressor(dict_data=d, write_content_size=False)
        return out

    def classify(self, text: str | None, encoders) -> tuple[str, float]:
        if not text or not self.dictionaries or not has_letter(text):
            return UNKNOWN, 0.0
        raw = _letters(text).encode("utf-8", "replace")
        step = self.piece
        pieces = [raw[i : i + step] for i in range(0, len(raw), step)]
        for made, longer in zip(encoders, [*encoders[1:], {}], strict=True):
            totals = {i: sum(len(e.compress(p)) for p in pieces) for i, e in made.items()}
            best = min(totals, key=totals.__getitem__)
            if best not in longer:
                break
        rest = min((t for i, t in totals.items() if i != best), default=totals[best] * 2)
        return list(self.dictionaries)[best], (rest - totals[best]) / rest

    def udf(self) -> Callable[[Column], Column]:
        model = self

        @F.pandas_udf("lang_pred string, score double")
        def judge(texts: pd.Series) -> pd.DataFrame:
            encoders = model.encoders()
            return pd.DataFrame([model.classify(t, encoders) for t in texts], columns=["lang_pred", "score"])

        return judge


def fit_languages(labelled: DataFrame, per_language: int = 300, languages: int = 200, piece: int = 1000, dictionary: int = 96 << 10) -> LanguageModel:
    """A model from rows with doc_id, text and lang (rows without text or lang teach nothing).

    The ``languages`` most frequent ones are learned, which bounds the model and the work a text, whatever a dirty column holds.
    """
    labelled = labelled.filter("lang IS NOT NULL AND text IS NOT NULL AND text != ''").select("doc_id", "lang", "text")
    size = piece * 4
    places = F.ceil(F.length("text") / size)
    most = labelled.groupBy("lang").agg(F.count("*").alias("rows"), F.sum(places).alias("parts")).orderBy(F.desc("rows"), "lang")
    counts = most.limit(languages).collect()
    texts: dict[str, list[str]] = {r["lang"]: [] for r in counts}
    few = labelled.sparkSession.createDataFrame([(r["lang"], min(1.0, 2 * per_language / r["parts"])) for r in counts], "lang string, few double")
    # The share that passes holds twice as many parts as are wanted; the first ones by hash are taken.
    parts = labelled.join(F.broadcast(few), "lang").select("*", F.explode(F.sequence(F.lit(0).cast("long"), places - 1)).alias("at"))
    turn = F.xxhash64("doc_id", "at")
    parts = parts.filter(F.pmod(turn, F.lit(1 << 30)) < F.col("few") * (1 << 30)).select("lang", "doc_id", turn.alias("turn"), F.substr("text", F.col("at") * size + 1, F.lit(size)).alias("part"))
    drawn: dict[str, list] = {lang: [] for lang in texts}
    for r in parts.toLocalIterator():
        own = drawn[r["lang"]]
        own.append((r["turn"] & (1 << 30) - 1, r["turn"], r["part"]))
        if len(own) >= 4 * per_language:  # ids that repeat can't make it grow
            own[:] = sorted(own)[:per_language]
    for lang, own in drawn.items():
        texts[lang] = [_letters(part) for _, _, part in sorted(own)[:per_language]]
    cut = {k: "".join(v).encode("utf-8", "replace") for k, v in texts.items() if v}
    return LanguageModel({k: v[-dictionary:] for k, v in cut.items()}, piece=piece)


def identify(docs: DataFrame, model: LanguageModel, narrow: float = 0.005, short: float = 0.3) -> DataFrame:
    """``docs`` with lang_pred, score and rejected."""
    judged = docs.withColumn("__judged", model.udf()(F.col("text")))
    judged = judged.withColumns({"lang_pred": F.col("__judged.lang_pred"), "score": F.col("__judged.score")}).drop("__judged")
    least = F.lit(narrow) + F.lit(short) / F.sqrt(F.greatest(F.length("text"), F.lit(1)))
    return judged.withColumn("rejected", (F.col("lang_pred") == UNKNOWN) | (F.col("score") < least))


def bucket(doc_id: Column, of: int) -> Column:
    """crc32 of the id's decimal text, modulo ``of``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % of
