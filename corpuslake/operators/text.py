"""Text quality, phrase presence and routing of extractions (TXT-*, PHR-*, ROU-*)."""

from __future__ import annotations

import string
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.sources.readers import spread

# White space as the reference's language has it, and a placeholder that stands for an image.
SPACES = " \t\n\v\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
_LINE_ENDS = [0x0A, 0x0D, 0x2028, 0x2029]
IMAGE = r"(?i)<!--\s*image\s*-->"


def strip_placeholders(text: Column) -> Column:
    out = F.regexp_replace(F.coalesce(text, F.lit("")), IMAGE, " ")
    out = F.regexp_replace(out, r"[ \t]+", " ")
    out = F.regexp_replace(out, r"\n[ \t]*\n[ \t]*\n+", "\n\n")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def _round(x: Column) -> Column:
    """Three digits, halves up, in the arithmetic of doubles."""
    return F.floor(x * 1000 + 0.5) / 1000


def _share(n: Column, of: Column) -> Column:
    return F.when(of > 0, _round(n / of)).otherwise(F.lit(0.0))


def _longest_runs(texts: pd.Series) -> pd.Series:
    """The longest run of at least four of a sign that ends no line, else 0."""
    out = []
    for text in texts:
        signs = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.append(np.flatnonzero(signs[1:] != signs[:-1]), len(signs) - 1) if len(signs) else np.empty(0, np.int64)
        sizes = np.diff(ends, prepend=-1)
        sizes, own = sizes[sizes > 3], signs[ends[sizes > 3]]
        out.append(max(sizes[~np.isin(own, _LINE_ENDS)].tolist(), default=0))
    return pd.Series(out, dtype="int64")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the quality measures of a text; classes of signs are counted in the JVM in one pass each without a pattern, runs of a sign in Arrow batches."""
    raw = F.coalesce(F.col(text), F.lit(""))
    without = lambda t, signs: F.translate(t, signs, "")
    letters, digits = string.ascii_letters, string.digits
    printable = "".join(map(chr, range(0x20, 0x7F)))
    d = spread(docs).withColumns({"length": F.length(raw), "placeholders": F.regexp_count(raw, F.lit(IMAGE)), "__body": F.regexp_replace(raw, IMAGE, " ")})
    d = d.withColumns({"__dense": without(F.col("__body"), SPACES), "__tokens": F.filter(F.split("__body", f"{SPACE}+"), lambda t: t != ""), "__lines": F.filter(F.split("__body", "\n"), lambda x: without(x, SPACES) != "")})
    # Signs of the text that are neither letters nor digits, each once: tokens are rid of them without a pattern.
    d = d.withColumns({"__odd": without(F.col("__dense"), letters + digits), "__letters": F.length("__dense") - F.length(without(F.col("__dense"), letters))})
    d = d.withColumn("__signs", F.array_join(F.array_distinct(F.split("__odd", "")), ""))
    plain = F.when(F.col("__signs") == "", F.col("__tokens")).otherwise(F.transform("__tokens", lambda t: F.call_function("translate", t, F.col("__signs"), F.lit(""))))
    d = d.withColumns({"__denom": F.greatest(F.length("__dense"), F.lit(1)), "__plain": plain, "__trimmed": F.length(F.trim("__body", F.lit(SPACES)))})
    d = d.withColumn("__words", F.filter("__plain", lambda w: (F.length(w) >= 3) & (without(w, digits) == w)))
    # A number counts with the blanks around it, so two neighbours need a blank each.
    numeric = lambda x: F.regexp_count(F.regexp_replace(x, f"({SPACE})", "$1$1"), F.lit(rf"(^|{SPACE})-?[0-9]+(\.[0-9]+)?({SPACE}|$)"))
    bars = lambda x: F.length(x) - F.length(F.replace(x, F.lit("|")))
    digital = lambda x: F.length(x) - F.length(without(x, digits)) >= 3
    rows = F.size(F.filter("__lines", lambda x: bars(x) >= 2)) + F.size(F.filter("__lines", lambda x: F.when(digital(x), numeric(x) >= 3).otherwise(False)))
    n, dense = F.size("__tokens"), F.length("__dense")
    d = d.withColumns(
        {
            "placeholder_ratio": _share(F.col("length") - F.col("__trimmed"), F.col("length")),
            "alpha_ratio": _round(F.col("__letters") / F.col("__denom")),
            "digit_ratio": _round((dense - F.length("__odd") - F.col("__letters")) / F.col("__denom")),
            "non_ascii_ratio": _round(F.length(without(F.col("__odd"), printable)) / F.col("__denom")),
            "token_count": n.cast("long"),
            "word_count": F.size("__words").cast("long"),
            "tabular": (F.size("__lines") > 0) & (rows * 2 >= F.size("__lines")),
            "mean_token_length": _share(dense, n),
            "short_token_ratio": _share(F.size(F.filter("__plain", lambda t: F.length(t) <= 2)), n),
            "vowelless_ratio": _share(F.size(F.filter("__words", lambda w: without(w, "aeiouyAEIOUY") == w)), F.size("__words")),
            "separator_ratio": _round(F.length(F.array_join(F.regexp_extract_all("__body", F.lit(r"[.\-_=·•*]{4,}"), F.lit(0)), "")) / F.col("__denom")),
            "max_repeat": F.pandas_udf(_longest_runs, "long")("__body"),
        }
    )
    return d.drop("__body", "__dense", "__tokens", "__lines", "__denom", "__trimmed", "__odd", "__letters", "__signs", "__plain", "__words")


def _named(tests: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests]))


def classify(measured: DataFrame) -> DataFrame:
    """``measured`` with verdict and reasons; tables are exempt from the rules on fragments."""
    c, prose = F.col, ~F.col("tabular")
    worded = c("word_count") >= 5
    # Names and limits of the rules, in the order of the reasons.
    garbage = _named(
        [
            ("mostly-image-placeholders", c("placeholder_ratio") > 0.5),
            ("vowelless-tokens", worded & (c("vowelless_ratio") > 0.2)),
            ("non-ascii-noise", c("non_ascii_ratio") > 0.15),
            ("mostly-separator-furniture", (c("separator_ratio") > 0.3) & (c("alpha_ratio") < 0.35)),
            ("fragmented-tokens", prose & (c("short_token_ratio") > 0.5)),
            ("low-letter-density", prose & (c("alpha_ratio") < 0.5) & (c("digit_ratio") < 0.3)),
        ]
    )
    marginal = _named(
        [
            ("some-image-placeholders", c("placeholder_ratio") > 0.2),
            ("some-separator-furniture", c("separator_ratio") > 0.1),
            ("some-vowelless-tokens", worded & (c("vowelless_ratio") > 0.1)),
            ("some-fragmented-tokens", prose & (c("short_token_ratio") > 0.35)),
            ("very-short-tokens", prose & (c("mean_token_length") > 0) & (c("mean_token_length") < 3)),
        ]
    )
    d = measured.withColumns({"__g": garbage, "__m": marginal})
    verdict = F.when(F.size("__g") > 0, "garbage").when(F.size("__m") > 0, "marginal").otherwise("clean")
    return d.withColumns({"verdict": verdict, "reasons": F.when(F.size("__g") > 0, F.col("__g")).otherwise(F.col("__m"))}).drop("__g", "__m")


def loose(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), rf"{SPACE}+", " "), "^ | $", ""))


class _Folding(dict):
    """Code point to what folding makes of it: nothing of a mark, a space of a separator, else its lower case."""

    def __missing__(self, code: int) -> str | None:
        ch = chr(code)
        kind = unicodedata.category(ch)[0]
        self[code] = None if kind == "M" else " " if kind in "PSZ" or ch.isspace() else ch.lower()
        return self[code]


_FOLDING = _Folding()


def fold(column) -> Column:
    """Compatibility form without marks, lower-cased: with single spaces for separators, and without them."""
    return F.pandas_udf(_folded, "spaced string, despaced string")(column)


def _folded(texts: pd.Series) -> pd.DataFrame:
    words = [unicodedata.normalize("NFKD", text or "").translate(_FOLDING).split() for text in texts]
    return pd.DataFrame({"spaced": [" ".join(w) for w in words], "despaced": ["".join(w) for w in words]})


def fault_evidence(text, phrase) -> Column:
    """(kind, evidence) of a phrase that is found without spaces only, null where it isn't.

    ``joined``: the text has fewer spaces than the phrase, ``split``: more, ``other``: as many. The evidence is the place in the text's compatibility form with 40 signs around it, white space as single spaces.
    """
    return F.pandas_udf(_evidence, "kind string, evidence string")(text, phrase)


def _place(text: str) -> tuple[str, list[int], list[int]]:
    """Letters without separators; for each its position in ``text`` and the spaces before it."""
    letters, at, before = [], [], []
    spaces, apart = 0, False
    for i, ch in enumerate(text):
        folded = _FOLDING[ord(ch)]
        if folded == " ":
            apart = bool(letters)
        elif folded:
            spaces += apart
            apart = False
            letters.append(folded)
            at += [i] * len(folded)
            before += [spaces] * len(folded)
    return "".join(letters), at, before


#: Signs of evidence on both sides of the place.
_AROUND = 40


def _evidence(texts: pd.Series, phrases: pd.Series) -> pd.DataFrame:
    out = []
    for text, phrase in zip(texts, phrases, strict=True):
        form = unicodedata.normalize("NFKD", text or "")
        (letters, at, before), (needle, _, own) = _place(form), _place(unicodedata.normalize("NFKD", phrase or ""))
        first = letters.find(needle) if needle else -1
        if first < 0:
            out.append((None, None))
            continue
        last = first + len(needle) - 1
        more = before[last] - before[first] - own[-1]
        out.append(("joined" if more < 0 else "split" if more > 0 else "other", " ".join(form[max(0, at[first] - _AROUND) : at[last] + 1 + _AROUND].split())))
    return pd.DataFrame(out, columns=["kind", "evidence"])


def ladder(text: Column, phrase: Column, folded_text: Column, folded_phrase: Column) -> Column:
    """The first rung on which the phrase is found, or null."""
    has = lambda a, b: F.contains(a, b)
    return (
        F.when(F.coalesce(phrase, F.lit("")) == "", F.lit(None).cast("string"))
        .when(has(text, phrase), "exact")
        .when(has(loose(text), loose(phrase)), "whitespace")
        .when(folded_phrase["despaced"] == "", None)
        .when(has(folded_text["spaced"], folded_phrase["spaced"]), "punct")
        .when(has(folded_text["despaced"], folded_phrase["despaced"]), "despaced")
    )


#: Rungs in order, as a column's rank.
RUNGS = ["exact", "whitespace", "punct", "despaced"]


def presence(labels: DataFrame, chunks: DataFrame) -> DataFrame:
    """Class of every label (label_id, document_id, phrase): the best rung over its document's
    chunks (document_id, chunk_index, content), straddle-<rung> over the joined chunks, absent, or no-chunks."""
    folded = labels.withColumn("__needle", fold("phrase"))
    pairs = folded.join(chunks.withColumn("__hay", fold("content")), "document_id", "left")
    rank = lambda rung: F.coalesce(*[F.when(rung == r, F.lit(i)) for i, r in enumerate(RUNGS)], F.lit(9))
    own = pairs.withColumn("__rung", ladder(F.col("content"), F.col("phrase"), F.col("__hay"), F.col("__needle")))
    per = own.groupBy("label_id", "document_id", "phrase").agg(
        F.min(F.struct(rank(F.col("__rung")).alias("rank"), F.col("chunk_index"), F.col("__rung").alias("rung"), F.when(F.col("__rung") == "despaced", F.col("content")).alias("own"))).alias("best"),
        F.count("content").alias("n_chunks"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"]), "\n\n").alias("joined"),
    )
    per = per.withColumns({"__hay": fold("joined"), "__needle": fold("phrase")})
    across = ladder(F.col("joined"), F.col("phrase"), F.col("__hay"), F.col("__needle"))
    found = (
        F.when(F.col("n_chunks") == 0, "no-chunks").when(F.col("best.rank") < 9, F.col("best.rung"))
        .when(across.isNotNull(), F.concat(F.lit("straddle-"), across)).otherwise("absent")
    )
    words = F.array_distinct(F.transform(tokenize(F.col("phrase")), F.lower))
    missing = F.filter(words, lambda w: ~F.contains(F.col("__hay.despaced"), w))
    share = F.when((F.size(words) > 0) & (F.col("n_chunks") > 0), F.round((F.size(words) - F.size(missing)) / F.size(words), 4))
    despaced = F.when(F.col("best.rung") == "despaced", F.col("best.own")).when(found == "straddle-despaced", F.col("joined"))
    fault = fault_evidence(despaced, F.when(despaced.isNotNull(), F.col("phrase")))
    per = per.withColumn("__fault", fault)
    return per.select(
        "label_id", "document_id", found.alias("class"), F.when((F.col("best.rank") < 9) & (F.col("n_chunks") > 0), F.col("best.chunk_index")).alias("matched_chunk"),
        share.alias("coverage"), F.when(F.col("n_chunks") > 0, missing).otherwise(F.array().cast("array<string>")).alias("missing_tokens"),
        F.col("__fault.kind").alias("despaced_kind"), F.when(F.col("best.rank") < 9, F.col("__fault.evidence")).alias("evidence"),
    )


def tokenize(text: Column, limit: int = 16) -> Column:
    """The first terms of a query: runs of letters and digits."""
    return F.slice(F.filter(F.split(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]+"), lambda t: t != ""), 1, limit)


def route(n_pages: Column, median_chars: Column, share_over_50: Column, size: Column) -> Column:
    """text or ocr by a probe of the pages."""
    return (
        F.when(n_pages == 0, "ocr").when((median_chars >= 200) & (share_over_50 >= 0.8), "text")
        .when((size < 200_000) & (median_chars > 0), "text").otherwise("ocr")
    )


def outcome(n_pages: Column, median_chars: Column, share_over_50: Column, size: Column, text: Column, recognised: Column, readable: Column, enabled: bool = True) -> Column:
    """(route, reason) of an extraction: text, ocr, ocr-empty (recognition ran and found nothing) or skip (it had nothing to read, or is off).

    ``n_pages`` is null where the probe could not open the file, ``text`` is the text layer, ``recognised`` what recognition gives and ``readable`` whether it
    could open the file.
    """
    probe = route(n_pages, median_chars, share_over_50, size)
    chars = real_chars(text)
    poor = F.when(n_pages.isNull(), F.lit("probe failed")).when(probe == "ocr", "probe says text-poor").when((chars < 500) & (size > 200_000), F.concat(F.lit("low yield ("), chars.cast("string"), F.lit(" chars from "), F.floor(size / 1024).cast("string"), F.lit(" KB)")))
    if not enabled:
        return F.when(poor.isNull(), F.struct(F.lit("text").alias("route"), poor.alias("reason"))).otherwise(F.struct(F.lit("skip").alias("route"), F.concat(poor, F.lit("; OCR disabled")).alias("reason")))
    found = real_chars(recognised) >= 1
    kind = F.when(poor.isNull(), "text").when(~F.coalesce(readable, F.lit(False)), "skip").when(found, "ocr").otherwise("ocr-empty")
    return F.struct(kind.alias("route"), F.when(kind == "ocr-empty", F.concat(poor, F.lit("; OCR found no text"))).otherwise(poor).alias("reason"))


def real_chars(text: Column) -> Column:
    """Characters that are neither placeholders nor white space."""
    return F.length(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), IMAGE, ""), r"\s+", ""))


def escalation(chars: Column, size: Column) -> Column:
    """What a low yield leads to: tiling without text, forced recognition with little of a large file."""
    return F.when(chars < 32, "tile").when((chars < 500) & (size > 200_000), "force").otherwise("keep")


def extension_class(extension: Column) -> Column:
    """image, document (what the converter reads), unsupported (what nothing reads), other (read as text layer or not known)."""
    # File types by the converter that reads them.
    images = ["jpg", "jpeg", "png", "tif", "tiff", "bmp", "gif"]
    documents = ["docx", "pptx", "xlsx", "htm", "html", "md"]
    unsupported = ["msg", "zip", "rtf", "doc", "ppt", "xls", "eml", "exe", "dwg"]
    ext = F.lower(F.regexp_replace(extension, r"^\.", ""))
    return F.when(ext.isin(images), "image").when(ext.isin(documents), "document").when(ext.isin(unsupported), "unsupported").otherwise("other")


def sampled_pages(n: int, most: int = 20) -> list[int]:
    """Pages to probe: all, or ``most`` evenly spaced ones with both ends (halves to even)."""
    return list(range(n)) if n <= most else sorted({round(i * (n - 1) / (most - 1)) for i in range(most)})


def probed_pages(n: Column, most: int = 20) -> Column:
    """Pages to probe by the other rule: every k-th from the first, where k is how often ``most`` goes into ``n``."""
    step = F.greatest(F.floor(n / most).cast("int"), F.lit(1))
    return F.when(n > 0, F.sequence(F.lit(0), n - 1, step)).otherwise(F.array().cast("array<int>"))


def evenly_probed_pages(n: Column, most: int = 20) -> Column:
    """All pages, or ``most`` evenly spaced ones with both ends, halves to even."""
    spaced = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * (n - 1) / (most - 1)).cast("int")))
    return F.when(n > most, spaced).when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def tiles(width: Column, height: Column, grid: int, overlap: float = 0.06) -> Column:
    """Boxes of a page cut into ``grid`` x ``grid`` equal tiles, row by row, each widened on all sides by a share of its own size."""
    def side(size: Column, k: Column) -> tuple[Column, Column]:
        tile = size.cast("double") / grid
        low, high = (k * tile - tile * overlap).cast("int"), ((k + 1) * tile + tile * overlap).cast("int")
        return F.greatest(low, F.lit(0)), F.least(high, size.cast("int"))

    def box(k: Column) -> Column:
        (left, right), (top, bottom) = side(width, k % grid), side(height, F.floor(k / grid))
        return F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom"))

    return F.transform(F.sequence(F.lit(0), F.lit(grid * grid - 1)), box)


def tiled_text(tiles: DataFrame, page: str, tile: str, text: str = "text") -> DataFrame:
    """(page, text): the lines of a page's tiles in order, each once, as tiles overlap; blank lines and placeholders are left out."""
    in_order = F.transform(F.array_sort(F.collect_list(F.struct(tile, text))), lambda t: t[text])
    lines = F.transform(F.split(F.array_join(in_order, "\n"), r"\r?\n"), lambda x: F.trim(x))
    kept = F.filter(lines, lambda x: (x != "") & ~x.rlike(f"^{IMAGE}$"))
    return tiles.groupBy(page).agg(F.array_join(F.array_distinct(kept), "\n\n").alias("text"))


def page_batches(page: Column, size: int = 25) -> Column:
    return F.floor(page / size).cast("int")
