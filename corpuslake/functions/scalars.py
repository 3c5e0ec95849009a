"""Scalar functions (FN-*), all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def regex_escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def object_key(key: Column, prefix: str) -> Column:
    """The key under its prefix, once. Null and empty keys, the bare prefix and any key under an empty prefix stay as they are."""
    folder = prefix.strip("/")
    if not folder:
        return key
    has = (key == folder) | key.startswith(f"{folder}/")
    return F.when(key.isNull() | (key == "") | has, key).otherwise(F.concat(F.lit(f"{folder}/"), F.regexp_replace(key, "^/+", "")))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"^\.", ""))


def log_path(url: Column) -> Column:
    return F.replace(F.substring_index(url, "?", 1), F.lit("%"), F.lit("%25"))


def caller_ip(forwarded: Column, remote: Column) -> Column:
    """The last forwarded entry without its port, else the remote address."""
    last = F.trim(F.element_at(F.split(forwarded, ","), -1))
    return F.coalesce(F.when(last != "", F.regexp_replace(last, r"^(\d+\.\d+\.\d+\.\d+):\d+$", "$1")), remote)


def masked_ip(ip: Column) -> Column:
    two = F.regexp_extract(ip, r"^(\d{1,3}\.\d{1,3})\.\d{1,3}\.\d{1,3}$", 1)
    return F.when(two != "", F.concat(two, F.lit(".x.x"))).otherwise("redacted")


def truncate(text: Column, most: int) -> Column:
    """Cut at the last space before the limit, with an ellipsis."""
    cut = F.substring(text, 1, most)
    space = F.instr(F.reverse(cut), " ")
    word = F.when(space > 0, F.substr(cut, F.lit(1), F.length(cut) - space)).otherwise(cut)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(word, F.lit("…")))


def iso_or_null(value: Column) -> Column:
    return F.try_to_timestamp(value)


def to_number(value: Column) -> Column:
    return F.when(F.trim(value.cast("string")) != "", value.try_cast("double"))


def clamp(value: Column, low: int, high: int, default: int) -> Column:
    return F.coalesce(F.least(F.greatest(value.try_cast("int"), F.lit(low)), F.lit(high)), F.lit(default))


def strict_boolean(value: Column) -> Column:
    """Only the two literals; other spellings are no boolean."""
    return F.when(value == "true", True).when(value == "false", False)


def or_default(value: Column, default: str) -> Column:
    """A default for null and for the empty string."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def title_from_file(name: Column) -> Column:
    """A display title: no extension, separators as spaces, words with a capital, and what it is."""
    bare = F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), r"[-_]+", " ")
    words = F.transform(F.split(F.trim(bare), r"\s+"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2), F.length(w))))
    return F.concat(F.array_join(words, " "), F.lit(" Document"))


def citations(text: Column, n: int) -> Column:
    """0-based numbers of [k] with 1 <= k <= n, distinct and sorted."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.try_cast("int"))
    return F.array_sort(F.array_distinct(F.transform(F.filter(found, lambda k: k.between(1, n)), lambda k: k - 1)))


def prompt(question: Column, passages: Column, most: int = 8, chars: int = 1500) -> Column:
    """Numbered passages, each cut at a word, before the question."""
    lines = F.transform(F.slice(passages, 1, most), lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), truncate(p, chars)))
    return F.concat(F.array_join(lines, "\n\n"), F.lit("\n\nQuestion: "), question)


def expiry(issued: Column, days: int = 90) -> Column:
    return issued + F.make_dt_interval(F.lit(days))


def provenance(raw: Column, most: int = 200) -> Column:
    """Known fields of a provenance record, cut to a length; null when none is there."""
    r = F.from_json(raw, "path string, engine string, version string, options string, at string")
    part = lambda f: F.left(r[f], F.lit(most)).alias(f)
    kept = F.struct(part("path"), part("engine"), part("version"), part("options"), part("at"))
    return F.when(F.coalesce(r["path"], r["engine"], r["version"], r["options"], r["at"]).isNotNull(), kept)


def fault_class(message: Column) -> Column:
    # Parts of messages that tell of the runner's fault.
    runner = [
        "terminated abruptly", "process pool", "cannot schedule new futures", "cuda", "cublas", "cudnn", "out of memory",
        "device-side assert", "no kernel image", "failed to load page",
    ]
    m = F.lower(F.coalesce(message, F.lit("")))
    has = lambda *parts: F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(m, p))
    return F.when(has(*runner), "runner").when(has("404", "not found", "no such key"), "source").otherwise("document")
