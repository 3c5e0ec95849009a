"""Keyword search: query compilation, postings, ranking, highlights (Q-*, RNK-*, JON-02..04, SET-01)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.operators.access import all_of
from corpuslake.operators.text import tokenize

# Limits, and the words that carry no fuzzy or prefix clause.
TERMS, MIN_FUZZY, FUZZY_WEIGHT, MAX_SKIP, PAGE, FANOUT = 16, 4, 0.5, 100_000, 500, 25
K1, B = 1.2, 0.75
STOPWORDS = frozenset(
    "from hers herself himself itself mine myself ours ourselves that their theirs them themselves these they this those with yourself".split()
)


@dataclass(frozen=True)
class Clause:
    term: str
    fuzzy: bool = False
    prefix: bool = False


def terms_of(text: str | None) -> list[str]:
    """The same terms as ``tokenize`` gives for a column."""
    out, now = [], ""
    for ch in (text or "") + " ":
        if ch.isalnum():
            now += ch
        elif now:
            out.append(now)
            now = ""
    return out[:TERMS]


def compile_query(keywords: str, fuzzy: bool = True, prefix: bool = False) -> list[Clause]:
    """Clauses that must all match. Stopwords match exactly or not at all: they are left out unless nothing else is there."""
    terms = [t.lower() for t in terms_of(keywords)]
    last = len(terms) - 1
    clauses = [Clause(t, fuzzy and len(t) >= MIN_FUZZY, prefix and i == last and len(t) >= MIN_FUZZY) for i, t in enumerate(terms) if t not in STOPWORDS]
    return clauses or [Clause(t) for t in terms]


def clauses_text(clauses: list[Clause]) -> str:
    """The query in its readable form."""
    out = []
    for c in clauses:
        parts = [c.term, *([f"{c.term}~1^{FUZZY_WEIGHT}"] if c.fuzzy else []), *([f"{c.term}*"] if c.prefix else [])]
        out.append(f"({' OR '.join(parts)})" if len(parts) > 1 else c.term)
    return " AND ".join(out)


def matched_terms(vocabulary: DataFrame, clauses: list[Clause], also: list[str] | None = None) -> DataFrame:
    """(clause, term, weight, and the columns ``also``) of the vocabulary's terms that satisfy a clause; the vocabulary is read once, never the documents."""
    options = []
    for i, c in enumerate(clauses):
        weight = F.when(F.col("term") == c.term, 1.0)
        if c.prefix:
            weight = weight.when(F.col("term").startswith(c.term), 1.0)
        if c.fuzzy:
            close = F.length("term").between(len(c.term) - 1, len(c.term) + 1) & (F.levenshtein("term", F.lit(c.term), 1) == 1)
            weight = weight.when(close, FUZZY_WEIGHT)
        options.append(F.struct(F.lit(i).alias("clause"), weight.alias("weight")))
    also = also or []
    hits = vocabulary.select("term", *also, F.explode(F.filter(F.array(*options), lambda o: o["weight"].isNotNull())).alias("o"))
    return hits.select("o.clause", "term", "o.weight", *also)


def bm25(tf: Column, length: Column, df: Column, n_docs: Column, avg_len: Column) -> Column:
    idf = F.log(F.lit(1.0) + (n_docs - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (F.lit(1 - B) + F.lit(B) * length / avg_len))


def keyword_page(ranked: DataFrame, order: list[Column], top: int = 20, skip: int = 0) -> DataFrame:
    """A page of a keyword search: an oversized one is refused, not clamped."""
    if top > PAGE:
        raise ValueError(f"a page of more than {PAGE} rows is not supported for a keyword search")
    return page(ranked, order, top, skip)


#: Orders of lists, each ended by the id.
LISTS = {"name": lambda column, key: [F.asc(column), F.asc(key)], "newest": lambda column, key: [F.desc_nulls_last(column), F.asc(key)]}


def listing(rows: DataFrame, kind: str, column: str, key: str, top: int | None = None) -> DataFrame:
    """A list by name or from the newest on; rows without the column's value are no part of a list by name."""
    shown = rows.filter(F.col(column).isNotNull()) if kind == "name" else rows
    out = shown.orderBy(*LISTS[kind](column, key))
    return out if top is None else out.limit(top)


def project_criteria(source: str | None = None, **tags: str | None) -> Column:
    """Projects of one source, and of the areas by which they are tagged (municipality, regional_district, electoral_district); what isn't given is no condition."""
    given = {"source_system": source, **tags}
    if unknown := tags.keys() - {"municipality", "regional_district", "electoral_district"}:
        raise ValueError(f"no such criteria: {', '.join(sorted(unknown))}")
    return all_of(*(F.col(column) == F.lit(value) for column, value in given.items() if value))


def typeahead(rows: DataFrame, typed: str, name: str = "name", key: str = "id") -> DataFrame:
    """Rows whose name or id holds what was typed, whatever its case; nothing typed finds all."""
    wanted = F.lit(typed.strip().lower())
    return rows.filter(F.contains(F.lower(F.coalesce(F.col(name), F.lit(""))), wanted) | F.contains(F.lower(F.col(key)), wanted))


def fan_out(rows: DataFrame, projects: DataFrame, order: list[Column], field: str = "project_id", most: int = FANOUT) -> DataFrame:
    """Rows of the first ``most`` projects (id) that were found."""
    first = projects.orderBy(*order).limit(most).select(F.col("id").alias(field))
    return rows.join(F.broadcast(first), field, "left_semi")


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, first): each key once, with the place at which it came first."""
    return rows.groupBy(key).agg(F.min(order).alias("first"))


def net_total(count: Column, withheld: Column, page_rows: Column) -> Column:
    """The total that a caller is told: without what was withheld from this page, and never less than its rows."""
    return F.greatest(count - withheld, page_rows)


#: Rows that a list is read to at most.
_LISTED = 1000


def list_page(rows: DataFrame, order: list[Column], size: int, skip: int = 0) -> DataFrame:
    """A page of a list: read from the start to its end, and never beyond the ceiling, then cut."""
    return rows.orderBy(*order).limit(min(max(skip, 0) + max(size, 0), _LISTED)).offset(max(skip, 0))


def page(ranked: DataFrame, order: list[Column], top: int = 20, skip: int = 0) -> DataFrame:
    """One page, with the clamps of the service."""
    return ranked.orderBy(*order).offset(min(max(skip, 0), MAX_SKIP)).limit(min(max(top, 1), PAGE))


@dataclass
class FieldSpec:
    """What a field of an index allows."""

    column: str
    kind: str = "string"
    filterable: bool = True
    sortable: bool = False
    facetable: bool = False


# Names of fields on the wire by dataset.
ALIASES = {
    "Project": {"_id": "external_id", "project.name": "name", "proponent.name": "proponent"},
    "Document": {"_id": "id", "project": "project_id"},
    "DocumentChunk": {"_id": "chunk_id", "project": "project_id", "document": "document_id"},
}


@dataclass
class Compiled:
    predicate: Column
    dropped: list[str] = field(default_factory=list)


def values_of(raw) -> list[str]:
    parts = raw if isinstance(raw, list) else [raw]
    return [v.strip() for part in parts for v in str(part).split(",") if v.strip()]


def _typed(spec: FieldSpec, value: str) -> Column | None:
    c = F.col(spec.column)
    if spec.kind == "boolean":
        return c == (value == "true") if value in ("true", "false") else None
    if spec.kind in ("int", "long"):
        digits = value.removeprefix("-")
        limit = 2**31 if spec.kind == "int" else 2**53
        return c == int(value) if digits.isascii() and digits.isdigit() and -limit <= int(value) < limit else None
    if spec.kind == "double":
        try:
            return c == float(value)
        except ValueError:
            return None
    if spec.kind == "collection":
        return F.array_contains(c, value)
    return c == value if spec.kind == "string" else None


def build_filter(params: dict, fields: dict[str, FieldSpec], acl: Column, aliases: dict[str, str] | None = None) -> Compiled:
    """Values of one key are alternatives, keys are joined, the visibility is always part of it;
    what can't be expressed is dropped and named."""
    out = Compiled(acl)
    for name, raw in params.items():
        spec = fields.get((aliases or {}).get(name, name))
        options = [] if spec is None or not spec.filterable or spec.kind == "point" else [_typed(spec, v) for v in values_of(raw)]
        options = [o for o in options if o is not None]
        if not options:
            out.dropped.append(name)
            continue
        either = options[0]
        for o in options[1:]:
            either = either | o
        out.predicate = out.predicate & either
    return out


# Fixed value: an id of the other registry.
_OTHER_ID = r"(?i)^[0-9a-f]{24}$"


def project_ids(query: dict) -> list[str]:
    """Project ids that a query asks for, in any of its shapes, each once."""
    named = [query["project"]] if query.get("project") else []
    own = and_params(query)
    return list(dict.fromkeys(v for raw in [*named, *([own["project"]] if "project" in own else [])] for v in values_of(raw)))


def of_projects(rows: DataFrame, requested: list[str], projects: DataFrame, field: str = "project_id") -> DataFrame:
    """``rows`` of the requested projects. Ids of the other registry are translated by the readable ``projects`` (id, external_id); if any of them isn't among these, no row is
    returned: to drop it from the filter would answer with every row."""
    if not requested:
        return rows
    asked = rows.sparkSession.createDataFrame([(i,) for i in requested], "asked string")
    other = F.col("asked").rlike(_OTHER_ID)
    known = projects.select(F.col("external_id").alias("__external"), F.col("id").cast("string").alias("__own"))
    found = asked.join(known, other & (F.lower("asked") == F.lower("__external")), "left")
    ids = found.select(F.when(other, F.col("__own")).otherwise(F.col("asked")).alias("__id"))
    lost = ids.filter("__id IS NULL").select(F.lit(True).alias("__lost")).limit(1)
    own = rows.join(ids.distinct(), F.col(field).cast("string") == F.col("__id"), "left_semi")
    return own.withColumn("__all", F.lit(True)).join(F.broadcast(lost), F.col("__all") == F.col("__lost"), "left_anti").drop("__all")


def and_params(query: dict) -> dict:
    """Parameters in both of their shapes: and[key]=v and a nested and."""
    out = dict(query.get("and") or {}) if isinstance(query.get("and"), dict) else {}
    for name, value in query.items():
        if name.startswith("and[") and name.endswith("]"):
            out[name[4:-1]] = value
    return out


def check_params(query: dict, known: set[str]) -> None:
    if unknown := [k for k in query if k not in known and not (k.startswith("and[") and k.endswith("]"))]:
        raise ValueError(f"unknown parameters: {', '.join(sorted(unknown))}")


def build_order(sort_by, fields: dict[str, FieldSpec], keywords: bool, default: str = "id") -> list[Column]:
    """+field and -field in order, relevance last when there are keywords, always ended by the id."""
    out, seen = [], set()
    for part in values_of(sort_by) if sort_by else []:
        name = part.lstrip("+-")
        spec = fields.get(name)
        if spec is None or not spec.sortable or name in seen:
            continue
        seen.add(name)
        out.append(F.col(spec.column).desc_nulls_last() if part.startswith("-") else F.col(spec.column).asc_nulls_last())
    if keywords and not out:
        out.append(F.col("score").desc())
    return [*out, F.col(default).asc()]


def facets(rows: DataFrame, fields: dict[str, FieldSpec], names: list[str]) -> DataFrame:
    """(field, value, n) of the named fields that may be counted; asking for another one is an error."""
    if wrong := [n for n in names if n not in fields or not fields[n].facetable]:
        raise ValueError(f"no facets: {', '.join(wrong)}")
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("field"), F.trim(F.col(fields[n].column).cast("string")).alias("value")) for n in names)))
    return rows.select(pairs.alias("f")).select("f.*").filter("value <> ''").groupBy("field", "value").agg(F.count("*").alias("n"))


def facet(rows: DataFrame, column: str, selected: list[str] | None = None) -> DataFrame:
    """(value, n): trimmed values without blanks, selected ones kept at 0, and the total as 'all'."""
    value = F.trim(F.col(column))
    counted = rows.select(value.alias("value")).filter("value <> ''").groupBy("value").agg(F.count("*").alias("n"))
    if selected:
        wanted = rows.sparkSession.createDataFrame([(s,) for s in dict.fromkeys(selected)], "value string")
        counted = counted.join(wanted, "value", "full").select("value", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    return counted.unionByName(rows.agg(F.count("*").alias("n")).select(F.lit("all").alias("value"), "n"))


def two_legs(direct: DataFrame, by_project: DataFrame, key: str) -> DataFrame:
    """Direct hits first, then those found through their project; each key once, with its leg."""
    both = direct.select(key, F.lit(0).alias("leg")).unionByName(by_project.select(key, F.lit(1).alias("leg")))
    return both.groupBy(key).agg(F.min("leg").alias("leg"))


def total_of(direct: DataFrame, by_project: DataFrame, key: str) -> DataFrame:
    """One row: direct + by project - overlap."""
    legs = direct.select(key, F.lit(1).alias("d"), F.lit(0).alias("p")).unionByName(by_project.select(key, F.lit(0).alias("d"), F.lit(1).alias("p")))
    per = legs.groupBy(key).agg(F.max("d").alias("d"), F.max("p").alias("p"))
    return per.agg(F.coalesce(F.sum("d"), F.lit(0)).alias("direct"), F.coalesce(F.sum("p"), F.lit(0)).alias("by_project"), F.count_if((F.col("d") == 1) & (F.col("p") == 1)).alias("overlap"), F.count("*").alias("total"))


def escape_html(text: Column, quote: str = "&#39;") -> Column:
    out = F.coalesce(text, F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", quote)):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def balanced(fragment: Column, opening: str = "", closing: str = "") -> Column:
    """An escaped fragment whose sentinels become balanced marks."""
    safe = F.split(escape_html(fragment), "")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("depth"))
    step = lambda s, ch: (
        F.when(ch == opening, F.struct(F.concat(s["out"], F.lit("<mark>")).alias("out"), (s["depth"] + 1).alias("depth")))
        .when(ch == closing, F.struct(F.when(s["depth"] > 0, F.concat(s["out"], F.lit("</mark>"))).otherwise(s["out"]).alias("out"), F.greatest(s["depth"] - 1, F.lit(0)).alias("depth")))
        .otherwise(F.struct(F.concat(s["out"], ch).alias("out"), s["depth"].alias("depth")))
    )
    return F.aggregate(safe, start, step, lambda s: F.concat(s["out"], F.repeat(F.lit("</mark>"), s["depth"])))


def snippet(fragments: Column, raw: Column | None = None) -> Column:
    """Fragments, each balanced by itself, in one line; without fragments the escaped ``raw`` text, or nothing."""
    joined = F.array_join(F.transform(fragments, lambda f: balanced(f)), " … ")
    return F.when(F.size(fragments) > 0, joined).otherwise(F.lit("") if raw is None else escape_html(raw))


def highlight(text: Column, terms: list[str]) -> Column:
    """Escaped text with the terms marked, whatever their case."""
    if not terms:
        return escape_html(text, "&#x27;")
    quoted = "|".join("".join(f"\\{ch}" if not ch.isalnum() else ch for ch in t) for t in terms)
    return F.regexp_replace(escape_html(text, "&#x27;"), f"(?i)({quoted})", "<mark>$1</mark>")


def only_marks(html: Column) -> Column:
    """Markup with everything but <mark> escaped."""
    out = escape_html(html, "&#x27;")
    return F.replace(F.replace(out, F.lit("&lt;mark&gt;"), F.lit("<mark>")), F.lit("&lt;/mark&gt;"), F.lit("</mark>"))


def fuzzy_match(text: Column, query: Column) -> Column:
    """Substring, or every token of over two characters begins a word or is within an edit or two of one."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    tokens = F.filter(F.split(F.lower(F.trim(query)), r"\s+"), lambda t: F.length(t) > 2)
    close = lambda t, w: w.startswith(t) | (F.levenshtein(w, t) <= F.when(F.length(t) >= 5, 2).otherwise(1))
    every = (F.size(tokens) > 0) & F.forall(tokens, lambda t: F.exists(words, lambda w: close(t, w)))
    return F.contains(F.lower(text), F.lower(F.trim(query))) | every


def rerank(ranked: DataFrame, score: Column, key: str, top: int = 50) -> DataFrame:
    """The first ``top`` rows permuted by another score; the set and the rows after it stay."""
    first = ranked.orderBy(F.desc("score"), key).limit(top).withColumns({"__in": F.lit(0), "__s": score})
    rest = ranked.join(first.select(key), key, "left_anti").withColumns({"__in": F.lit(1), "__s": F.col("score")})
    return first.unionByName(rest.select(*first.columns)).orderBy("__in", F.desc("__s"), key).drop("__in", "__s")


def rank_in(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))

