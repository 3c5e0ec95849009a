"""Two upstream registries merged into one, with its reports and gates (JON-*, AGG-14, AGG-15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.operators.access import PUBLIC, merge_acl
from corpuslake.operators.geo import pick_centroid
from corpuslake.sources.readers import spread


def has_value(column: Column, kind: str = "string") -> Column:
    """Not null and not blank (string), not empty (array); false and 0 are values."""
    if kind == "string":
        return column.isNotNull() & (F.trim(column) != "")
    if kind.startswith("array"):
        return column.isNotNull() & (F.size(column) > 0)
    return column.isNotNull()


def valued(df: DataFrame, name: str) -> Column:
    """The column where it has a value, else null."""
    return F.when(has_value(df[name], dict(df.dtypes)[name]), df[name])


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key the last in order, as a map built from them would keep."""
    turn = Window.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("__n", F.row_number().over(turn)).filter("__n = 1").drop("__n")


#: Merged field, left field, right field (None: the right has no such field).
PRECEDENCE = [
    ("name", "name", "name"), ("description", "description", "description"), ("project_type", "type_name", "type"),
    ("project_sub_type", "sub_type_name", None), ("proponent_name", "proponent_name", None), ("project_state", "project_state_name", "status"),
    ("abbreviation", "abbreviation", "short_name"), ("address", "address", "location"), ("is_active", "is_active", "active_status"),
]


def match_classes(left: DataFrame, right: DataFrame, guid: str = "guid", right_key: str = "right_id") -> DataFrame:
    """Full outer join on the left's one-directional key, with class: matched, no-guid, dangling or right-only."""
    left = left.withColumn("__guid", valued(left, guid)).withColumn("__l", F.lit(True))
    right = right.filter(F.col(right_key).isNotNull()).withColumn("__r", F.lit(True))
    both = left.alias("l").join(right.alias("r"), F.col("l.__guid") == F.col(f"r.{right_key}"), "full")
    kind = (
        F.when(F.col("__l").isNull(), "right-only").when(F.col("__r").isNotNull(), "matched")
        .when(F.col("__guid").isNull(), "no-guid").otherwise("dangling")
    )
    return both.withColumn("class", kind)


def merge(left: DataFrame, right: DataFrame, left_id: str = "left_id", guid: str = "guid", right_id: str = "right_id", fill: tuple[str, ...] = ()) -> DataFrame:
    """Merged projects: the left's values first, the right's for what it lacks, ``fill`` from the right alone."""
    joined = match_classes(left, right, guid, right_id)
    pick = lambda side, frame, name: F.when(has_value(F.col(f"{side}.{name}"), dict(frame.dtypes)[name]), F.col(f"{side}.{name}"))
    fields = []
    for target, a, b in PRECEDENCE:
        options = [pick("l", left, a)] if a in left.columns else []
        options += [pick("r", right, b)] if b and b in right.columns else []
        if options:
            fields.append(F.coalesce(*options).alias(target))
    read = merge_acl(F.col("r.read")) if "read" in right.columns else merge_acl(F.lit(None).cast("array<string>"))
    only = F.col("class") == "right-only"
    return joined.select(
        F.when(only, F.concat(F.lit("right-"), F.col(f"r.{right_id}").cast("string"))).otherwise(F.col(f"l.{left_id}").cast("string")).alias("id"),
        F.when(only, F.lit("right")).otherwise(F.lit("left")).alias("source_system"), "class",
        F.array_contains(read, PUBLIC).alias("is_published"), read.alias("read"), *fields,
        *(F.when(has_value(F.col(f"r.{f}"), dict(right.dtypes)[f]), F.col(f"r.{f}")).alias(f) for f in fill),
    )


def reconciliation(classes: DataFrame, guid: str = "__guid", first: int = 20) -> DataFrame:
    """One row: how many rows each class has, and the first dangling keys."""
    n = lambda kind: F.count_if(F.col("class") == kind).alias(kind.replace("-", "_"))
    ranked = classes.filter("class = 'dangling'").select(F.col(guid).alias("g")).orderBy("g").limit(first)
    examples = ranked.agg(F.array_sort(F.collect_list("g")).alias("dangling_guids"))
    return classes.agg(n("matched"), n("no-guid"), n("dangling"), n("right-only"), F.count("*").alias("total")).join(examples, F.lit(True))


def resolve_either(refs: DataFrame, projects: DataFrame, ref: str, first: str, second: str) -> DataFrame:
    """Project of a reference in either of two id spaces; the first one wins."""
    a = projects.select(F.col(first).cast("string").alias("__a"), F.col("id").alias("__id_a")).filter("__a IS NOT NULL").dropDuplicates(["__a"])
    b = projects.select(F.col(second).cast("string").alias("__b"), F.col("id").alias("__id_b")).filter("__b IS NOT NULL").dropDuplicates(["__b"])
    key = F.col(ref).cast("string")
    out = refs.join(a, key == F.col("__a"), "left").join(b, key == F.col("__b"), "left")
    return out.withColumn("project", F.coalesce("__id_a", "__id_b")).drop("__a", "__b", "__id_a", "__id_b")


def decoded(rows: DataFrame, lookup: DataFrame, ref: str, label: str) -> DataFrame:
    """A list id as its label, or itself where the list lacks it."""
    names = lookup.select(F.col("id").alias("__id"), F.col("label").alias("__label"))
    return rows.join(names, F.col(ref) == F.col("__id"), "left").withColumn(label, F.coalesce("__label", F.col(ref).cast("string"))).drop("__id", "__label")


def gates(projects: DataFrame, most_names: int = 20, synthetic: int = 8_000_000) -> DataFrame:
    """One row for each rule with the number of rows that break it (columns id, name, read, is_published, number)."""
    names = projects.filter("name IS NOT NULL").groupBy("name").agg(F.count("*").alias("n"))
    ids = projects.groupBy("id").agg(F.count("*").alias("n"))
    rules = [
        ("synthetic-ids", projects.agg(F.count_if(F.col("number") >= synthetic).alias("broken"))),
        ("duplicate-names", names.agg(F.count_if(F.col("n") > most_names).alias("broken"))),
        ("duplicate-ids", ids.agg(F.coalesce(F.sum(F.greatest(F.col("n") - 1, F.lit(0))), F.lit(0)).cast("long").alias("broken"))),
        ("missing-acl", projects.agg(F.count_if(F.coalesce(F.size("read"), F.lit(0)) <= 0).alias("broken"))),
        ("mirror-drift", projects.agg(F.count_if(F.coalesce(F.array_contains("read", PUBLIC), F.lit(False)) != F.coalesce("is_published", F.lit(False))).alias("broken"))),
    ]
    out = None
    for name, row in rules:
        row = row.select(F.lit(name).alias("rule"), "broken")
        out = row if out is None else out.unionByName(row)
    return out


def phrase_holders(items: DataFrame, docs: DataFrame, most: int = 200_000) -> DataFrame:
    """(item_id, doc_id) of the documents (doc_id, text) that hold the whole text of an item (item_id, text), each pair once.

    An item is looked up by its longest inner word, which is a word of every text that holds it. Up to ``most`` counted items go to all
    tasks, so that of the documents' words only those are shuffled that some item asks for; only documents with one are read for the whole text.
    """
    cut = F.split("text", r"\s+")
    inner = F.slice(cut, 2, F.greatest(F.size(cut) - 2, F.lit(1)))
    longest = F.try_element_at(F.array_sort(F.transform(inner, lambda w: F.struct(F.length(w), w.alias("word")))), F.lit(-1))["word"]
    keyed = items.select("item_id", F.col("text").alias("item"), F.coalesce(longest, F.element_at(cut, 1)).alias("key")).filter("item IS NOT NULL")
    asked = keyed.select("item_id", "key")
    if asked.count() <= most:
        asked = F.broadcast(asked)
    words = spread(docs.select("doc_id", "text")).select("doc_id", F.explode_outer(F.array_distinct(F.split("text", r"\s+"))).alias("key")).filter("key IS NOT NULL")
    pairs = words.join(asked, "key").select("item_id", "doc_id").distinct()
    return pairs.join(keyed.select("item_id", "item"), "item_id").join(docs.select("doc_id", "text"), "doc_id").filter(F.contains("text", "item")).select("item_id", "doc_id").distinct()
