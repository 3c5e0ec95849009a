"""Sources (SRC-*): files, envelopes, labels, and lookups by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.operators.access import Access, all_of, visible


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """A small scan over all cores: a file of one row group is one split, and costly maps over it would be one task. Scans with enough splits stay as they are."""
    if rows.isStreaming:
        return rows
    wanted = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(wanted) if rows.rdd.getNumPartitions() < wanted else rows


def scan(rows: DataFrame, access: Access, where: Column | None = None, field: str | None = "project_id") -> DataFrame:
    """Every scan carries the visibility; the rest of the criteria is joined to it."""
    return rows.filter(all_of(visible(access, field), *([where] if where is not None else [])))


def parameterised(spark: SparkSession, query: str, args: dict) -> DataFrame:
    """SQL with named parameters only."""
    if not args or any(f":{name}" not in query for name in args):
        raise ValueError("a query takes named parameters, and uses each of them")
    return spark.sql(query, args=args)


def keyset_page(rows: DataFrame, key: str, after, size: int) -> DataFrame:
    """The next page after a key: no offset to count through."""
    rest = rows if after is None else rows.filter(F.col(key) > after)
    return rest.orderBy(key).limit(size)


def by_ids(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows of a list of ids, each once; a join and no long IN list."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def first_of(rows: DataFrame, where: list[Column], order: str) -> DataFrame:
    """At most one row: the first criterion that finds any decides."""
    rank = F.coalesce(*[F.when(w, F.lit(i)) for i, w in enumerate(where)])
    return rows.withColumn("__rank", rank).filter("__rank IS NOT NULL").orderBy("__rank", order).limit(1).drop("__rank")


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that holds one JSON array; an empty one is an error."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    if rows.isEmpty():
        raise ValueError(f"no record in {path}")
    return rows


def envelope(responses: DataFrame, body: str, item: str) -> DataFrame:
    """Records of [{meta, searchResults}]; a response without searchResults fails the job."""
    found = F.from_json(F.col(body), f"array<struct<searchResults:array<struct<{item}>>>>")
    results = F.get(found, F.lit(0))["searchResults"]
    checked = F.when(results.isNotNull(), results).otherwise(F.raise_error(F.lit("response without searchResults")))
    return responses.select(F.explode(checked).alias("r")).select("r.*")


def labels(spark: SparkSession, path: str) -> DataFrame:
    """(line, document_id, phrase, note) of a JSONL file; comments and blanks are skipped, a malformed line fails the job with its number.

    Lines are numbered within the whole file, which is read as one record: label files are small by their purpose.
    """
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.split("value", r"\r?\n"))).select((F.col("pos") + 1).alias("line"), F.trim("col").alias("value"))
    lines = lines.filter("value <> '' AND NOT startswith(value, '#')")
    record = F.from_json("value", "documentId string, phrase string, note string")
    good = F.coalesce(F.trim(record["documentId"]) != "", F.lit(False)) & F.coalesce(F.trim(record["phrase"]) != "", F.lit(False))
    record = F.when(good, record).otherwise(F.raise_error(F.concat(F.lit("malformed label in line "), F.col("line").cast("string"))))
    return lines.select("line", record.alias("r")).select("line", F.col("r.documentId").alias("document_id"), "r.phrase", "r.note")


def ndjson_blocks(lines: DataFrame) -> DataFrame:
    """(doc_id, block_no, block) of ingest lines (doc_id, line_no, line): line 0 is the header, others are JSON strings."""
    block = F.get(F.from_json(F.concat(F.lit("["), F.col("line"), F.lit("]")), "array<string>"), F.lit(0))
    checked = F.when(block.isNotNull(), block).otherwise(F.raise_error(F.concat(F.lit("malformed line "), F.col("line_no").cast("string"))))
    return lines.filter("line_no > 0").select("doc_id", (F.col("line_no") - 1).alias("block_no"), checked.alias("block"))


def ndjson_body(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The inverse: a header and one JSON string for each block of a text."""
    blocks = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\n{2,}"), lambda b: F.trim(b) != "")
    quoted = F.transform(blocks, lambda b: F.regexp_replace(F.to_json(F.array(b)), r"^\[|\]$", ""))
    header = F.to_json(F.struct(F.col(key).alias("documentId"), F.size(blocks).alias("blocks")))
    return docs.select(F.col(key).alias("doc_id"), F.posexplode(F.concat(F.array(header), quoted))).select("doc_id", F.col("pos").alias("line_no"), F.col("col").alias("line"))


def sniff(content: Column) -> Column:
    """File type by its first bytes."""
    head = F.hex(F.substring(content, 1, 8))
    # Magic bytes.
    kinds = {"25504446": "pdf", "89504E47": "png", "FFD8FF": "jpg", "49492A00": "tif", "4D4D002A": "tif", "504B0304": "zip", "D0CF11E0": "ole", "47494638": "gif"}
    out = F.lit("unknown")
    for magic, kind in kinds.items():
        out = F.when(head.startswith(magic), kind).otherwise(out)
    return out


def page_text(pages: DataFrame, document: str = "doc_id", page: str = "page_no", text: str = "text") -> DataFrame:
    """Pages joined by a blank line, in order."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(page, text))), lambda p: p[text]), "\n\n")
    return pages.groupBy(document).agg(joined.alias("text"), F.count("*").alias("pages"), F.count_if(F.trim(text) == "").alias("empty_pages"))


def worklist(documents: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Documents not extracted yet and not in the ledger."""
    return documents.filter(F.col("content_extracted") == F.lit(False)).join(done.select(key), key, "left_anti")


def queue_ids(messages: DataFrame, value: str = "value") -> DataFrame:
    """A bare id, or a JSON object with documentId."""
    return messages.select(F.coalesce(F.get_json_object(value, "$.documentId"), F.trim(value)).alias("document_id"))


def keys_of(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    keys = spark.read.text(path).select(F.trim("value").alias("key")).filter("key <> ''").distinct()
    return keys.limit(limit) if limit else keys


def features(collection: DataFrame, body: str, schema: str) -> DataFrame:
    """Features of a GeoJSON collection."""
    parsed = F.from_json(F.col(body), f"struct<features:array<struct<{schema}>>>")
    return collection.select(F.explode(parsed["features"]).alias("f")).select("f.*")


def counted(rows: DataFrame, total: int) -> DataFrame:
    """``rows`` if there are as many as their source announced."""
    if (n := rows.count()) != total:
        raise ValueError(f"{n} rows were read where {total} were announced")
    return rows


def scorecard(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, phrase, rank, started) of a retrieval report: {"started", "results": [{documentId, phrase, rank}]}; of a phrase that is there twice the last holds."""
    report = spark.read.schema("started string, results array<struct<documentId:string,phrase:string,rank:int>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    return scorecard_rows(report)


def scorecard_rows(report: DataFrame) -> DataFrame:
    rows = report.select("started", F.posexplode("results")).select("started", "pos", "col.*")
    last = rows.groupBy(F.col("documentId").alias("document_id"), "phrase").agg(F.max_by(F.struct("rank", "started"), "pos").alias("r"))
    return last.select("document_id", "phrase", "r.rank", "r.started")
