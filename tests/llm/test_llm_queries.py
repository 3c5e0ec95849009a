"""The registered queries of the subpackage, and the pipeline stage by stage."""

import brute
import corpus_pipeline
import pytest
import sentencepiece
from compare import connect, rows
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpuslake.llm import queries
from corpuslake.llm.decontamination import MASKS
from corpuslake.llm.language import bucket
from corpuslake.llm.sentencepiece_lattice import default_model

COLUMNS = {
    "op1_quality_classifier": ["doc_id", "held_out", "score", "predicted"],
    "op2_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op3_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op4_html_extraction": ["page_id", "url", "text", "n_chars"],
    "op5_decontamination": ["doc_id", "contaminated"],
    "op6_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op7_url_filter": ["page_id", "host", "path", "rule", "verdict"],
    "op8_chat_format": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op9_minhash_near_dedup": ["doc_id", "n_shingles", "component_id", "kept"],
    "op10_sentencepiece": ["doc_id", "n_tokens", "ids", "exact"],
    "op11_best_fit_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op12_hard_negatives": ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
    "op13_hamerly_centroids": ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    assert df.columns[: len(COLUMNS[name])] == COLUMNS[name]
    got = df.toPandas()
    if name in queries.ORACLES:
        want = connect(sf_dir).execute(queries.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
    else:
        source = {"op4_html_extraction": "pages"}.get(name, "documents")
        got = got[got.piece == 0] if "piece" in got else got
        assert len(got) == spark.read.parquet(f"{sf_dir}/{source}.parquet").count()


def test_all_are_registered():
    assert set(entry.queries()) >= {*COLUMNS, "pipeline"}
    assert set(entry.oracle_sql()) >= set(queries.ORACLES)


def test_native_operators_plan_no_python(spark, sf_dir):
    for name in ("op2_exact_dedup", "op7_url_filter"):
        plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_the_pipeline_stage_by_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").unionByName(
        spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "", None, "s", 0), (10**6 + 2, "42 !", "de", None, 4)], "doc_id long, text string, lang string, source string, n_chars int"), allowMissingColumns=True
    ).withColumn("n_chars", F.col("n_chars").cast("int"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        before, after = docs.toPandas(), out.toPandas()
        kept[name] = (before, after)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert list(after.columns) == corpus_pipeline.COLUMNS
            docs = spark.createDataFrame(after.astype(object).where(after.notna(), None).values.tolist(), docs.select(corpus_pipeline.COLUMNS).schema)

    before, after = kept["language ID"]
    assert not {10**6, 10**6 + 1, 10**6 + 2} & set(after.doc_id) and len(after) > 0.9 * len(before)
    before, after = kept["exact dedup"]
    norm = before.text.map(lambda t: t.translate(brute.UPPER))
    assert set(after.doc_id) == set(before.groupby(norm).doc_id.max())
    before, after = kept["MinHash near-dedup"]
    want = brute.components(list(zip(before.doc_id, before.text, strict=True)), 5, 80)
    assert set(after.doc_id) == {i for i, (_, c) in want.items() if i == c}
    before, after = kept["benchmark decontamination"]
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").toPandas()
    dirty = {d for d, _ in brute.contaminated(list(zip(before.doc_id, before.text, strict=True)), list(zip(items.item_id, items.text, strict=True)), MASKS, 13, 0.7)}
    assert set(after.doc_id) == set(before.doc_id) - dirty
    before, after = kept["SentencePiece encoding and decoding"]
    model = sentencepiece.SentencePieceProcessor(model_file=default_model())
    ids = dict(zip(after.doc_id, after.ids, strict=True))
    assert set(ids) == set(before.doc_id) and after.exact.all()
    assert all(list(ids[i]) == model.encode(t) for i, t in zip(before.doc_id, before.text, strict=True))


def test_stages_take_empty_tables(spark, sf_dir):
    empty = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_buckets_are_crc32(spark):
    import zlib

    got = spark.range(50).select("id", bucket(F.col("id"), 5).alias("b")).collect()
    assert all(r["b"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in got)
