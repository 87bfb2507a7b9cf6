"""The pipeline's stages on odd rows: nulls, repeats, clashing column names, empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terraquant.llm import decontam, mixing, rules

DATA = "/root/testdata/sf0.001"
CLASHING = ["_text", "_words", "_packed", "_id", "_copies", "_epoch", "echo_share", "score", "predicted", "held_out", "item_ids", "contaminated", "containment", "n", "c", "component_id", "size", "taken", "block", "key", "_gone", "_twice", "a.b c"]


def odd(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    more = spark.createDataFrame([(None, "a short text of null id " * 9, "en", "src1", 5), (None, None, None, None, None), (7, None, "en", None, 1), (7, "", "en", "src0", 0), (8, "one", None, "src2", 3)], docs.schema)
    out = docs.unionByName(more).unionByName(docs.limit(3))
    for c in CLASHING:
        out = out.withColumn(c, F.lit("own"))
    return out


def test_stages_keep_every_column(spark):
    docs = odd(spark)
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        rows = out.collect()
        assert 0 < len(rows) <= 2 * n, name
        columns = out.columns[: len(docs.columns)]
        assert columns == docs.columns, name
        assert all(r[docs.columns.index(c)] == "own" for r in rows for c in CLASHING), name


def test_stages_on_an_empty_table(spark):
    empty = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0, name


def test_items_without_an_id_contaminate(spark):
    text = " ".join(f"w{k}" for k in range(30))
    items = spark.createDataFrame([(None, text)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"so {text} it is"), (2, "nothing of it in here"), (None, text)], "doc_id long, text string")
    got = {r["doc_id"]: (r["contaminated"], r["item_ids"], r["containment"]) for r in decontam.find_contamination(docs, items).collect()}
    assert got == {1: (True, [], 1.0), 2: (False, [], 0.0), None: (True, [], 1.0)}
    assert [r["doc_id"] for r in decontam.keep_clean(docs, items).collect()] == [2]


def test_blocks_of_items_are_searched_one_after_the_other(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 1)
    texts = [" ".join(f"{c}{k}" for k in range(12)) for c in "abc"]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    docs = spark.createDataFrame([(9, " ".join(texts)), (8, texts[1])], "doc_id long, text string")
    got = {r["doc_id"]: r["item_ids"] for r in decontam.find_contamination(docs, items).collect()}
    assert got == {9: [0, 1, 2], 8: [1]}


def test_rows_without_ids_are_mixed(spark):
    docs = spark.createDataFrame([(None, "a b c", "s"), (None, "d e f", "s"), (1, "g h", "t")], "doc_id long, text string, source string")
    plan = {(r["doc_id"], r["size"]): r["taken"] for r in mixing.mix(docs).collect()}
    out = [r["doc_id"] for r in mixing.mixed_documents(docs).collect()]
    most = max(-(-t // s) for (i, s), t in plan.items() if i is None)
    assert out.count(None) == 2 * most and out.count(1) == -(-plan[1, 2] // 2)


@pytest.mark.parametrize("labelled", [True, False])
def test_quality_stage_without_labels_keeps_all(spark, labelled):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    kept = rules.keep_good(docs, labels if labelled else labels.limit(0)).count()
    assert (kept == docs.count()) is (not labelled)
