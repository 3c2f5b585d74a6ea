"""The corpus pipeline's stages, each on what the one before kept."""

import pytest
from pyspark.sql import functions as F

pytest.importorskip("strideframe.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = first = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.schema == first.schema and out.join(docs, "doc_id", "left_anti").count() == 0
            kept[name] = {r["doc_id"] for r in out.select("doc_id").collect()}
            docs = out
    packed = {r["doc_id"] for r in out.select("doc_id").distinct().collect()}
    assert packed == kept["ngram_jaccard_join"] < kept["language_id"] <= kept["toxicity"]
    texts = {r["doc_id"]: set(zip(*[r["text"].split()[k:] for k in range(5)])) for r in docs.select("doc_id", "text").collect() if r["text"]}
    left = [s for s in texts.values() if s]
    assert not any(len(a & b) >= 0.8 * len(a | b) for i, a in enumerate(left) for b in left[:i])


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_one_of_each_class(spark):
    """Two texts under one id, repeated rows, copies without an id, rows without words."""
    rows = [(3, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (2, "an other text of the id two"), (9, None), (9, None), (None, "z z"), (None, "a b c d e f"), (2**60 + 1, "x y"), (2**60, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(0) for c in ("node", "links", "_id", "_text", "text_key")})
    got = corpus_pipeline.keep_one_of_near_copies(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"] or -1, r["text"]) for r in got.collect()), key=str) == sorted(
        [(2, "a b c d e f"), (2, "an other text of the id two"), (9, None), (9, None), (-1, "z z"), (2**60, "x y")], key=str
    )


def test_columns_of_clashing_names_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({c: F.lit("mine") for c in ("score", "lang_pred", "_toxicity", "_language", "_lang_score", "_lang_pred")})
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.filter("score != 'mine' or _toxicity != 'mine' or _lang_score != 'mine' or _lang_pred != 'mine'").count() == 0


def test_held_out_toxic_documents_go(spark):
    """The query and the stage at the registered threshold, on labels that neither learned from."""
    from strideframe.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    found = QUERIES["op7_toxicity"](spark, sf).join(labels, "doc_id").filter("held_out").groupBy("toxic").agg(F.avg("predicted").alias("share")).collect()
    share = {r["toxic"]: r["share"] for r in found}
    assert share[1] >= 0.8 and share[0] <= 0.05
