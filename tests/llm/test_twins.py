"""The queries of this package that have SQL, against it."""

import os

import duckdb
import pytest

pytest.importorskip("strideframe.llm")
from strideframe.llm.queries import ORACLES, QUERIES  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def like(rows):
    return sorted((tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    assert got and like(got) == like(duck.sql(f"select {', '.join(columns)} from ({ORACLES[name]})").fetchall())


# ---- queries without SQL: held-out results on the given tables, repeated rows, missing languages


def test_languages_held_out_of_the_given_tables(spark):
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/documents.parquet").filter("lang is not null and length(text) >= 200").select("doc_id", "lang")
    found = QUERIES["op3_language_id"](spark, sf).filter("held_out").join(truth, "doc_id")
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert right[1] > 50 and right[0] >= 0.95


def test_repeated_rows_and_missing_languages(spark):
    """Copies of a row come out as often as they went in, with equal results; a language nobody else has, or none, is one of its own."""
    from pyspark.sql import functions as F

    from strideframe.llm import language_id, piece_codec, quality, toxicity
    from strideframe.llm.queries import tokenizer_file

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(3).select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(None).cast("string").alias("lang"), "source", "n_chars").union(docs.limit(2).withColumn("lang", F.lit("xx")))
    twice = docs.unionByName(docs).unionByName(odd)
    n = twice.count()
    rules = quality.quality(twice)
    assert rules.count() == n
    assert rules.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c"), F.count_distinct("word_chars", "n_symbols", "base_failed").alias("d")).filter("c < 2 or d > 1").count() == 0
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(twice, labels.unionByName(labels), F.lit(True))
    scored = toxicity.score(twice, model)
    assert scored.count() == n and scored.groupBy("text").agg(F.count_distinct("score").alias("d")).filter("d > 1").count() == 0
    langs = language_id.predict(twice, language_id.fit(twice, F.lit(True)))
    assert langs.count() == n and langs.groupBy("text").agg(F.count_distinct("lang_pred", F.round("score", 9)).alias("d")).filter("d > 1").count() == 0
    assert piece_codec.round_trips(twice, tokenizer_file("piece_bpe_32k.model")).count() == n
