"""A text corpus, cleaned and packed: toxicity, language, near copies, sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the docs of the
next one; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.llm import jaccard_join, language_id, packing, toxicity
from strideframe.llm.common import free_name, id_fold, new_path, table

#: A document whose languages are so mixed that no one reaches this share is rejected; so is one without letters.
MIN_LANGUAGE_SCORE = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), id_fold(F.col("doc_id"), 3) != 1)
    column = free_name(docs, "_toxicity")
    return toxicity.score(docs, model, column=column).filter(F.col(column) < toxicity.THRESHOLD).select(*docs.columns)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.fit(docs, id_fold(F.col("doc_id"), 5) != 0)
    lang, score = free_name(docs, "_lang_pred"), free_name(docs, "_lang_score")
    found = language_id.predict(docs, model, lang=lang, score=score)
    return found.filter((F.col(lang) != language_id.UNDETERMINED) & (F.col(score) >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each_class(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_languages),
    ("ngram_jaccard_join", keep_one_of_near_copies),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Trained models decide; SQL can't express that. tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None
