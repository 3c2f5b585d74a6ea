"""The queries of this package: (spark, sf_dir) -> DataFrame, each over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    backoff_lm, imatch, jaccard_join, language_id, oracles, packing, piece_codec, prefix_trie, quality, structure_repair, token_store, topk, toxicity, url_trust,
)
from .common import id_fold, table


URL_RULES = [
    url_trust.Rule("block", "com", "/en/"),
    url_trust.Rule("allow", "example.com", "/en/7"),
    url_trust.Rule("allow", "net", "/de/"),
    url_trust.Rule("block", "example.net", "/de/8"),
    url_trust.Rule("block", "org", "/es/"),
]


def tokenizer_file(name: str) -> str:
    """Path of a public vocabulary file; every machine has the package that holds them."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def r6(*columns: str) -> dict[str, Column]:
    """Doubles that the order of additions could change in the last bit."""
    return {c: F.round(c, 6) for c in columns}


def op1_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trust.judge(table(spark, sf_dir, "pages"), URL_RULES).withColumns(r6("trust", "distrust"))


def op2_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_fold(F.col("doc_id"), 5) == 0
    model = language_id.fit(docs, ~held_out)
    return language_id.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.encode_and_read_back(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=2)


def op5_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_lm.stupid_backoff(table(spark, sf_dir, "documents")).withColumns(r6("score"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_fold(F.col("doc_id"), 3) == 1
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op8_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).withColumns(r6("classes_distance", "words_distance"))


def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.round_trips(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edited_and_next(table(spark, sf_dir, "documents")).withColumns(r6("near_edited", "near_next"))


def damaged(convs: DataFrame) -> DataFrame:
    """The turns with faults planted by a hash of their place; nulls are one space, but for conv_id and turn themselves."""
    space = F.lit(" ")
    place = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    df = convs.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(place.cast("binary")) % 20).alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.array_repeat(F.lit(0), F.when(F.col("fate") == 3, 2).otherwise(1))
    kept = df.filter("fate != 0").select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("_copy"))
    return kept.drop("_copy")


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = table(spark, sf_dir, "conversations")
    repair = structure_repair.Repair(damaged(convs))
    found = repair.report.join(repair.digests(), "id", "left").withColumnRenamed("conv_id", "_conv")
    whole = convs.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return whole.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids and turns of conversations that begin with the first h turns of conversation c - c % 5, h = crc32(c) % 9."""
    ids = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("long")
    donors = ids.select(F.col("conv_id").alias("donor"), F.col("n").alias("donor_n"))
    ids = ids.withColumn("h", h).withColumn("donor", F.col("conv_id") - F.col("conv_id") % 5).join(donors, "donor", "left")
    ids = ids.select("conv_id", "donor", "h", F.least("h", F.coalesce("donor_n", F.lit(0))).alias("head"))
    opening = turns.filter("at < 8").withColumnRenamed("conv_id", "donor")
    heads = ids.join(opening, "donor").filter("at < h").select("conv_id", "at", "sym", "bytes")
    own = turns.join(ids, "conv_id").filter("at >= h").select("conv_id", (F.col("at") - F.col("h") + F.col("head")).alias("at"), "sym", "bytes")
    return ids.select("conv_id"), heads.unionByName(own)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids, turns = rebuilt(prefix_trie.symbols(table(spark, sf_dir, "conversations")))
    return prefix_trie.trie(ids, turns)


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_trust, op2_threshold_topk, op3_language_id, op4_token_ids, op5_stupid_backoff, op6_ngram_jaccard_join, op7_toxicity,
        op8_quality_divergence, op9_piece_codec, op10_best_fit_packing, op11_imatch, op12_structure_repair, op13_prefix_trie,
    )
}

#: DuckDB SQL of the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op1_url_trust": oracles.url_sql(URL_RULES), "op2_threshold_topk": oracles.TOP_K, "op5_stupid_backoff": oracles.BACKOFF, "op6_ngram_jaccard_join": oracles.JACCARD,
    "op8_quality_divergence": oracles.quality_sql(), "op11_imatch": oracles.imatch_sql(), "op12_structure_repair": oracles.repair_sql(), "op13_prefix_trie": oracles.trie_sql(),
}
