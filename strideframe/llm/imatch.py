"""I-Match fingerprints over randomised subsets of an inverse-document-frequency band.

Terms are runs of letters and digits, lower-cased. The lexicon holds the terms whose document frequency lies in a band: at
least one in RAREST documents and at most one in COMMONEST, so that it has at most RAREST times as many terms as a document
has on average, whatever the number of documents. Every lexicon term belongs to some of the SUBSETS random subsets, drawn by a
hash of the term. A text keeps its terms of the lexicon; for each subset they are sorted and hashed, and the hashes make up
the fingerprint. Two texts are alike by the share of equal hashes among the subsets that hold a term of either.

Rare subsets (one term in 256) compare long texts, common ones (one in 8) short texts: a subset's hash survives an edit
that touches none of its terms.

Document frequencies are exact. They are counted in two passes that shuffle little: hash buckets first (a bucket under the
band's floor holds no term of the band), then the terms of the remaining buckets.

Rows meet the next row in blocks: bounds taken from a sample of the ids cut the descending order of (id, hash of the text),
and a block's first row goes to the block before it as well, so every row has its successor at hand after one shuffle. The
bounds decide where a block ends, not what comes out.

Edge cases: null texts are empty. A text without a term in any subset is known by its own hash, in place of the first
subset's. Repeated rows and ids count as documents of their own; equal ids are ordered by a hash of their texts, rows
equal in both are each other's successors and stay in one block. Null ids come last. A single row follows itself. Extra
columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_below, stored

#: The band: a term of the lexicon is in at least two documents, in one of 200 or more, and in one of 10 at most.
RAREST, COMMONEST = 200, 10
#: (subsets, one term in how many).
SUBSETS = ((8, 8), (20, 64), (20, 256))
#: Hash buckets of the first counting pass; there are at most so many of them to broadcast.
BUCKETS = 1 << 18
#: A lexicon up to so many terms is broadcast, a larger one is joined by shuffle.
BROADCAST_TERMS = 500_000
#: Blocks hold about so many characters; there are at least four for each shuffle partition and at most MOST_BLOCKS.
BLOCK_CHARS, MOST_BLOCKS, SAMPLED = 32_000_000, 1 << 16, 20
#: Stands for every text in the join with the lexicon, so that texts without a lexicon term stay.
EVERY = ""
#: What a fingerprint has for a subset that holds no term of the text.
EMPTY = "." * 8


def terms_of(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def rates() -> list[int]:
    return [one_in for n, one_in in SUBSETS for _ in range(n)]


def subset_mask(term: Column) -> Column:
    """Bit k is set if the term belongs to subset k: 20 bits of a hash of (k, term) against the subset's rate."""
    drawn = [F.conv(F.substring(F.md5(F.concat(F.lit(f"{k}:"), term)), 1, 5), 16, 10).cast("long") % one_in == 0 for k, one_in in enumerate(rates())]
    mask = F.lit(0).cast("long")
    for k, hit in enumerate(drawn):
        mask = mask.bitwiseOR(F.when(hit, F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return mask


def lexicon(docs: DataFrame, text: str = "text") -> DataFrame:
    """term, df, mask: the terms of the band with their exact document frequencies and subsets. Stored."""
    n = docs.count()
    lowest, highest = max(2, -(-n // RAREST)), n // COMMONEST
    found = docs.select(F.explode(terms_of(F.coalesce(F.col(text), F.lit("")))).alias("term"))
    found = found.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
    heavy = stored(found.groupBy("bucket").count().filter(F.col("count") >= lowest).select("bucket"), "imatch-buckets")
    counted = found.join(F.broadcast(heavy), "bucket", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    band = counted.filter(F.col("df").between(lowest, highest))
    return stored(band.withColumn("mask", subset_mask(F.col("term"))), "imatch-lexicon")


def block_bounds(docs: DataFrame, key: Column) -> list:
    """The first keys of the blocks of descending keys: the greatest of all, then about evenly placed ones of a sample."""
    whole = docs.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.max(key).alias("first")).first()
    if not whole["n"]:
        return []
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = min(MOST_BLOCKS, max(4 * parts, (whole["chars"] or 0) // BLOCK_CHARS))
    sampled = docs.select(key.alias("key")).filter(hash_below(F.col("key"), SAMPLED * blocks / whole["n"], 11)).distinct().select("key.*")
    keys = sorted({(r[0], r[1]) for r in sampled.collect()} - {tuple(whole["first"])}, key=lambda k: (k[0] is not None, k), reverse=True)
    step = max(1, len(keys) // blocks)
    return [tuple(whole["first"]), *keys[step - 1 :: step]]


def in_order_of_ids(docs: DataFrame) -> DataFrame:
    """block, pos, spare, doc_id, text, next_text: rows of a block by descending id; spare rows are the next block's first."""
    df = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    key = F.struct(F.col("doc_id"), F.xxhash64("text").alias("h"))
    bounds = block_bounds(df, key)
    if not bounds:
        return df.select(F.lit(0).alias("block"), F.lit(0).alias("pos"), F.lit(False).alias("spare"), "doc_id", "text", F.col("text").alias("next_text"))
    kind = f"struct<doc_id:{df.schema['doc_id'].dataType.simpleString()},h:bigint>"
    # Two levels of bounds, so that a row is compared with a few of them only.
    width = max(1, round(len(bounds) ** 0.5))
    literal = lambda k: F.struct(F.lit(k[0]).alias("doc_id"), F.lit(k[1]).alias("h")).cast(kind)
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    upper, lower = F.array(*[literal(g[0]) for g in groups]), F.array(*[F.array(*[literal(k) for k in g]) for g in groups])
    at_or_below = lambda among, k: F.size(F.filter(among, lambda b: b >= k))
    df = df.withColumn("key", key).withColumn("group", at_or_below(upper, F.col("key")) - 1)
    df = df.withColumn("within", at_or_below(F.get(lower, F.col("group")), F.col("key")) - 1)
    first = F.get(F.get(lower, F.col("group")), F.col("within")) == F.col("key")
    own = F.col("group") * width + F.col("within")
    before = F.pmod(own - 1, F.lit(len(bounds)))
    places = F.array(F.struct(own.alias("block"), F.lit(False).alias("spare")))
    both = F.concat(places, F.array(F.struct(before.alias("block"), F.lit(True).alias("spare"))))
    df = df.select("doc_id", "text", "key", F.explode(F.when(first, both).otherwise(places)).alias("p")).select("p.*", "doc_id", "text", "key")
    order = Window.partitionBy("block").orderBy("spare", F.col("key.doc_id").desc_nulls_last(), F.col("key.h").desc())
    return df.select("block", "spare", "doc_id", "text", F.row_number().over(order).alias("pos"), F.lead("text").over(order).alias("next_text"))


def groups_of_subsets() -> list[tuple[str, range]]:
    """For each rate, a column's name and the subsets of that rate."""
    first = [sum(n for n, _ in SUBSETS[:i]) for i in range(len(SUBSETS))]
    return [(f"one_in_{one_in}", range(k, k + n)) for k, (n, one_in) in zip(first, SUBSETS, strict=True)]


def listed(subsets: range) -> Column:
    """An aggregate: the sorted terms that belong to any of these subsets, with their masks."""
    any_of = F.lit(sum(1 << k for k in subsets)).cast("long")
    return F.sort_array(F.collect_list(F.when(F.col("mask").bitwiseAND(any_of) != 0, F.struct("term", "mask"))))


def subset_hashes(terms: Column, subsets: range) -> Column:
    """One hash for each subset over the sorted distinct terms, which are structs of term and mask; EMPTY where none belongs."""
    k = F.sequence(F.lit(subsets[0]), F.lit(subsets[-1]))
    kept = F.transform(k, lambda i: F.array_join(F.transform(F.filter(terms, lambda t: F.call_function("getbit", t["mask"], i) == 1), lambda t: t["term"]), " "))
    return F.transform(kept, lambda s: F.substring(F.coalesce(F.md5(F.nullif(s, F.lit(""))), F.lit(EMPTY)), 1, 8))


def likeness(a: Column, b: Column) -> Column:
    """Equal hashes among the subsets that hold a term of either text; 1 for equal fingerprints."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    held = F.size(F.filter(pairs, lambda p: (p["a"] != EMPTY) | (p["b"] != EMPTY)))
    same = F.size(F.filter(pairs, lambda p: (p["a"] == p["b"]) & (p["a"] != EMPTY)))
    return F.when(a == b, F.lit(1.0)).otherwise(same / held)


def fingerprints(texts: DataFrame, keys: list[str], text: str, words: DataFrame) -> DataFrame:
    """The keys and hashes (an array) of each row's text, by the lexicon. Keys name a row; equal keys must lie in one partition already or are shuffled."""
    every = words.sparkSession.createDataFrame([(EVERY, 0)], "term string, mask long")
    known = words.filter("mask != 0").select("term", "mask").unionByName(every)
    known = F.broadcast(known) if words.count() <= BROADCAST_TERMS else known
    # Behind the generator each term's row carries short columns only, never the text or the list it comes from.
    lists = texts.select(*keys, F.concat(F.array(F.lit(EVERY)), terms_of(F.col(text))).alias("terms"), F.substring(F.md5(F.col(text)), 1, 8).alias("whole"))
    held = lists.select(*keys, "whole", F.explode("terms").alias("term"))
    # A rate's terms are a list of their own: the few terms of rare subsets are not sought among all of a text's.
    groups = groups_of_subsets()
    found = held.join(known, "term").groupBy(*keys).agg(*[listed(subsets).alias(name) for name, subsets in groups], F.first("whole").alias("whole"))
    bare = F.concat(F.array("whole"), F.array_repeat(F.lit(EMPTY), len(rates()) - 1))
    some = F.greatest(*[F.size(name) for name, _ in groups]) > 0
    # The hashes stand once in the plan, or they would be computed as often as they stand in it.
    hashes = F.concat(*[subset_hashes(F.col(name), subsets) for name, subsets in groups])
    return found.select(*keys, F.when(some, hashes).otherwise(bare).alias("hashes"))


def edited_and_next(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: a row for each document.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next document's.
    """
    words = lexicon(docs)
    n = F.length("text")
    cut = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    rows = in_order_of_ids(docs).withColumn("edited", F.coalesce(edited, F.lit("")))
    about = F.struct("spare", "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited"), 256).alias("edited_sha256"))
    rows = rows.select("block", "pos", about.alias("about"), "text", "edited")
    texts = rows.select("block", "pos", "about", F.posexplode(F.array("text", "edited")).alias("which", "text"))
    # All that follows is grouped within blocks: no further shuffle.
    found = fingerprints(texts, ["block", "pos", "about", "which"], "text", words)
    row = found.groupBy("block", "pos", "about").agg(*[F.max(F.when(F.col("which") == i, F.col("hashes"))).alias(name) for i, name in enumerate(("own", "edited"))])
    row = row.withColumn("next", F.lead("own").over(Window.partitionBy("block").orderBy("pos"))).filter(~F.col("about.spare"))
    text = lambda c: F.array_join(c, "")
    return row.select(
        "about.doc_id", "about.n_chars", "about.edited_sha256", text("own").alias("fingerprint"), text("edited").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
