"""Quality rules by distribution divergence.

Each text gives a histogram of character classes and one of common words. Histograms of all documents of a language that
pass the base rules add up to the language's references. A document is rejected where the Jensen-Shannon distance of either
histogram to its language's reference exceeds a limit that grows for short texts (noise of a sample of n words falls as
1 / sqrt(n)); texts under MIN_WORDS words are not judged by divergence at all. Everything is DataFrame expressions.

Base rules: a text fails with fewer than 50 words, or if over half its words lie in three-word windows that occur twice or
more in it. Edge cases: null texts have no words (and fail); a null language is a language of its own; languages without a
reference (all their documents fail the base rules) reject nothing further. Rows repeat as they come in; extra columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

SPACE = r"\x20\x09-\x0D"
MIN_WORDS, MAX_REPEAT = 50, 50
#: Limits of the distance: at infinite length, and what is added, divided by the root of the number of words (classes: characters).
CLASS_LIMIT, CLASS_SLACK = 0.20, 1.0
WORD_LIMIT, WORD_SLACK = 0.16, 1.5

# Frequent function words of English, German, French and Spanish.
COMMON_WORDS = tuple(dict.fromkeys((
    "the of and to in is it that was for a on are as with be this by from at "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als "
    "de la le et les des en un du une que est pour qui dans sur par au plus pas "
    "de la que el en y a los del se las por un para con no una su al lo"
).split()))
#: One letter stands for each word, so that a text's common words become one short string to count in.
LETTERS = [chr(0x4E00 + i) for i in range(len(COMMON_WORDS))]


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a generator: they are computed once a row, and no lambda that reads them computes them again."""
    for name, value in columns.items():
        df = df.select("*", F.explode(F.array(value)).alias(name))
    return df


def histograms(docs: DataFrame) -> DataFrame:
    """doc_id, lang, base counts, and the two histograms as arrays."""
    df = docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    df = once(df, words=F.filter(F.split("text", f"[{SPACE}]+"), lambda w: w != ""))
    later = lambda k: F.slice("words", k, F.greatest(F.size("words") - 2, F.lit(0)))
    df = once(df, windows=F.transform(F.arrays_zip(later(1).alias("a"), later(2).alias("b"), later(3).alias("c")), lambda z: F.xxhash64(z["a"], z["b"], z["c"])))
    # Only texts with a repeated window are sorted: equal windows become neighbours.
    pairs = F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = once(df, ranked=F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(pairs)).otherwise(F.slice(pairs, 1, 0)))
    twice = F.filter("ranked", lambda x, k: (F.get("ranked", k - 1)["h"] == x["h"]) | F.coalesce(F.get("ranked", k + 1)["h"] == x["h"], F.lit(False)))
    df = once(df, spots=F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(F.transform("spots", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("spots", k + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    df = once(df, lines=F.filter(F.split("text", "\n", -1), lambda x: x.rlike(f"[^{SPACE}]")))
    kept = lambda kind: F.length(F.regexp_replace("text", f"[^{kind}]+", "")).cast("long")
    letter = F.create_map(*[F.lit(x) for pair in zip(COMMON_WORDS, LETTERS, strict=True) for x in pair])
    common = F.filter(F.transform("words", F.lower), lambda w: w.isin(*COMMON_WORDS))
    df = once(df, coded=F.array_join(F.transform(common, lambda w: F.element_at(letter, w)), ""))
    df = df.select(
        "doc_id", "lang", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), kept("#*$%&|<>").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), covered.cast("long").alias("n_repeat_words"),
        F.length("text").cast("long").alias("chars"), kept("a-z").alias("lower"), kept(r"\p{Lu}").alias("upper"), kept(r"\p{L}").alias("letters"), kept(r"\p{Nd}").alias("digits"),
        F.array(*[(F.length("coded") - F.length(F.replace("coded", F.lit(c)))).cast("long") for c in LETTERS]).alias("common"),
    )
    other = F.col("n_words") - F.aggregate("common", F.lit(0).cast("long"), lambda a, x: a + x)
    marks = F.col("word_chars") - F.col("letters") - F.col("digits") - F.col("n_symbols")
    classes = F.array("lower", "upper", F.col("letters") - F.col("lower") - F.col("upper"), "digits", "n_symbols", F.greatest(marks, F.lit(0).cast("long")), F.col("chars") - F.col("word_chars"))
    return df.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars", classes.alias("classes"), F.concat("common", F.array(other)).alias("words"))


def jensen_shannon(p: Column, q: Column) -> Column:
    """Distance (root of the divergence in bits) of two arrays of shares; null where one is null."""
    part = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    parts = F.zip_with(p, q, lambda a, b: (part(a, b) + part(b, a)) / 2)
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda a, v: a + v), F.lit(0.0)))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, counts, base_failed, kept, classes_distance, words_distance: one row for each document."""
    found = stored(histograms(docs).withColumn("base_failed", base_failed()), "quality-histograms")
    # One row for each language: summed histograms, then shares.
    bins, wholes = {"classes": 7, "words": len(COMMON_WORDS) + 1}, {"classes": "chars", "words": "n_words"}
    sums = [F.array(*[F.sum(F.get(name, F.lit(i))) for i in range(n)]).alias(f"ref_{name}") for name, n in bins.items()]
    reference = found.filter(~F.col("base_failed")).groupBy(F.col("lang").alias("ref_lang")).agg(*sums, *[F.sum(w).alias(f"all_{w}") for w in wholes.values()])
    judged = found.join(reference, F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    for name, whole in wholes.items():
        own = F.transform(name, lambda v: v / F.nullif(F.col(whole), F.lit(0)))  # noqa: B023
        ref = F.transform(f"ref_{name}", lambda v: v / F.nullif(F.col(f"all_{whole}"), F.lit(0)))  # noqa: B023
        judged = judged.withColumn(f"{name}_distance", jensen_shannon(own, ref))
    far = (F.col("classes_distance") > CLASS_LIMIT + CLASS_SLACK / F.sqrt(F.greatest("chars", F.lit(1)))) | (F.col("words_distance") > WORD_LIMIT + WORD_SLACK / F.sqrt(F.greatest("n_words", F.lit(1))))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).alias("kept"), "classes_distance", "words_distance"
    )
