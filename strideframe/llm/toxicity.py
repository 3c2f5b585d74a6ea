"""Toxicity scores from two class-conditional Kneser-Ney word models.

Bigram counts of a bounded sample of labelled documents are made in Spark, once per class and half; all of them are kept.
From them come, for each class, Kneser-Ney models of order one and two that back off to shared counts: continuation counts of
the class -> those of both classes, and bigrams of the class -> those of both classes, times what the class's lower order
makes of the second word. Both classes weigh the same in shared counts, whatever their sizes in the sample. An expression that
is rare in both classes gets most of its mass from the shared counts, so its log-likelihood ratio stays near zero (a bigram's
near that of its second word). The models are tables in the shared folder, made by joins and sums; tasks that score read them
once a process. A document's features are its log-likelihood ratios divided by its number of words; a logistic curve, fitted to
ratios that each half gets from the other half's model with equal weight for both classes, turns them into a probability.
Its scale does not depend on how rare toxic texts are among the labels.

Edge cases: null and wordless texts get the score of ratios of 0; rows with a null or non 0/1 label and labels of unknown
documents teach nothing; repeated label rows count once (the higher label wins), and so do texts that are repeated under one
label; with no usable labels, or only one class, every score is the share of toxic labels (0 without labels). Extra columns of
the input are kept as they are, but one named as the score is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow.dataset import dataset
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, file_system, in_short_batches, new_path, slices, stored

WORD = re.compile(r"\w+")
#: Labelled documents of each class that the models are fitted on, about; the bound of everything the driver gathers.
DOCS_PER_CLASS = 4000
#: Words of no meaning that a text is taken to have besides its own: one odd word in a very short text is weak evidence.
PRIOR = 20
THRESHOLD = 0.7


@dataclass(frozen=True)
class ToxicityModel:
    """Tables of the two models in the shared folder, read once by every Python process, and the curve."""

    words: str
    bigrams: str
    curve: tuple[float, ...]

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(design(features) @ np.array(self.curve), -30, 30)))


#: Code of what stands before a text's first word; words have odd ones.
START = 0


class Words:
    """The words of some texts: the code (64 bits of hash) of each different one, and the place of every word's code, text after text."""

    def __init__(self, texts: list[str | None]):
        index: dict[str, int] = {}
        rows = [[index.setdefault(w, len(index)) for w in WORD.findall(t.lower())] if t else [] for t in texts]
        self.sizes = np.array([len(r) for r in rows], dtype=np.int64)
        # The last code is the start's; every text begins with it.
        self.codes = np.append(pd.util.hash_array(np.array([*index, ""], dtype=object), categorize=False).view(np.int64)[:-1] | 1, START)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes + 1)[:-1])).astype(np.int64) if rows else np.zeros(0, dtype=np.int64)
        self.flat = np.full(int(self.sizes.sum()) + len(rows), len(index), dtype=np.int64)
        for begin, r in zip(self.starts, rows, strict=True):
            self.flat[begin + 1 : begin + 1 + len(r)] = r


class Ratios:
    """Log-likelihood ratios of words and bigrams by the models of one part of the sample."""

    def __init__(self, words: pa.Table, bigrams: pa.Table, part: str):
        order = np.argsort(words["code"].to_numpy())
        self.codes, self.uni = words["code"].to_numpy()[order], words[f"ratio{part}"].to_numpy()[order]
        order = np.argsort(bigrams["key"].to_numpy())
        self.keys, self.adds = bigrams["key"].to_numpy()[order], bigrams[f"add{part}"].to_numpy()[order]

    @classmethod
    def load(cls, words: str, bigrams: str, part: str) -> Ratios:
        return cls(_read(words, ["code", f"ratio{part}"]), _read(bigrams, ["key", f"add{part}"]), part)

    def ratio(self, words: Words) -> np.ndarray:
        """Log-likelihood ratio of every word given the one before; a start's own is 0, and so is that of a word that neither class knows."""
        spot = np.minimum(np.searchsorted(self.codes, words.codes), len(self.codes) - 1)
        known = self.codes[spot] == words.codes
        at = words.flat
        before = np.concatenate((at[:1], at[:-1]))
        out = np.where(known, self.uni[spot], 0.0)[at]
        if len(self.keys):
            keys = (words.codes[before] << 1) ^ words.codes[at]
            spot = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = known[before] & known[at] & (self.keys[spot] == keys)  # behind an unknown word only the lower order speaks
            out += np.where(hit, self.adds[spot], 0)
        out[words.starts] = 0
        return out

    def features(self, texts: list[str | None]) -> np.ndarray:
        """For each text: ratio a word, ratio above one unit a word, ratio above one unit a word with PRIOR neutral words added."""
        words = Words(texts)
        if not len(texts):
            return np.zeros((0, 3))
        ratio, sizes = self.ratio(words), words.sizes
        all_, high = np.add.reduceat(ratio, words.starts), np.add.reduceat(np.maximum(ratio - 1, 0), words.starts)
        return np.stack((all_ / np.maximum(sizes, 1), high / np.maximum(sizes, 1), high / (sizes + PRIOR)), axis=1)


def _read(uri: str, columns: list[str]) -> pa.Table:
    system, path = file_system(uri)
    return dataset(path, filesystem=system, format="parquet").to_table(columns=columns)


#: The tables that a Python process has read last.
_loaded: dict[tuple[str, str, str], Ratios] = {}


def _ratios(words: str, bigrams: str, part: str) -> Ratios:
    key = (words, bigrams, part)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Ratios.load(*key)
    return _loaded[key]


def design(features: np.ndarray) -> np.ndarray:
    """The high ratios count by their root alone: a curve with a linear term too may turn down where they are highest."""
    return np.concatenate((np.ones((len(features), 1)), features[:, :1], np.sqrt(features[:, 2:])), axis=1)


#: Parts of the sample: each half, and both (no suffix). Classes: t toxic, p plain.
PARTS, CLASSES = ("0", "1", ""), ("t", "p")


def _discounts(n: list[float]) -> list[float]:
    """Discounts of counts 1, 2 and 3 or more, from how many things have count 1, 2, 3 and 4."""
    n = [max(1.0, x) for x in n]
    y = n[0] / (n[0] + 2 * n[1])
    raw = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
    return np.clip(raw, (0.4, 0.5, 0.6), (0.95, 1.8, 2.7)).tolist()


def _spectrum(names: list[str]) -> list[Column]:
    """Of each count column the total, how many of its values are 1, 2, 3 and 4, and how many are 3 or more."""
    out = [F.sum(n).alias(f"{n}_total") for n in names]
    out += [F.count(F.when(F.col(n) == k, 1)).alias(f"{n}_{k}") for n in names for k in (1, 2, 3, 4)]
    return out + [F.count(F.when(F.col(n) > 2, 1)).alias(f"{n}_more") for n in names]


class _Counts:
    """What the spectrum of one count column says of it."""

    def __init__(self, sums: dict[str, float], name: str):
        of = lambda k: float(sums[f"{name}_{k}"] or 0)
        self.count, self.total = F.col(name), max(of("total"), 1.0)
        self.discounts = _discounts([of(k) for k in (1, 2, 3, 4)])
        #: Share of all counts that the discounts take off, for the order below.
        self.rest = max(sum(d * of(k) for d, k in zip(self.discounts, (1, 2, "more"), strict=True)) / self.total, 1e-3)

    def discounted(self) -> Column:
        one, two, more = self.discounts
        cut = F.when(self.count == 0, 0.0).when(self.count == 1, one).when(self.count == 2, two).otherwise(more)
        return F.greatest(self.count - cut, F.lit(0.0))


def _word_table(pairs: DataFrame) -> tuple[DataFrame, int]:
    """Every word with the log-likelihood ratio of the lower order and how far each class lifts it above the shared counts; and how many there are."""
    met = lambda *names: F.count(F.when(sum((F.col(n) for n in names), F.lit(0)) > 0, 1))
    ends = {f"{c}{h}": met(f"{c}{h}") for h in PARTS for c in CLASSES} | {f"s{h}": met(f"t{h}", f"p{h}") for h in PARTS}
    seconds = pairs.groupBy(F.col("second").alias("code")).agg(*[v.alias(k) for k, v in ends.items()])
    sums = seconds.agg(*_spectrum(list(ends)), F.count(F.lit(1)).alias("words")).first().asDict()
    table = seconds
    for h in PARTS:
        own, rest = {c: _Counts(sums, f"{c}{h}") for c in CLASSES}, _Counts(sums, f"s{h}").rest
        shared = sum((own[c].count / own[c].total for c in CLASSES), F.lit(0.0)) * ((1 - rest) / 2) + rest / (sums["words"] + 1)
        table = table.withColumn(f"shared{h}", shared)
        table = table.withColumns({f"lift_{c}{h}": own[c].discounted() / own[c].total / F.col(f"shared{h}") + own[c].rest for c in CLASSES})
        table = table.withColumn(f"ratio{h}", F.log(F.col(f"lift_t{h}") / F.col(f"lift_p{h}")))
    lifts = [f"lift_{c}{h}" for c in CLASSES for h in PARTS]
    table = table.select("code", *[f"ratio{h}" for h in PARTS], *lifts)
    start = table.sparkSession.range(1).select(F.lit(START).cast("long").alias("code"), *[F.lit(0.0).alias(c) for c in table.columns[1:]])
    return table.unionByName(start), sums["words"]


def _bigram_table(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """key of every bigram, and what each part's models add to the ratio of its second word."""
    names = [f"{c}{h}" for c in CLASSES for h in PARTS]
    sums = pairs.agg(*_spectrum(names)).first().asDict()
    kept = {n: _Counts(sums, n).discounted() for n in names}
    # Of each first word: all that follows it, and the mass that the discounts leave to the lower order.
    firsts = pairs.groupBy("first").agg(*[F.sum(n).alias(f"all_{n}") for n in names], *[F.sum(kept[n]).alias(f"kept_{n}") for n in names])
    whole = {n: F.greatest(F.col(f"all_{n}"), F.lit(1)) for n in names}
    firsts = firsts.withColumns({f"back_{n}": F.greatest(1 - F.col(f"kept_{n}") / whole[n], F.lit(1e-3)) for n in names})
    both = pairs.join(firsts, "first").join(words.withColumnRenamed("code", "second"), "second")
    adds = []
    for h in PARTS:
        t, p = f"t{h}", f"p{h}"
        shared = (F.col(t) / whole[t] + F.col(p) / whole[p]) / 2
        # In units of the backoff, which says nothing of the second word. A bigram that this part has not seen adds nothing.
        pair = {n: kept[n] / whole[n] / F.col(f"back_{n}") + shared * F.col(f"lift_{n}") for n in (t, p)}
        add = F.when(shared > 0, F.log(pair[t] / pair[p]) - F.col(f"ratio{h}")).otherwise(0.0)
        adds.append(add.cast("float").alias(f"add{h}"))
    return both.select(F.shiftleft("first", 1).bitwiseXOR(F.col("second")).alias("key"), *adds)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by damped Newton steps with a small ridge."""
    scale = np.maximum(np.sqrt((x**2 * weight[:, None]).sum(0) / weight.sum()), 1e-9)
    z, beta = x / scale, np.zeros(x.shape[1])
    ridge = 1e-5 * weight.sum()

    def loss(b: np.ndarray) -> float:
        m = z @ b
        return float(weight @ (np.logaddexp(0, m) - y * m) + 0.5 * ridge * b @ b)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        grad = z.T @ (weight * (y - p)) - ridge * beta
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(beta))
        step, now = np.linalg.solve(hess, grad), loss(beta)
        while loss(beta + step) > now and np.abs(step).max() > 1e-9:
            step /= 2
        beta += step
        if np.abs(step).max() < 1e-7:
            break
    return beta / scale


def fit(docs: DataFrame, labels: DataFrame, teaches: Column, *, docs_per_class: int = DOCS_PER_CLASS) -> ToxicityModel | float:
    """Fit on labelled documents for which teaches (a condition on labels.doc_id) holds; a float where there is nothing to learn."""
    labels = (
        labels.filter(teaches & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
        .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    )
    seen = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    if len(seen) < 2:
        return float(seen.get(1, 0) > 0)
    share = {c: min(1.0, docs_per_class / n) for c, n in seen.items()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000))
    sample = labels.filter(draw < F.when(F.col("toxic") == 1, round(share[1] * 1e6)).otherwise(round(share[0] * 1e6)))
    sample = sample.select(F.col("doc_id").alias("_id"), "toxic", (F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(2))).cast("int").alias("half"))
    # The sample is bounded by docs_per_class, so it can be sent to every task and no text is shuffled.
    picked = (
        in_short_batches(docs).select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))
        .select("text", "toxic", "half").dropDuplicates(["text", "toxic"])
    )
    when = lambda t, h: F.sum(F.when((F.col("toxic") == t) & (F.col("half") == h), F.col("n")).otherwise(0))
    pairs = (
        picked.mapInPandas(_pairs, "first long, second long, toxic int, half int, n long").groupBy("first", "second")
        .agg(when(1, 0).alias("t0"), when(1, 1).alias("t1"), when(0, 0).alias("p0"), when(0, 1).alias("p1"))
        .withColumns({c: F.col(f"{c}0") + F.col(f"{c}1") for c in CLASSES})
    )
    pairs = stored(pairs, "toxicity-pairs")
    # The tables stay in the shared folder: the driver sees sums of them only.
    spark, paths = docs.sparkSession, [new_path(docs.sparkSession, f"toxicity-{x}") for x in ("words", "bigrams")]
    table, n = _word_table(pairs)
    if not n:
        return seen[1] / sum(seen.values())
    table.write.parquet(paths[0])
    _bigram_table(pairs, spark.read.schema(table.schema).parquet(paths[0])).write.parquet(paths[1])
    discard(pairs)

    def scored_by(half: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                x = _ratios(*paths, str(half)).features(list(b["text"]))
                yield pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "toxic": b["toxic"].to_numpy()})

        return picked.filter(F.col("half") == 1 - half).mapInPandas(run, "a double, b double, c double, toxic int")

    got = scored_by(0).union(scored_by(1)).toPandas()
    y = got["toxic"].to_numpy(float)
    # Both classes weigh the same, whatever their share of the labels: a score of 0.7 stands for odds of 7 to 3 between a text of either.
    weight = np.where(y == 1, len(y) / max(y.sum(), 1), len(y) / max((1 - y).sum(), 1))
    curve = _logistic(design(got[["a", "b", "c"]].to_numpy(float)), y, weight)
    return ToxicityModel(*paths, tuple(curve.tolist()))


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Bigram counts of each slice of a batch, by the words' codes; a text's first word follows START."""
    for b in batches:
        for (toxic, half), rows in b.groupby(["toxic", "half"]):
            for part in slices(rows["text"]):
                words = Words(part)
                inner = np.ones(len(words.flat), dtype=bool)
                inner[words.starts] = False
                at = np.flatnonzero(inner)
                size = len(words.codes)
                pair, n = np.unique(words.flat[at - 1] * size + words.flat[at], return_counts=True)
                yield pd.DataFrame({"first": words.codes[pair // size], "second": words.codes[pair % size], "toxic": np.int32(toxic), "half": np.int32(half), "n": n})


def score(docs: DataFrame, model: ToxicityModel | float, *, column: str = "score", text: str = "text") -> DataFrame:
    """Add the probability that a document is toxic; all other columns stay."""
    if not isinstance(model, ToxicityModel):
        return docs.withColumn(column, F.lit(float(model)))

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ratios = _ratios(model.words, model.bigrams, "")
        for texts in batches:
            out = [model.probability(ratios.features(part)) for part in slices(texts)]
            yield pd.Series(np.concatenate([np.zeros(0), *out]))

    return in_short_batches(docs).withColumn(column, probability.asNondeterministic()(F.col(text)))
