"""Language-model scores by stupid backoff over bigram and unigram counts of the whole corpus.

A document is scored with the counts of all other documents: score(w | v) = c(v w) / c(v) where the pair occurs elsewhere,
else ALPHA * c(w) / N; the first word, which nothing precedes, has c(w) / N. A word that no other document holds counts one
half. The document's score is the mean natural logarithm over its words, so copies of a text look familiar and junk does not.

As a relation this is: n-grams exploded from the documents, count tables partitioned by a hash of the word, a join of the two
and a sum for each document. All of it takes one shuffle of packed columns. Each occurrence of a word w goes to the partition
of hash(w), together with the words before and behind it. There the partition has every occurrence of w and every bigram
that begins or ends with w, so it counts c(w), c(v w) and c(w x), takes off what the document itself holds, and adds up the
parts of the document's score that depend on w: log c(v w), the backed-off log c(w), and - log c(w) for every seen (w x).
Words that make up a large share of all text would be hot keys. Their counts, and those of all pairs of two of them, come from
a small table that is counted before and sent to every task: pairs of two hot words are scored where they are read, as by a
broadcast join, and a bigram of a hot and another word is dealt by its own hash.

Rows of that relation travel as packed columns (a row for each slice of documents and partition), since an n-gram a row takes
more shuffle than the text has bytes. A word is known by 64 bits of hash, a neighbour of a given word by 32. Edge cases: null and wordless texts have no score.
Rows are documents, also when an id or text is repeated or null. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, hash_below, in_short_batches, slices, stored

ALPHA = 0.4
#: Words with tables of their own, at most, chosen on a sample of so many documents; their counts are of all documents.
HOT_WORDS, SAMPLE_DOCS = 256, 2000
#: Characters of text for each partition of the count tables; bounds a task's memory.
CHARS_PER_PART = 9_000_000
SLICE = 6_000_000
#: A part is scored in so many shares of its words, one after the other.
SHARES = 4
ROW_BITS = 20  # documents of one slice


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(28))


def _words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words of each text)."""
    index: dict[str, int] = {}
    rows = [np.array([index.setdefault(w, len(index)) for w in t.split()] if t else [], dtype=np.int64) for t in texts]
    codes = _mix(pd.util.hash_array(np.array([*index, ""], dtype=object), categorize=False) | np.uint64(1))
    return codes[np.concatenate([*rows, np.zeros(0, dtype=np.int64)]).astype(np.int64)], np.array([len(r) for r in rows], dtype=np.int64)


def hot_words(docs: DataFrame, total_docs: int) -> np.ndarray:
    """Sorted hashes of the most frequent words of a sample."""
    sample = docs.filter(hash_below(F.col("text"), SAMPLE_DOCS / max(total_docs, 1), 17))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in slices(b["text"], SLICE):
                word, n = np.unique(_words(part)[0], return_counts=True)
                yield pd.DataFrame({"word": word.view(np.int64), "n": n})

    top = sample.select("text").mapInPandas(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(HOT_WORDS).collect()
    return np.sort(np.array([r["word"] for r in top], dtype=np.int64).view(np.uint64))


@dataclass
class Hot:
    """Hot words by their hashes, how often each occurs in all documents, and each pair (row: first, column: second)."""

    words: np.ndarray
    counts: np.ndarray
    pairs: np.ndarray


def _before(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each word the value of the one before it in its text, -1 for a text's first; n: number of words of each text."""
    out = np.concatenate(([-1], at[:-1])) if len(at) else at
    out[(np.cumsum(n) - n)[n > 0]] = -1
    return out


def count_hot(docs: DataFrame, words: np.ndarray) -> Hot:
    h = len(words)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(h + h * h, dtype=np.int64)
        for b in batches:
            for part in slices(b["text"], SLICE):
                word, n = _words(part)
                at = _spots(word, words)
                before = _before(at, n)
                on = at >= 0
                total[:h] += np.bincount(at[on], minlength=h)
                on &= before >= 0
                total[h:] += np.bincount(before[on] * h + at[on], minlength=h * h)
        k = np.flatnonzero(total)
        yield pd.DataFrame({"k": k, "n": total[k]})

    # At most one row for each pair of hot words.
    out = np.zeros(h + h * h, dtype=np.int64)
    for r in docs.select("text").mapInPandas(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        out[r["k"]] = r["n"]
    return Hot(words, out[:h], out[h:].reshape(h, h))


def _score_hot_pairs(row: np.ndarray, before: np.ndarray, at: np.ndarray, own: tuple[np.ndarray, np.ndarray], hot: Hot, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Log sums and numbers of backed-off words of each document, over pairs of hot words; own: sorted row * hot words + word, and their counts."""
    h = len(hot.words)
    elsewhere = lambda w: hot.counts[w] - own[1][np.searchsorted(own[0], row * h + w)]
    _, kind, n = np.unique((row * h + before) * h + at, return_inverse=True, return_counts=True)
    seen = hot.pairs[before, at] - n[kind]
    backed = np.log(np.maximum(elsewhere(at), 0.5)) + np.log(ALPHA)
    log = np.where(seen > 0, np.log(np.maximum(seen, 1)) - np.log(np.maximum(elsewhere(before), 1)), backed)
    return np.bincount(row, weights=log, minlength=docs), np.bincount(row, weights=seen <= 0, minlength=docs)


def _spots(words: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Place of each word among the hot ones, or -1."""
    if not len(hot):
        return np.full(len(words), -1)
    at = np.minimum(np.searchsorted(hot, words), len(hot) - 1)
    return np.where(hot[at] == words, at, -1)


def _small(x: np.ndarray) -> bytes:
    """Numbers in as few bytes each as the largest needs: 1, 2 or 4."""
    most = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32).tobytes()


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, dtype={1: np.uint8, 2: np.uint16, 4: np.uint32}[len(data) // n]) if n and data else np.zeros(0, dtype=np.uint8)


def _pack(word: np.ndarray, near: np.ndarray, row: np.ndarray, own: np.ndarray | None) -> dict[str, bytes]:
    """Columns of one part: distinct words with run lengths, neighbours, document rows, and the document's count of a hot word."""
    order = np.lexsort((row, word))
    word, near, row = word[order], near[order], row[order]
    kinds, runs = np.unique(word, return_counts=True)
    return {
        "words": kinds.tobytes(), "runs": runs.astype(np.uint32).tobytes(), "near": near.tobytes(), "rows": _small(row),
        "own": b"" if own is None else _small(own[order]),
    }


def _exploded(docs: DataFrame, hot: Hot, parts: int) -> DataFrame:
    """Packed n-grams: part, base (document number of row 0), kind and columns. Kind 0 has pairs of neighbours (before, behind), 1 and 2 hot words' other neighbours before and behind, 3 the documents, 4 their sums over pairs of hot words."""
    deal = lambda x: (_mix(x) % np.uint64(parts)).astype(np.int64)

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, number = TaskContext.get().partitionId(), 0
        for b in batches:
            at = 0
            for texts in slices(b["text"], SLICE):
                ids = b["doc_id"].iloc[at : at + len(texts)]
                at += len(texts)
                base = (task << (63 - 24)) + (number << ROW_BITS)
                number += 1
                word, n = _words(texts)
                row = np.repeat(np.arange(len(n)), n)
                first = np.zeros(len(word), dtype=bool)
                first[(np.cumsum(n) - n)[n > 0]] = True
                last = np.roll(first, -1) if len(word) else first
                near = np.maximum((word >> np.uint64(32)).astype(np.uint32), np.uint32(1))  # 0 stands for a text's end
                before, behind = np.where(first, np.uint32(0), np.roll(near, 1)), np.where(last, np.uint32(0), np.roll(near, -1))
                spot = _spots(word, hot.words)
                led = _before(spot, n)
                follows = np.where(last, -1, np.roll(spot, -1)) if len(spot) else spot
                cold, warm = np.flatnonzero(spot < 0), np.flatnonzero(spot >= 0)
                rows = []
                for p, at_p in _by(deal(word[cold]), parts):
                    k = cold[at_p]
                    rows.append({"part": p, "base": base, "kind": 0, **_pack(word[k], np.stack((before[k], behind[k]), axis=1), row[k], None)})
                kinds, inverse, own = np.unique(row[warm] * len(hot.words) + spot[warm], return_inverse=True, return_counts=True)
                for kind, near_, other in ((1, before, led), (2, behind, follows)):
                    left = np.flatnonzero(other[warm] < 0)
                    k = warm[left]
                    for p, at_p in _by(deal(word[k] ^ _mix(near_[k].astype(np.uint64) + np.uint64(7))), parts):
                        j = k[at_p]
                        rows.append({"part": p, "base": base, "kind": kind, **_pack(word[j], near_[j], row[j], own[inverse[left[at_p]]])})
                k = np.flatnonzero((spot >= 0) & (led >= 0))
                log, back = _score_hot_pairs(row[k], led[k], spot[k], (kinds, own), hot, len(n))
                listed = {"part": base % parts, "base": base, "own": b""}
                known = ids.isna().to_numpy()
                docs_ = np.array([0 if lost else int(i) for i, lost in zip(ids, known, strict=True)], dtype=np.int64)
                rows.append({**listed, "kind": 3, "words": docs_.tobytes(), "runs": n.astype(np.uint32).tobytes(), "near": known.tobytes(), "rows": b""})
                rows.append({**listed, "kind": 4, "words": log.tobytes(), "runs": b"", "near": b"", "rows": _small(back.astype(np.int64))})
                yield pd.DataFrame(rows)

    asked = in_short_batches(docs).select(as_text(), "text")
    return asked.mapInPandas(explode, "part long, base long, kind int, words binary, runs binary, near binary, rows binary, own binary")


def _by(to: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cuts)):
        yield int(p), order[cuts[p] : cuts[p + 1]]


def _elsewhere(key: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each occurrence, how often its key occurs in other rows."""
    if not len(key):
        return np.zeros(0, dtype=np.int64)
    order = np.lexsort((row, key))
    k, r = key[order], row[order]
    new_key = np.concatenate(([True], k[1:] != k[:-1]))
    new_row = new_key | np.concatenate(([True], r[1:] != r[:-1]))
    of_key, of_row = np.cumsum(new_key) - 1, np.cumsum(new_row) - 1
    out = np.empty(len(key), dtype=np.int64)
    out[order] = np.bincount(of_key)[of_key] - np.bincount(of_row)[of_row]
    return out


def _score_part(pdf: pd.DataFrame, hot: Hot) -> pd.DataFrame:
    """Sums of each slice's documents in one part: rows, log sums without N, numbers of backed-off words; and the lists of documents."""
    sums: dict[str, list[np.ndarray]] = {"doc": [], "log": [], "back": []}
    bases = np.sort(pdf["base"].unique())

    def add(doc: np.ndarray, log: np.ndarray, back: np.ndarray) -> None:
        kinds, at = np.unique(doc, return_inverse=True)
        sums["doc"].append(kinds)
        sums["log"].append(np.bincount(at, weights=log, minlength=len(kinds)))
        sums["back"].append(np.bincount(at, weights=back, minlength=len(kinds)))

    def columns(kind: int) -> tuple[np.ndarray, ...] | None:
        rows = pdf[pdf["kind"] == kind]
        if not len(rows):
            return None
        word, near, doc, own = [], [], [], []
        for r in rows.itertuples(index=False):
            runs = np.frombuffer(r.runs, dtype=np.uint32)
            word.append(np.repeat(np.frombuffer(r.words, dtype=np.uint64), runs))
            near.append(np.frombuffer(r.near, dtype=np.uint32))
            n = len(word[-1])
            doc.append((int(np.searchsorted(bases, r.base)) << ROW_BITS) + _wide(r.rows, n).astype(np.int64))
            own.append(_wide(r.own, n).astype(np.int64))
        return np.concatenate(word), np.concatenate(near), np.concatenate(doc), np.concatenate(own)

    def left(seen: np.ndarray, first: np.ndarray, word_elsewhere: np.ndarray, doc: np.ndarray) -> None:
        single = np.log(np.maximum(word_elsewhere, 0.5)) + np.where(first, 0.0, np.log(ALPHA))
        hit = (seen > 0) & ~first
        add(doc, np.where(hit, np.log(np.maximum(seen, 1)), single), ~hit)

    if (got := columns(0)) is not None:
        # A word's rows stay together; a share of the words at a time keeps the sorts small.
        part = (got[0] >> np.uint64(60)).astype(np.uint8) % SHARES
        for k in range(SHARES):
            on = part == k
            word, near, doc = got[0][on], got[1].reshape(-1, 2)[on], got[2][on]
            _, number = np.unique(word, return_inverse=True)
            number = number.astype(np.uint64) << np.uint64(32)
            elsewhere = _elsewhere(number, doc)
            left(_elsewhere(number | near[:, 0], doc), near[:, 0] == 0, elsewhere, doc)
            hit = (_elsewhere(number | near[:, 1], doc) > 0) & (near[:, 1] != 0)
            add(doc[hit], -np.log(elsewhere[hit]), np.zeros(int(hit.sum())))
        del got
    for kind in (1, 2):
        if (got := columns(kind)) is not None:
            part = (got[1] >> np.uint32(28)).astype(np.uint8) % SHARES
            for k in range(SHARES):
                word, near, doc, own = (x[part == k] for x in got)
                spot = _spots(word, hot.words)
                elsewhere = hot.counts[spot] - own
                seen = _elsewhere((spot.astype(np.uint64) << np.uint64(32)) | near, doc)
                if kind == 1:
                    left(seen, near == 0, elsewhere, doc)
                else:
                    hit = (seen > 0) & (near != 0)
                    add(doc[hit], -np.log(elsewhere[hit]), np.zeros(int(hit.sum())))
            del got
    part, rows = int(pdf["part"].iloc[0]), []
    if sums["doc"]:
        doc, at = np.unique(np.concatenate(sums["doc"]), return_inverse=True)
        log = np.bincount(at, weights=np.concatenate(sums["log"]))
        back = np.bincount(at, weights=np.concatenate(sums["back"])).astype(np.int64)
        cuts = np.searchsorted(doc >> ROW_BITS, np.arange(len(bases) + 1))
        for k in np.flatnonzero(np.diff(cuts)):
            on = slice(cuts[k], cuts[k + 1])
            rows.append((int(bases[k]), part, 0, _small(doc[on] & ((1 << ROW_BITS) - 1)), log[on].tobytes(), _small(back[on])))
    for r in pdf[pdf["kind"] == 4].itertuples(index=False):
        rows.append((int(r.base), part, 0, _small(np.arange(len(r.words) // 8)), r.words, r.rows))
    listed = pdf[pdf["kind"] == 3]
    rows += [(int(r.base), part, 1, r.words, r.near, r.runs) for r in listed.itertuples(index=False)]
    return pd.DataFrame(rows, columns=["base", "part", "kind", "rows", "logs", "backs"])


def _merge_slice(pdf: pd.DataFrame) -> pd.DataFrame:
    """The documents of one slice with their sums over all parts."""
    (listed,) = pdf[pdf["kind"] == 1].itertuples(index=False)
    ids, lost = np.frombuffer(listed.rows, dtype=np.int64), np.frombuffer(listed.logs, dtype=bool)
    log, back = np.zeros(len(ids)), np.zeros(len(ids), dtype=np.int64)
    for r in pdf[pdf["kind"] == 0].sort_values("part").itertuples(index=False):
        values = np.frombuffer(r.logs, dtype=np.float64)
        at = _wide(r.rows, len(values)).astype(np.int64)
        log[at] += values
        back[at] += _wide(r.backs, len(values)).astype(np.int64)
    out = pd.DataFrame({"doc_id": pd.array(ids, dtype="Int64"), "n_words": np.frombuffer(listed.backs, dtype=np.uint32).astype(np.int64), "n_backoff": back, "log_sum": log})
    out.loc[lost, "doc_id"] = pd.NA
    return out


def stupid_backoff(docs: DataFrame, *, chars_per_part: int = CHARS_PER_PART) -> DataFrame:
    """doc_id, n_words, n_backoff, score (null without words): one row for each row of docs."""
    size = docs.agg(F.count(F.lit(1)).alias("docs"), F.sum(F.length("text")).alias("chars")).first()
    parts = max(1, -(-(size["chars"] or 0) // chars_per_part))
    hot = count_hot(docs, hot_words(docs, size["docs"]))
    packed = _exploded(docs, hot, parts)
    scored = packed.groupBy("part").applyInPandas(lambda pdf: _score_part(pdf, hot), "base long, part long, kind int, rows binary, logs binary, backs binary")
    # A row for each part and slice, not for each part and document: a slice's documents meet their sums in one task.
    merged = scored.groupBy("base").applyInPandas(_merge_slice, "doc_id long, n_words long, n_backoff long, log_sum double")
    found = stored(merged, "backoff-sums")  # one narrow row a document
    total = found.agg(F.sum("n_words")).first()[0] or 0
    others = F.log(F.greatest(F.lit(total) - F.col("n_words"), F.lit(1)).cast("double"))
    return found.select("doc_id", "n_words", "n_backoff", F.when(F.col("n_words") > 0, (F.col("log_sum") - F.col("n_backoff") * others) / F.col("n_words")).alias("score"))
