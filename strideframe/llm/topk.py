"""Exact top-k inner products by Fagin's threshold algorithm.

Vectors are quantised to integers, so scores are exact. Candidates are cut into blocks by a hash of their id; in each block
every dimension has a list of the candidates sorted by their value. A query reads its lists from the end that is best for
the sign of its component, all lists to the same depth, looks up the full score of every new candidate, and stops when no
candidate beyond that depth can reach its k-th result any more. The k best of every block are merged.

Queries are dealt out in blocks too, so that a task holds one block of either; that is the stated set of queries against
all rows, in blocks. Ties go to the smaller id, so a list is read on while the bound equals the k-th score. Lists are read a
few entries further at a time, a quarter of what is read already once that is more, so that little is read in vain.

Edge cases: null vectors and vectors with null or non-finite components take no part, nor do empty ones; vectors of
another length than the query's are no candidates for it. All rows with the query's id are its own; other repeated rows
are candidates each. A query is a pair of id and vector: repeated rows of it give one result, and an id with two vectors
gives one for each. A null id is a candidate (and goes last among ties) but no query. Quantised components and scores end at
the bounds of 64 bits. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Candidates and queries that a task holds at once.
BLOCK, QUERY_BLOCK = 4096, 2048
SCALE = 256.0
LAST = 2**63 - 1


def quantised(vector: Column, scale: float = SCALE) -> Column:
    """floor(scale * x) of every component, null where the vector takes no part."""
    x = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)), F.transform(x, lambda v: F.floor(v * scale)))


class SortedLists:
    """One block's candidates with a sorted list for each dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[by_id], vectors[by_id]
        self.order = np.argsort(self.vectors, axis=0, kind="stable")
        self.values = np.take_along_axis(self.vectors, self.order, axis=0)

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, scores) of the k best, best first, and how many candidates were scored for it."""
        n = len(self.ids)
        up, down = np.flatnonzero(query < 0), np.flatnonzero(query > 0)
        found, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=self.vectors.dtype)
        seen = self.ids == own
        if not len(up) and not len(down):
            found = np.flatnonzero(~seen)[:k]
            return self.ids[found], np.zeros(len(found), dtype=self.vectors.dtype), len(found)
        depth, scored = 0, 0
        while depth < n:
            deeper = min(n, depth + max(4 * k, depth // 2))
            met = np.zeros(n, dtype=bool)
            met[self.order[depth:deeper, up]] = True
            met[self.order[n - deeper : n - depth, down]] = True
            new = np.flatnonzero(met & ~seen)
            seen |= met
            scored += len(new)
            found, scores = np.concatenate((found, new)), np.concatenate((scores, self.vectors[new] @ query))
            best = np.lexsort((found, -scores))[:k]  # positions rise with ids
            found, scores = found[best], scores[best]
            depth = deeper
            bound = self.values[depth - 1, up] @ query[up] + self.values[n - depth, down] @ query[down]
            if len(found) == k and scores[-1] > bound:
                break
        return self.ids[found], scores, scored


def _exact(*arrays: np.ndarray) -> type:
    """float64 holds all sums of products exactly while they stay under 2**53; Python's integers do beyond int64."""
    most = 1
    for a in arrays:
        most *= max((abs(int(a.max())), abs(int(a.min())), 1) if a.size else (1,))
    most *= arrays[0].shape[1]
    return np.float64 if most < 2**53 else np.int64 if most < 2**63 else object


def top_of_blocks(candidates: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    out = {"query_id": [], "query": [], "vec_id": [], "score": []}
    if len(candidates) and len(queries):
        v, q = np.stack(candidates["vector"].to_numpy()), np.stack(queries["vector"].to_numpy())
        kind = _exact(v, q)
        lists = SortedLists(candidates["vec_id"].to_numpy(np.int64), v.astype(kind))
        for own, key, vector in zip(queries["query_id"].to_numpy(np.int64), queries["query"].to_numpy(np.int64), q.astype(kind), strict=True):
            ids, scores, _ = lists.top(vector, own, k)
            out["query_id"] += [own] * len(ids)
            out["query"] += [key] * len(ids)
            out["vec_id"] += ids.tolist()
            out["score"] += [min(max(int(s), -LAST - 1), LAST) for s in scores]
    return pd.DataFrame(out).astype("int64")


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 5, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score; vectors has vec_id and embedding, is_query is a condition on them."""
    rows = vectors.select("vec_id", quantised(F.col("embedding")).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks")).filter("vector is not null")
    size = vectors.agg(F.count(F.lit(1)).alias("all"), F.count(F.when(is_query, 1)).alias("asking")).first()
    parts, asking = max(1, -(-size["all"] // block)), max(1, -(-size["asking"] // query_block))
    deal = lambda n, *by: F.pmod(F.xxhash64("vec_id", "vector", *by), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dim, last = F.size("vector").alias("dim"), F.lit(LAST)
    # Equal rows go to different parts: their place in the table is part of the hash.
    # A null id is the greatest number on its way through pandas, which would make floats of all ids beside it.
    candidates = rows.select(F.coalesce("vec_id", last).alias("vec_id"), "vector", dim, deal(parts, F.monotonically_increasing_id()).alias("part"), each(asking).alias("ask"))
    queries = (
        rows.filter("asks and vec_id is not null").groupBy("vec_id", "vector").agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("vec_id").alias("query_id"), F.xxhash64("vector").alias("query"), "vector", dim, deal(asking).alias("ask"), each(parts).alias("part"))
    )
    key = ["dim", "part", "ask"]
    best = queries.groupBy(*key).cogroup(candidates.groupBy(*key)).applyInPandas(lambda q, c: top_of_blocks(c, q, k), "query_id long, query long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.nullif("vec_id", last).alias("vec_id"), "score")
