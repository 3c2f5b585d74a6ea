"""Similarity self-join of documents on the Jaccard similarity of their word n-gram sets, by MinHash banding.

1. Every text becomes the set of its n-word shingles; documents with equal sets are one node (exact copies in all that
   counts here). 2. The node's MinHash values are cut into bands; how many bands of how many rows follows from the target
   recall at the threshold. 3. Band hashes are shuffled; each bucket's members are tied to its smallest node, which keeps
   everything that shares a bucket in one candidate cluster without listing pairs. 4. Each cluster's full sets are compared
   exactly, in blocks of bounded size: a cluster that exceeds one block is dealt out as pairs of blocks, and only link
   counts and a spanning forest leave a task. 5. Links make classes.

One row per document: its class (the smallest doc_id in it) and how many other documents it has a link to; copies count.

Edge cases: a text of 1 to n - 1 words is one shingle; null and wordless texts have no shingle, no link and a class of their
own. Repeated rows are copies of each other. Rows with a null doc_id take part; a class id is null only where all its ids
are. A node is known by 64 bits of a BLAKE2 digest of its set. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, discard, free_name, id_type, in_short_batches, slices, stored

THRESHOLD, WORDS, RECALL = 0.8, 5, 0.9999
#: Documents that are compared with each other at once, and shingles that they may have together; memory of a task is bounded by two blocks.
BLOCK, BLOCK_SHINGLES = 1024, 2_000_000


def bands_for(threshold: float, recall: float, max_hashes: int = 300) -> tuple[int, int]:
    """(bands, rows) with the most rows for which so many hashes find a pair at the threshold with the wanted probability."""
    best = (math.ceil(math.log(1 - recall) / math.log1p(-threshold)) if threshold < 1 else 1, 1)
    for rows in range(2, 33):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows))) if threshold < 1 else 1
        if bands * rows > max_hashes:
            break
        best = (bands, rows)
    return best


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], n: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's n-word shingles."""
    index: dict[str, int] = {}
    rows = [[index.setdefault(w, len(index)) for w in t.split()] if t else [] for t in texts]
    codes = pd.util.hash_array(np.array([*index, ""], dtype=object), categorize=False)
    out = []
    for r in rows:
        if not r:
            out.append(np.zeros(0, dtype=np.uint64))
            continue
        w = codes[r]
        k = min(n, len(w))
        h = np.full(len(w) - k + 1, k, dtype=np.uint64)
        for i in range(k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - k + 1 + i]
        out.append(np.unique(_mix(h)))
    return out


def set_id(shingles: np.ndarray) -> int:
    return int.from_bytes(blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def band_hashes(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """(sets, bands) 64-bit hashes; sets are not empty."""
    rng = np.random.default_rng(97)
    mult = rng.integers(0, 2**31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    add = rng.integers(0, 2**32, bands * rows, dtype=np.uint32)
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out, y = np.empty((len(sets), bands), dtype=np.uint64), np.empty_like(x)
    for b in range(bands):
        h = np.full(len(sets), b + 1, dtype=np.uint64)
        for r in range(b * rows, (b + 1) * rows):
            np.multiply(x, mult[r], out=y)
            np.add(y, add[r], out=y)
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(y, starts))
        out[:, b] = h
    return out


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_key (a hash of the text), and of its shingle set: node (null without shingles), size and band hashes."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = 0
            for part in slices(batch["text"]):
                own = batch.iloc[at : at + len(part)]
                at += len(part)
                sets = shingle_sets(part, n)
                full = [s for s in sets if len(s)]
                hashes = iter(band_hashes(full, bands, rows).astype(np.int64)) if full else iter(())
                yield pd.DataFrame({
                    "doc_id": own["doc_id"], "text_key": own["text_key"],
                    "node": pd.array([set_id(s) if len(s) else None for s in sets], dtype="Int64"),
                    "size": np.array([len(s) for s in sets], dtype=np.int64),
                    "bands": pd.Series([next(hashes) if len(s) else None for s in sets], index=own.index, dtype=object),
                })

    asked = in_short_batches(docs).select(as_text(), F.xxhash64("text").alias("text_key"), "text")
    signed = asked.mapInPandas(sign, "doc_id string, text_key long, node long, size long, bands array<long>")
    return signed.withColumn("doc_id", F.col("doc_id").cast(id_type(docs)))


def collapsed(edges: DataFrame) -> DataFrame:
    """Fewer edges with the same components, for edges (a, b) in which a node is a of a bounded number of edges only.

    A node and all its b are tied to the smallest of them. Nodes that share many b (near copies in many buckets) so leave one
    edge each, and one for each different pair of a b and a smallest one.
    """
    low = F.least("a", F.array_min("ends"))
    tied = edges.groupBy("a").agg(F.collect_set("b").alias("ends")).select(low.alias("b"), F.explode(F.concat("ends", F.array("a"))).alias("a"))
    return tied.filter("a != b").select("a", "b").distinct()


def components(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b): smallest node that can be reached.

    Labels go along edges and then jump to their label's label, so that rounds grow with the logarithm of the longest path.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "component-edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "component-labels")
    for _ in range(max_rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", "root", F.least("root", "near").alias("low"))
        far = labels.select(F.col("node").alias("low"), F.col("root").alias("next"))
        new = stored(step.join(far, "low").select("node", F.col("root").alias("was"), F.least("low", "next").alias("root")), "component-labels")
        discard(labels)
        labels = new.select("node", "root")
        if new.filter(F.col("was") != F.col("root")).isEmpty():
            discard(both)
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _similar(sets: list[np.ndarray], left: int, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of the link matrix, in blocks: (first row, boolean block); all sets against each other, or, with left > 0, the first so many against the others."""
    rows, cols = (slice(0, left), slice(left, len(sets))) if left else (slice(0, len(sets)), slice(0, len(sets)))
    sizes = np.array([len(s) for s in sets], dtype=np.float32)
    owner = np.repeat(np.arange(len(sets)), sizes.astype(np.int64))
    _, item, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = seen[item] > 1
    owner, item = owner[keep], item[keep]
    # Shingles that the same documents hold count as one with a weight.
    marks = np.random.default_rng(3).integers(1, 2**63, len(sets), dtype=np.uint64)
    pattern = np.zeros(len(seen), dtype=np.uint64)
    np.add.at(pattern, item, marks[owner])
    _, first, kind, weight = np.unique(pattern[np.unique(item)], return_index=True, return_inverse=True, return_counts=True) if len(item) else ([], [], [], [])
    inter = np.zeros((rows.stop - rows.start, cols.stop - cols.start), dtype=np.float32)
    if len(item):
        used = np.unique(item)
        chosen = np.full(len(seen), -1)
        chosen[used[first]] = np.arange(len(first))
        column = chosen[item]
        on = column >= 0
        owner, column = owner[on], column[on]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        for k in range(0, len(first), 2048):
            lo, hi = np.searchsorted(column, (k, k + 2048))
            x = np.zeros((len(sets), min(2048, len(first) - k)), dtype=np.float32)
            x[owner[lo:hi], column[lo:hi] - k] = 1
            inter += (x[rows] * weight[k : k + 2048].astype(np.float32)) @ x[cols].T
    linked = inter.astype(np.float64) / (sizes[rows, None].astype(np.float64) + sizes[None, cols] - inter) >= threshold
    if not left:
        np.fill_diagonal(linked, False)
    yield rows.start, linked


def _roots(n: int, pairs: np.ndarray) -> np.ndarray:
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(int(a)), find(int(b))
        if a != b:
            parent[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(n)], dtype=np.int64)


def compare(nodes: np.ndarray, copies: np.ndarray, blocks: np.ndarray, sets: list[np.ndarray], i: int, j: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of the members of a cluster's blocks i and j (weighted by copies) and each one's smallest linked node."""
    order = np.lexsort((nodes, blocks if i != j else np.zeros_like(blocks)))
    nodes, copies, sets, blocks = nodes[order], copies[order], [sets[k] for k in order], blocks[order]
    left = int((blocks == i).sum()) if i != j else 0
    if len(nodes) < 2 or (i != j and left in (0, len(nodes))):
        return nodes, np.zeros(len(nodes), dtype=np.int64), nodes
    links, pairs = np.zeros(len(nodes), dtype=np.int64), []
    for _, linked in _similar(sets, left, threshold):
        links[: linked.shape[0]] += linked @ copies[left:] if left else linked @ copies
        if left:
            links[left:] += copies[:left] @ linked
        # A forest is enough: every row with its first link, and every link between rows that those leave apart.
        a, b = np.nonzero(linked)
        pairs.append(np.stack((a, b + left), axis=1))
    root = _roots(len(nodes), np.concatenate(pairs))
    by_root = np.full(len(nodes), np.iinfo(np.int64).max)
    np.minimum.at(by_root, root, nodes)
    return nodes, links, by_root[root]


def _clusters(signed: DataFrame) -> DataFrame:
    """(node, root) of the nodes that share a bucket with others: all of a bucket are tied to its smallest node, its hub."""
    band = signed.filter("node is not null").select("node", F.explode("bands").alias("band")).groupBy("band", "node").agg(F.lit(1).alias("one"))
    hubs = band.groupBy("band").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return components(collapsed(band.join(hubs, "band").select(F.col("node").alias("a"), F.col("hub").alias("b"))))


def _dealt(clusters: DataFrame, nodes: DataFrame, block: int) -> DataFrame:
    """The clustered nodes with the number of blocks of their cluster (nb) and their own block; blocks are bounded in documents and in shingles."""
    of_node = clusters.join(nodes, "node")
    sizes = of_node.groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.sum("size").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("members") / block), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    return (
        of_node.join(sizes.select("root", blocks.alias("nb")), "root")
        .withColumn("block", F.pmod(F.xxhash64("node", F.lit(5)), F.col("nb")).cast("int"))
    )


def _full_sets(docs: DataFrame, dealt: DataFrame, words: int) -> DataFrame:
    """The dealt nodes with their shingle sets, made anew from the text of one document each."""

    @F.pandas_udf("node long, shingles binary")
    def full_set(texts: pd.Series) -> pd.DataFrame:
        sets = [s for part in slices(texts) for s in shingle_sets(part, words)]
        return pd.DataFrame({"node": pd.array([set_id(s) if len(s) else None for s in sets], dtype="Int64"), "shingles": [s.tobytes() for s in sets]})

    texts = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"), "text")
    # By shuffle at every size: what is clustered grows with the input, and a broadcast would hold up to some threshold only.
    asked = texts.join(dealt.hint("merge"), (texts["key"] == dealt["text_key"]) & texts["id"].eqNullSafe(dealt["first_id"])).drop("id", "key")
    asked = in_short_batches(asked.dropDuplicates(["node"])).withColumn("s", full_set.asNondeterministic()("text")).filter(F.col("s.node") == F.col("node"))
    return asked.select("node", "root", "copies", "nb", "block", F.col("s.shingles").alias("shingles"))


def _verified(full: DataFrame, bins: int, threshold: float) -> DataFrame:
    """Links of every node inside one pair of its cluster's blocks each, and the smallest node that it reaches there."""
    pair = lambda k: F.struct(F.least(k, "block").alias("i"), F.greatest(k, "block").alias("j"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), pair)
    large = F.col("nb") > 1
    spread = full.select("*", large.alias("large"), F.when(large, F.col("root")).otherwise(F.pmod(F.xxhash64("root"), F.lit(bins))).alias("bin"), F.explode(pairs).alias("p"))

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in pdf.groupby("root", sort=False):
            sets = [np.frombuffer(s, dtype=np.uint64) for s in g["shingles"]]
            node, links, low = compare(g["node"].to_numpy(), g["copies"].to_numpy(), g["block"].to_numpy(), sets, int(g["i"].iloc[0]), int(g["j"].iloc[0]), threshold)
            out.append(pd.DataFrame({"node": node, "links": links, "low": low, "large": bool(g["large"].iloc[0])}))
        return pd.concat(out)

    dealt = spread.select("*", F.col("p.i").alias("i"), F.col("p.j").alias("j")).drop("p")
    return dealt.groupBy("large", "bin", "i", "j").applyInPandas(verify, "node long, links long, low long, large boolean")


def _classes(docs: DataFrame, threshold: float, words: int, recall: float, block: int) -> DataFrame:
    """A row for each row of docs: doc_id, text_key, node, class_id, links, and (keep_none, keep_id, keep_text) of the document that stands for the class."""
    bands, rows = bands_for(threshold, recall)
    signed = stored(signatures(docs, words, bands, rows), "jaccard-signatures")
    # Copies: one node for each set. All of it is combined before the shuffle, so a large group of copies is no burden.
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_key").alias("text"))
    nodes = stored(
        signed.filter("node is not null").groupBy("node")
        .agg(F.min("doc_id").alias("doc_id"), F.min(place).alias("place"), F.first("size").alias("size"), F.count(F.lit(1)).alias("copies"))
        .select("*", F.col("place.id").alias("first_id"), F.col("place.text").alias("text_key")),
        "jaccard-nodes",
    )
    dealt = stored(_dealt(_clusters(signed), nodes.select("node", "first_id", "text_key", "size", "copies"), block), "jaccard-clusters")
    few = dealt.agg(
        F.count(F.when(F.col("nb") == 1, 1)).alias("small"), F.sum(F.when(F.col("nb") == 1, F.col("size"))).alias("shingles"), F.count(F.when(F.col("nb") > 1, 1)).alias("large")
    ).first()
    bins = max(1, math.ceil(few["small"] / (2 * block)), math.ceil((few["shingles"] or 0) / BLOCK_SHINGLES))
    found = stored(_verified(_full_sets(docs, dealt, words), bins, threshold), "jaccard-links")
    roots = found.filter("not large").select("node", F.col("low").alias("root"))
    if few["large"]:
        # Each pair of blocks of a large cluster knows a part of the links only.
        loose = found.filter("large and node != low").select(F.col("node").alias("a"), F.col("low").alias("b"))
        roots = roots.union(components(collapsed(loose)))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.join(links, "node", "left").join(roots.distinct(), "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = named.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.min("place").alias("keep"))
    named = named.join(ids, "root").select("node", "class_id", "keep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    return signed.join(named, "node", "left").select(
        "doc_id", "text_key", "node", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("links"), F.col("keep.id").alias("keep_id"), F.col("keep.text").alias("keep_text"),
    )


def jaccard_join(docs: DataFrame, *, threshold: float = THRESHOLD, words: int = WORDS, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id, links (long): one row for each row of docs."""
    return _classes(docs, threshold, words, recall, block).select("doc_id", "class_id", "links")


def one_of_each_class(docs: DataFrame, *, threshold: float = THRESHOLD, words: int = WORDS, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """The rows of docs without near copies: of each class the one of the smallest id, then of the smallest hash of its text.

    An id may stand for several texts; each is judged by itself. A row without an id stays only where no row of its class has
    one. Rows without words all stay. Of a row that is repeated in id and text one stays.
    """
    found = _classes(docs, threshold, words, recall, block).filter("node is not null")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("text_key") == F.col("keep_text"))
    keys = [free_name(docs, k) for k in ("_id", "_none", "_text")]
    key = lambda text: dict(zip(keys, (F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("doc_id").isNull(), text), strict=True))
    fate = found.withColumns(key(F.col("text_key"))).groupBy(*keys).agg(F.max(kept.cast("int")).alias("stays"), F.count(F.lit(1)).alias("n"))
    fate = stored(fate.filter("stays = 0 or n > 1"), "jaccard-fates")
    keyed = docs.withColumns(key(F.xxhash64("text")))
    single = keyed.join(fate.select(*keys), keys, "left_anti")
    once = keyed.join(fate.filter("stays = 1").select(*keys), keys, "left_semi").dropDuplicates(keys)
    return single.select(*docs.columns).unionByName(once.select(*docs.columns))
