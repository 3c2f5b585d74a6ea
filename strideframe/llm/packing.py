"""Variable-capacity best-fit packing of documents into training sequences.

A document's length is its number of words plus one end mark, or a number of tokens that is given. Documents longer than the largest permitted sequence are cut
into pieces; full pieces are sequences of their own. All other pieces are dealt by a hash of their id into shards of
bounded size, and each shard is packed by itself: longest piece first, into the open bin that it fills best. When none
fits, a bin of the least cost a token is opened, judged by what the shorter pieces still to come can fill; one size floor
for each permitted length is tried as well, and the cheapest whole packing of the shard is kept. In the end every bin takes
the smallest permitted capacity that holds its contents. The cost of a bin is its capacity plus a fixed overhead.

Edge cases: null and wordless texts have length 1 (the end mark). Repeated rows are packed as often as they occur. Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_text, id_type, stored

CAPACITIES = (512, 1024, 2048, 4096)
OVERHEAD = 32
SHARD_PIECES = 20_000


def length_of(text: str = "text") -> Column:
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    return F.size(words).cast("long") + 1


def best_fit(lengths: list[int], capacities: tuple[int, ...], overhead: int, floor: int | None) -> tuple[list[int], list[int], int]:
    """Bin of each piece (lengths fall), capacity of each bin, total cost. floor: least capacity that is opened, None: the least cost a token."""
    caps = sorted(capacities)
    after = np.concatenate((np.cumsum(np.array(lengths, dtype=np.int64)[::-1])[::-1], [0]))  # words from a piece on
    rising = [-x for x in lengths]
    open_at: dict[int, list[int]] = {}
    residuals: list[int] = []
    where, filled, size = [], [], []
    for i, n in enumerate(lengths):
        k = bisect_left(residuals, n)
        if k < len(residuals):
            left = residuals[k]
            b = open_at[left].pop()
            if not open_at[left]:
                del open_at[left], residuals[k]
        else:
            fit = [c for c in caps if c >= n]
            if floor is None:
                # What can still come into a bin of capacity c: all later pieces that fit beside this one.
                pick = min(fit, key=lambda c: ((c + overhead) / min(c, n + after[max(i + 1, bisect_left(rising, n - c))]), c))
            else:
                pick = max(floor, fit[0])
            b, left = len(filled), pick
            filled.append(0)
            size.append(pick)
        filled[b] += n
        left -= n
        where.append(b)
        if left:
            if left not in open_at:
                insort(residuals, left)
                open_at[left] = []
            open_at[left].append(b)
    size = [caps[bisect_left(caps, f)] for f in filled]
    return where, size, sum(size) + overhead * len(size)


def pack_shard(pdf: pd.DataFrame, capacities: tuple[int, ...], overhead: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    lengths = pdf["length"].astype(int).tolist()
    where, size, _ = min((best_fit(lengths, capacities, overhead, f) for f in (None, *sorted(capacities))), key=lambda x: x[2])
    where = np.array(where, dtype=np.int64)
    pdf["capacity"] = np.array(size, dtype=np.int64)[where]
    pdf["position"] = pdf.groupby(where)["length"].cumsum() - pdf["length"]
    pdf["bin_id"] = pdf["shard"].to_numpy() * (1 << 24) + where
    return pdf[["doc_id", "piece", "start", "length", "bin_id", "position", "capacity"]]


def pack(docs: DataFrame, *, length: Column | None = None, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """doc_id, piece (from 0), start (in the document), length, bin_id, position (in the bin), capacity; a row for each piece.

    length counts a document's tokens with its end mark; its words and one if it is not given.
    """
    top = max(capacities)
    sized = stored(docs.select("doc_id", (length_of() if length is None else F.greatest(length.cast("long"), F.lit(1))).alias("n")), "packing-lengths")
    total = sized.agg(F.sum(F.ceil(F.col("n") / top))).first()[0] or 0
    shards = max(1, -(-int(total) // shard_pieces))
    pieces = (
        sized.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / top) - 1)).alias("piece"), F.monotonically_increasing_id().alias("row"))
        .select("doc_id", "piece", (F.col("piece") * top).alias("start"), F.least(F.lit(top).cast("long"), F.col("n") - F.col("piece") * top).alias("length"), "row")
    )
    # Full pieces fill a bin each; negative ids keep their bins apart from those of the shards.
    whole = pieces.filter(F.col("length") == top).select(
        "doc_id", "piece", "start", "length", (-1 - F.monotonically_increasing_id()).alias("bin_id"), F.lit(0).cast("long").alias("position"), F.lit(top).cast("long").alias("capacity")
    )
    rest = pieces.filter(F.col("length") < top).withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "row"), F.lit(shards)))
    packed = rest.select(as_text(), "piece", "start", "length", "shard").groupBy("shard").applyInPandas(
        lambda pdf: pack_shard(pdf, capacities, overhead), "doc_id string, piece long, start long, length long, bin_id long, position long, capacity long"
    )
    return packed.withColumn("doc_id", F.col("doc_id").cast(id_type(docs))).unionByName(whole)


def sequences(tokens: DataFrame, *, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """bin_id, capacity, doc_ids, ids: the packed sequences themselves, from (doc_id, ids); doc_ids are those of a bin's pieces in order.

    Rows are packed under a key of their own, so repeated and null ids stay apart. Rows without token ids take no part.
    """
    rows = stored(tokens.filter(F.size("ids") > 0).select("doc_id", "ids", F.monotonically_increasing_id().alias("row")), "packing-rows")
    sized = rows.select(F.col("row").alias("doc_id"), F.size("ids").alias("n_ids"))
    packed = pack(sized, length=F.col("n_ids"), capacities=capacities, overhead=overhead, shard_pieces=shard_pieces).withColumnRenamed("doc_id", "row")
    pieces = packed.join(rows, "row").select(
        "bin_id", "capacity", "position", "doc_id", F.slice("ids", (F.col("start") + 1).cast("int"), F.col("length").cast("int")).alias("part")
    )
    # A bin holds at most its capacity of ids, whatever the number of documents.
    parts = F.sort_array(F.collect_list(F.struct("position", "doc_id", "part")))
    bins = pieces.groupBy("bin_id", "capacity").agg(parts.alias("parts"))
    return bins.select("bin_id", "capacity", F.transform("parts", lambda x: x["doc_id"]).alias("doc_ids"), F.flatten(F.transform("parts", lambda x: x["part"])).alias("ids"))
