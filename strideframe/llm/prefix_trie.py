"""The trie of conversation prefixes, as a Cartesian tree over the LCP array of the sorted conversations.

Distinct conversations are sorted by their turns (known by hashes), which puts those that share a prefix side by side. Each has
the number of turns it shares with the one before it (LCP). In the Cartesian tree of that array, a value's subtree is the
stretch between its nearest smaller values; equal values of one stretch are one node, and its parent is the larger of the two
neighbours. Nodes in between, without a branch, are expanded from the depth of the parent to their own.

Nearest smaller values are found in parallel: blocks of max(BLOCK, sqrt(m)) of m values search inside themselves, then the
minima of the blocks (at most max(m / BLOCK, sqrt(m)) numbers) tell which block has the answer that lies outside, and that block
gives it; a block asks once for each value. Sums and minima over a node's stretch are made the same way, from the pieces of a
stretch that lie in one block each. Conversations of over SPAN turns are sorted by their first SPAN hashes and the rank of the
rest, which is found by ranks of blocks of SPAN turns, then of SPAN blocks; two long neighbours are compared turn by turn in a
join. No task holds more than a block, whatever the length of a conversation or the number of its copies.

Turns are ordered by turn (nulls first), ties by role, the first 64 characters of the text and its hash. Null roles and texts
are empty. Rows without a conversation id take no part. Turns with one hash (128 bits of MD5) count as equal. An empty table
gives an empty result, one without turns has the root alone. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, ordered_digests, stored

SPAN, BLOCK, CHAIN, IDS = 64, 4096, 4096, 4096


def symbols(turns: DataFrame) -> DataFrame:
    """conv_id, at (from 0), sym (hash of role and text), bytes (of the text): a row for each turn. Stored."""
    empty = F.lit("")
    rows = turns.filter("conv_id IS NOT NULL").select("conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    rows = rows.select(
        "conv_id", "turn", "role", F.substring("text", 1, 64).alias("begins"), F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")).alias("sym"),
        F.octet_length("text").cast("long").alias("bytes"), F.monotonically_increasing_id().alias("deal"),
    )
    placed = numbered(rows, "conv_id", F.col("turn").asc_nulls_first(), "role", "begins", "sym", "deal", name="trie-turns")
    starts = placed.groupBy("conv_id").agg(F.min("row").alias("start"))
    return stored(placed.join(starts, "conv_id").select("conv_id", (F.col("row") - F.col("start")).alias("at"), "sym", "bytes"), "trie-symbols")


def ranks(rows: DataFrame) -> DataFrame:
    """id, rank (from 1): the place of each id's sequence of (at, sym) among the distinct ones; at runs from 0."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct("at", "sym"))), lambda x: x["sym"])
    if (rows.agg(F.max("at")).first()[0] or 0) >= SPAN:
        blocks = rows.groupBy("id", F.floor(F.col("at") / SPAN).alias("block")).agg(F.transform(F.sort_array(F.collect_list(F.struct((F.col("at") % SPAN).alias("at"), "sym"))), lambda x: x["sym"]).alias("syms"))
        names = numbered(blocks.select("syms").distinct(), "syms", name="trie-names")
        named = blocks.join(names, "syms").select("id", F.col("block").alias("at"), F.lpad(F.hex("row"), 16, "0").alias("sym"))
        return ranks(stored(named, "trie-blocks"))
    sequences = rows.groupBy("id").agg(listed.alias("syms"))
    names = numbered(sequences.select("syms").distinct(), "syms", name="trie-names")
    return sequences.join(names, "syms").select("id", (F.col("row") + 1).alias("rank"))


def with_running_bytes(turns: DataFrame) -> DataFrame:
    """conv_id, at, before: the bytes of the turns ahead of each one; summed in stretches of turns, then over the stretches."""
    rows = turns.select("conv_id", "at", "bytes", F.floor(F.col("at") / BLOCK).alias("part"))
    sums = rows.groupBy("conv_id", "part").agg(F.sum("bytes").alias("whole"))
    ahead = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("conv_id", "part", F.coalesce(F.sum("whole").over(ahead), F.lit(0)).alias("base")).filter("part > 0")
    within = Window.partitionBy("conv_id", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("bytes").over(within), F.lit(0)))
    return rows.join(base, ["conv_id", "part"], "left").select("conv_id", "at", (F.col("inside") + F.coalesce("base", F.lit(0))).alias("before"), "bytes")


def nearest_smaller(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest smaller value before and behind each value of a block, -1 where there is none in it."""
    left, right = np.full(len(values), -1, dtype=np.int64), np.full(len(values), -1, dtype=np.int64)
    open_: list[int] = []
    numbers = values.tolist()
    for i, v in enumerate(numbers):
        while open_ and numbers[open_[-1]] > v:
            right[open_.pop()] = i
        if open_:
            top = open_[-1]
            left[i] = left[top] if numbers[top] == v else top
        open_.append(i)
    return left, right


class Trie:
    """Nodes of the trie of conversations (ids) whose turns are (conv_id, at, sym, bytes)."""

    def __init__(self, ids: DataFrame, turns: DataFrame) -> None:
        self.turns = stored(turns, "trie-rebuilt")
        self.bytes = with_running_bytes(self.turns)
        self.members, self.seqs = self._sorted(ids)
        self.m = self.seqs.count()
        self.block = max(BLOCK, int(np.ceil(np.sqrt(self.m))))
        self.entries = self._entries()

    def _sorted(self, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Members (conv_id, name) and the distinct conversations in order: row, syms, rest, name, w (copies), first (smallest id), len, total (bytes)."""
        opening = F.transform(F.sort_array(F.collect_list(F.when(F.col("at") < SPAN, F.struct("at", "sym")))), lambda x: x["sym"])
        convs = self.turns.groupBy("conv_id").agg(opening.alias("syms"), F.count("*").alias("len"), F.sum("bytes").alias("total"))
        long = self.turns.filter(F.col("at") >= SPAN)
        rest = ranks(long.select(F.col("conv_id").alias("id"), (F.col("at") - SPAN).alias("at"), "sym")).withColumnsRenamed({"id": "conv_id", "rank": "rest"})
        none = F.lit(0).cast("long")
        convs = ids.join(convs, "conv_id", "left").join(rest, "conv_id", "left").select(
            "conv_id", F.coalesce("syms", F.array().cast("array<string>")).alias("syms"), F.coalesce("rest", none).alias("rest"), F.coalesce("len", none).alias("len"), F.coalesce("total", none).alias("total")
        )
        convs = stored(convs.withColumn("name", F.md5(F.concat_ws(":", F.array_join("syms", ""), F.col("rest").cast("string")))), "trie-conversations")
        distinct = convs.groupBy("syms", "rest", "name", "len", "total").agg(F.count("*").alias("w"), F.min("conv_id").alias("first"))
        return convs.select("conv_id", "name"), numbered(distinct, "syms", "rest", name="trie-sequences")

    def _entries(self) -> DataFrame:
        """A row for each distinct conversation in order: shared (turns with the one before), covers (the one before is its prefix), old (bytes of what it shares). Stored."""
        b = self.seqs
        a = b.select((F.col("row") + 1).alias("row"), F.col("syms").alias("syms_a"), F.col("rest").alias("rest_a"), F.col("first").alias("first_a"), F.col("len").alias("len_a"))
        pairs = b.join(a, "row", "left")
        unlike = F.array_position(F.zip_with("syms", "syms_a", lambda x, y: F.coalesce(x == y, F.lit(False))), F.lit(False))
        shared = F.when(F.col("len_a").isNull(), 0).when(unlike > 0, unlike - 1).otherwise(F.least("len", "len_a"))
        pairs = pairs.withColumn("shared", shared.cast("long")).withColumn("deep", F.coalesce((unlike == 0) & (F.col("rest") > 0) & (F.col("rest_a") > 0), F.lit(False)))
        pairs = stored(pairs.select("row", "name", "w", "first", "len", "total", "shared", "deep", "first_a", "len_a"), "trie-neighbours")
        # Neighbours that are alike in their first SPAN turns and longer: compared turn by turn.
        deep, long = pairs.filter("deep"), self.turns.filter(F.col("at") >= SPAN)
        ours = deep.select("row", F.col("first").alias("conv_id")).join(long, "conv_id").select("row", "at", "sym")
        theirs = deep.select("row", F.col("first_a").alias("conv_id")).join(long, "conv_id").select("row", "at", F.col("sym").alias("sym_a"))
        differs = ours.join(theirs, ["row", "at"]).filter("sym != sym_a").groupBy("row").agg(F.min("at").alias("differs"))
        pairs = pairs.join(differs, "row", "left").withColumn("shared", F.when(F.col("deep"), F.coalesce("differs", F.least("len", "len_a"))).otherwise(F.col("shared")))
        ends = self.bytes.select(F.col("conv_id").alias("first"), (F.col("at") + 1).alias("shared"), (F.col("before") + F.col("bytes")).alias("old"))
        found = pairs.join(ends, ["first", "shared"], "left").select(
            "row", F.floor(F.col("row") / self.block).alias("block"), "name", "w", "first", "len", "total", "shared", F.coalesce(F.col("shared") == F.col("len_a"), F.lit(False)).alias("covers"), F.coalesce("old", F.lit(0)).alias("old")
        )
        return stored(found, "trie-entries")

    def _bounds(self) -> DataFrame:
        """row, block, shared, left and right (rows of the nearest smaller values; 0 and m where there is none), with the values there (0 at the ends), and the value behind."""
        start = F.min_by("shared", "row").alias("start")
        least = self.entries.groupBy("block").agg(F.min(F.when(F.col("row") > 0, F.col("shared"))).alias("least"), start).orderBy("block").collect()
        # At most m / block of them: see the head of this module.
        minima = np.array([np.iinfo(np.int64).max if r["least"] is None else r["least"] for r in least], dtype=np.int64)
        starts, m, size = [r["start"] for r in least], self.m, self.block

        def inside(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("row")
            block, rows, values = int(pdf["block"].iloc[0]), pdf["row"].to_numpy(), pdf["shared"].to_numpy()
            behind = np.append(values[1:], starts[block + 1] if block + 1 < len(starts) else 0)
            searched = values.copy()
            searched[rows == 0] = -1  # nothing goes on beyond the first
            left, right = nearest_smaller(searched)
            out = pd.DataFrame({"row": rows, "block": block, "shared": values, "behind": behind})
            for name, found in (("left", left), ("right", right)):
                out[name] = np.where(found >= 0, rows[found], -1)
                out[f"{name}_value"] = np.where(found >= 0, values[found], -1)
            return out[rows > 0] if len(rows) else out

        near = self.entries.select("row", "block", "shared").groupBy("block").applyInPandas(inside, "row long, block long, shared long, behind long, left long, left_value long, right long, right_value long")
        near = stored(near, "trie-near")

        def asked(batches):
            for pdf in batches:
                rows = []
                for block, value, to_left, to_right in pdf.itertuples(index=False):
                    if to_left:
                        smaller = np.flatnonzero(minima[:block] < value)
                        rows.append((block, value, "left", int(smaller[-1]) if len(smaller) else -1))
                    if to_right:
                        smaller = np.flatnonzero(minima[block + 1 :] < value)
                        rows.append((block, value, "right", block + 1 + int(smaller[0]) if len(smaller) else -1))
                yield pd.DataFrame(rows, columns=["block", "shared", "side", "target"])

        far = near.groupBy("block", "shared").agg(F.bool_or(F.col("left") < 0).alias("to_left"), F.bool_or(F.col("right") < 0).alias("to_right")).filter("to_left OR to_right")
        asks = stored(far.mapInPandas(asked, "block long, shared long, side string, target long"), "trie-asked")

        def answered(entries: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
            entries = entries[entries["row"] > 0].sort_values("row")
            rows, values, out = entries["row"].to_numpy(), entries["shared"].to_numpy(), []
            for target, value, side in asks.itertuples(index=False):
                smaller = np.flatnonzero(values < value)
                i = smaller[-1 if side == "left" else 0]
                out.append((target, value, side, int(rows[i]), int(values[i])))
            return pd.DataFrame(out, columns=["target", "shared", "side", "found", "value"])

        questions = asks.filter("target >= 0").select("target", "shared", "side").distinct()
        holding = self.entries.select("row", "block", "shared").join(questions.select(F.col("target").alias("block")).distinct(), "block", "left_semi")
        answers = holding.groupBy("block").cogroup(questions.groupBy("target")).applyInPandas(answered, "target long, shared long, side string, found long, value long")
        known = asks.join(answers, ["target", "shared", "side"], "left")
        for side, end in (("left", 0), ("right", m)):
            own = known.filter(F.col("side") == side).select("block", "shared", F.coalesce("found", F.lit(end)).alias("found"), F.coalesce("value", F.lit(0)).alias("value"))
            near = near.join(own, ["block", "shared"], "left").withColumns({side: F.when(F.col(side) < 0, F.col("found")).otherwise(F.col(side)), f"{side}_value": F.when(F.col(f"{side}_value") < 0, F.col("value")).otherwise(F.col(f"{side}_value"))}).drop("found", "value")
        return stored(near, "trie-bounds")

    def _sums(self, stretches: DataFrame) -> DataFrame:
        """lo, hi, depth with n_convs, first, n_leaves, spent (bytes of all members), made (bytes that the stretch's conversations add to the ones before)."""
        size = self.block
        cut = F.sequence(F.floor(F.col("lo") / size), F.floor(F.col("hi") / size))
        pieces = stretches.select("lo", "hi", "depth", F.explode(cut).alias("block"))

        def summed(entries: pd.DataFrame, pieces: pd.DataFrame) -> pd.DataFrame:
            if pieces.empty or entries.empty:
                return pd.DataFrame([], columns=["lo", "hi", "depth", "n", "first", "covered", "spent", "made"])
            entries = entries.sort_values("row")
            base = int(entries["row"].iloc[0])
            w, total = entries["w"].to_numpy(), entries["total"].to_numpy()
            run = lambda x: np.concatenate(([0], np.cumsum(x)))
            n, spent, made, covered = run(w), run(w * total), run(total - entries["old"].to_numpy()), run(entries["covers"].to_numpy().astype(np.int64))
            # Least ids of stretches of 1, 2, 4 ... entries.
            least = [entries["first"].to_numpy()]
            while 2 ** len(least) <= len(entries):
                half = 2 ** (len(least) - 1)
                least.append(np.minimum(least[-1][:-half], least[-1][half:]))
            lo, hi = pieces["lo"].to_numpy(), pieces["hi"].to_numpy()
            a, b = np.maximum(lo - base, 0), np.minimum(hi - base, len(entries) - 1) + 1
            level = np.frexp(b - a)[1] - 1
            first = np.array([min(least[k][i], least[k][j - 2**k]) for k, i, j in zip(level.tolist(), a.tolist(), b.tolist(), strict=True)], dtype=np.int64)
            out = pieces[["lo", "hi", "depth"]].copy()
            # The first conversation of a stretch goes on from one outside it.
            outside = np.where(lo >= base, 1, 0)
            out["n"], out["first"], out["covered"] = n[b] - n[a], first, covered[b] - covered[a + outside]
            out["spent"], out["made"] = spent[b] - spent[a], made[b] - made[a]
            return out

        kinds = "lo long, hi long, depth long, n long, first long, covered long, spent long, made long"
        entries = self.entries.select("block", "row", "w", "first", "total", "old", "covers")
        parts = entries.groupBy("block").cogroup(pieces.groupBy("block")).applyInPandas(summed, kinds)
        sums = parts.groupBy("lo", "hi", "depth").agg(F.sum("n").alias("n_convs"), F.min("first").alias("first"), F.sum("covered").alias("covered"), F.sum("spent").alias("spent"), F.sum("made").alias("made"))
        return sums.withColumn("n_leaves", F.col("hi") - F.col("lo") + 1 - F.col("covered")).drop("covered")

    def _owners(self, bounds: DataFrame, inner: DataFrame) -> DataFrame:
        """row, parent: the smallest member of the node that a boundary belongs to; joined by block, so that a node of many boundaries is no hot key."""
        size = self.block
        placed = inner.select("lo", "hi", "depth", F.col("first").alias("parent"), F.explode(F.sequence(F.floor(F.col("lo") / size), F.floor(F.col("hi") / size))).alias("block"))
        return bounds.select("row", "block", "lo", "hi", "depth").join(placed, ["block", "lo", "hi", "depth"]).select("row", "parent")

    def nodes(self) -> DataFrame:
        """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, lo (place of the node's first conversation), ends_here."""
        if not self.m:
            return self.turns.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, lo long, ends_here boolean")
        near = self._bounds()
        bounds = near.select("row", "block", F.col("shared").alias("depth"), F.col("left").alias("lo"), (F.col("right") - 1).alias("hi"), F.greatest("left_value", "right_value", F.lit(0)).alias("up"), F.when(F.col("left_value") >= F.col("right_value"), F.col("left")).otherwise(F.col("right")).alias("up_row"))
        bounds = stored(bounds.filter("depth > 0"), "trie-boundaries")
        # Equal values of one stretch are one node.
        merged = bounds.groupBy("lo", "hi", "depth").agg(F.count("*").alias("cuts"), F.max("up").alias("up"), F.max("up_row").alias("up_row"))
        inner = merged.join(self._sums(merged.select("lo", "hi", "depth")), ["lo", "hi", "depth"])
        inner = stored(inner, "trie-inner")
        # Conversations whose end no other shares.
        after = near.select("row", "behind").unionByName(self.entries.filter("row = 0").select("row", F.lit(None).cast("long").alias("behind")))
        second = self.entries.filter("row = 1").agg(F.max("shared")).first()[0] or 0
        single = self.entries.join(after, "row").withColumn("behind", F.coalesce("behind", F.lit(second)))
        single = single.withColumn("up", F.greatest("shared", "behind")).filter("len > up").select(
            F.col("row").alias("lo"), F.col("row").alias("hi"), F.col("len").alias("depth"), "up", F.when(F.col("shared") >= F.col("behind"), F.col("row")).otherwise(F.col("row") + 1).alias("up_row"),
            F.lit(-1).cast("long").alias("cuts"), F.col("w").alias("n_convs"), "first", F.lit(1).cast("long").alias("n_leaves"), (F.col("w") * F.col("total")).alias("spent"), (F.col("total") - F.col("old")).alias("made"),
        )
        whole = self.entries.agg(F.sum("w").alias("n"), F.min("first").alias("first"), F.sum(F.col("w") * F.col("total")).alias("spent"), F.sum(F.col("total") - F.col("old")).alias("made"), F.sum(F.col("covers").cast("long")).alias("covered"), F.sum(((F.col("shared") == 0) & (F.col("row") > 0)).cast("long")).alias("cuts"), F.min("len").alias("shortest")).first()
        compressed = inner.unionByName(single).join(self._owners(bounds, inner).withColumnRenamed("row", "up_row"), "up_row", "left")
        compressed = compressed.withColumn("parent", F.when(F.col("up") == 0, F.lit(whole["first"])).otherwise(F.col("parent")))
        lead = self.entries.select(F.col("row").alias("lo"), F.col("first").alias("lead"), F.col("len").alias("lead_len"), F.col("old").alias("lead_old"))
        compressed = stored(compressed.join(lead, "lo"), "trie-compressed")
        # Missing depths, in two steps so that no list is longer than a stretch of a chain.
        last = F.floor((F.col("depth") - F.col("up") - 1) / CHAIN)
        chains = compressed.withColumn("link", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        from_, to = F.col("up") + 1 + F.col("link") * CHAIN, F.least(F.col("depth"), F.col("up") + (F.col("link") + 1) * CHAIN)
        each = chains.withColumn("e", F.explode(F.sequence(from_, to)))
        before = self.bytes.select(F.col("conv_id").alias("lead"), (F.col("at") + 1).alias("e"), "before")
        each = each.join(before, ["lead", "e"])
        ends = F.col("lead_len") == F.col("e")
        children = F.when(F.col("e") < F.col("depth"), 1).otherwise(F.col("cuts") + 1 - (ends & (F.col("cuts") >= 0)).cast("long"))
        nodes = each.select(
            F.col("first").alias("conv_id"), F.col("e").alias("depth"), F.when(F.col("e") == F.col("up") + 1, F.col("parent")).otherwise(F.col("first")).alias("parent_conv_id"), "n_convs", children.cast("long").alias("n_children"), "n_leaves",
            (F.col("spent") - F.col("n_convs") * F.col("before") - F.col("made") - F.col("lead_old") + F.col("before")).alias("saved_tokens"), "lo", ends.alias("ends_here"),
        )
        kids = whole["cuts"] + 1 - (whole["shortest"] == 0)
        root = self.turns.sparkSession.createDataFrame(
            [(whole["first"], 0, None, whole["n"], kids, self.m - whole["covered"], whole["spent"] - whole["made"], 0, whole["shortest"] == 0)],
            "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, lo long, ends_here boolean",
        )
        return nodes.unionByName(root)

    def end_digests(self) -> DataFrame:
        """lo, ends_sha256: of the ids of each distinct conversation's members, ascending, joined by commas."""
        placed = numbered(self.members, "name", "conv_id", name="trie-members")
        ids = F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string"))
        pieces = placed.groupBy("name", F.floor(F.col("row") / IDS).alias("part")).agg(F.array_join(ids, ",").alias("piece"))
        pieces = stored(pieces, "trie-pieces")
        parts = pieces.groupBy("name").agg(F.count("*").alias("n"), F.first("piece").alias("piece"))
        several = pieces.join(parts.filter("n > 1").select("name"), "name")
        digests = parts.filter("n = 1").select("name", F.sha2("piece", 256).alias("sha256")).unionByName(ordered_digests(several, "name", "part", "piece", ","))
        return self.entries.select(F.col("row").alias("lo"), "name").join(digests, "name").select("lo", F.col("sha256").alias("ends_sha256"))


def trie(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """A row for each node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ids: every conversation once; turns: conv_id, at (from 0 without gaps), sym, bytes.
    """
    made = Trie(ids, turns)
    nodes, nobody = made.nodes(), F.sha2(F.lit(""), 256)
    # Most nodes end somewhere below: only those where a conversation ends look for its members.
    ending = nodes.filter("ends_here").join(made.end_digests(), "lo", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", nobody))
    passing = nodes.filter("NOT ends_here").withColumn("ends_sha256", nobody)
    return ending.unionByName(passing, allowMissingColumns=True).drop("lo", "ends_here")
