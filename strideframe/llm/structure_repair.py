"""Conversation structure repair by error-correcting Earley parsing.

A well-formed conversation is empty, or an optional system turn and pairs of a user's and an assistant's turn. The grammar is
left-linear, so every chart item starts at the first turn and a chart column has a handful of items, however long the
conversation. Each terminal can be read in four ways: kept, re-roled (user or assistant), preceded by deleted turns, or
inserted; an item keeps its least (cost, audit), where the audit names the edits in order and ties go to the smaller text.
Two audits of one cost over the same turns never begin one another (they would differ by insertions, which cost), so the least
of a prefix stays the least of the whole.

Turns are numbered by a range sort and cut into segments of at most SEGMENT turns. A segment is parsed from the beginning of
a conversation, or from each item that may stand at its border; tables of (item in, item out) are then joined up in groups of
FAN_IN until one is left for a conversation. So a conversation of any length is parsed in bounded pieces. Only codes of turns
(role initial and fault, one letter) go to Python for that; equal code strings are parsed once a task.

Order of turns: by turn (nulls first), ties by role, the first 64 characters of the text and its hash; rows that are equal in
all of them are copies. Faults: blank (only white space), duplicate (an earlier turn has its role and text), truncated (the
last character that is not white space is none of . ! ?); the first that holds counts. Null roles and texts are one space.
A null conversation id is a conversation of its own. A role whose first letter is none of s, u, a (an empty role too) can't
be kept. Extra columns are not read; an empty table gives empty results.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache, partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, ordered_digests, stored

SPACE = r"\x20\x09-\x0D"
SEGMENT, FAN_IN = 512, 64

# The grammar of roles and the costs of edits.
START = "conversation"
PRODUCTIONS = (
    (START, ()), (START, ("pairs",)),
    ("pairs", ("asked", "a")), ("asked", ("u",)), ("asked", ("system", "u")), ("asked", ("pairs", "u")), ("system", ("s",)),
)
TERMINALS = {"s", "u", "a"}
ROLES = {"u": "user", "a": "assistant"}
DELETE, REROLE, INSERT, CUT_SHORT = 2, 1, 5, 5

#: Codes of a turn: its role's initial as it is, in capitals where truncated, as a digit where it has to go.
INITIALS, OTHER = "sua", "x"
CODE = {c: (c, False, False) for c in INITIALS + OTHER} | {c.upper(): (c, True, False) for c in INITIALS + OTHER} | {d: (c, False, True) for c, d in zip(INITIALS + OTHER, "1230", strict=True)}

Item = tuple[int, int]
Value = tuple[int, str]
ITEMS: list[Item] = [(p, dot) for p, (_, body) in enumerate(PRODUCTIONS) for dot in range(len(body) + 1)]
INDEX = {item: i for i, item in enumerate(ITEMS)}


def next_symbol(item: Item) -> str | None:
    body = PRODUCTIONS[item[0]][1]
    return body[item[1]] if item[1] < len(body) else None


def is_final(item: Item) -> bool:
    return PRODUCTIONS[item[0]][0] == START and next_symbol(item) is None


#: What a chart may hold between two turns that later turns can go on from; other items follow from these.
BORDER = [item for item in ITEMS if next_symbol(item) in TERMINALS or is_final(item)]
#: Stands for the beginning of a conversation in the tables of segments.
BEGIN = -1


def predicted() -> dict[Item, Value]:
    """The first column: what may stand at the beginning, before any completion."""
    return {(p, 0): (0, "") for p, (_, body) in enumerate(PRODUCTIONS) if not body or body[0] in TERMINALS}


def closed(column: dict[Item, Value]) -> dict[Item, Value]:
    """Complete items and insert terminals, cheapest first."""
    agenda = [(value, item) for item, value in column.items()]
    heapq.heapify(agenda)
    best: dict[Item, Value] = {}
    while agenda:
        value, item = heapq.heappop(agenda)
        if item in best:
            continue
        best[item] = value
        symbol = next_symbol(item)
        if symbol is None:
            head = PRODUCTIONS[item[0]][0]
            for p, (_, body) in enumerate(PRODUCTIONS):
                if body and body[0] == head:
                    heapq.heappush(agenda, (value, (p, 1)))
        elif symbol in ROLES:
            heapq.heappush(agenda, ((value[0] + INSERT, value[1] + "I"), (item[0], item[1] + 1)))
    return best


def scanned(column: dict[Item, Value], code: str) -> dict[Item, Value]:
    """The next column after a turn: deleted, kept or re-roled."""
    initial, short, doomed = CODE[code]
    out: dict[Item, Value] = {}

    def reach(item: Item, cost: int, audit: str) -> None:
        if item not in out or (cost, audit) < out[item]:
            out[item] = (cost, audit)

    for item, (cost, audit) in column.items():
        reach(item, cost + DELETE, audit + "D")
        symbol = next_symbol(item)
        if doomed or symbol is None or symbol not in TERMINALS:
            continue
        after, cost = (item[0], item[1] + 1), cost + CUT_SHORT * short
        if symbol == initial:
            reach(after, cost, audit + "K")
        if symbol in ROLES:
            reach(after, cost + REROLE, audit + "R")
    return out


@lru_cache(maxsize=20_000)
def parsed(codes: str, begins: bool) -> tuple[tuple[int, int, int, str], ...]:
    """(item in, item out, cost, audit) of a segment; from the beginning only where it begins a conversation."""
    rows = []
    for enter in [None] if begins else BORDER:
        column = closed(predicted() if enter is None else {enter: (0, "")})
        for code in codes:
            column = closed(scanned(column, code))
        rows += [(BEGIN if enter is None else INDEX[enter], INDEX[item], *column[item]) for item in BORDER if item in column]
    return tuple(rows)


def joined_up(first: list[tuple], second: list[tuple]) -> list[tuple]:
    """The table of two adjoining segments."""
    onward: dict[int, list[tuple]] = {}
    for row in second:
        onward.setdefault(row[0], []).append(row)
    best: dict[tuple[int, int], Value] = {}
    for enter, between, cost, audit in first:
        for _, leave, more, rest in onward.get(between, []):
            value = (cost + more, audit + rest)
            if (enter, leave) not in best or value < best[enter, leave]:
                best[enter, leave] = value
    return [(*ends, *value) for ends, value in best.items()]


def unlike(codes: str) -> int:
    """Adjacent turns whose initials don't follow one another."""
    letters = "".join(CODE[c][0] for c in codes)
    return sum(letters[i : i + 2] not in ("su", "ua", "au") for i in range(len(letters) - 1))


TABLE = "id string, part long, n_parts long, enter array<int>, leave array<int>, cost array<long>, audit array<string>, illegal long, ends string"


def as_row(key: str, part: int, n_parts: int, table: list[tuple], illegal: int, ends: str) -> tuple:
    enter, leave, cost, audit = (list(x) for x in zip(*table, strict=True))
    return key, part, n_parts, enter, leave, cost, audit, illegal, ends


def frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in TABLE.split(", ")])


def parse_segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield frame([as_row(r.id, r.part, r.n_parts, list(parsed(r.codes, r.part == 0)), unlike(r.codes), r.codes[0] + r.codes[-1]) for r in pdf.itertuples()])


def join_segments(pdf: pd.DataFrame, fan_in: int) -> pd.DataFrame:
    """At most fan_in adjoining tables of one conversation."""
    pdf = pdf.sort_values("part")
    table, illegal, ends = None, 0, ""
    for r in pdf.itertuples():
        own = list(zip(r.enter, r.leave, r.cost, r.audit, strict=True))
        illegal += r.illegal + (unlike(ends[-1] + r.ends[0]) if table is not None else 0)
        table, ends = (own, r.ends) if table is None else (joined_up(table, own), ends[0] + r.ends[-1])
    return frame([as_row(pdf["id"].iloc[0], int(pdf["part"].iloc[0]) // fan_in, -(-int(pdf["n_parts"].iloc[0]) // fan_in), table, illegal, ends)])


def cheapest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for r in pdf.itertuples():
            cost, audit = min((c, a) for leave, c, a in zip(r.leave, r.cost, r.audit, strict=True) if is_final(ITEMS[leave]))
            rows.append((r.id, int(r.illegal), int(cost), audit))
        yield pd.DataFrame(rows, columns=["id", "illegal", "cost", "audit"])


SLICE = "id string, block long, n_blocks long, at long, edits array<struct<edit:string,place:int,role:string>>"


def slices_of(start: int, n_turns: int, audit: str, segment: int) -> Iterator[tuple]:
    """(block, n_blocks, at, edits): the turns that stay of each segment, with the place in the segment of a kept turn and the role it gets if not its own."""
    block, last = start // segment, (start + n_turns - 1) // segment
    n_blocks = last - block + 1
    # An odd number of turns begins with a system turn; from there on users and assistants take turns.
    shift = (len(audit) - audit.count("D")) % 2
    edits, at, filled, place, room = [], 0, 0, 0, segment - start % segment
    for edit in audit:
        if place == room and block < last:
            yield block, n_blocks, at, edits
            edits, at, place, room, block = [], filled, 0, segment, block + 1
        if edit != "D":
            edits.append({"edit": edit, "place": None if edit == "I" else place, "role": None if edit == "K" else ROLES["ua"[(filled - shift) % 2]]})
            filled += 1
        place += edit != "I"
    yield block, n_blocks, at, edits


def sliced(batches: Iterator[pd.DataFrame], segment: int) -> Iterator[pd.DataFrame]:
    """Audits cut where their conversations were, some slices at a time."""
    columns = [c.split()[0] for c in ("id", "block", "n_blocks", "at", "edits")]
    for pdf in batches:
        rows = []
        for r in pdf.itertuples():
            for s in slices_of(r.start, r.n_turns, r.audit, segment):
                rows.append((r.id, *s))
                if len(rows) >= 2000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
        yield pd.DataFrame(rows, columns=columns)


def fault(text: Column, repeated: Column) -> Column:
    return F.when(~text.rlike(f"[^{SPACE}]"), "blank").when(repeated, "duplicate").when(~text.rlike(rf"[.!?][{SPACE}]*\z"), "truncated")


class Repair:
    """The repair of a table of turns (conv_id, turn, role, text).

    report: a row for each conversation: conv_id, id, gaps, blank, duplicate, truncated, illegal, cost, audit, start, n_turns.
    turns(): the repaired conversations, a row for each turn with the edit that made it.
    digests(): sha256 of each repaired conversation's `role:text`, joined by newlines.
    """

    def __init__(self, turns: DataFrame, *, segment: int = SEGMENT, fan_in: int = FAN_IN) -> None:
        self.segment, self.fan_in = segment, fan_in
        space = F.lit(" ")
        key = F.when(F.col("conv_id").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))
        rows = turns.select(key.alias("id"), "conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
        rows = rows.withColumn("hash", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
        # The last key only deals equal rows out to several parts.
        order = ["id", F.col("turn").asc_nulls_first(), "role", F.substring("text", 1, 64), "hash", F.monotonically_increasing_id()]
        self.rows = numbered(rows, *order, name="repair-turns").withColumn("block", F.floor(F.col("row") / segment))
        repeats = self.rows.groupBy("id", "hash").agg(F.min("row").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
        initial = F.substring("role", 1, 1)
        coded = self.rows.join(repeats, ["id", "hash"], "left").withColumn("fault", fault(F.col("text"), F.col("row") > F.col("first")))
        letter = F.when(initial.isin(*INITIALS), initial).otherwise(F.lit(OTHER))
        code = F.when(F.col("fault") == "truncated", F.upper(letter)).when(F.col("fault").isNull(), letter).otherwise(F.translate(letter, INITIALS + OTHER, "1230"))
        self.coded = stored(coded.select("id", "conv_id", "turn", "row", "block", "fault", code.alias("code")), "repair-codes")
        self.report = stored(self._report(), "repair-report")

    def _report(self) -> DataFrame:
        count = lambda kind: F.sum((F.col("fault") == kind).cast("long"))
        whole = self.coded.groupBy("id").agg(
            F.first("conv_id").alias("conv_id"), (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"), *[F.coalesce(count(k), F.lit(0)).alias(k) for k in ("blank", "duplicate", "truncated")],
            F.min("row").alias("start"), F.count("*").alias("n_turns"), F.min("block").alias("first_block"), F.max("block").alias("last_block"),
        ).withColumn("gaps", F.coalesce(F.col("gaps").cast("long"), F.lit(0)))
        whole = stored(whole, "repair-counts")
        turns = F.transform(F.sort_array(F.collect_list(F.struct("row", "code"))), lambda x: x["code"])
        segments = self.coded.groupBy("id", "block").agg(F.array_join(turns, "").alias("codes"))
        placed = segments.join(whole.select("id", "first_block", "last_block"), "id")
        placed = placed.select("id", (F.col("block") - F.col("first_block")).alias("part"), (F.col("last_block") - F.col("first_block") + 1).alias("n_parts"), "codes")
        tables = stored(placed.mapInPandas(parse_segments, TABLE), "repair-segments")
        fan_in, one, many = self.fan_in, tables.filter("n_parts = 1"), tables.filter("n_parts > 1")
        longest = whole.agg(F.max(F.col("last_block") - F.col("first_block") + 1)).first()[0] or 1
        while longest > 1:
            joined = many.groupBy("id", F.floor(F.col("part") / self.fan_in)).applyInPandas(lambda pdf: join_segments(pdf, fan_in), TABLE)
            many, longest = stored(joined, "repair-joined"), -(-longest // fan_in)
        best = one.unionByName(many).mapInPandas(cheapest, "id string, illegal long, cost long, audit string")
        return whole.drop("first_block", "last_block").join(best, "id")

    def _segments(self) -> DataFrame:
        """id, block, n_blocks, at, turns: the repaired turns of each segment."""
        slices = self.report.select("id", "start", "n_turns", "audit").mapInPandas(partial(sliced, segment=self.segment), SLICE)
        rows = self.rows.groupBy("id", "block").agg(F.sort_array(F.collect_list(F.struct("row", "role", "text"))).alias("rows"))
        own = lambda e: F.get("rows", e["place"])
        turn = lambda e: F.struct(e["edit"].alias("edit"), F.coalesce(e["role"], own(e)["role"]).alias("role"), F.coalesce(own(e)["text"], F.lit("")).alias("text"))
        return slices.join(rows, ["id", "block"]).select("id", "block", "n_blocks", "at", F.transform("edits", turn).alias("turns"))

    def turns(self) -> DataFrame:
        """id, place (from 0), edit (K, R or I), role, text."""
        return self._segments().select("id", "at", F.posexplode("turns").alias("i", "t")).select("id", (F.col("at") + F.col("i")).alias("place"), "t.*")

    def digests(self) -> DataFrame:
        """id, sha256. A conversation of one segment is hashed where it is; longer ones pass a task segment by segment."""
        lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
        pieces = stored(self._segments().filter(F.size("turns") > 0).select("id", "block", "n_blocks", lines.alias("piece")), "repair-pieces")
        return pieces.filter("n_blocks = 1").select("id", F.sha2("piece", 256).alias("sha256")).unionByName(ordered_digests(pieces.filter("n_blocks > 1"), "id", "block", "piece", "\n"))
