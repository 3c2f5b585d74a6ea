"""I-Match, structure repair and the prefix trie against brute force, with edge cases; packed ids, equal vectors, schemes."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

pytest.importorskip("strideframe.llm")
from strideframe.llm import common, imatch, packing, prefix_trie, structure_repair, topk  # noqa: E402
from strideframe.llm.queries import damaged  # noqa: E402

CLASH = ["block", "pos", "spare", "row", "term", "mask", "id", "code", "fault", "sym", "at", "deal", "bytes", "hash", "h", "key"]


def cluttered(df):
    return df.withColumns({c: F.lit("x") for c in CLASH if c not in df.columns})


def md5(s):
    return hashlib.md5(s.encode()).hexdigest()


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# ---- I-Match


def terms(text):
    return {w for w in re.split(r"[^\w]+|_", text.lower()) if w}


def brute_imatch(rows):
    n = len(rows)
    df = Counter(t for _, text in rows for t in terms(text or ""))
    low, high = max(2, -(-n // imatch.RAREST)), n // imatch.COMMONEST
    rates = imatch.rates()
    member = {t: [int(md5(f"{k}:{t}")[:5], 16) % r == 0 for k, r in enumerate(rates)] for t, c in df.items() if low <= c <= high}

    def fingerprint(text):
        own = sorted(terms(text))
        kept = [" ".join(t for t in own if t in member and member[t][k]) for k in range(len(rates))]
        out = [md5(s)[:8] if s else imatch.EMPTY for s in kept]
        return out if any(x != imatch.EMPTY for x in out) else [md5(text)[:8], *[imatch.EMPTY] * (len(rates) - 1)]

    def near(a, b):
        held = [(x, y) for x, y in zip(a, b, strict=True) if x != imatch.EMPTY or y != imatch.EMPTY]
        return 1.0 if a == b else sum(x == y for x, y in held) / len(held)

    order = sorted(rows, key=lambda r: (r[0] is not None, r[0]), reverse=True)
    for i, (key, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % n][1] or ""
        cut = len(text) // 2
        edited = text[: len(text) - cut] + after[:cut]
        a, b, c = fingerprint(text), fingerprint(edited), fingerprint(after)
        yield key, len(text), sha(edited), "".join(a), "".join(b), round(near(a, b), 9), round(near(a, c), 9)


def imatch_rows(df):
    return sorted(((r[0], r[1], r[2], r[3], r[4], round(r[5], 9), round(r[6], 9)) for r in imatch.edited_and_next(df).collect()), key=repr)


def test_imatch(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice([f"w{rng.randrange(150)}", f"É{rng.randrange(30)}", "the,", "x-y"]) for _ in range(rng.choice([1, 20, 200])))) for i in range(0, 240, 2)]
    rows += [(1, None), (3, ""), (5, "  \n"), (7, "🙂🙂🙂 odd 𝒳"), (9, "w1 " * 30_000), (None, "w1 w2 w3 w4 w5"), (301, rows[4][1]), (303, rows[4][1])]
    df = cluttered(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    got = imatch_rows(df)
    assert got == sorted(brute_imatch(rows), key=repr)
    prints = {r[0]: r[3] for r in got}
    assert prints[301] == prints[303] == prints[8]


def test_imatch_small_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert imatch.edited_and_next(make([])).count() == 0
    assert imatch_rows(make([(4, "one two")])) == sorted(brute_imatch([(4, "one two")]), key=repr)
    # Rows equal in id and text follow one another.
    assert [r[6] for r in imatch_rows(make([(4, "one two")] * 3))] == [1.0] * 3
    assert len(imatch_rows(make([(4, "one two"), (4, "three"), (None, None), (None, "x")]))) == 4


# ---- structure repair


def turn_faults(rows):
    seen, out = set(), []
    for role, text in rows:
        kind = None
        stripped = text.rstrip(" \t\n\v\f\r")
        if not stripped:
            kind = "blank"
        elif (role, text) in seen:
            kind = "duplicate"
        elif stripped[-1] not in ".!?":
            kind = "truncated"
        seen.add((role, text))
        out.append(kind)
    return out


def brute_repair(rows, most_inserts=3):
    """The cheapest edits by trying all of them: keep, re-role or delete each turn, with insertions between."""
    faults, best = turn_faults(rows), None
    for n_in in range(most_inserts + 1):
        for spots in itertools.combinations_with_replacement(range(len(rows) + 1), n_in):
            for ops in itertools.product("KRD", repeat=len(rows)):
                if any(op != "D" and f in ("blank", "duplicate") for op, f in zip(ops, faults, strict=True)):
                    continue
                cost = 5 * n_in + sum({"K": 0, "R": 1, "D": 2}[op] + 5 * (f == "truncated" and op != "D") for op, f in zip(ops, faults, strict=True))
                # Roles are forced by place: s first if the number is odd, then u and a in turn.
                plan = []
                for i in range(len(rows) + 1):
                    plan += [("I", None)] * spots.count(i)
                    if i < len(rows):
                        plan.append((ops[i], rows[i]))
                stay = [p for p in plan if p[0] != "D"]
                want = ("s" if len(stay) % 2 else "") + "ua" * (len(stay) // 2)
                if any((op == "K" and row[0][:1] != w) or (op in "RI" and w == "s") for (op, row), w in zip(stay, want, strict=True)) or want == "s":
                    continue
                audit = "".join(op for op, _ in plan)
                full = {"u": "user", "a": "assistant"}
                lines = [f"{row[0] if op == 'K' else full[w]}:{row[1] if row else ''}" for (op, row), w in zip(stay, want, strict=True)]
                if best is None or (cost, audit) < best[:2]:
                    best = (cost, audit, sha("\n".join(lines)))
    return best


def repaired(repair):
    found = repair.report.join(repair.digests(), "id", "left").collect()
    return {r["conv_id"]: r.asDict() for r in found}


def random_conversations(rng, n, longest):
    for c in range(n):
        for t in range(rng.randrange(1, longest + 1)):
            text = rng.choice(["Yes.", "No!", f"Word {rng.randrange(3)}?", "cut off", " \t", "Ends. \n", ""])
            yield c, rng.choice([t, t, t + 1]), rng.choice(["user", "assistant", "system", "tool"]), text


def test_repair(spark):
    rows = list(random_conversations(random.Random(1), 60, 5))
    rows += [(None, 0, "user", "Hi."), (None, None, None, None), (-3, None, "user", "Hi."), (-3, None, "user", "Hi."), (-4, 1, "", "Empty role."), (-5, 0, "user", "Long. " * 30_000), (-5, 9, "assistant", "Yes.")]
    df = cluttered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3))
    got = repaired(structure_repair.Repair(df))
    by_conv = defaultdict(list)
    for c, t, role, text in rows:
        by_conv[c].append((t is not None, t or 0, " " if role is None else role, " " if text is None else text))
    assert got.keys() == by_conv.keys()
    for c, turns in by_conv.items():
        turns = sorted(turns)
        ordered = [(role, text) for *_, role, text in turns]
        faults, known = turn_faults(ordered), [t for has, t, *_ in turns if has]
        assert {k: got[c][k] for k in ("blank", "duplicate", "truncated")} == {k: faults.count(k) for k in ("blank", "duplicate", "truncated")}
        assert got[c]["gaps"] == (max(known) - min(known) + 1 - len(set(known)) if known else 0)
        assert got[c]["illegal"] == sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(ordered))
        cost, audit, digest = brute_repair(ordered)
        assert (got[c]["cost"], got[c]["audit"], got[c]["sha256"] or sha("")) == (cost, audit, digest), (c, ordered)


def test_repair_by_segments(spark):
    """Conversations over several segments and several rounds of joining come out as in one."""
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), f"{rng.randrange(40)}" + rng.choice([".", ".", ""])) for c in range(4) for t in range(rng.choice([3, 40, 90]))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole, cut = structure_repair.Repair(df), structure_repair.Repair(df, segment=4, fan_in=3)
    keep = lambda r: {k: v for k, v in r.items() if k not in ("start", "id")}
    assert {k: keep(v) for k, v in repaired(cut).items()} == {k: keep(v) for k, v in repaired(whole).items()}
    turns = sorted(tuple(r) for r in cut.turns().collect())
    assert turns == sorted(tuple(r) for r in whole.turns().collect())
    places = defaultdict(list)
    for key, place, *_ in turns:
        places[key].append(place)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_repair_of_nothing_and_damage(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    repair = structure_repair.Repair(empty)
    assert repair.report.count() == repair.digests().count() == repair.turns().count() == 0
    rows = [(c, t, "user", "A. B!") for c in range(40) for t in range(3)] + [(None, None, None, None)]
    out = damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    import zlib

    fate = {(c, t): zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20 for c, t, *_ in rows}
    assert len(out) == sum(0 if f == 0 else 2 if f == 3 else 1 for f in fate.values())
    assert all(r["text"] == ("" if fate[r["conv_id"], r["turn"]] == 1 else "A B" if fate[r["conv_id"], r["turn"]] == 2 else "A. B!" if r["conv_id"] is not None else " ") for r in out)


# ---- prefix trie


def brute_trie(rows):
    convs = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, role or "", text or ""))
    paths = {c: [(role, text) for *_, role, text in sorted(turns)] for c, turns in convs.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, path in paths.items():
        ends[tuple(path)].append(c)
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    kids = Counter(node[:-1] for node in members if node)
    saved, leaves = Counter(), Counter()
    for node, cs in members.items():
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(cs) - 1) * len(node[-1][1].encode()) if node else 0
            leaves[node[:d]] += kids[node] == 0
    for node, cs in members.items():
        yield min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), kids[node], leaves[node], saved[node], sha(",".join(map(str, sorted(ends[node]))))


def trie_rows(df):
    turns = prefix_trie.symbols(df)
    ids = turns.select("conv_id").distinct()
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in prefix_trie.trie(ids, turns).select(columns).collect()), key=repr)


TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("small", [False, True])
def test_trie(spark, monkeypatch, small):
    if small:
        for name, n in (("SPAN", 3), ("BLOCK", 4), ("CHAIN", 2), ("IDS", 2)):
            monkeypatch.setattr(prefix_trie, name, n)
    rng = random.Random(8)
    rows = [(c, t, rng.choice("ua"), rng.choice(["", "x", "é"])) for c in range(60) for t in range(rng.choice([1, 2, 3, 5]))]
    stem = [("u", f"s{k}") for k in range(90)]
    for c in range(100, 112):
        cut = rng.choice([3, 63, 64, 65, 80, 89])
        rows += [(c, t, *x) for t, x in enumerate([*stem[:cut], ("a", rng.choice("pq"))])]
    rows += [(c, t, *x) for c in (201, 202, 203) for t, x in enumerate(stem)]
    rows += [(300, None, None, None), (300, None, "u", "x"), (300, 0, "u", "x"), (None, 0, "u", "x"), (301, 4, "u", "y" * 100_000), (-7, 1, "u", "x"), (-7, 1, "u", "x")]
    assert trie_rows(cluttered(spark.createDataFrame(rows, TURNS).repartition(4))) == sorted(brute_trie(rows), key=repr)


def test_small_tries(spark):
    make = lambda rows: spark.createDataFrame(rows, TURNS)
    assert trie_rows(make([])) == []
    for rows in ([(5, 0, "u", "x")], [(5, 0, "u", "x"), (5, 1, "a", "y"), (9, 0, "u", "x"), (9, 1, "a", "y")], [(5, 0, "u", "x"), (6, 0, "u", "z")]):
        assert trie_rows(make(rows)) == sorted(brute_trie(rows), key=repr)
    # Conversations without turns end at the root.
    ids, turns = spark.createDataFrame([(4,), (2,)], "conv_id long"), prefix_trie.symbols(make([]))
    root = prefix_trie.trie(ids, turns).collect()
    assert [(r["conv_id"], r["depth"], r["n_convs"], r["n_children"], r["n_leaves"], r["ends_sha256"]) for r in root] == [(2, 0, 2, 0, 1, sha("2,4"))]


# ---- packed ids, equal vectors, schemes


def test_packed_ids_stay_whole(spark):
    """Each document's ids once and in order, with ids that repeat or are missing, and texts over the largest sequence."""
    rng = random.Random(2)
    docs = [(rng.choice([1, 2, None, 50 + i]), [rng.randrange(1000) for _ in range(rng.choice([1, 3, 14, 16, 40]))]) for i in range(60)] + [(7, []), (8, None)]
    out = packing.sequences(spark.createDataFrame(docs, "doc_id long, ids array<long>"), capacities=(8, 16), overhead=1, shard_pieces=20).collect()
    assert all(len(r["ids"]) <= r["capacity"] in (8, 16) for r in out)
    assert sum(len(r["ids"]) for r in out) == sum(len(ids or []) for _, ids in docs)
    # Short documents lie in one piece: they are found in a sequence that names them.
    left = Counter((d, tuple(ids)) for d, ids in docs if ids and len(ids) < 16)
    for (d, ids), n in left.items():
        held = sum(sum(tuple(r["ids"][k : k + len(ids)]) == ids for k in range(len(r["ids"]))) for r in out if d in r["doc_ids"])
        assert held >= n


def test_equal_vectors_are_dealt_out(spark):
    rows = spark.range(10_000).select(F.lit(3).cast("long").alias("vec_id"), F.array(F.lit(0.5), F.lit(0.25)).alias("embedding"))
    largest = []
    real = topk.top_of_blocks
    out = topk.top_k(rows.unionByName(spark.createDataFrame([(50, [0.5, 0.5])], "vec_id long, embedding array<double>")), F.col("vec_id") % 50 == 0, k=5, block=1000)
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in out.collect()] == [(50, 3, 128 * 128 + 64 * 128)] * 5
    deal = F.pmod(F.xxhash64("vec_id", "embedding", F.monotonically_increasing_id()), F.lit(10))
    largest = rows.groupBy(deal.alias("part")).count().agg(F.max("count")).first()[0]
    assert largest < 1500 and real is topk.top_of_blocks


def test_schemes_of_spark():
    pytest.importorskip("pyarrow.fs")
    assert common.SCHEMES["s3a"] == "s3"
    system, path = common.file_system("file:///tmp/x/y")
    assert system.type_name == "local" and path == "/tmp/x/y"
    try:
        assert common.file_system("s3a://bucket/key?region=us-east-1")[0].type_name == "s3"
    except ImportError:
        pass


def test_discard(spark):
    kept = common.stored(spark.range(3), "gone")
    assert kept.count() == 3
    folder = kept.inputFiles()[0].rpartition("/")[0].removeprefix("file:").replace("///", "/")
    common.discard(kept)
    import os

    assert not os.path.exists(folder)
