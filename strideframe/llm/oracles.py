"""DuckDB SQL of the queries that SQL can express, over whole tables.

op3, op4, op7, op9 and op10 hang on trained models, files or a packing heuristic; their tests compare them with brute force.
"""

from __future__ import annotations

from . import imatch, quality, url_trust

#: What Python's str.split takes for white space.
WHITE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
SPLIT = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{WHITE}'), lambda w: w <> '')"
#: Rounds of the spread; 0.85 to this power is nothing against the sixth decimal.
ROUNDS = 150


def url_sql(rules: list[url_trust.Rule]) -> str:
    rows = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in rules)
    link = url_trust.LINK.replace("'", "''")
    lower = f"'{url_trust.UPPER}', '{url_trust.LOWER}'"
    return f"""
WITH RECURSIVE rules(verdict, rhost, rpath) AS (VALUES {rows}),
split AS (SELECT row_number() OVER () AS page, page_id, html, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), {lower}) AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
fits AS (SELECT page, arg_max(rhost || rpath, (length(rhost || rpath), verdict)) AS rule, arg_max(verdict, (length(rhost || rpath), verdict)) AS ruled
    FROM split JOIN rules ON (host = rhost OR suffix(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page),
judged AS (SELECT split.*, rule, ruled FROM split LEFT JOIN fits USING (page)),
seeds AS (SELECT CASE WHEN ruled = 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*)::DOUBLE AS mass FROM judged WHERE ruled IS NOT NULL GROUP BY ALL),
found AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1)), {lower}) AS dst FROM split),
links AS (SELECT src, dst, count(*) AS links FROM found WHERE src <> dst GROUP BY ALL),
ways AS (SELECT kind, host, dst, links / sum(links) OVER (PARTITION BY kind, host) AS share
    FROM (SELECT 'trust' AS kind, src AS host, dst, links FROM links UNION ALL SELECT 'distrust', dst, src, links FROM links)),
base AS (SELECT kind, host, 0.15 * mass AS mass FROM seeds),
rounds AS (
    SELECT 0 AS round, kind, host, mass FROM base
    UNION ALL
    SELECT min(round) + 1, kind, host, sum(mass) FROM (
        SELECT r.round, w.kind, w.dst AS host, 0.85 * w.share * r.mass AS mass FROM rounds r JOIN ways w ON w.kind = r.kind AND w.host = r.host WHERE r.round < {ROUNDS}
        UNION ALL
        SELECT n.round, b.kind, b.host, b.mass FROM base b, (SELECT generate_series AS round FROM generate_series(0, {ROUNDS - 1})) n)
    WHERE round = (SELECT max(round) FROM rounds) GROUP BY kind, host
),
settled AS (SELECT kind, host, arg_max(mass, round) AS mass FROM rounds GROUP BY ALL),
whole AS (SELECT kind, sum(mass) AS mass FROM settled GROUP BY kind),
seeded AS (SELECT kind, sum(mass) AS mass FROM seeds GROUP BY kind),
spread AS (SELECT s.kind, s.host, s.mass * seeded.mass / whole.mass AS mass FROM settled s JOIN whole USING (kind) JOIN seeded USING (kind)),
hosts AS (SELECT host, coalesce(sum(mass) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(mass) FILTER (kind = 'distrust'), 0) AS distrust FROM spread GROUP BY host)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict,
    round(coalesce(trust, 0), 6) AS trust, round(coalesce(distrust, 0), 6) AS distrust
FROM judged LEFT JOIN hosts USING (host)"""


TOP_K = """
WITH taken AS (SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
    WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM taken q JOIN taken c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
ranked AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM pairs)
SELECT * FROM ranked WHERE rank <= 5"""

BACKOFF = f"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id, {SPLIT} AS words FROM documents),
tokens AS (SELECT d, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM docs),
pairs AS (SELECT *, lag(w) OVER (PARTITION BY d ORDER BY i) AS v FROM tokens),
uni AS (SELECT w, count(*) AS n FROM tokens GROUP BY w),
own AS (SELECT d, w, count(*) AS n FROM tokens GROUP BY d, w),
bi AS (SELECT v, w, count(*) AS n FROM pairs WHERE v IS NOT NULL GROUP BY v, w),
own2 AS (SELECT d, v, w, count(*) AS n FROM pairs WHERE v IS NOT NULL GROUP BY d, v, w),
total AS (SELECT count(*) AS n FROM tokens),
counted AS (SELECT p.d, p.v, uni.n - own.n AS cw, coalesce(bi.n - own2.n, 0) AS cvw, univ.n - ownv.n AS cv, greatest(total.n - len(docs.words), 1) AS others
    FROM pairs p JOIN docs ON docs.d = p.d CROSS JOIN total JOIN uni ON uni.w = p.w JOIN own ON own.d = p.d AND own.w = p.w
    LEFT JOIN bi ON bi.v = p.v AND bi.w = p.w LEFT JOIN own2 ON own2.d = p.d AND own2.v = p.v AND own2.w = p.w
    LEFT JOIN uni univ ON univ.w = p.v LEFT JOIN own ownv ON ownv.d = p.d AND ownv.w = p.v),
scored AS (SELECT d, (cvw = 0)::INT AS backed,
    CASE WHEN cvw > 0 THEN ln(cvw / cv) ELSE ln(CASE WHEN v IS NULL THEN 1.0 ELSE 0.4 END * greatest(cw, 0.5) / others) END AS part FROM counted),
sums AS (SELECT d, sum(backed) AS n_backoff, avg(part) AS score FROM scored GROUP BY d)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_backoff, 0)::BIGINT AS n_backoff, round(score, 6) AS score FROM docs LEFT JOIN sums USING (d)"""

JACCARD = f"""
WITH RECURSIVE docs AS (SELECT doc_id, {SPLIT} AS words FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS shingle
    FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM docs WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
linked AS (SELECT a, b FROM shared s JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE s.n / (x.n + y.n - s.n)::DOUBLE >= 0.8),
either AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach(a, b) AS (SELECT a, b FROM either UNION SELECT r.a, e.b FROM reach r JOIN either e ON e.a = r.b),
roots AS (SELECT a AS doc_id, min(b) AS root FROM reach GROUP BY a),
counts AS (SELECT a AS doc_id, count(*) AS links FROM either GROUP BY a)
SELECT doc_id, least(doc_id, coalesce(root, doc_id)) AS class_id, coalesce(links, 0)::BIGINT AS links
FROM docs LEFT JOIN roots USING (doc_id) LEFT JOIN counts USING (doc_id)"""


def quality_sql() -> str:
    common = ", ".join(f"'{w}'" for w in quality.COMMON_WORDS)
    bins = ["lower", "upper", "caseless", "digits", "n_symbols", "marks", "space"]
    distance = "CASE WHEN count(own) = count(*) AND count(ref) = count(*) THEN sqrt(greatest(sum((part(own, ref) + part(ref, own)) / 2), 0)) END"
    part = "CASE WHEN {0} > 0 THEN {0} * log2(2 * {0} / ({0} + {1})) ELSE 0 END"
    distance = distance.replace("part(own, ref)", part.format("own", "ref")).replace("part(ref, own)", part.format("ref", "own"))
    kept = lambda kind: f"length(regexp_replace(t, '[^{kind}]+', '', 'g'))"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id, coalesce(lang, chr(0)) AS lang, coalesce(text, '') AS t FROM documents),
split AS (SELECT *, list_filter(regexp_split_to_array(t, '[{quality.SPACE}]+'), lambda w: w <> '') AS words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{quality.SPACE}]')) AS lines FROM docs),
tokens AS (SELECT d, words, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM split),
grams AS (SELECT d, i, count(*) OVER (PARTITION BY d, words[i], words[i + 1], words[i + 2]) AS n FROM tokens WHERE i <= len(words) - 2),
covered AS (SELECT d, count(DISTINCT i + k) AS n_repeat_words FROM grams, (VALUES (0), (1), (2)) s(k) WHERE n > 1 GROUP BY d),
counts AS (SELECT d, doc_id, lang, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, {kept("#*$%&|<>")} AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    length(t) AS chars, {kept("a-z")} AS lower, {kept(chr(92) + "p{Lu}")} AS upper, {kept(chr(92) + "p{L}")} AS letters, {kept(chr(92) + "p{Nd}")} AS digits
    FROM split LEFT JOIN covered USING (d)),
base AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT} * n_words AS base_failed, letters - lower - upper AS caseless,
    greatest(word_chars - letters - digits - n_symbols, 0) AS marks, chars - word_chars AS space FROM counts),
bins AS (SELECT d, lang, base_failed, 'classes' AS kind, bin, n, chars AS whole FROM base UNPIVOT (n FOR bin IN ({", ".join(bins)}))),
named AS (SELECT unnest([{common}]) AS bin),
met AS (SELECT d, lower(w) AS bin, count(*) AS n FROM tokens WHERE lower(w) IN ({common}) GROUP BY ALL),
word_bins AS (SELECT d, lang, base_failed, bin, coalesce(n, 0) AS n, n_words AS whole FROM base CROSS JOIN named LEFT JOIN met USING (d, bin)),
other AS (SELECT d, lang, base_failed, '' AS bin, whole - sum(n) AS n, whole FROM word_bins GROUP BY d, lang, base_failed, whole),
grid AS (SELECT d, lang, base_failed, kind, bin, n, whole FROM bins UNION ALL SELECT d, lang, base_failed, 'words', bin, n, whole FROM (FROM word_bins UNION ALL FROM other)),
ref AS (SELECT lang, kind, bin, sum(n) / nullif(sum(whole), 0) AS ref FROM grid WHERE NOT base_failed GROUP BY ALL),
shares AS (SELECT d, kind, n / nullif(whole, 0) AS own, ref FROM grid LEFT JOIN ref USING (lang, kind, bin)),
far AS (SELECT d, kind, {distance} AS distance FROM shares GROUP BY d, kind),
wide AS (SELECT base.*, c.distance AS cd, w.distance AS wd FROM base JOIN far c ON c.d = base.d AND c.kind = 'classes' JOIN far w ON w.d = base.d AND w.kind = 'words')
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
    NOT base_failed AND NOT coalesce(cd > {quality.CLASS_LIMIT} + {quality.CLASS_SLACK} / sqrt(greatest(chars, 1)) OR wd > {quality.WORD_LIMIT} + {quality.WORD_SLACK} / sqrt(greatest(n_words, 1)), false) AS kept,
    round(cd, 6) AS classes_distance, round(wd, 6) AS words_distance FROM wide"""


def imatch_sql() -> str:
    rates = ", ".join(map(str, imatch.rates()))
    pattern = r"[^\p{L}\p{N}]+"
    return rf"""
WITH rates AS (SELECT unnest(range({len(imatch.rates())})) AS k, unnest([{rates}]) AS one_in),
d AS (SELECT row_number() OVER (ORDER BY doc_id DESC NULLS LAST) AS r, doc_id, coalesce(text, '') AS text FROM documents),
o AS (SELECT *, length(text) AS n, coalesce(lead(text) OVER (ORDER BY r), first_value(text) OVER (ORDER BY r)) AS next_text FROM d),
e AS (SELECT r, doc_id, n, text, left(text, n - n // 2) || left(next_text, n // 2) AS edited FROM o),
texts AS (SELECT r, 0 AS which, text FROM e UNION ALL SELECT r, 1, edited FROM e),
terms AS (SELECT DISTINCT r, which, unnest(regexp_split_to_array(lower(text), '{pattern}')) AS term FROM texts),
words AS (SELECT * FROM terms WHERE term <> ''),
size AS (SELECT count(*) AS docs FROM d),
band AS (SELECT term FROM words, size WHERE which = 0 GROUP BY term, docs HAVING count(*) BETWEEN greatest(2, (docs + {imatch.RAREST - 1}) // {imatch.RAREST}) AND docs // {imatch.COMMONEST}),
members AS (SELECT term, k FROM band, rates WHERE ('0x' || left(md5(k || ':' || term), 5))::INT % one_in = 0),
held AS (SELECT r, which, k, left(md5(string_agg(term, ' ' ORDER BY term)), 8) AS hash FROM words JOIN members USING (term) GROUP BY ALL),
whole AS (SELECT r, which, left(md5(text), 8) AS hash FROM texts),
every AS (SELECT * FROM held UNION ALL SELECT r, which, 0, hash FROM whole WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.r = whole.r AND h.which = whole.which)),
printed AS (SELECT r, which, list(coalesce(hash, '{imatch.EMPTY}') ORDER BY k) AS hashes FROM (SELECT * FROM (SELECT r, which FROM texts), rates) LEFT JOIN every USING (r, which, k) GROUP BY ALL),
sides AS (SELECT own.r, own.hashes AS a, edit.hashes AS b, coalesce(lead(own.hashes) OVER w, first_value(own.hashes) OVER w) AS c FROM printed own JOIN printed edit ON edit.r = own.r AND own.which = 0 AND edit.which = 1 WINDOW w AS (ORDER BY own.r)),
near AS (SELECT *, list_filter(list_zip(a, b), lambda x: x[1] <> '{imatch.EMPTY}' OR x[2] <> '{imatch.EMPTY}') AS ab, list_filter(list_zip(a, c), lambda x: x[1] <> '{imatch.EMPTY}' OR x[2] <> '{imatch.EMPTY}') AS ac FROM sides)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, array_to_string(a, '') AS fingerprint, array_to_string(b, '') AS edited_fingerprint,
    CASE WHEN a = b THEN 1.0::DOUBLE ELSE round(len(list_filter(ab, lambda x: x[1] = x[2]))::DOUBLE / len(ab), 6) END AS near_edited,
    CASE WHEN a = c THEN 1.0::DOUBLE ELSE round(len(list_filter(ac, lambda x: x[1] = x[2]))::DOUBLE / len(ac), 6) END AS near_next
FROM near JOIN e USING (r)"""


def repair_sql() -> str:
    """One state for each way a conversation may stand: nothing yet, after s, after u, after a; each with its least cost, audit and text."""
    # A key of cost and audit sorts as (cost, audit) does; the text goes with it.
    key = lambda v, cost, edit, text="''": f"CASE WHEN {v} IS NOT NULL THEN struct_pack(k := lpad((left({v}.k, 12)::BIGINT + {cost})::VARCHAR, 12, '0') || substr({v}.k, 13) || '{edit}', t := {v}.t || {text}) END"
    least = lambda *ways: f"list_min(list_filter([{', '.join(ways)}], lambda x: x IS NOT NULL))"
    user, helper = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    inserted_u = least("u", *[key(v, 5, "I", user) for v in ("z", "s", "a")])
    inserted_a = least("a", key("u", 5, "I", helper))
    stay = lambda v: key(v, 2, "D")
    read = lambda v, initial, role: [
        f"CASE WHEN NOT doomed AND initial = '{initial}' THEN {key(v, 'short', 'K', 'chr(10) || line')} END",
        *([f"CASE WHEN NOT doomed THEN {key(v, '1 + short', 'R', f'{role} || text')} END"] if role else []),
    ]
    begin = "struct_pack(k := '000000000000', t := '')"
    kind = "STRUCT(k VARCHAR, t VARCHAR)"
    return rf"""
WITH RECURSIVE {CRC_TABLE},
fates AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS place FROM conversations),
bits AS (SELECT fates.*, {crc32_of("place")} % 20 AS fate FROM fates, crc),
rows_ AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM bits),
numbered AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM rows_),
told AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM numbered),
judged AS (SELECT *, left(role, 1) AS initial, role || ':' || text AS line, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' END AS fault FROM told),
coded AS (SELECT *, coalesce(fault IN ('blank', 'duplicate'), false) AS doomed, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS short,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM judged),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM coded GROUP BY conv_id),
walk AS (
    SELECT conv_id, n, 0::BIGINT AS i, {begin}::{kind} AS z, NULL::{kind} AS s, NULL::{kind} AS u, NULL::{kind} AS a FROM counts
    UNION ALL
    SELECT conv_id, n, i, {stay("z")}, {least(stay("s"), *read("z", "s", None))}, {least(stay("u"), *[w for v in ("z", "s", "a") for w in read(v, "u", user)])}, {least(stay("a"), *read("u", "a", helper))}
    FROM (SELECT w.conv_id, w.n, c.i, c.initial, c.line, c.text, c.doomed, c.short, z, s, u, {inserted_a} AS a FROM (SELECT * REPLACE ({inserted_u} AS u) FROM (SELECT * REPLACE ({inserted_a} AS a) FROM walk)) w
        JOIN coded c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.i = w.i + 1)),
ended AS (SELECT conv_id, least_of.k AS k, least_of.t AS t FROM (SELECT conv_id, {least("z", "a")} AS least_of
    FROM (SELECT * REPLACE ({inserted_a} AS a) FROM (SELECT * REPLACE ({inserted_u} AS u) FROM walk WHERE i = n))))
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    coalesce(left(k, 12)::BIGINT, 0) AS cost, coalesce(substr(k, 13), '') AS audit, sha256(coalesce(substr(t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id"""


#: CRC-32 in SQL: a table of 256 by its rule, and a fold over the characters (ASCII) of a text.
CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, x)) AS tab)"


def crc32_of(text: str) -> str:
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce({codes}, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


def trie_sql() -> str:
    return f"""
WITH {CRC_TABLE},
turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS at,
    md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS sym, strlen(coalesce(text, '')) AS bytes FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, n, donor, {crc32_of("conv_id::VARCHAR")} % 9 AS h FROM (SELECT conv_id, count(*) AS n, conv_id - conv_id % 5 AS donor FROM turns GROUP BY conv_id), crc),
heads AS (SELECT i.*, least(i.h, coalesce(d.n, 0)) AS head FROM ids i LEFT JOIN ids d ON d.conv_id = i.donor),
rebuilt AS (SELECT i.conv_id, t.at + 1 AS depth, sym, bytes FROM heads i JOIN turns t ON t.conv_id = i.donor AND t.at < i.h
    UNION ALL SELECT i.conv_id, t.at - h + head + 1, sym, bytes FROM heads i JOIN turns t ON t.conv_id = i.conv_id AND t.at >= i.h),
paths AS (SELECT conv_id, depth, bytes, md5(list(sym) OVER (PARTITION BY conv_id ORDER BY depth)::VARCHAR) AS node FROM rebuilt UNION ALL SELECT conv_id, 0, 0, 'root' FROM ids),
linked AS (SELECT *, lag(node) OVER w AS up, row_number() OVER (PARTITION BY conv_id ORDER BY depth DESC) = 1 AS last FROM paths WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
nodes AS (SELECT node, any_value(depth) AS depth, any_value(bytes) AS bytes, any_value(up) AS up, min(conv_id) AS first, count(*) AS n, string_agg(conv_id, ',' ORDER BY conv_id) FILTER (last) AS ends FROM linked GROUP BY node),
kids AS (SELECT up AS node, count(*) AS kids FROM nodes WHERE up IS NOT NULL GROUP BY up),
sized AS (SELECT nodes.*, coalesce(kids, 0) AS kids FROM nodes LEFT JOIN kids USING (node)),
below AS (SELECT p.node, sum((x.n - 1) * x.bytes) AS saved, count(*) FILTER (x.kids = 0) AS leaves FROM sized x JOIN paths p ON p.conv_id = x.first AND p.depth <= x.depth GROUP BY p.node)
SELECT s.first AS conv_id, s.depth, u.first AS parent_conv_id, s.n AS n_convs, s.kids AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(s.ends, '')) AS ends_sha256
FROM sized s JOIN below USING (node) LEFT JOIN sized u ON u.node = s.up"""
