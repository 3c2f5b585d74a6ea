"""URL filter: rules first, then trust and distrust that spread over the links between hosts.

A page that a rule fits gets the longest fitting rule's verdict. Allowed pages are trusted seeds of their host, blocked pages
distrusted ones. Trust is a personalised PageRank from the trusted seeds along links; distrust is one from the blocked seeds
against the links (who links to bad hosts is suspect). Both are measured in pages, and a host is blocked where distrust
exceeds `ratio` times trust; its pages without a rule follow it. Everything is DataFrame expressions; iterations work on one
row for each pair of hosts and cut their lineage with checkpoints.

Edge cases: a url that is null or has no "://" has empty host and path, fits no rule with a host, and is allowed unless the
empty host is blocked. Null html has no links. Links with a scheme or with // in front name another host; relative links and
links of a host to itself do not count. Repeated links and repeated rows count again. Without any link the seeds alone decide. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""
#: Copies of the host table's keys, so that pages of one hot host are joined in several tasks.
SALTS = 16
#: Links of a host to others that one task takes at a time; hosts with more are salted.
LINKS_A_SHARE = 100_000
#: Rounds go on until three of them move less than this share of a kind's mass; more than MAX_ROUNDS raise.
TOLERANCE, MAX_ROUNDS = 1e-9, 3000
#: Rules become one expression of the plan; more than this belong into a table.
MAX_RULES = 1000


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return f"{self.host}{self.path}"


def host_of(url: Column) -> Column:
    """Behind the first "://" up to /, ?, # or the end, A-Z in lower case; empty if there is none."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(size, verdict, rule) of the longest rule that fits; a block goes before an allow of the same length; null if none does."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    if not rules:
        return F.lit(None).cast("struct<size:int,verdict:string,rule:string>")
    fits = [
        F.when(
            ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path),
            F.struct(F.lit(len(r.text)).alias("size"), F.lit(r.verdict).alias("verdict"), F.lit(r.text).alias("rule")),
        )
        for r in rules
    ]
    return F.array_max(F.array(*fits))


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, links) between different hosts."""
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("to"))
    links = links.select("src", F.translate("to", UPPER, LOWER).alias("dst"))
    return links.filter("src != dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("links"))


def spread(links: DataFrame, seeds: DataFrame, *, damping: float, iterations: int | None = None) -> DataFrame:
    """(kind, host, mass) from seeds of the same columns: kind trust goes along links, distrust against them.

    The mass of hosts without a way on goes back to the seeds of its kind. In the limit that scales a kind's values so that they
    sum to its seeds, which is done once at the end. With iterations given, so many rounds are made and no mass goes back.
    """
    key = ["kind", "host"]
    ways = links.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "links").union(
        links.select(F.lit("distrust"), F.col("dst"), F.col("src"), "links")
    )
    whole = ways.groupBy(*key).agg(F.sum("links").alias("all"), F.ceil(F.count(F.lit(1)) / LINKS_A_SHARE).cast("int").alias("salts"))
    salt = F.pmod(F.xxhash64("to"), F.col("salts")).cast("int")
    ways = stored(ways.join(whole, key).select(*key, "to", salt.alias("salt"), (F.col("links") / F.col("all")).alias("share")), "url-ways")
    if ways.isEmpty():
        left = 1.0 if iterations is None else 1 - damping
        return seeds.select(*key, (F.col("mass") * left).alias("mass"))
    hubs = stored(whole.filter("salts > 1").select(*key, "salts"), "url-hubs")
    base = stored(seeds.select(*key, (F.col("mass") * (1 - damping)).alias("mass")), "url-seeds")
    sums = lambda df: {r["kind"]: r["mass"] for r in df.groupBy("kind").agg(F.sum("mass").alias("mass")).collect()}
    mass, settled, last = base, None, sums(base)
    for i in range(MAX_ROUNDS if iterations is None else iterations):
        salts = F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)
        salted = mass.join(hubs, key, "left").select(*key, "mass", F.explode(salts).alias("salt"))
        moved = ways.join(salted, [*key, "salt"]).groupBy("kind", F.col("to").alias("host")).agg((F.sum(F.col("share") * F.col("mass")) * damping).alias("mass"))
        mass = moved.unionByName(base).groupBy(*key).agg(F.sum("mass").alias("mass"))
        if i % 3 < 2 and i + 1 != iterations:
            continue
        old, settled = settled, stored(mass, "url-mass")
        if old is not None:
            discard(old)
        mass = settled
        if iterations is None:
            # From the seeds' own mass no host's value ever falls, so the change of the sums is the summed change.
            now = sums(mass)
            if all(now[k] - last[k] <= TOLERANCE * now[k] for k in now):
                break
            last = now
    else:
        if iterations is None:
            raise RuntimeError(f"masses still move after {MAX_ROUNDS} rounds")
    if iterations is None:
        whole = seeds.groupBy("kind").agg(F.sum("mass").alias("_seeds")).join(mass.groupBy("kind").agg(F.sum("mass").alias("_mass")), "kind")
        mass = mass.join(F.broadcast(whole), "kind").select(*key, (F.col("mass") * F.col("_seeds") / F.col("_mass")).alias("mass"))
    return mass


def judge(pages: DataFrame, rules: list[Rule], *, damping: float = 0.85, iterations: int | None = None, ratio: float = 1.0) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust: one row for each page."""
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = split.withColumn("_rule", longest_rule(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.col("_rule.verdict").alias("ruled"))
    seeds = ruled.filter("ruled is not null").groupBy(F.when(F.col("ruled") == "allow", "trust").otherwise("distrust").alias("kind"), "host").agg(F.count(F.lit(1)).cast("double").alias("mass"))
    mass = spread(host_links(pages), seeds, damping=damping, iterations=iterations)
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("mass"))), F.lit(0.0))
    hosts = stored(mass.groupBy("host").agg(of("trust").alias("trust"), of("distrust").alias("distrust")), "url-hosts")
    hosts = hosts.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = ruled.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int"))
    none = F.lit(0.0)
    out = salted.join(hosts, ["host", "salt"], "left").withColumns({"trust": F.coalesce("trust", none), "distrust": F.coalesce("distrust", none)})
    own = F.when(F.col("distrust") > F.col("trust") * ratio, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "trust", "distrust")
