"""URL filters by link-graph propagation, in DataFrame functions only.

Rules allow or block a host with its subdomains and a path prefix; the longest rule that fits decides a page. Pages
without a rule are decided by their host: hosts of allowed pages are trusted seeds of a personalised PageRank over
host links, hosts of blocked pages are seeds of the same walk over reversed links (who links to bad hosts is
distrusted), seeds weighted by their pages. A host whose distrust exceeds `threshold` of trust plus distrust is
blocked; a host that neither walk reaches is allowed.

Host links are the hosts of absolute or protocol-relative href and src targets in the html, counted once a pair; a
host that links nowhere gives its rank back to the seeds. A step shrinks what ranks still move by DAMPING at least, so the
walk ends by itself, within about 130 steps, when ranks move by less than TOLERANCE in all. Edges, ranks and seeds are
tables: nothing grows on the driver. Rank that flows into a host is summed before every shuffle; the links of a host with
very many of them, and the pages of a host with very many, are dealt out in parts, each with a copy of the host's one row.

A null url, or one without "://", has an empty host and path, fits no rule and is no node; it is allowed. Null html
has no links. Rows that repeat come back each. Other columns, of any name, play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fjordframe.llm.common import discard, written

DAMPING, TOLERANCE, THRESHOLD = 0.85, 1e-9, 0.5
#: Links of a host that one part takes, and parts that the pages of any host are dealt out to.
PART, SALT = 100_000, 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """allow or block; host and path as in "example.com/en/7"."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lowered; empty without one."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ? # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(rules: list[Rule], host: Column, path: Column) -> Column:
    """Struct (verdict, rule) of the longest rule that fits, or null; the first given wins among equals."""
    out = F.lit(None).cast("struct<verdict: string, rule: string>")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.verdict).alias("verdict"), F.lit(r.text).alias("rule"))).otherwise(out)
    return out


def host_links(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) of different hosts, from pages with host and html."""
    target = r"""(?i)(?:href|src)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""
    found = F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(target), F.lit(1))))
    links = pages.where("host <> ''").select(F.col("host").alias("src"), found.alias("dst"))
    return links.withColumn("dst", F.translate("dst", _UPPER, _LOWER)).where("src <> dst").distinct()


def propagated(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(kind, host, rank): a personalised PageRank of each kind.

    edges has kind, src, dst; seeds has kind, host, share, and shares of a kind sum to 1. Rank that reaches a host
    without out-links of that kind goes back to the seeds. Steps end when ranks move by less than TOLERANCE in all.
    """
    degree = edges.groupBy("kind", "src").agg(F.count("*").alias("degree"))
    parts = F.ceil(F.col("degree") / PART).cast("int")
    joined = edges.join(degree, ["kind", "src"])
    steps = written(joined.select("kind", "src", F.pmod(F.xxhash64("dst"), parts).cast("int").alias("part"), "dst", (1 / F.col("degree")).alias("share")), "edges")
    seeds = written(seeds, "seeds")
    ranks = seeds.select("kind", "host", F.col("share").alias("rank"))
    if steps.isEmpty():
        return ranks
    # Hosts with several parts: at most one in PART links.
    many = written(degree.where(parts > 1).select("kind", F.col("src").alias("host"), parts.alias("parts")), "many")
    few = many.isEmpty()
    step = 0
    while True:
        step += 1
        dealt = ranks.withColumn("part", F.lit(0)) if few else ranks.join(many, ["kind", "host"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        met = (dealt["kind"] == steps["kind"]) & (dealt["host"] == steps["src"]) & (dealt["part"] == steps["part"])
        walked = dealt.join(steps, met).select(steps["kind"], F.col("dst").alias("host"), (DAMPING * F.col("rank") * F.col("share")).alias("rank"))
        given = walked.groupBy("kind").agg(F.sum("rank").alias("given"))
        back = seeds.join(given, "kind", "left").select("kind", "host", (F.col("share") * (1 - F.coalesce("given", F.lit(0.0)))).alias("rank"))
        new = written(walked.unionByName(back).groupBy("kind", "host").agg(F.sum("rank").alias("rank")), "ranks")
        old, ranks = ranks, new
        if step % 4 == 0 or step < 3:
            change = F.abs(F.coalesce(new["rank"], F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))
            moved = new.join(old.withColumnRenamed("rank", "old"), ["kind", "host"], "full").agg(F.sum(change)).first()[0]
            if (moved or 0) < TOLERANCE:
                return ranks
        discard(old)


def filtered(pages: DataFrame, rules: list[Rule], threshold: float = THRESHOLD) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, and the trust and distrust of its host."""
    pages = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    judged = pages.withColumn("fit", matched_rule(rules, F.col("host"), F.col("path")))
    kind = F.when(F.col("fit.verdict") == "allow", "trust").otherwise("distrust")
    weights = judged.where("fit IS NOT NULL AND host <> ''").groupBy(kind.alias("kind"), "host").agg(F.count("*").alias("n"))
    totals = weights.groupBy("kind").agg(F.sum("n").alias("total"))
    seeds = weights.join(totals, "kind").select("kind", "host", (F.col("n") / F.col("total")).alias("share"))
    links = host_links(pages)
    both = F.explode(F.array(F.struct(F.lit("trust").alias("kind"), "src", "dst"), F.struct(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"))))
    ranks = propagated(links.select(both.alias("e")).select("e.*"), seeds)
    hosts = ranks.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("rank")).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("kind") == "distrust", F.col("rank")).otherwise(0.0)).alias("distrust"))
    copies = hosts.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    dealt = judged.drop("html").withColumn("part", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALT)).cast("int"))
    out = dealt.join(copies, ["host", "part"], "left").withColumn("trust", F.coalesce("trust", F.lit(0.0))).withColumn("distrust", F.coalesce("distrust", F.lit(0.0)))
    by_host = F.when(F.col("distrust") > threshold * (F.col("trust") + F.col("distrust")), "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", by_host).alias("verdict"), "trust", "distrust")
