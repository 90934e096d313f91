"""URL filters: rules first; for the rest, trust and distrust propagated over the graph of links between hosts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import deleted, written

#: PageRank's share of links, and the change of a score at which it has settled. Scores change by the power of the round, so some 90 rounds do.
DAMPING, SETTLED = 0.85, 1e-6
#: A host is blocked if its share of distrust exceeds its share of trust by more than this; a share is exact to TIE.
THRESHOLD, TIE = 0.5, 1e-4


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def matched(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, and what it says; null if none does. A rule fits its host and all subdomains."""
    rule, says = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        rule, says = F.when(fits, F.lit(r.name)).otherwise(rule), F.when(fits, F.lit("allow" if r.allow else "block")).otherwise(says)
    return rule, says


def host_links(pages: DataFrame) -> DataFrame:
    """Distinct links (src, dst) between different hosts, of pages (host, html)."""
    target = F.explode(F.regexp_extract_all("html", F.lit(r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""), 1))
    links = pages.where("host <> '' and html is not null").select(F.col("host").alias("src"), target.alias("url"))
    full = F.when(F.startswith("url", F.lit("//")), F.concat(F.lit("http:"), "url")).otherwise(F.col("url"))
    return links.select("src", host_and_path(full)[0].alias("dst")).where("dst <> '' and src <> dst").distinct()


def personalised_rank(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """host, score and most. links (src, dst) and seeds (host, seed from 0 to 1) are written tables; mass flows from src to dst.

    A host's score is (1 - d) of its seed and d of what its neighbours share out in equal parts; most is the same were all seeds 1, the most
    that the host's neighbourhood can give it. Rounds go on until no score changes by more than SETTLED, and each is written.
    """
    out = links.groupBy("src").agg(F.count("*").alias("n"))
    shares = written(links.join(out, "src"), "shares")
    base = seeds.select("host", ((1 - DAMPING) * F.col("seed")).alias("score"), F.lit(1 - DAMPING).alias("most"))
    now, change = written(base, "rank"), 1.0
    while change > SETTLED:
        part = F.lit(DAMPING) / F.col("n")
        flow = shares.join(now.withColumnRenamed("host", "src"), "src").select(F.col("dst").alias("host"), (part * F.col("score")).alias("score"), (part * F.col("most")).alias("most"))
        new = written(base.unionByName(flow).groupBy("host").agg(F.sum("score").alias("score"), F.sum("most").alias("most")), "rank")
        # most changes at least as much as score does
        delta = new.select("host", "most").unionByName(now.select("host", (-F.col("most")).alias("most"))).groupBy("host").agg(F.abs(F.sum("most")).alias("d"))
        change = delta.agg(F.max("d")).first()[0] or 0.0
        deleted(now)
        now = new
    deleted(shares)
    return now


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's shares of trust and distrust.

    A host's seed is the share of its pages that rules allow (trust) or block (distrust). Trust flows along links, distrust
    against them, to those that link to what is blocked. What flows to a host is taken by the most that could, were all hosts
    seeds: so it doesn't depend on how many others link to the same hosts, or on the size of the graph. A host's share is the larger
    of that and its own seed. A page without a rule is blocked if its host's share of distrust exceeds that of trust by more than the
    threshold.

    Null urls and such without ://: host and path are empty, allowed without a rule. Null html: no links. Very long urls and pages are
    read in whole. Repeated pages each get a row, and count for their host's seed. Null ids stay. Empty table: no rows. Other columns are not
    read.
    """
    host, path = host_and_path(F.col("url"))
    split = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), "html")
    rule, says = matched(F.col("host"), F.col("path"), rules)
    ruled = split.withColumns({"rule": rule, "says": says})

    def share(verdict: str) -> Column:
        return F.count_if(F.col("says") == verdict) / F.count("*")

    links = written(host_links(split), "links")
    own = ruled.where("host <> ''").groupBy("host").agg(share("allow").alias("trusted"), share("block").alias("blocked"))
    linked = links.select(F.explode(F.array("src", "dst")).alias("host"), F.lit(0.0).alias("trusted"), F.lit(0.0).alias("blocked"))
    seeds = written(own.unionByName(linked).groupBy("host").agg(F.max("trusted").alias("trusted"), F.max("blocked").alias("blocked")), "seeds")
    trust = personalised_rank(links, seeds.select("host", F.col("trusted").alias("seed")))
    distrust = personalised_rank(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")), seeds.select("host", F.col("blocked").alias("seed")))

    def shares(rank: DataFrame, seed: str, name: str) -> DataFrame:
        flowed = F.col("most") - (1 - DAMPING)
        came = F.when(flowed > SETTLED, (F.col("score") - (1 - DAMPING) * F.col(seed)) / flowed).otherwise(0.0)
        return rank.join(seeds, "host").select("host", F.greatest(came, F.col(seed)).alias(name))

    scores = written(shares(trust, "trusted", "trust").join(shares(distrust, "blocked", "distrust"), "host"), "scores")
    deleted(links, seeds, trust, distrust)
    out = ruled.drop("html").join(scores, "host", "left").na.fill(0.0, ["trust", "distrust"])
    verdict = F.when(F.col("distrust") - F.col("trust") > threshold + TIE, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("says", verdict).alias("verdict"), "trust", "distrust")
