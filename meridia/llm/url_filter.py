"""URL filters: listed rules first, then trust and distrust propagated over host edges.

A rule (host, path) fits a url whose host is the rule's or a subdomain of it and
whose path starts with the rule's; of those that fit the longest wins. Hosts that
rules allow seed personalised PageRank along the links, hosts that they block seed
it against the links (who links to a blocked host is distrusted), each with the share
of its urls that are ruled so. A url without a rule is blocked if its host's distrust
passes a threshold and its trust.

All is DataFrame operations. What grows with the web (edges, ranks) is only
joined and aggregated; nothing of it is collected or broadcast by hand.

Edge cases: a null url, and one without ``://``, has an empty host and path, fits
no rule, takes part in no edge and is allowed. A page with null html has no links.
Links to the own host and links that name no host are no edges; repeated links
add weight. Ties between rules can't happen: rules that fit are nested, and a rule
listed twice must have one verdict. An empty table gives an empty result. Only the
named columns are read, so further columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_URL = "(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = "(?i)<a\\s[^<>]*?\\bhref\\s*=\\s*[\"']?\\s*(?:https?:)?//([^/?#\"'\\s>]+)"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules that the query is given.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
#: More rules than this don't go into one expression.
MOST_RULES = 1000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; {MOST_RULES} at most are compiled into one expression")
    if len({x.text for x in rules}) < len({(x.text, x.verdict) for x in rules}):
        raise ValueError("a rule is listed with two verdicts")
    longest = sorted(rules, key=lambda x: (-len(x.text), x.text))
    cases = [F.when(_fits(x, host, path), F.struct(F.lit(x.text).alias("rule"), F.lit(x.verdict).alias("verdict"))) for x in longest]
    return F.coalesce(*cases) if cases else F.lit(None).cast("struct<rule:string,verdict:string>")


def host_edges(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, weight): links of all pages of a host to each other host."""
    links = pages.select(
        host_of(F.col(url)).alias("src"),
        F.explode(F.regexp_extract_all(F.col(html), F.lit(_LINK), 1)).alias("to"),
    )
    links = links.select("src", F.translate("to", UPPER, LOWER).alias("dst"))
    return links.filter("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, *, damping: float = 0.85, rounds: int | None = None, cut_every: int = 4, tolerance: float = 1e-4, hub: int = 10_000) -> DataFrame:
    """Personalised PageRank: (kind, host, score), for all kinds of seed at once.

    ``edges``: kind, src, dst, weight. ``seeds``: kind, host, mass. Edges are shared out
    per host; masses count as they are, so a host's score depends on the seeds that reach
    it and not on how many others there are, and the scores of two kinds compare. What
    reaches a host without edges is not passed on. The sum of a kind is its mass at most.

    Ranks are written every ``cut_every`` rounds; once these have moved less than ``tolerance``
    of all mass it ends. A round moves at most ``damping`` of what the one before did, so
    without ``rounds`` there are enough for this; if those given don't suffice it is an error. The edges of a host with more than ``hub``
    are dealt to so many parts, and its score to each of them, so no task gets them all.
    """
    if rounds is None:
        rounds = math.ceil(math.log(tolerance / 2) / math.log(damping)) + 2 * cut_every
    start = written(seeds.select("kind", "host", F.col("mass").alias("score")), "seeds")
    out = edges.groupBy("kind", "src").agg(F.sum("weight").alias("out_weight"), F.ceil(F.count(F.lit(1)) / hub).cast("int").alias("parts"))
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("dst"), F.col("parts"))).otherwise(0).cast("int").alias("part")
    share = written(edges.join(out, ["kind", "src"]).select("kind", "src", part, "dst", (F.col("weight") / F.col("out_weight")).alias("share")), "edge-share")
    if share.isEmpty():
        return start
    hubs = written(out.filter("parts > 1").select("kind", "src", "parts"), "hubs")
    dealt = not hubs.isEmpty()
    base = start.select("kind", "host", ((1 - damping) * F.col("score")).alias("score"))
    mass = start.agg(F.sum("score")).first()[0] or 0.0
    scores = last = start
    for i in range(1, rounds + 1):
        given = scores.withColumnRenamed("host", "src")
        if dealt:
            given = given.join(hubs, ["kind", "src"], "left").select("kind", "src", "score", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
        else:
            given = given.withColumn("part", F.lit(0))
        passed = given.join(share, ["kind", "src", "part"]).select("kind", F.col("dst").alias("host"), (damping * F.col("score") * F.col("share")).alias("score"))
        scores = base.unionByName(passed).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if i % cut_every == 0 or i == rounds:
            scores = written(scores, "ranks")
            both = scores.join(last.withColumnRenamed("score", "was"), ["kind", "host"], "full_outer")
            moved = both.agg(F.sum(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("was", F.lit(0.0))))).first()[0] or 0.0
            if moved <= tolerance * mass:
                break
            last = scores
    else:
        raise ValueError(f"ranks still move after {rounds} rounds")
    return scores


def host_scores(judged: DataFrame, edges: DataFrame, **options: float) -> DataFrame:
    """(host, trust, distrust) of every host that either reaches.

    ``judged``: host, verdict (of a rule, or null). The share of a host's urls that rules
    allow is its mass as a seed of trust, the share that they block that of distrust.
    """
    share = lambda verdict: F.avg((F.coalesce("verdict", F.lit("")) == verdict).cast("double"))
    hosts = judged.filter("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    seeds = hosts.selectExpr("host", "stack(2, 'trust', trust, 'distrust', distrust) AS (kind, mass)").filter("mass > 0")
    seeds = seeds.select("kind", "host", "mass")
    ways = edges.select(F.lit("trust").alias("kind"), "src", "dst", "weight").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    )
    scores = propagate(ways, seeds, **options)
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0)).alias(kind)
    return scores.groupBy("host").agg(of("trust"), of("distrust"))


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule] = RULES,
    *,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    least_distrust: float = 1e-6,
    ratio: float = 1.0,
    **options: float,
) -> DataFrame:
    """key, host, path, rule, verdict, trust, distrust of every page.

    Without a rule a url is blocked if its host's distrust is ``least_distrust`` or
    more and over ``ratio`` times its trust. Both are in units of a host all of whose
    urls are ruled alike.
    """
    host, path = host_of(F.col(url)), path_of(F.col(url))
    judged = pages.select(F.col(key).alias(key), host.alias("host"), path.alias("path"))
    judged = judged.select("*", rule_of(F.col("host"), F.col("path"), rules).alias("hit"))
    judged = judged.select(key, "host", "path", F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("ruled"))
    edges = host_edges(pages, url=url, html=html)
    scores = host_scores(judged.select("host", F.col("ruled").alias("verdict")), edges, **options)
    doubt = (F.col("distrust") >= least_distrust) & (F.col("distrust") > ratio * F.col("trust"))
    verdict = F.coalesce(F.col("ruled"), F.when(doubt, "block").otherwise("allow"))
    return judged.join(scores, "host", "left").select(
        key, "host", "path", "rule", verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")
    )


def op2_url_filters(pages: DataFrame) -> DataFrame:
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict", F.round("trust", 9).alias("trust"), F.round("distrust", 9).alias("distrust"))
