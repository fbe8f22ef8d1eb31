"""URL rules and, where no rule fits, trust and distrust spread over the links between hosts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, pick, stored, text_of


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules in use.
RULES: tuple[Rule, ...] = (Rule("com", "/", "allow"), Rule("example.com", "/en/", "block"), Rule("www.example.com", "/en/", "allow"), Rule("net", "/es/", "block"), Rule("net", "/fr/", "block"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The host of an absolute link inside a page.
LINK = r"""(?is)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(text_of(url), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(text_of(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest rule that fits as (rule, verdict), else null; of equally long ones the longer host, then the name."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), len(r.host), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, weight): distinct links between different hosts with their number of pages. Relative links stay on their host."""
    rows = pages.select(host_of(F.col(url_col)).alias("src"), F.array_distinct(F.transform(F.regexp_extract_all(text_of(F.col(html_col)), F.lit(LINK), 1), lambda h: F.translate(h, _UPPER, _LOWER))).alias("links"))
    rows = rows.filter((F.size("links") > 0) & (F.col("src") != "")).select("src", F.explode("links").alias("dst")).filter("src <> dst and dst <> ''")
    return rows.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def shares_of(edges: DataFrame) -> DataFrame:
    """(src, dst, share): what part of a host's score goes along each of its links, by their weights."""
    total = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    return edges.join(total, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share"))


def spread(seeds: DataFrame, edges: DataFrame, damping: float, tolerance: float = 1e-4, together: int = 6, max_rounds: int = 400) -> DataFrame:
    """Personalised PageRank: (host, score) from (host, seed) over (src, dst, weight).

    A host passes `damping` of its score on along its links, in the shares of their weights; one without links keeps
    it. Scores start at and return to the seeds, so a seed host without any links keeps its seed as score. `together`
    rounds are one job, written to the shared folder; they end when the last of them moved no more than `tolerance`
    of all score, which damping makes sure of.
    """
    shares = stored(shares_of(edges), "shares")
    back = stored(seeds.select("host", (F.col("seed") * (1 - damping)).alias("part"), "seed"), "seeds")
    scores, old = back.select("host", F.col("seed").alias("score")), None
    for _ in range(0, max_rounds, together):
        for _ in range(together):
            before = scores
            # A host without links meets none and passes to itself. Scores stand in one branch, so plans grow by the round, not double.
            moved = before.join(shares, before["host"] == shares["src"], "left").select(F.coalesce("dst", "host").alias("host"), (F.col("score") * F.coalesce("share", F.lit(1.0)) * damping).alias("part"))
            scores = moved.unionByName(back.select("host", "part")).groupBy("host").agg(F.sum("part").alias("score"))
        last = before.select("host", F.lit(0.0).alias("score"), F.col("score").alias("was")).unionByName(scores.select("host", "score", F.lit(0.0).alias("was")))
        both = stored(last.groupBy("host").agg(F.sum("score").alias("score"), F.sum("was").alias("was")), "scores")
        discard(old)
        scores, old = both.select("host", "score"), both
        told = both.agg(F.sum(F.abs(F.col("score") - F.col("was"))).alias("moved"), F.sum("score").alias("all")).first()
        if told["all"] is None or told["moved"] <= tolerance * told["all"]:
            break
    else:
        raise RuntimeError(f"scores did not settle in {max_rounds} rounds")
    discard(shares, back)
    scores.scratch = [old]
    return scores


def received(scores: DataFrame, edges: DataFrame) -> DataFrame:
    """(host, part): what each host gets along (src, dst, weight) when every host gives its score away."""
    return scores.join(shares_of(edges), scores["host"] == F.col("src")).groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("score") * F.col("share")).alias("part"))


def url_filter(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", damping: float = 0.85, tolerance: float = 1e-4, threshold: float = 0.5) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    A rule fits its host and all its subdomains where the path starts with the rule's; the longest decides. Where none
    fits, the host does: each host's seed of trust (distrust) is the share of its pages that rules allow (block).
    Trust runs along the links between hosts, distrust against them, by personalised PageRank, weighted by the number of
    linking pages, until no round moves more than `tolerance` of the score. What a host gets of both from other hosts is
    compared as (distrust - trust) / (distrust + trust), so it does not matter among how many hosts a score is divided. This stands for the pages that no rule fits: it is weighted by their share and
    added to the seeds' difference, which it can only raise. A host where the sum is `threshold` or more is blocked, any
    other allowed; one that gets nothing is judged by its seeds.

    Null urls and such without `://` have an empty host and path, fit no rule and are allowed, as hosts are judged only
    by name. Null html has no links. A null page_id is carried through. Repeated pages count as often as they stand
    there. Of rules of equal length the longer host decides, then the name. An empty table gives an empty one. Links are counted for each pair of hosts before the shuffle and all page texts stay where they are; the verdicts of hosts join
    pages by host, a join that adaptive execution splits for a hot host.
    """
    rows = pick(pages, (id_col, "page_id"), (url_col, "url"), (html_col, "html"))
    judged = rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = judged.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    share = lambda verdict: F.avg(F.coalesce((F.col("fit.verdict") == verdict).cast("double"), F.lit(0.0)))
    hosts = stored(judged.filter("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust")), "hosts")
    edges = stored(host_edges(rows), "edges")
    worse = F.col("distrust") - F.col("trust")
    told = hosts
    if not edges.isEmpty():  # without links every host keeps its seed
        along, against = edges, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
        for seed, part, links in (("trust", "good", along), ("distrust", "bad", against)):
            scores = spread(hosts.filter(F.col(seed) > 0).select("host", F.col(seed).alias("seed")), links, damping, tolerance)
            got = stored(received(scores, links).withColumnRenamed("part", part), part)
            discard(*scores.scratch)
            told = told.join(got, "host", "left")
        good, bad = F.coalesce("good", F.lit(0.0)), F.coalesce("bad", F.lit(0.0))
        others = F.when(bad > good, (bad - good) / (bad + good)).otherwise(0.0)
        worse = worse + (1 - F.col("trust") - F.col("distrust")) * others
    blocked = stored(told.filter(worse >= threshold).select("host", F.lit("block").alias("by_links")), "blocked")
    discard(hosts, edges)
    out = judged.join(blocked, "host", "left")
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), F.col("by_links"), F.lit("allow")).alias("verdict"))
