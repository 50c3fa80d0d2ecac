"""URL verdicts from host and path rules, and from trust and distrust spread over the host link graph.

DataFrame operations only. Trust flows along links from hosts that the rules allow; distrust flows against links from
hosts that the rules block (who links to blocked hosts is distrusted). Both are personalised PageRank with restart
weight 1 at each seed; they are compared with restart weight 1 in all, so that neither side gains by having more seeds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import quoted, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Absolute and protocol-relative link targets; others stay on their host.
LINK = r"""(?i)href\s*=\s*["']((?:https?:)?//[^"'>\s]+)"""
#: Share by which distrust must be over trust; above what settled scores may still lack.
MARGIN = 1e-5


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z in lower case; empty without ://."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null if none does. Rules are a short literal list."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight) between different hosts from (host, html); weight is the share of src's links."""
    links = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("link"))
    links = links.select("src", ascii_lower(F.regexp_extract("link", r"//([^/?#]*)", 1)).alias("dst")).where("dst <> '' and dst <> src")
    links = links.groupBy("src", "dst").agg(F.count("*").alias("n"))
    out = links.groupBy("src").agg(F.sum("n").alias("all_n"))
    return links.join(out, "src").select("src", "dst", (F.col("n") / F.col("all_n")).alias("weight"))


def personalised_pagerank(edges: DataFrame, seeds: DataFrame, iterations: int | None = None, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """(host, score); edges are (src, dst, weight), seeds (host). Cuts the lineage every 4 steps.

    Runs until 4 steps add no more than tolerance of its own score to any host, so it also goes on while they reach new
    hosts; or for exactly so many iterations. Scores only grow from step to step.
    """
    base = seeds.select("host", F.lit(1 - damping).alias("score"))
    ranks, before, step = base, base, 0
    while iterations is None or step < iterations:
        moved = edges.join(ranks, edges.src == ranks.host).select(F.col("dst").alias("host"), (F.col("weight") * F.col("score") * damping).alias("score"))
        ranks = base.unionByName(moved).groupBy("host").agg(F.sum("score").alias("score"))
        step += 1
        if step % 4 == 0:
            ranks = written(ranks, "host-ranks")
            if iterations is None:
                both = ranks.join(before.withColumnRenamed("score", "old"), "host", "left")
                if both.where(F.col("score") - F.coalesce("old", F.lit(0.0)) > tolerance * F.col("score")).isEmpty():
                    break
                before = ranks
    return ranks


def judge_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", iterations: int | None = None, damping: float = 0.85, threshold: float = 0.05) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust.

    The longest fitting rule decides. Where none fits, a host is blocked if its distrust, divided by the number of
    distrusted seeds, is over its trust, divided by that of trusted seeds, by more than the share MARGIN, and at least the
    share threshold of both together; it is allowed otherwise, and so are empty hosts and hosts that no link ties to a seed. The share has no absolute floor: distrust is split among all that link to a blocked host, so a
    floor would let them pass once they are many. Both scores run until they settle, or for so many iterations. A host with both allowed and blocked pages seeds both. A null url has an empty host
    and path; null html has no links; repeated rows are each judged.
    """
    rows = pages.select(quoted(id_col).alias("page_id"), quoted(url_col).cast("string").alias("url"), quoted(html_col).cast("string").alias("html"))
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    judged = rows.withColumn("fit", matching_rule(F.col("host"), F.col("path"), rules))
    seeds = written(judged.where("host <> '' and fit is not null").select("host", "fit.verdict").distinct(), "host-seeds")
    edges = written(host_edges(rows), "host-edges")
    judged = judged.select("page_id", "host", "path", "fit.rule", F.col("fit.verdict").alias("by_rule"))
    if edges.isEmpty():  # then each seed keeps its restart weight, and no other host has a score
        trust, distrust = (seeds.where(F.col("verdict") == v).select("host", F.lit(1 - damping).alias("score")) for v in ("allow", "block"))
    else:
        back = edges.groupBy("dst").agg(F.sum("weight").alias("all_w"))
        against = edges.join(back, "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("weight") / F.col("all_w")).alias("weight"))
        against = written(against, "host-edges-back")
        trust = personalised_pagerank(edges, seeds.where("verdict = 'allow'").select("host"), iterations, damping)
        distrust = personalised_pagerank(against, seeds.where("verdict = 'block'").select("host"), iterations, damping)
    scores = trust.withColumnRenamed("score", "trust").join(distrust.withColumnRenamed("score", "distrust"), "host", "full_outer")
    scored = judged.join(scores, "host", "left").fillna(0.0, ["trust", "distrust"])
    seeded = {r.verdict: r["count"] for r in seeds.groupBy("verdict").count().collect()}  # two numbers
    d, t = F.col("distrust") / seeded.get("block", 1), F.col("trust") / seeded.get("allow", 1)
    by_graph = F.when((d > t * (1 + MARGIN)) & (d >= threshold * (d + t)), "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_graph).alias("verdict"), "trust", "distrust")
