"""URL filtering by rules and link-graph propagation.

Trust is a personalised PageRank from hosts that an allow rule names, over host
links; distrust is the same walk over reversed links from hosts that a block rule
names. A host whose distrust outweighs its trust by the threshold is blocked.
Iterations run in Spark over the host table; each is written to the shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, dealt_join, discard, hot_keys, materialize, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The contract's rules: (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Links that name a host; those without a scheme ("//host/") take the page's.
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'<>\s]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    return ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])


def match_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest fitting rule; null where none fits. The earlier of equals wins."""
    text = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = _fits(host, path, r)
        text, verdict = F.when(fits, r[1] + r[2]).otherwise(text), F.when(fits, r[0]).otherwise(verdict)
    return text, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct links (src, dst, n) between different hosts, with the number of linking pages."""
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))).alias("to"))
    links = links.withColumn("to", F.when(F.col("to").startswith("//"), F.concat(F.lit("any:"), "to")).otherwise(F.col("to")))
    return (
        links.select("src", host_of(F.col("to")).alias("dst")).filter("src <> '' and dst <> '' and src <> dst")
        .groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    )


def personalised_pagerank(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, settled: float = 1e-5, rounds: int = 200) -> DataFrame:
    """(host, score) of the walk on (src, dst, n) that restarts at `seeds` (host, mass).

    The mass of `seeds` should sum to 1. The walk goes on until the scores of all
    hosts together change by `settled` at most and no host is newly reached;
    `rounds` only stops a walk that would not end. Each round takes `damping` of the
    change off, so 1e-5 takes some 70 rounds. A host without outgoing links gives
    its mass back to the seeds. Hosts never reached have no row. A hub's links are
    dealt to several tasks, and shares are summed on the map side, so neither its
    outgoing nor its incoming links are gathered in one.
    """
    weight = materialize(edges.groupBy("src").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("links")), "weight")
    if not weight.limit(1).count():
        return seeds.select("host", F.col("mass").alias("score"))
    hubs = materialize(hot_keys(weight, ["src"], "links"), "hubs")
    moves = dealt_join(edges, weight.drop("links"), ["src"], hubs, F.xxhash64("dst"))
    moves = materialize(moves.select("src", "dst", (F.col("n") / F.col("total")).alias("w")), "moves")
    rank = seed = materialize(seeds.select("host", F.col("mass").alias("score")), "seeds")
    reached = 0
    for _ in range(rounds):
        met = dealt_join(moves, rank.select(F.col("host").alias("src"), "score"), ["src"], hubs, F.xxhash64("dst"))
        gone = met.groupBy(F.col("dst").alias("host")).agg((damping * F.sum(F.col("score") * F.col("w"))).alias("score"))
        gone = materialize(gone, "walk")
        kept = gone.agg(F.sum("score")).first()[0] or 0.0
        back = seed.select("host", (F.col("score") * F.lit(1.0 - kept)).alias("score"))
        after = materialize(
            gone.union(back).groupBy("host").agg(F.sum("score").alias("score")).join(rank.select("host", F.col("score").alias("was")), "host", "left")
            .select("host", "score", F.abs(F.col("score") - F.coalesce("was", F.lit(0.0))).alias("change")),
            "rank",
        )
        hosts, change = after.agg(F.count(F.lit(1)), F.sum("change")).first()
        discard(gone)
        if rank is not seed:
            discard(rank)
        rank = after
        if hosts == reached and change <= settled:
            break
        reached = hosts
    discard(moves, seed, weight, hubs)
    return rank.select("host", "score")


def judge_urls(pages: DataFrame, rules=RULES, threshold: float = 1.0, damping: float = 0.85) -> DataFrame:
    """Verdict on every row of `pages` (page_id, url, html).

    Returns (page_id, host, path, rule, verdict, trust, distrust). The longest rule
    that fits decides; else the host is blocked if its distrust is above `threshold`
    times its trust, and allowed otherwise, as a host that no walk reaches is. Seeds
    are the hosts of pages that a rule decides, weighed by those pages. A null url
    or one without "://" has empty host and path; a null html has no links.
    Repeated rows are judged alike; other columns are ignored; an empty table gives
    no rows.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    text, verdict = match_rule(F.col("host"), F.col("path"), rules)
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).select("page_id", "host", "path", text.alias("rule"), verdict.alias("ruled"))
    edges = materialize(host_edges(pages), "edges")
    counts = materialize(
        rows.filter("ruled is not null and host <> ''").groupBy("host").agg(
            F.count(F.when(F.col("ruled") == "allow", 1)).alias("allow"), F.count(F.when(F.col("ruled") == "block", 1)).alias("block")
        ),
        "seeds",
    )
    totals = counts.agg(F.sum("allow"), F.sum("block")).first()
    scores = []
    for kind, total, links in (("allow", totals[0], edges), ("block", totals[1], edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))):
        seeds = counts.filter(F.col(kind) > 0).select("host", (F.col(kind) / F.lit(total or 1)).alias("mass"))
        scores.append(personalised_pagerank(links, seeds, damping))
    both = reduce(
        lambda a, b: a.join(b, "host", "full"),
        [s.withColumnRenamed("score", n) for s, n in zip(scores, ("trust", "distrust"))],
    ).select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    judged = materialize(both, "hosts")
    method = F.when(F.coalesce("distrust", F.lit(0.0)) > threshold * F.coalesce("trust", F.lit(0.0)), "block").otherwise("allow")
    return attach(rows, judged, "host", F.xxhash64("page_id")).select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )


def op7_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
