"""URL verdicts from rules, and from trust that spreads over links between hosts.

Rules (host and path) decide first, the longest that fits. Their verdicts are also the seeds: hosts with allowed pages are trusted, hosts with blocked
pages are distrusted, in proportion to those pages. Trust follows links from page to target (personalised PageRank); distrust
follows them backwards, to those who link to blocked hosts. Both ranks are computed in one loop over a table of host edges that are
counted before they are shuffled. A host is blocked if its distrust is above ``SHARE`` of trust and distrust together, each relative to the sum
over all hosts; hosts that neither reaches are allowed.

Mass that reaches hosts without outgoing edges is not redistributed: by linearity that only scales the ranks, which are normalised. A null
url, or one without ``://``, has an empty host and path, fits no rule and is allowed. Null html has no links. Rows that repeat are all judged and all
counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from editlore.llm import common

DAMPING = 0.85
ROUNDS = 100  # a bound; 0.85 ** 85 is below the tolerance
TOLERANCE = 1e-6  # of all mass; the loop ends when less has moved
SHARE = 0.5

#: Rules of the registered query, longest first wins.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)(?:href|src|action)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def host_of(url: str | Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: str | Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_columns(rules: list[tuple[str, str, str]], host: str = "host", path: str = "path") -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null if none does."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col(host) == h) | F.col(host).endswith("." + h)) & F.col(path).startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Links between different hosts: source, target, n."""
    targets = F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(_LINK), 1), lambda x: F.translate(x, _UPPER, _LOWER))))
    links = pages.select(host_of(F.col(url)).alias("source"), targets.alias("target"))
    return links.filter("source != '' and source != target").groupBy("source", "target").agg(F.count("*").alias("n"))


def spread(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """Trust and distrust of hosts (``host``, ``trust``, ``distrust``), each adding up to 1 unless no host is a seed. ``seeds`` has host and the
    weights ``allowed`` and ``blocked``."""
    ways = edges.select(F.lit("trust").alias("kind"), F.col("source").alias("from"), F.col("target").alias("to"), "n").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("target").alias("from"), F.col("source").alias("to"), "n"))
    out = ways.groupBy("kind", "from").agg(F.sum("n").alias("total"))
    ways = common.stored(ways.join(out, ["kind", "from"]).select("kind", "from", "to", (F.col("n") / F.col("total")).alias("share")))
    both = seeds.select(F.lit("trust").alias("kind"), "host", F.col("allowed").alias("w")).unionByName(seeds.select(F.lit("distrust").alias("kind"), "host", F.col("blocked").alias("w")))
    totals = F.broadcast(both.groupBy("kind").agg(F.sum("w").cast("double").alias("total")))  # two rows
    start = common.stored(both.filter("w > 0").join(totals, "kind").select("kind", "host", (F.col("w") / F.col("total")).alias("seed")))
    # Walks are added up as steps: each round moves what arrived in the round before.
    moving = start.select("kind", "host", (F.col("seed") * (1 - damping)).alias("mass"))
    ranks = moving
    for _ in range(rounds):
        step = moving.withColumnRenamed("host", "from").join(ways, ["kind", "from"]).groupBy("kind", F.col("to").alias("host")).agg(
            (F.sum(F.col("mass") * F.col("share")) * damping).alias("mass"))
        moving = common.stored(step)
        if (moving.agg(F.sum("mass")).first()[0] or 0.0) < tolerance:
            break
        ranks = common.stored(ranks.unionByName(moving).groupBy("kind", "host").agg(F.sum("mass").alias("mass")))
    sums = F.broadcast(ranks.groupBy("kind").agg(F.sum("mass").alias("all")))  # two rows
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("mass") / F.col("all"))), F.lit(0.0))
    return ranks.join(sums, "kind").groupBy("host").agg(of("trust").alias("trust"), of("distrust").alias("distrust"))


def judged(pages: DataFrame, rules: list[tuple[str, str, str]], key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Every page: its id, host, path, rule, verdict, and its host's trust and distrust."""
    rule, verdict = rule_columns(rules)
    placed = pages.select(F.col(key).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")).select(
        "page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"))
    seeds = common.stored(placed.filter("by_rule is not null and host != ''").groupBy("host").agg(
        F.count_if(F.col("by_rule") == "allow").alias("allowed"), F.count_if(F.col("by_rule") == "block").alias("blocked")))
    hosts = spread(common.stored(host_edges(pages, url, html)), seeds)
    method = F.when(F.coalesce(F.col("distrust") > SHARE * (F.col("trust") + F.col("distrust")), F.lit(False)), "block").otherwise("allow")
    return placed.join(hosts, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("by_rule", method).alias("verdict"),
                                                     F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op2_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)
