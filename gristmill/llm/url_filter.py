"""URL filtering by rules and by trust that spreads over host links, in DataFrame operations only.

Rules name a host with its subdomains and the start of a path; the longest that fits decides. For
pages without a rule the method decides by host: personalised PageRank carries trust along links
from the hosts whose pages rules allow, and distrust against the direction of links from the hosts
whose pages rules block. A host is blocked when its distrust exceeds ``ratio`` times its trust.

Edges are the links to other hosts in the pages, and between a host and the domain above it (both
ways). Masses are whole numbers out of UNITS, and each edge's share is rounded down, so that sums
don't depend on the order of rows and reruns agree.

Defined cases: a null url and one without ``://`` have an empty host and path; an empty host has no
links and gets "allow". More than MAX_RULES rules are refused: they are compiled into one expression. A null page is a page without links; null ids and repeated rows are rows
like others (a repeated page counts its links and seeds twice). Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

#: (verdict, host, start of the path)
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
MAX_RULES = 1000
UNITS = 10**12
LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _folded(column):
    return F.translate(column, UPPER, UPPER.lower())


def with_rules(pages: DataFrame, url_col: str, rules=RULES) -> DataFrame:
    """Add host, path, rule and ruled (the rule's verdict; null without one)."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules; apply them in several calls")
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    parts = pages.withColumn("host", _folded(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))).withColumn("path", F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1))
    rule = verdict = None
    for kind, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, host + path) if rule is None else rule.when(fits, host + path)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    none = F.lit(None).cast("string")
    return parts.withColumn("rule", none if rule is None else rule).withColumn("ruled", none if verdict is None else verdict)


def host_edges(pages: DataFrame, html_col: str) -> DataFrame:
    """(a, b, links) between different hosts: links in pages, and host to domain above and back."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    linked = pages.select(F.col("host").alias("a"), F.explode(F.regexp_extract_all(html, F.lit(LINK), 1)).alias("b")).select("a", _folded("b").alias("b"))
    up = pages.select("host").distinct().select("host", F.split("host", r"\.").alias("labels"))
    up = up.filter("size(labels) > 2").select("host", F.explode(F.expr("transform(sequence(1, size(labels) - 2), k -> struct(array_join(slice(labels, k, size(labels)), '.') AS low, array_join(slice(labels, k + 1, size(labels)), '.') AS high))")).alias("e"))
    up = up.select("e.low", "e.high").distinct()
    both = up.select(F.col("low").alias("a"), F.col("high").alias("b")).union(up.select(F.col("high").alias("a"), F.col("low").alias("b")))
    return linked.union(both).filter("a <> '' AND b <> '' AND a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("links"))


def spread(work: Workspace, edges: DataFrame, seeds: DataFrame, name: str, *, damping_percent: int = 85, steps: int = 12) -> DataFrame:
    """Personalised PageRank of (host, seed) over (a, b, links): (host, mass), after a fixed number of steps."""
    out = edges.groupBy("a").agg(F.sum("links").alias("all_links"))
    shares = work.table(edges.join(out, "a"), f"{name}-edges")
    seeds = work.table(seeds, f"{name}-seeds")
    mass = seeds.select("host", F.col("seed").alias("mass"))
    for step in range(steps):
        sent = shares.join(mass, shares["a"] == mass["host"]).select(F.col("b").alias("host"), F.expr(f"bigint(floor(mass * 1.0D * {damping_percent} * links / (100 * all_links)))").alias("mass"))
        kept = seeds.select("host", F.expr(f"seed * {100 - damping_percent} div 100").alias("mass"))
        mass = work.table(sent.union(kept).groupBy("host").agg(F.sum("mass").alias("mass")), f"{name}-{step}")
        if step:
            work.drop(f"{name}-{step - 1}")
    return mass


def url_verdicts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *, rules=RULES, ratio: float = 1.0, steps: int = 12) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, and the host's trust and distrust (out of UNITS)."""
    work = Workspace(pages.sparkSession)
    judged = with_rules(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")), "url", rules)
    edges = work.table(host_edges(judged, "html"), "edges")
    ruled = work.table(judged.filter("ruled is not null AND host <> ''").groupBy("host", "ruled").agg(F.count(F.lit(1)).alias("pages")), "ruled")

    def seeds(kind: str) -> DataFrame:
        own = ruled.filter(F.col("ruled") == kind)
        total = own.agg(F.sum("pages")).first()[0] or 1
        return own.select("host", F.floor(F.lit(float(UNITS)) * F.col("pages") / F.lit(total)).cast("long").alias("seed"))

    trust = spread(work, edges, seeds("allow"), "trust", steps=steps)
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "links")
    distrust = spread(work, back, seeds("block"), "distrust", steps=steps)
    hosts = trust.select("host", F.col("mass").alias("trust")).join(distrust.select("host", F.col("mass").alias("distrust")), "host", "full")
    hosts = work.table(hosts.select(F.col("host").alias("of"), F.coalesce("trust", F.lit(0)).alias("trust"), F.coalesce("distrust", F.lit(0)).alias("distrust")), "hosts")
    work.keep("hosts")
    found = judged.join(hosts, F.col("host") == F.col("of"), "left")
    own = F.when(F.coalesce("distrust", F.lit(0)) > ratio * F.coalesce("trust", F.lit(0)), "block").otherwise("allow")
    return found.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), F.coalesce("trust", F.lit(0)).alias("trust"), F.coalesce("distrust", F.lit(0)).alias("distrust"))
