"""URL filters: host and path rules, and link-graph propagation where no rule fits. DataFrame expressions only.

Host edges are the absolute links of pages and the ties between a host and the next host above it that the pages or
links know; a domain that is no host itself, such as a public suffix, ties nothing. Trust is a personalised PageRank
from hosts with allowed pages along the edges, distrust one from hosts with blocked pages against them. Ranks are whole
numbers, so that a result depends on no order of summation. After r rounds all ranks together are within 2 * 0.85**r of
their limit, whatever the graph; ``ROUNDS`` makes that less than ``TOLERANCE``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.shared import discard, staged

RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
MASS = 4 * 10**18
DAMPING = 85
TOLERANCE = 1e-4
ROUNDS = math.ceil(math.log(TOLERANCE / 2) / math.log(DAMPING / 100))  # 61
STEP = 4
LEAST_LABELS = 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """The longest rule ``(verdict, host, path)`` that fits, as struct ``(rule, verdict)``; a block rule at a tie."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1:]))
    texts = F.array(*(F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in ordered))
    fits = F.filter(
        texts, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"])
    )
    first = F.get(fits, F.lit(0))
    return F.when(first.isNotNull(), F.struct(F.concat(first["host"], first["path"]).alias("rule"), first["verdict"].alias("verdict")))


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html", least_labels: int = LEAST_LABELS) -> DataFrame:
    """Distinct ``(src, dst)`` hosts: absolute links in ``href`` attributes, and ties both ways between a host and the
    longest other one of at least ``least_labels`` labels that it ends in. Empty hosts and loops are left out."""
    link = r"""(?i)href\s*=\s*["']?\s*([a-z][a-z0-9+.-]*://[^/?#"'\s>]+)"""
    found = F.transform(F.regexp_extract_all(F.coalesce(F.col(f"`{html_col}`"), F.lit("")), F.lit(link), F.lit(1)), host_of)
    both = pages.select(host_of(F.col(f"`{url_col}`")).alias("src"), F.array_distinct(found).alias("dsts"))
    links = staged(both.select("src", F.explode_outer("dsts").alias("dst")).distinct(), "host-links")
    hosts = links.select(F.col("src").alias("host")).union(links.select("dst")).filter("host <> ''").distinct()
    labels = F.split("host", r"\.")
    above = F.transform(
        F.when(F.size(labels) > least_labels, F.sequence(F.lit(2), F.size(labels) - least_labels + 1)).otherwise(F.array().cast("array<int>")),
        lambda k: F.struct(k.alias("k"), F.array_join(F.slice(labels, k, F.size(labels)), ".").alias("high")),
    )
    known = hosts.select("host", F.explode(above).alias("t")).select("host", "t.k", "t.high").join(hosts.withColumnRenamed("host", "high"), "high")
    ties = known.groupBy("host").agg(F.min_by("high", "k").alias("high")).select(F.col("host").alias("low"), "high")
    all_edges = links.union(ties.select("low", "high")).union(ties.select("high", "low"))
    return all_edges.filter("src <> '' and dst <> '' and src <> dst").distinct()


def seeds(ruled: DataFrame) -> DataFrame:
    """``(kind, host, weight)``: for each host the thousandths of its pages that rules allow (trust) or block (distrust)."""
    share = lambda v: (1000 * F.count_if(F.col("verdict") == v)).cast("long")
    counted = ruled.filter("host <> ''").groupBy("host").agg(F.count("*").alias("n"), share("allow").alias("a"), share("block").alias("b"))
    both = F.array(
        F.struct(F.lit("trust").alias("kind"), F.expr("a div n").alias("weight")),
        F.struct(F.lit("distrust").alias("kind"), F.expr("b div n").alias("weight")),
    )
    return counted.select("host", F.explode(both).alias("s")).select("s.kind", "host", "s.weight").filter("weight > 0")


def propagated(edges: DataFrame, seeded: DataFrame, rounds: int = ROUNDS, damping: int = DAMPING) -> DataFrame:
    """``(kind, host, rank)``: both ranks after ``rounds`` steps, of a total of at most ``MASS`` each."""
    ways = edges.select(F.lit("trust").alias("kind"), "src", "dst").union(edges.select(F.lit("distrust"), "dst", "src"))
    degrees = ways.groupBy("kind", "src").agg(F.count("*").alias("degree"))
    ways = staged(ways.join(degrees, ["kind", "src"]), "host-ways")
    totals = seeded.groupBy("kind").agg(F.sum("weight").alias("total"))
    base = seeded.join(F.broadcast(totals), "kind")  # two rows
    base = staged(base.select("kind", "host", F.expr(f"weight * ({MASS} div total)").alias("rank")), "base-ranks")
    restart = base.select("kind", "host", F.expr(f"rank div 100 * {100 - damping}").alias("rank"))
    now, cut = base, []
    for k in range(1, rounds + 1):
        sent = ways.join(now.withColumnRenamed("host", "src"), ["kind", "src"])
        sent = sent.select("kind", F.col("dst").alias("host"), F.expr(f"rank div 100 * {damping} div degree").alias("rank"))
        now = restart.union(sent).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        if k % STEP == 0 or k == rounds:  # the plan is cut every few steps
            now = staged(now, "ranks")
            discard(*cut)
            cut = [now]
    return now


def judged(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    rules: tuple[tuple[str, str, str], ...] = RULES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """``(id, host, path, rule, verdict, trust, distrust)`` for every page.

    The verdict is the rule's; without one, a page is blocked if its host's distrust is over its trust. Null urls
    and urls without ``://`` have an empty host, no rule and no rank, and are allowed, as is a host whose trust and
    distrust are equal. Repeated rows are judged each.
    """
    url = F.col(f"`{url_col}`")
    ruled = pages.select(F.col(f"`{id_col}`").alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    ruled = ruled.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).select("id", "host", "path", "r.rule", "r.verdict")
    ruled = staged(ruled, "ruled-pages")
    edges = staged(host_edges(pages, url_col, html_col), "host-edges")
    ranks = propagated(edges, seeds(ruled), rounds)
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0)).alias(kind)
    hosts = staged(ranks.groupBy("host").agg(of("trust"), of("distrust")), "host-ranks")
    discard(edges)
    out = ruled.join(hosts, "host", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("trust", "distrust")})
    method = F.when(F.col("distrust") > F.col("trust"), "block").otherwise("allow")
    return out.select("id", "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"), "trust", "distrust")
