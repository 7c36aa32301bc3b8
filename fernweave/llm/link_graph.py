"""URL filters: fixed rules, and trust and distrust propagated over the graph of hosts.

A page's url is judged by the longest rule that fits; where none does, by its host. Trust is
personalised PageRank over links between hosts from the pages that rules allow; distrust is the same
over the reversed links from the pages that rules block: who links to the blocked is distrusted. A
host is blocked if its distrust exceeds its trust and `RATIO` times its share of all pages.

Links of a page are reduced to hosts and counts before the shuffle, so the graph is one row a pair of
hosts, however many pages a host has. Both propagations are one table and one loop; each round is a
table in the shared folder and rounds are fixed, so the result doesn't depend on a tolerance.

Defined cases: a null url or one without `://` has empty host and path, and fits no rule; null html
has no links; a link without host is to the page's own host; masses are compared by 12 digits, so that reruns agree; mass of hosts without links and of empty
seeds goes back to the seeds; hosts that occur in links only carry mass but have no page; equal rows
are pages of their own; without pages there are no rows; of equally long rules the first listed wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_written, lower_ascii, read, written

#: (verdict, host, path), fixed by the contract of the query.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
DAMPING, ROUNDS, RATIO = 0.85, 8, 2.0
HREF = r"""(?i)href\s*=\s*["']?([^"'\s>]+)"""


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]], what: int) -> Column:
    """The rule's text (what 1) or verdict (what 0), or null. Rules are a short list given by the caller."""
    out = F.lit(None).cast("string")
    for v, h, p in reversed(sorted(rules, key=lambda r: -len(r[1] + r[2]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.lit(h + p if what else v)).otherwise(out)
    return out


def parsed(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, html, host, path, rule, by_rule)."""
    host, path = host_path(F.col("url"))
    out = pages.select("page_id", "html", host.alias("host"), path.alias("path"))
    return out.select("*", longest_rule(F.col("host"), F.col("path"), rules, 1).alias("rule"), longest_rule(F.col("host"), F.col("path"), rules, 0).alias("by_rule"))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between hosts, counted."""
    to = r"transform(regexp_extract_all(html, '{0}', 1), x -> regexp_extract(x, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1))".format(HREF.replace("\\", "\\\\").replace("'", "\\'"))
    links = pages.where("html is not null").select(F.col("host").alias("src"), F.explode(F.expr(to)).alias("dst"))
    links = links.withColumn("dst", F.when(F.col("dst") == "", F.col("src")).otherwise(lower_ascii(F.col("dst"))))
    return links.groupBy("src", "dst").agg(F.count("*").cast("double").alias("n"))


def propagated(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(kind, host, mass) after the rounds. edges (kind, src, dst, n); seeds (kind, host, seed), which sum to 1 a kind or are none."""
    out = edges.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    moves = written(edges.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("all")).alias("share")), "moves")
    seeds = written(seeds, "seeds")
    mass = seeds.select("kind", "host", F.col("seed").alias("mass"))
    for i in range(rounds):
        flow = moves.join(mass.select("kind", F.col("host").alias("src"), "mass"), ["kind", "src"]).groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.col("mass") * F.col("share") * damping).alias("flow"))
        flow = written(flow, "flow")
        sums = {r["kind"]: r["s"] for r in flow.groupBy("kind").agg(F.sum("flow").alias("s")).collect()}  # two rows
        back = F.lit(1.0) - F.when(F.col("kind") == 0, F.lit(sums.get(0, 0.0))).otherwise(F.lit(sums.get(1, 0.0)))
        new = seeds.join(flow, ["kind", "host"], "full").select("kind", "host", (F.coalesce(F.col("seed") * back, F.lit(0.0)) + F.coalesce("flow", F.lit(0.0))).alias("mass"))
        new, was = written(new, "mass"), mass
        drop_written(flow)
        if i:
            drop_written(was)
        mass = new
    return mass


def host_verdicts(pages: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, ratio: float = RATIO) -> DataFrame:
    """(host, blocked, trust, distrust) for the hosts of parsed pages."""
    hosts = written(pages.groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("by_rule") == "allow").alias("a"), F.count_if(F.col("by_rule") == "block").alias("b")), "hosts")
    sums = hosts.agg(F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    if not sums["n"]:
        return hosts.select("host", F.lit(False).alias("blocked"), F.lit(0.0).alias("trust"), F.lit(0.0).alias("distrust"))
    seeds = hosts.where("a > 0").select(F.lit(0).alias("kind"), "host", (F.col("a") / F.lit(float(sums["a"] or 1))).alias("seed")).unionByName(hosts.where("b > 0").select(F.lit(1).alias("kind"), "host", (F.col("b") / F.lit(float(sums["b"] or 1))).alias("seed")))
    e = written(host_edges(pages), "edges")
    edges = e.select(F.lit(0).alias("kind"), "src", "dst", "n").unionByName(e.select(F.lit(1).alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    mass = propagated(edges, seeds, damping, rounds)
    side = mass.groupBy("host").agg(F.sum(F.when(F.col("kind") == 0, F.col("mass"))).alias("trust"), F.sum(F.when(F.col("kind") == 1, F.col("mass"))).alias("distrust"))
    out = hosts.join(side, "host", "left").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"), (F.col("n") / F.lit(float(sums["n"]))).alias("share"))
    near = lambda c: F.round(c, 12)  # noqa: E731  sums of doubles depend on the order of tasks in their last digits
    blocked = (near(F.col("distrust")) > near(F.col("trust"))) & (near(F.col("distrust")) > near(F.lit(ratio) * F.col("share")))
    return out.select("host", blocked.alias("blocked"), "trust", "distrust")


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each page."""
    p = parsed(pages, rules)
    v = host_verdicts(p).select("host", "blocked")
    by_host = F.when(F.coalesce("blocked", F.lit(False)), F.lit("block")).otherwise(F.lit("allow"))
    return p.drop("html").join(v, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_host).alias("verdict"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
