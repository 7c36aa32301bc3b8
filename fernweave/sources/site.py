"""Documentation sites over landed pages: sitemaps, robots, and the crawl as a frontier over links."""

from __future__ import annotations

import itertools
import time
import urllib.request
from collections.abc import Sequence
from dataclasses import dataclass
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.markup import page_links
from ..functions.text import any_of, glob_regex, same_site, url_no_fragment
from ..storage import kept


@dataclass(frozen=True)
class CrawlConfig:
    root: str
    include: Sequence[str] = ()
    exclude: Sequence[str] = ()
    max_depth: int | None = 4  # None: without a bound, as is None below
    max_pages: int | None = 300
    delay: float = 0.5
    retries: int = 3
    timeout: float = 30.0


def sitemap_urls(spark: SparkSession, xml: DataFrame) -> DataFrame:
    """(loc, is_index) from sitemap texts (text); what isn't well-formed gives no rows."""
    body = F.regexp_replace("text", r"""\sxmlns(:\w+)?=("[^"]*"|'[^']*')""", "")
    ok = xml.where(F.col("text").rlike(r"(?s)<(urlset|sitemapindex)\b.*</(urlset|sitemapindex)>\s*$")).select(body.alias("x"))
    urls = ok.select(F.explode(F.xpath("x", F.lit("urlset/url/loc/text()"))).alias("loc"), F.lit(False).alias("is_index"))
    return urls.unionByName(ok.select(F.explode(F.xpath("x", F.lit("sitemapindex/sitemap/loc/text()"))).alias("loc"), F.lit(True).alias("is_index"))).withColumn("loc", F.trim("loc"))


def robots(text: str | None) -> RobotFileParser:
    """The rules of a robots.txt; none (an error, or not found) allows all."""
    r = RobotFileParser()
    r.parse((text or "").splitlines())
    return r


def allowed_path(url, cfg: CrawlConfig):
    """Whether a url's path is included, and not excluded."""
    path = F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit("/"))
    ok = any_of([path.rlike(glob_regex(g)) for g in cfg.include]) if cfg.include else F.lit(True)
    return ok & ~any_of([path.rlike(glob_regex(g)) for g in cfg.exclude])


def crawl(pages: DataFrame, cfg: CrawlConfig, seeds: DataFrame | None = None, rules: RobotFileParser | None = None, agent: str = "*") -> DataFrame:
    """(url, depth): the landed pages that a crawl from the root reaches, nearest first, max_pages at most.

    Sitemap urls (seeds: url) stand beside the root at depth 0, and their links are followed too. A depth is one
    join of the whole frontier with the links.
    """
    spark = pages.sparkSession
    known = pages.select(url_no_fragment(F.col("url")).alias("url"), "html").where(same_site(F.col("url"), cfg.root) & allowed_path(F.col("url"), cfg))
    if rules is not None:

        @F.pandas_udf("boolean")
        def may(urls: pd.Series) -> pd.Series:
            return urls.map({u: rules.can_fetch(agent, u) for u in urls.unique()})

        known = known.where(may("url"))
    known = known.dropDuplicates(["url"])
    links = kept(page_links(known).select("url", url_no_fragment(F.col("link")).alias("link")).distinct(), "links")  # pages are parsed once
    known = kept(known.select("url"), "urls")
    start = spark.createDataFrame([(cfg.root.rstrip("/"),), (cfg.root,)], "url string")
    frontier = (start.unionByName(seeds.select("url")) if seeds is not None else start).distinct().join(known.select("url"), "url", "left_semi").select("url", F.lit(0).alias("depth"))
    seen = frontier
    for depth in itertools.count(1) if cfg.max_depth is None else range(1, cfg.max_depth + 1):
        step = links.join(frontier.select("url"), "url").select(F.col("link").alias("url")).distinct().join(known.select("url"), "url", "left_semi").join(seen.select("url"), "url", "left_anti")
        frontier = kept(step.select("url", F.lit(depth).alias("depth")), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen if cfg.max_pages is None else seen.orderBy("depth", "url").limit(cfg.max_pages)


def fetch(url: str, cfg: CrawlConfig, opener=urllib.request.urlopen, sleep=time.sleep) -> bytes | None:
    """A page's bytes; three tries with growing waits, then None. The landing step's only network call."""
    for i in range(cfg.retries):
        try:
            with opener(url, timeout=cfg.timeout) as r:
                return r.read()
        except OSError:
            if i + 1 < cfg.retries:
                sleep(i + 1)
    return None


def text_resources(rows: DataFrame, most: int | None = None) -> DataFrame:
    """Landed resources (ordinal, uri, mime, text) that are text: mime text/* or none; most: the first ones."""
    mime = F.coalesce("mime", F.lit(""))
    out = rows.where(((mime == "") | mime.startswith("text/")) & F.col("text").isNotNull())
    return out.orderBy("ordinal").limit(most) if most is not None else out
