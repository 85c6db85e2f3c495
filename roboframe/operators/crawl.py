"""Crawl over listings: which pages are reached from roots, and what they link to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import directory_links


def listing_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Listings by their address -> page, link, is_dir, target: links below the listing, resolved against its address."""
    host = F.parse_url(F.col(url), F.lit("HOST"))
    rows = directory_links(pages, html, host).where(F.col(url).isNotNull())
    link = F.regexp_replace(F.col("link"), r"^(\./)+", "")
    base = F.concat(F.rtrim(F.col(url), F.lit("/")), F.lit("/"))
    target = F.when(F.col("link").rlike("^[a-z]+://"), F.col("link")).otherwise(F.concat(base, link))
    rows = rows.where(link != "")
    return rows.select(base.alias("page"), link.alias("link"), link.endswith("/").alias("is_dir"), target.alias("target"))


def crawl(links: DataFrame, roots: DataFrame, depth: int, write: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """links(page, link, is_dir, target), roots(root, page) -> root, page, link, depth: the files that are linked by pages which
    are reached from each root in less than `depth` steps; depth is that of the page, 0 for a root's own.

    A page is visited once for each root, at its least depth, so cycles end. A round is one join of the frontier with the
    links of its pages and an anti-join with what was seen; `write` keeps a table in shared storage and reads it back, so
    that rounds have no lineage. Null ends are ignored; rows that repeat a link count once.
    """
    links = links.where("page IS NOT NULL AND link IS NOT NULL").select("page", "link", "is_dir", "target").distinct()
    links = write(links)
    frontier = write(roots.where("page IS NOT NULL").select("root", "page").distinct().withColumn("depth", F.lit(0)))
    seen = files = None
    for k in range(depth):
        seen = frontier if seen is None else seen.unionByName(frontier)
        met = write(frontier.join(links, "page"))
        found = met.where("NOT is_dir").select("root", "page", "link", "depth").distinct()
        files = found if files is None else files.unionByName(found)
        if k + 1 == depth:
            break
        ahead = met.where("is_dir AND target IS NOT NULL").select("root", F.col("target").alias("page")).distinct()
        frontier = write(ahead.join(seen.select("root", "page"), ["root", "page"], "left_anti").withColumn("depth", F.lit(k + 1)))
        if frontier.isEmpty():
            break
    if files is None:
        return frontier.join(links.where("NOT is_dir"), "page").select("root", "page", "link", "depth").limit(0)
    return files
