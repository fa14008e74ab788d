"""Facts of a page that its markup states once, read with expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The first title; the markup of a page is scanned lazily up to its end tag only.
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
LANG = r'(?is)<html[^>]*?\slang="([^"]*)"'
H1 = r"(?is)<h1[^>]*>(.*?)</h1>"
NAV_LINK = r'<li><a href="([^"]*)"'
HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def unescaped(text: Column) -> Column:
    """The five entities that XML names; the ampersand last, so that nothing is read twice."""
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def first(html: Column, pattern: str) -> Column:
    """The first group of the first match, null where there is none or it is blank."""
    found = F.trim(F.regexp_replace(F.regexp_extract(html, pattern, 1), r"\s+", " "))
    return F.when(found != "", unescaped(found))


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.lower(url), HOST, 1)
    return F.when(found != "", found)


def site_of(url: Column) -> Column:
    """The host without one leading ``www.``."""
    return F.regexp_replace(host_of(url), r"^www\.", "")


def page_facts(pages: DataFrame) -> DataFrame:
    """page_id, url, host, title, lang, h1 and n_links (links of navigation lists) of every page."""
    return pages.select(
        "page_id",
        "url",
        host_of(F.col("url")).alias("host"),
        first(F.col("html"), TITLE).alias("title"),
        first(F.col("html"), LANG).alias("lang"),
        first(F.col("html"), H1).alias("h1"),
        F.coalesce(F.size(F.regexp_extract_all("html", F.lit(NAV_LINK), 1)).cast("long"), F.lit(0)).alias("n_links"),
    )


def nav_links(pages: DataFrame) -> DataFrame:
    """One row per navigation link: page_id, ord, href."""
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(NAV_LINK), 1)).alias("ord", "href"))


def host_report(pages: DataFrame) -> DataFrame:
    """Per host: pages, distinct titles and the mean number of navigation links."""
    facts = page_facts(pages)
    return facts.groupBy("host").agg(
        F.count("*").alias("n_pages"),
        F.countDistinct("title").alias("n_titles"),
        F.round(F.avg("n_links"), 6).alias("mean_links"),
    )
