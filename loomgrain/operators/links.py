"""Link relations and usage rights of pages, from the parsed links and metas."""

from __future__ import annotations

import urllib.parse

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CRAWLERS = "googlebot googlebot-news googlebot-image googlebot-video google-extended bingbot msnbot slurp yandex baiduspider duckduckbot applebot gptbot ccbot".split()
#: Relations of which a page's first address counts.
_SINGLE = ("next", "prev", "amphtml", "manifest")
_FEEDS = {"application/rss+xml": "rss", "application/atom+xml": "atom", "application/feed+json": "json"}


@F.pandas_udf(T.StringType())
def joined(base: pd.Series, address: pd.Series) -> pd.Series:
    """An address seen from a base; as it is where the two don't join."""

    def one(b: str | None, a: str | None) -> str | None:
        if a is None:
            return None
        a = a.strip(" \t\n\r\f").replace("\t", "").replace("\n", "").replace("\r", "")
        try:
            return urllib.parse.urljoin(b or "", a)
        except ValueError:
            return a

    return pd.Series([one(b, a) for b, a in zip(base, address)], dtype=object)


def _rels(rel: Column) -> Column:
    return F.split(F.lower(F.trim(F.coalesce(rel, F.lit("")))), r"\s+")


def relations(parsed: DataFrame) -> DataFrame:
    """page_id, ord, tag, rel (one word each), address, type, hreflang, title, in_head of links with a relation."""
    rows = parsed.select("page_id", "base", F.explode("links").alias("l")).select("page_id", "base", "l.*")
    rows = rows.where("rel is not null").where(~F.trim("href").rlike(r"^(?:#|javascript:|$)"))
    rows = rows.select("page_id", "ord", "tag", F.explode(F.array_distinct(_rels(F.col("rel")))).alias("rel"), joined("base", "href").alias("address"), "type", "hreflang", "title", "in_head")
    return rows.where("rel <> ''")


def links(parsed: DataFrame) -> DataFrame:
    """page_id, kind and address (and lang) of canonical, next, prev, amphtml, manifest, alternates, feeds and oEmbed.

    A single relation keeps its first address; a canonical counts in the head alone, and two different ones are ``canonical_conflict``.
    """
    r = relations(parsed)
    link, rel = F.col("tag") == "link", F.when(F.col("rel") == "previous", "prev").otherwise(F.col("rel"))
    mime = F.lower(F.trim(F.split(F.coalesce("type", F.lit("")), ";")[0]))
    spoken = F.trim(F.coalesce("hreflang", F.lit("")))
    alternate = link & (F.col("rel") == "alternate")
    feed = F.create_map(*(F.lit(x) for mime_, name in _FEEDS.items() for x in (mime_, f"feed_{name}")))
    kind = (
        F.when((rel.isin("next", "prev") & F.col("tag").isin("link", "a")) | (link & rel.isin("amphtml", "manifest")), rel)
        .when(link & F.col("in_head") & (F.col("rel") == "canonical"), "canonical")
        .when(alternate & (spoken != ""), "alternate")
        .when(alternate & mime.isin(*_FEEDS), feed[mime])
        .when(alternate & mime.isin("application/json+oembed", "text/xml+oembed", "application/xml+oembed"), "oembed")
    )
    # one link is of one kind: all kinds are told apart in one aggregate, by what makes two links of a kind the same
    lang = F.when(F.col("kind") == "alternate", spoken)
    told = r.select("page_id", "ord", "address", kind.alias("kind"), "hreflang").where("kind is not null").withColumn("lang", lang)
    each = told.groupBy("page_id", "kind", F.when(~F.col("kind").isin(*_SINGLE), F.col("address")).alias("of"), F.lower("lang").alias("l")).agg(F.min_by(F.struct("address", "lang"), "ord").alias("x"))
    several = (F.col("kind") == "canonical") & (F.count_if(F.col("kind") == "canonical").over(Window.partitionBy("page_id")) > 1)
    return each.select("page_id", F.when(several, "canonical_conflict").otherwise(F.col("kind")).alias("kind"), "x.address", "x.lang")


def rights(parsed: DataFrame) -> DataFrame:
    """page_id, agent and directive of robots metas, TDM reservations and policies, and licence links, each once."""
    m = parsed.select("page_id", F.explode("metas").alias("m")).select("page_id", "m.ord", F.lower(F.trim("m.name")).alias("name"), F.trim(F.regexp_replace("m.content", r"\s+", " ")).alias("content")).where("name is not null and content <> ''")
    directives = m.where(F.col("name").isin("robots", *CRAWLERS)).select("page_id", F.col("name").alias("agent"), F.explode(F.transform(F.split(F.lower("content"), ","), lambda x: F.trim(x))).alias("directive")).where("directive <> ''").distinct()
    tdm = m.where(F.col("name").isin("tdm-reservation", "tdm-policy")).groupBy("page_id", F.col("name").alias("agent")).agg(F.min_by("content", "ord").alias("directive"))
    licences = relations(parsed).where((F.col("rel") == "license") & F.col("tag").isin("a", "link", "area")).select("page_id", F.lit("license").alias("agent"), F.col("address").alias("directive")).distinct()
    return directives.unionByName(tdm).unionByName(licences)


def followed(parsed: DataFrame) -> DataFrame:
    """page_id, ord and address of every link that a crawl may follow, each address once a page, normalised."""
    from loomgrain.functions.scalars import normalised_url

    said_no = parsed.select("page_id", F.exists("metas", lambda m: F.lower(F.trim(m["name"])).isin("robots") & F.arrays_overlap(F.split(F.lower(m["content"]), r"[\s,]+"), F.array(F.lit("nofollow"), F.lit("none")))).alias("no"), "base", "links").where("not coalesce(no, false)")
    rows = said_no.select("page_id", "base", F.explode("links").alias("l")).where(F.col("l.tag").isin("a", "area")).where(~F.array_contains(_rels(F.col("l.rel")), "nofollow"))
    rows = rows.select("page_id", F.col("l.ord").alias("ord"), normalised_url(joined("base", F.col("l.href"))).alias("address")).where("address is not null")
    return rows.groupBy("page_id", "address").agg(F.min("ord").alias("ord"))
