"""Queries of the declared-data readers, over pages that are written from ``part``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrain.operators import declared, extract, links
from loomgrain.plans import rendered
from loomgrain.plans.registry import register

_MONEY = "cast(cast(p_retailprice as decimal(12,2)) as varchar)"


def _json(spark: SparkSession, sf_dir: str, reader: str, head: str = "", body: str = "") -> DataFrame:
    pages = rendered.parts(spark, sf_dir, head, body)
    return declared.items(declared.parse(pages)).where(F.col("reader") == reader)


def _value(path: str):
    return F.get_json_object("json", path)


@register(
    "jsonld_product",
    f"select p_partkey as page_id, 'Product' as type, p_name as name, 'P' || p_partkey as sku, p_brand as brand, {_MONEY} as price, 'USD' as currency from part",
)
def jsonld_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _json(spark, sf_dir, "jsonld", rendered.JSONLD)
    return found.select("page_id", F.col("types")[0].alias("type"), _value("$.name").alias("name"), _value("$.sku").alias("sku"), _value("$.brand.name").alias("brand"), _value("$.offers.price").alias("price"), _value("$.offers.priceCurrency").alias("currency"))


@register("jsonld_graph_ref", "select p_partkey as page_id, 'Article' as type, p_name as headline, p_brand as author from part union all select p_partkey, 'Person', null, null from part")
def jsonld_graph_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node that names its author by reference has the author, whichever block defines it."""
    head = (
        '<script type="application/ld+json">{"@context":"https://schema.org","@graph":[{"@type":"Article","headline":"{{name}}","author":{"@id":"#a"}},]}</script>'
        '<script type="application/LD+JSON; charset=utf-8"><!-- {"@context":"http://schema.org","@type":"Person","@id":"#a","name":"{{brand}}"} // the writer\n--></script>'
    )
    found = _json(spark, sf_dir, "jsonld", head)
    return found.select("page_id", F.col("types")[0].alias("type"), _value("$.headline").alias("headline"), _value("$.author.name").alias("author"))


@register("microdata_product", f"select p_partkey as page_id, 'Product' as type, p_name as name, 'P' || p_partkey as sku, p_brand as brand, {_MONEY} as price from part")
def microdata_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _json(spark, sf_dir, "microdata", body=rendered.MICRODATA)
    return found.select("page_id", F.col("types")[0].alias("type"), _value("$.name").alias("name"), _value("$.sku").alias("sku"), _value("$.brand").alias("brand"), _value("$.offers.price").alias("price"))


@register("microdata_itemref", "select p_partkey as page_id, p_name as name, p_brand as brand, cast(p_size as varchar) as size from part")
def microdata_itemref(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = '<p id="x"><b itemprop="brand">{{brand}}</b></p><div itemscope itemtype="http://schema.org/Thing" itemref="x y"><i itemprop="name">{{name}}</i></div><data id="y" itemprop="size" value="{{size}}">s</data>'
    found = _json(spark, sf_dir, "microdata", body=body)
    return found.select("page_id", _value("$.name").alias("name"), _value("$.brand").alias("brand"), _value("$.size").alias("size"))


@register("rdfa_product", f"select p_partkey as page_id, 'Product' as type, p_name as name, p_brand as brand, {_MONEY} as price from part")
def rdfa_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _json(spark, sf_dir, "rdfa", body=rendered.RDFA)
    return found.select("page_id", F.col("types")[0].alias("type"), _value("$.name").alias("name"), _value("$.brand").alias("brand"), _value("$.offers.price").alias("price"))


@register("microformats_card", "select p_partkey as page_id, 'h-card' as type, p_name as name, p_brand as org, 'https://shop.example/u/' || p_partkey as url from part")
def microformats_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = '<div class="h-card"><a class="p-name u-url" href="/u/{{key}}">{{name}}</a> of <span class="p-org">{{brand}}</span></div>'
    found = declared.items(declared.parse(rendered.parts(spark, sf_dir, body=body), ("microformats",)))
    return found.select("page_id", F.col("types")[0].alias("type"), _value("$.name").alias("name"), _value("$.org").alias("org"), _value("$.url").alias("url"))


_OG = (
    '<meta property="og:title" content="{{name}}"><meta property="OG:Title" content="second"><meta property="og:image" content="/a{{key}}.jpg"><meta property="og:image:width" content="{{size}}">'
    '<meta property="og:image" content="/b{{key}}.jpg"><meta property="og:image:height" content="9"><meta property="article:tag" content="{{brand}}"><meta property="article:tag" content="{{type}}"><meta name="twitter:card" content="summary">'
    '<meta name="twitter:title" content="T {{name}}"><meta name="DC.title" content="D {{name}}"><meta name="dcterms.issued" content="2020-01-02"><meta name="Description" content=" {{brand}} {{type}} "><meta name="viewport" content="x"><meta name="author" content="">'
)


@register(
    "opengraph_flat",
    """select p_partkey as page_id, 'opengraph' as reader, unnest(['title', 'image', 'image:width', 'article:tag']) as key, unnest([p_name, '/a' || p_partkey || '.jpg', cast(p_size as varchar), p_brand]) as value from part""",
)
def opengraph_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return declared.opengraph(declared.parse(rendered.parts(spark, sf_dir, _OG), ()))


@register(
    "og_arrays",
    """select p_partkey as page_id, unnest(['title', 'image', 'article:tag']) as key,
 unnest(['"' || p_name || '"', '[{"url":"/a' || p_partkey || '.jpg","width":"' || p_size || '"},{"height":"9","url":"/b' || p_partkey || '.jpg"}]', '["' || p_brand || '","' || p_type || '"]']) as value from part""",
)
def og_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return declared.opengraph_arrays(declared.parse(rendered.parts(spark, sf_dir, _OG), ()))


@register("twitter_card", "select p_partkey as page_id, 'twitter' as reader, unnest(['card', 'title']) as key, unnest(['summary', 'T ' || p_name]) as value from part")
def twitter_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return declared.twitter(declared.parse(rendered.parts(spark, sf_dir, _OG), ()))


@register("dublin_core", "select p_partkey as page_id, 'dublincore' as reader, unnest(['title', 'issued']) as key, unnest(['D ' || p_name, '2020-01-02']) as value from part")
def dublin_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    return declared.dublin_core(declared.parse(rendered.parts(spark, sf_dir, _OG), ()))


@register("html_meta", "select p_partkey as page_id, 'html' as reader, 'description' as key, p_brand || ' ' || p_type as value from part")
def html_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return declared.html_meta(declared.parse(rendered.parts(spark, sf_dir, _OG), ()))


_LINKS = (
    '<link rel="canonical" href="/p/{{key}}?x"><link rel="alternate" hreflang="de" href="/de/{{key}}"><link rel="alternate" type="application/rss+xml" href="feed.xml"><link rel="amphtml" href="/amp/{{key}}">'
    '<link rel="next" href="/p/n{{key}}"><meta name="robots" content="NoIndex, follow"><meta name="googlebot" content="nosnippet"><meta name="tdm-reservation" content="1"><link rel="license" href="https://l.example/{{size}}">'
)


@register(
    "link_relations",
    """select p_partkey as page_id, unnest(['canonical', 'alternate', 'feed_rss', 'amphtml', 'next', 'prev']) as kind,
 unnest(['https://shop.example/p/' || p_partkey || '?x', 'https://shop.example/de/' || p_partkey, 'https://shop.example/p/feed.xml', 'https://shop.example/amp/' || p_partkey, 'https://shop.example/p/n' || p_partkey, 'https://shop.example/p/first']) as address,
 unnest([null, 'de', null, null, null, null]) as lang from part""",
)
def link_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = rendered.parts(spark, sf_dir, _LINKS, '<link rel="canonical" href="/other"><a rel="prev nofollow" href="first">b</a><a rel="previous" href="later">c</a>')
    return links.links(declared.parse(pages, ()))


@register(
    "usage_rights",
    """select p_partkey as page_id, unnest(['robots', 'robots', 'googlebot', 'tdm-reservation', 'license']) as agent, unnest(['noindex', 'follow', 'nosnippet', '1', 'https://l.example/' || p_size]) as directive from part""",
)
def usage_rights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.rights(declared.parse(rendered.parts(spark, sf_dir, _LINKS), ()))


# --- folding: JSON-LD has a name where the key isn't a multiple of 3, microdata a name and a brand, OpenGraph a title

_FOLD_HEAD = '<script type="application/ld+json">{"@context":"https://schema.org","@type":"Product","name":"{{name}}","sku":"P{{key}}"}</script><meta property="og:title" content="{{type}}"><meta property="og:sku" content="no">'
_FOLD_BODY = '<div itemscope itemtype="https://schema.org/Product"><b itemprop="name">{{name}}</b><i itemprop="brand">{{brand}}</i><u itemprop="sku">Q{{size}}</u></div><div itemscope itemtype="https://schema.org/Product"><b itemprop="name">other</b></div>'


@register(
    "merge_precedence",
    """select p_partkey as page_id, unnest([0, 0, 0, 0, 1]) as ix, 'Product' as type, unnest(['name', 'sku', 'brand', 'title', 'name']) as key,
 unnest([p_name, 'P' || p_partkey, p_brand, p_type, 'other']) as value, unnest(['jsonld', 'jsonld', 'microdata', 'opengraph', 'microdata']) as source from part""",
)
def merge_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of records: earlier readers win, later ones fill gaps, and a second item of a vocabulary is a second record."""
    return extract.record_fields(extract.extract(rendered.parts(spark, sf_dir, _FOLD_HEAD, _FOLD_BODY), parts=("records",)))


@register("overruled_values", "select p_partkey as page_id, 0 as ix, 'price' as key, cast(p_size as varchar) as value, 'microdata' as source from part")
def overruled_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a fold of one thing set aside."""
    head = '<script type="application/ld+json">{"@context":"https://schema.org","@type":"Offer","name":"{{name}}","price":"x{{price}}"}</script>'
    body = '<div itemscope itemtype="https://schema.org/Offer"><b itemprop="name"> {{name}} </b><u itemprop="price">{{size}}</u></div>'
    found = extract.extract(rendered.parts(spark, sf_dir, head, body), parts=("aside",))
    return found.select("page_id", F.explode("aside").alias("a")).select("page_id", "a.*")


@register(
    "record_paths",
    f"""select p_partkey as page_id, 0 as ix, unnest(['name', 'sku', 'brand', 'brand', 'offers', 'offers', 'offers', 'offers']) as key,
 unnest(['name', 'sku', 'brand.@type', 'brand.name', 'offers.@type', 'offers.price', 'offers.priceCurrency', 'offers.availability']) as path, unnest([p_name, 'P' || p_partkey, 'Brand', p_brand, 'Offer', {_MONEY}, 'USD', 'https://schema.org/InStock']) as leaf from part""",
)
def record_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.paths(extract.record_fields(extract.extract(rendered.parts(spark, sf_dir, rendered.JSONLD), parts=("records",))))
