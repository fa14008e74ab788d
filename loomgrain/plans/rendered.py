"""Pages written from the tables, so that what they declare is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrain.sources.tables import spread, table


def money(column: str) -> Column:
    return F.col(column).cast("decimal(12,2)").cast("string")


def filled(template: str, **values: Column) -> Column:
    """``template`` with ``{{name}}`` replaced, as one concat."""
    parts: list[Column] = []
    for k, piece in enumerate(template.split("{{")):
        if k:
            name, _, piece = piece.partition("}}")
            parts.append(values[name])
        if piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)



def parts(spark: SparkSession, sf_dir: str, head: str = "", body: str = "") -> DataFrame:
    """A page for each part, with ``head`` and ``body`` of which {{key}}, {{name}}, {{brand}}, {{type}}, {{size}} and {{price}} are filled."""
    p = spread(table(spark, sf_dir, "part"))
    values = {"key": F.col("p_partkey").cast("string"), "name": F.col("p_name"), "brand": F.col("p_brand"), "type": F.col("p_type"), "size": F.col("p_size").cast("string"), "price": money("p_retailprice")}
    html = filled(f'<!DOCTYPE html><html lang="en"><head><title>{{{{name}}}} | Shop</title>{head}</head><body>{body}</body></html>', **values)
    return p.select(F.col("p_partkey").alias("page_id"), F.concat(F.lit("https://shop.example/p/"), F.col("p_partkey").cast("string")).alias("url"), html.alias("html"))


JSONLD = '<script type="application/ld+json">{"@context":"https://schema.org","@type":"Product","name":"{{name}}","sku":"P{{key}}","brand":{"@type":"Brand","name":"{{brand}}"},"offers":{"@type":"Offer","price":{{price}},"priceCurrency":"USD","availability":"https://schema.org/InStock"}}</script>'
MICRODATA = '<div itemscope itemtype="https://schema.org/Product"><h1 itemprop="name">{{name}}</h1><meta itemprop="sku" content="P{{key}}"><span itemprop="brand">{{brand}}</span><div itemprop="offers" itemscope itemtype="https://schema.org/Offer"><span itemprop="price" content="{{price}}">${{price}}</span><meta itemprop="priceCurrency" content="USD"></div></div>'
RDFA = '<div vocab="https://schema.org/" typeof="Product"><span property="name">{{name}}</span><span property="brand">{{brand}}</span><div property="offers" typeof="Offer"><span property="price" content="{{price}}">x</span></div></div>'
