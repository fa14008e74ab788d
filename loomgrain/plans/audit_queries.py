"""Queries of the audit, of what pages show, and of their other readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrain.operators import audit, declared, extract, readings
from loomgrain.plans import rendered
from loomgrain.plans.registry import register
from loomgrain.sources.tables import spread, table

_KEY = "{{key}}"


def _products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products without an image; every third has no offer, every fourth an invalid GTIN, every fifth a price with a sign."""
    p = spread(table(spark, sf_dir, "part"))
    offer = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit(',"offers":{"@type":"Offer","price":"'), F.when(F.col("p_partkey") % 5 == 0, "$").otherwise(""), rendered.money("p_retailprice"), F.lit('","priceCurrency":"USD"}')))
    gtin = F.when(F.col("p_partkey") % 4 == 0, "4006381333930").otherwise("4006381333931")
    html = rendered.filled('<html><script type="application/ld+json">{"@context":"https://schema.org","@type":"Product","name":"{{name}}","gtin13":"{{gtin}}","datePublished":"{{day}}"{{offer}}}</script></html>', name=F.col("p_name"), gtin=gtin, offer=offer, day=F.when(F.col("p_size") % 2 == 0, "2024-02-30").otherwise("2024-02-28"))
    return p.select(F.col("p_partkey").alias("page_id"), F.lit("https://x.example/").alias("url"), html.alias("html"))


@register(
    "audit_missing_required",
    """select p_partkey as page_id, unnest(['image', 'offers', 'review|aggregateRating|offers']) as options, unnest(['Merchant listing', 'Merchant listing', 'Product snippet']) as feature from part where p_partkey % 3 = 0
 union all select p_partkey, 'image', 'Merchant listing' from part where p_partkey % 3 <> 0""",
)
def audit_missing_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audit.missing(extract.extract(_products(spark, sf_dir), ("jsonld",), ("records",)))
    return found.where("level = 'required'").select("page_id", "options", "feature")


@register("audit_verdicts", "select p_partkey as page_id, 'Product snippet' as feature, case when p_partkey % 3 = 0 then 'ineligible' else 'improvable' end as verdict from part union all select p_partkey, 'Merchant listing', 'ineligible' from part")
def audit_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.features(extract.extract(_products(spark, sf_dir), ("jsonld",), ("records",))).drop("ix")


@register(
    "audit_wrong_values",
    """select p_partkey as page_id, 'gtin13' as path, '4006381333930' as value, 'gtin' as "check" from part where p_partkey % 4 = 0
 union all select p_partkey, 'offers.price', '$' || cast(cast(p_retailprice as decimal(12,2)) as varchar), 'price' from part where p_partkey % 5 = 0 and p_partkey % 3 <> 0
 union all select p_partkey, 'datePublished', '2024-02-30', 'date' from part where p_size % 2 = 0""",
)
def audit_wrong_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.wrong_values(extract.paths(extract.record_fields(extract.extract(_products(spark, sf_dir), ("jsonld",), ("records",))))).drop("ix")


@register(
    "audit_conflicts",
    """select p_partkey as page_id, 'Product' as type, 'price' as fact, cast(cast(p_retailprice as decimal(12,2)) as varchar) as one, '7' as other from part
 union all select p_partkey, 'Product', 'name', p_name, 'other' from part where p_partkey % 2 = 0""",
)
def audit_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON-LD against microdata; a currency that both give alike is no conflict."""
    p = spread(table(spark, sf_dir, "part"))
    body = '<div itemscope itemtype="https://schema.org/Product"><b itemprop="name">{{other}}</b><div itemprop="offers" itemscope itemtype="https://schema.org/Offer"><i itemprop="price">7</i><meta itemprop="priceCurrency" content="usd"></div></div>'
    html = rendered.filled(f"<html>{rendered.JSONLD}{body}</html>", key=F.col("p_partkey").cast("string"), name=F.col("p_name"), brand=F.col("p_brand"), price=rendered.money("p_retailprice"), other=F.when(F.col("p_partkey") % 2 == 0, "other").otherwise(F.upper("p_name")))
    pages = p.select(F.col("p_partkey").alias("page_id"), F.lit("https://x.example/").alias("url"), html.alias("html"))
    return audit.contradictions(declared.items(declared.parse(pages, ("jsonld", "microdata"))))


@register(
    "page_findings",
    """select page_id, unnest(['missing-description', 'missing-canonical', 'missing-opengraph', 'missing-opengraph', 'missing-opengraph', 'missing-opengraph']) as code, unnest([null, null, 'og:title', 'og:type', 'og:image', 'og:url']) as value from pages
 union all select page_id, 'missing-title', null from pages where nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') is null""",
)
def page_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.page_findings(declared.parse(table(spark, sf_dir, "pages"), ()))


@register("llms_links", "select 's' || p_partkey as site, 'Brands' as section, p_brand as name, '/b/' || p_partkey as address, 'about ' || p_type as note from part")
def llms_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = rendered.filled("# {{name}}\n\n> Summary\n\n## Brands\n\n- [{{brand}}](/b/{{key}}): about {{type}}\nnot a link\n", name=F.col("p_name"), brand=F.col("p_brand"), key=F.col("p_partkey").cast("string"), type=F.col("p_type"))
    return audit.llms_txt(table(spark, sf_dir, "part").select(F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("site"), text.alias("text"))).drop("ord")


@register(
    "visible_guesses",
    """select p_partkey as page_id, 'title' as question, p_name as value, 'sole-h1' as rule from part union all select p_partkey, 'author', 'Ada Lovelace', 'byline' from part
 union all select p_partkey, 'published', '2024-03-0' || (p_partkey % 9 + 1), 'time' from part where p_size % 2 = 0 union all select p_partkey, 'published', '2023-05-0' || (p_partkey % 9 + 1), 'address' from part where p_size % 2 = 1""",
)
def visible_guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = (F.col("p_partkey") % 9 + 1).cast("string")
    time = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit('<time datetime="2024-03-0'), day, F.lit('">some day</time>'))).otherwise("")
    html = rendered.filled('<html><body><nav><h1>Menu</h1></nav><h1>{{name}}</h1><p class="byline">By Ada Lovelace, Staff</p>{{time}}<p>text</p></body></html>', name=F.col("p_name"), time=time)
    pages = spread(table(spark, sf_dir, "part")).select(F.col("p_partkey").alias("page_id"), F.concat(F.lit("https://x.example/2023/05/0"), day, F.lit("/x")).alias("url"), html.alias("html"))
    return readings.visible(pages).drop("place")


@register("page_markdown", "select p_partkey as page_id, '# ' || p_name || chr(10) || chr(10) || 'By [' || p_brand || '](https://x.example/b) **now**' || chr(10) || chr(10) || '- ' || p_type || chr(10) || '- two' as markdown from part")
def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = rendered.filled('<html><body><nav>menu</nav><article><h1>{{name}}</h1><p>By <a href="/b">{{brand}}</a> <b>now</b></p><ul><li>{{type}}<li>two</ul><script>x()</script></article><footer>f</footer></body></html>', name=F.col("p_name"), brand=F.col("p_brand"), type=F.col("p_type"))
    pages = spread(table(spark, sf_dir, "part")).select(F.col("p_partkey").alias("page_id"), F.lit("https://x.example/a").alias("url"), html.alias("html"))
    return readings.as_markdown(pages)


@register("syntax_counts", "select syntax, case syntax when 'json-ld' then n when 'opengraph' then n else 0 end as n_items from (select count(*) as n from part), (select unnest(['json-ld', 'microdata', 'opengraph', 'microformat', 'rdfa', 'dublincore']) as syntax)")
def syntax_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = rendered.parts(spark, sf_dir, rendered.JSONLD + '<meta property="og:title" content="{{name}}">')
    found = readings.by_syntax(pages)
    return found.groupBy("syntax").agg(F.sum(F.json_array_length("items")).cast("long").alias("n_items"))


_CRUMBS = '{"@type":"BreadcrumbList","itemListElement":[{"@type":"ListItem","position":1,"name":"a"{{first}}},{"@type":"ListItem","position":2,"name":"b","item":"/b"},{"@type":"ListItem","position":3,"name":"c"}]}'
_BAKERY = '{"@type":"Bakery","name":"{{name}}","geo":{"@type":"GeoCoordinates","latitude":"1"{{longitude}}},"telephone":"1","priceRange":"$","url":"/","openingHoursSpecification":[{"opens":"08:00","closes":"18:00"},{"opens":"09:00"}]}'
_POST = '{"@type":"LiveBlogPosting","headline":"{{name}}","image":"/i","datePublished":"2024-01-01","dateModified":"2024-01-01","author":[{"@type":"Person","name":"A","url":"/a"},{"@type":"Organization","name":"B"},{"@type":"Thing","name":"C"}]}'


@register(
    "audit_conditions",
    """select p_partkey as page_id, 'Breadcrumb' as feature, 'required' as level, 'itemListElement[0]' as under, 'item' as options from part where p_partkey % 3 = 0
 union all select p_partkey, 'Local business', 'recommended', 'geo', 'longitude' from part where p_partkey % 2 = 0
 union all select p_partkey, 'Local business', 'recommended', 'openingHoursSpecification[1]', 'closes' from part
 union all select p_partkey, 'Local business', 'required', '', 'address' from part
 union all select p_partkey, 'Organization', 'recommended', '', unnest(['logo', 'address', 'sameAs']) from part
 union all select p_partkey, 'Article', 'recommended', 'author[1]', 'url' from part
 union all select p_partkey, 'Discussion forum', 'recommended', unnest(['', 'author[1]', 'author[2]']), 'url' from part""",
)
def audit_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Needs of all but a list's last item, of values that have another property or are of a type, and of subtypes (a bakery, a live blog)."""
    p = spread(table(spark, sf_dir, "part"))
    html = rendered.filled(
        f'<html><script type="application/ld+json">{{"@context":"https://schema.org","@graph":[{_CRUMBS},{_BAKERY},{_POST}]}}</script></html>', name=F.col("p_name"),
        first=F.when(F.col("p_partkey") % 3 == 0, "").otherwise(',"item":"/a"'), longitude=F.when(F.col("p_partkey") % 2 == 0, "").otherwise(',"longitude":"2"'),
    )
    pages = p.select(F.col("p_partkey").alias("page_id"), F.lit("https://x.example/").alias("url"), html.alias("html"))
    return audit.missing(extract.extract(pages, ("jsonld",), ("records",))).drop("ix")


@register(
    "value_places",
    """select p_partkey as page_id, unnest(['name', 'offers[0].price', 'offers[1].price', 'a/b']) as path, unnest([p_name, '1', p_size::varchar, 'x']) as leaf,
 unnest(['jsonld:0#/name', 'jsonld:0#/offers/0/price', 'jsonld:0#/offers/1/price', 'jsonld:0#/a~1b']) as place from part""",
)
def value_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(table(spark, sf_dir, "part"))
    html = rendered.filled('<html><script type="application/ld+json">{"@context":"https://schema.org","@type":"Product","name":"{{name}}","a/b":"x","offers":[{"price":1},{"price":"{{size}}"}]}</script></html>', name=F.col("p_name"), size=F.col("p_size").cast("string"))
    pages = p.select(F.col("p_partkey").alias("page_id"), F.lit("https://x.example/").alias("url"), html.alias("html"))
    return extract.places(extract.extract(pages, ("jsonld",), ("records",)), pages).drop("ix")
