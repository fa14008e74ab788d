"""Queries of the fixed questions, their meanings and contradictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrain.functions import scalars
from loomgrain.operators import extract
from loomgrain.plans import rendered
from loomgrain.plans.registry import register
from loomgrain.sources.tables import spread, table

_MONEY = "cast(cast(p_retailprice as decimal(12,2)) as varchar)"
_URL = "'https://shop.example/p/' || p_partkey"


@register(
    "summary_wide",
    f"""select p_partkey as page_id, p_name as title, 'About ' || p_brand as description, {_URL} as url, 'en' as language, 'Shop' as site_name, 'Product' as type, {_MONEY} as price, 'USD' as currency, 'InStock' as availability,
 p_brand as brand, 'P' || p_partkey as sku from part""",
)
def summary_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = rendered.JSONLD + '<link rel="canonical" href="/p/{{key}}"><meta name="description" content="About {{brand}}"><meta property="og:site_name" content="Shop"><meta property="og:title" content="not this">'
    found = extract.summary(extract.extract(rendered.parts(spark, sf_dir, head), parts=("candidates",)))
    return found.select("page_id", "title", "description", "url", "language", "site_name", "type", "price", "currency", "availability", "brand", "sku")


@register(
    "summary_price_range",
    """select l_partkey as page_id, cast(cast(min(l_extendedprice) as decimal(12,2)) as varchar) as price_low, cast(cast(max(l_extendedprice) as decimal(12,2)) as varchar) as price_high, 'EUR' as currency, cast(count(*) as varchar) as rating_count from lineitem group by l_partkey""",
)
def summary_price_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = (f("l_extendedprice").cast("decimal(12,2)").cast("string") for f in (F.min, F.max))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(low.alias("low"), high.alias("high"), F.count("*").cast("string").alias("n"))
    html = rendered.filled(
        '<html><script type="application/ld+json">{"@context":"https://schema.org","@type":"Product","name":"x","offers":{"@type":"AggregateOffer","lowPrice":{{low}},"highPrice":{{high}},"priceCurrency":"EUR"},"aggregateRating":{"ratingValue":4.5,"reviewCount":{{n}}}}</script></html>',
        low=F.col("low"), high=F.col("high"), n=F.col("n"),
    )
    pages = rows.select(F.col("l_partkey").alias("page_id"), F.lit("https://x.example/").alias("url"), html.alias("html"))
    return extract.summary(extract.extract(pages, parts=("candidates",))).select("page_id", "price_low", "price_high", "currency", "rating_count")


@register("summary_breadcrumb", "select p_partkey as page_id, 'Home > ' || p_brand || ' > ' || p_name as breadcrumb from part")
def summary_breadcrumb(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = '<script type="application/ld+json">{"@context":"https://schema.org","@type":"BreadcrumbList","itemListElement":[{"@type":"ListItem","position":3,"name":"{{name}}"},{"@type":"ListItem","position":1,"item":{"@id":"/","name":"Home"}},{"@type":"ListItem","position":"2","name":"{{brand}}"}]}</script>'
    return extract.summary(extract.extract(rendered.parts(spark, sf_dir, head), parts=("candidates",))).select("page_id", "breadcrumb")


@register("summary_sources", f"select p_partkey as page_id, 'price' as question, {_MONEY} as value, 'opengraph' as source, 'product:price:amount' as key from part")
def summary_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A price of two numbers is passed over, and the answer says where it is from."""
    head = '<meta property="product:price:amount" content="{{price}}">'
    body = '<div itemscope itemtype="https://schema.org/Product"><b itemprop="name">n</b><p itemprop="offers" itemscope itemtype="https://schema.org/Offer"><s itemprop="price">{{price}} € 99 €</s></p></div>'
    return extract.summary_long(extract.extract(rendered.parts(spark, sf_dir, head, body), parts=("candidates",))).where("question = 'price'")


_CONFLICT = '<script type="application/ld+json">{"@context":"https://schema.org","@type":"Product","name":"{{name}}","datePublished":"2020-0{{month}}-01T10:00:00Z","offers":{"price":"{{price}}","priceCurrency":"USD"}}</script><meta property="product:price:amount" content="{{other}}"><meta property="article:published_time" content="2020-0{{month2}}-01">'


def _contradicting(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(table(spark, sf_dir, "part"))
    price = rendered.money("p_retailprice")
    other = F.when(F.col("p_partkey") % 7 == 0, (F.col("p_retailprice") + 1).cast("decimal(12,2)").cast("string")).otherwise(F.concat(price, F.lit("0")))
    month = (F.col("p_partkey") % 9 + 1).cast("string")
    month2 = F.when(F.col("p_partkey") % 5 == 0, ((F.col("p_partkey") + 1) % 9 + 1).cast("string")).otherwise(month)
    html = rendered.filled(f"<html><head>{_CONFLICT}</head></html>", name=F.col("p_name"), price=price, other=other, month=month, month2=month2)
    return p.select(F.col("p_partkey").alias("page_id"), F.lit("https://x.example/").alias("url"), html.alias("html"))


@register("conflicts_price", f"select p_partkey as page_id, 'price' as question, [{_MONEY}, cast(cast(p_retailprice + 1 as decimal(12,2)) as varchar)] as answers from part where p_partkey % 7 = 0")
def conflicts_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.conflicts(extract.extract(_contradicting(spark, sf_dir), parts=("aside", "candidates"))).where("question = 'price'")


@register(
    "conflicts_published",
    "select p_partkey as page_id, 'published' as question, ['2020-0' || (p_partkey % 9 + 1) || '-01T10:00:00Z', '2020-0' || ((p_partkey + 1) % 9 + 1) || '-01'] as answers from part where p_partkey % 5 = 0",
)
def conflicts_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.conflicts(extract.extract(_contradicting(spark, sf_dir), parts=("aside", "candidates"))).where("question = 'published'")


@register("normalised_answers", "select p_partkey as page_id, unnest(['price', 'currency']) as question, unnest([cast(cast(p_retailprice as decimal(12,2)) as varchar), 'USD']) as meaning from part")
def normalised_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.normalised(extract.summary_long(extract.extract(rendered.parts(spark, sf_dir, rendered.JSONLD), parts=("candidates",))))


# --- scalars over texts made of the tables


@register("amount_plain", "select o_orderkey as id, cast(cast(o_totalprice as decimal(12,2)) as varchar) as amount from orders")
def amount_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    money = F.format_number(F.col("o_totalprice").cast("decimal(12,2)"), 2)
    german = F.translate(money, ",.", ".,")
    written = F.element_at(F.array(F.concat(F.lit("$"), money), F.concat(german, F.lit(" €")), F.concat(F.lit("EUR "), money), F.replace(F.replace(german, F.lit("."), F.lit(" ")), F.lit("x"), F.lit(""))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return o.select(F.col("o_orderkey").alias("id"), scalars.amount(written).alias("amount"))


@register("amount_unsure", "select p_partkey as id, cast(null as varchar) as amount from part")
def amount_unsure(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(table(spark, sf_dir, "part"))
    written = F.element_at(F.array(F.lit("1,299"), F.lit("1.299"), F.lit("12 50"), F.lit("call us"), F.lit("1,29,000")), (F.col("p_partkey") % 5 + 1).cast("int"))
    return p.select(F.col("p_partkey").alias("id"), scalars.amount(written).alias("amount"))


@register("currency_code", "select p_partkey as id, case p_partkey % 5 when 0 then 'EUR' when 1 then 'GBP' when 2 then null when 3 then 'USD' else null end as currency from part")
def currency_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(table(spark, sf_dir, "part"))
    written = F.element_at(F.array(F.lit(" € "), F.lit("gbp"), F.lit("$"), F.lit("US$"), F.lit("kr")), (F.col("p_partkey") % 5 + 1).cast("int"))
    return p.select(F.col("p_partkey").alias("id"), scalars.currency(written).alias("currency"))


@register(
    "gtin_check",
    """with d as (select p_partkey as id, lpad(cast(p_partkey * 7919 as varchar), 12, '0') as body from part),
 c as (select id, body, (10 - list_sum([cast(substr(body, i, 1) as int) * (case when i % 2 = 0 then 3 else 1 end) for i in range(1, 13)]) % 10) % 10 as digit from d)
 select id, case when id % 3 = 0 then null else body || digit::int end as gtin from c""",
)
def gtin_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third check digit is one too high."""
    body = F.lpad((F.col("p_partkey") * 7919).cast("string"), 12, "0")
    total = sum((F.substring(body, i, 1).cast("int") * (3 if i % 2 == 0 else 1) for i in range(1, 13)), F.lit(0))
    digit = (10 - total % 10) % 10
    digit = F.when(F.col("p_partkey") % 3 == 0, (digit + 1) % 10).otherwise(digit)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), scalars.gtin(F.concat(F.substring(body, 1, 6), F.lit("-"), F.substring(body, 7, 6), F.lit(" "), digit.cast("string"))).alias("gtin"))


@register("iso_date_text", "select o_orderkey as id, strftime(o_orderdate, '%Y-%m-%d') || case o_orderkey % 5 when 0 then 'T08:30:00Z' else '' end as day from orders where o_orderkey % 5 < 4 union all select o_orderkey, null from orders where o_orderkey % 5 = 4")
def iso_date_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    d = F.col("o_orderdate")
    written = F.element_at(
        F.array(F.concat(F.date_format(d, "EEE, dd MMM yyyy"), F.lit(" 08:30:00 GMT")), F.date_format(d, "MMMM d, yyyy"), F.date_format(d, "d MMM yyyy"), F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "MM/dd/yyyy")),
        (F.col("o_orderkey") % 5 + 1).cast("int"),
    )
    return o.select(F.col("o_orderkey").alias("id"), scalars.iso_date(written).alias("day"))


_SHAPE = " || ".join(f"(case when regexp_matches({{0}}, '\\p{{{{{c}}}}}') then '{c}' else '' end)" for c in "LNPS")


@register("shape_of_values", f"select p_partkey as id, {_SHAPE.format('p_brand')} as brand, {_SHAPE.format('p_name')} as name, 'NPS' as price from part")
def shape_of_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), scalars.shape(F.col("p_brand")).alias("brand"), scalars.shape(F.col("p_name")).alias("name"), scalars.shape(F.concat(F.lit("$"), rendered.money("p_retailprice"))).alias("price"))


@register(
    "url_facts",
    r"""select page_id, lower(regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1)) || coalesce(nullif(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), ''), '/') || regexp_extract(url, '^[^?#]*(\?[^#]*)?', 1) as address,
 regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)), '^www\.', '') as site, regexp_extract(lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1)), '\.([^./]*)$', 1) in ('pdf', 'zip', 'jpg', 'png', 'xml') as is_file from pages""",
)
def url_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, u = table(spark, sf_dir, "pages"), F.col("url")
    return p.select("page_id", scalars.normalised_url(u).alias("address"), scalars.site(u).alias("site"), scalars.names_a_file(u).alias("is_file"))


@register(
    "page_table_csv_safe",
    "select event_id, case when event_id % 3 = 0 then '''=' || event_type when event_id % 3 = 1 then cast(round(-value, 2) as varchar) else event_type end as cell from events",
)
def page_table_csv_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.col("event_id") % 3
    cell = F.when(k == 0, F.concat(F.lit("="), F.col("event_type"))).when(k == 1, scalars.rounded(-F.col("value"), 2)).otherwise(F.col("event_type"))
    return e.select("event_id", scalars.formula_safe(cell).alias("cell"))


_VARIANT = """{"@type":"Product","name":"{{name}}","sku":"P{{key}}-%d","brand":{"@type":"Brand","name":"{{brand}}"},"offers":{"@type":"Offer","price":"{{price%d}}","priceCurrency":"USD","availability":"https://schema.org/InStock"}%s}"""


def _three_prices() -> dict[str, Column]:
    """Three prices of which every fourth part's are the same."""
    price = F.col("p_retailprice").cast("decimal(12,2)")
    more = F.when(F.col("p_partkey") % 4 == 0, 0).otherwise(1)
    return {f"price{k}": (price + k * more).cast("decimal(12,2)").cast("string") for k in range(3)}


def _of_variants(spark: SparkSession, sf_dir: str, template: str) -> DataFrame:
    p = spread(table(spark, sf_dir, "part"))
    html = rendered.filled(f'<html><head><script type="application/ld+json">{template}</script></head></html>', key=F.col("p_partkey").cast("string"), name=F.col("p_name"), brand=F.col("p_brand"), **_three_prices())
    pages = p.select(F.col("p_partkey").alias("page_id"), F.lit("https://x.example/").alias("url"), html.alias("html"))
    return extract.summary_long(extract.extract(pages, parts=("candidates",)))


_SAME = "p_partkey % 4 = 0"
_ASKED = "question in ('title', 'brand', 'sku', 'price', 'price_low', 'price_high', 'currency', 'availability')"


@register(
    "summary_variants",
    f"""select p_partkey as page_id, unnest(['title', 'brand', 'currency', 'availability']) as question, unnest([p_name, p_brand, 'USD', 'InStock']) as value from part
 union all select p_partkey, 'price', {_MONEY} from part where {_SAME}""",
)
def summary_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One thing declared once a size: what the declarations don't share is no answer of the page."""
    each = ",".join(_VARIANT % (k, k, "") for k in range(3))
    found = _of_variants(spark, sf_dir, f'{{"@context":"https://schema.org","@graph":[{each}]}}')
    return found.where(_ASKED).select("page_id", "question", "value")


_LATER = "cast(cast(p_retailprice + 2 as decimal(12,2)) as varchar)"
_GROUP_SQL = f"""select p_partkey as page_id, unnest(['title', 'brand', 'currency', 'availability']) as question, unnest([p_name || ' all', p_brand, 'USD', 'InStock']) as value,
 unnest(['ProductGroup.name', '{{0}}brand', '{{0}}offers.priceCurrency', '{{0}}offers.availability']) as key from part
 union all select p_partkey, 'price', {_MONEY}, '{{0}}offers.price' from part where {_SAME}
 union all select p_partkey, unnest(['price_low', 'price_high']), unnest([{_MONEY}, {_LATER}]), unnest(['{{0}}offers.price', '{{2}}offers.price']) from part where not {_SAME}"""


@register("summary_group_range", _GROUP_SQL.replace("{0}", "ProductGroup.hasVariant[0].").replace("{2}", "ProductGroup.hasVariant[2]."))
def summary_group_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group that lists its variants: what all say, and the range of what they ask, with the places where both ends stand."""
    each = ",".join(_VARIANT % (k, k, "") for k in range(3))
    found = _of_variants(spark, sf_dir, f'{{"@context":"https://schema.org","@type":"ProductGroup","name":"{{{{name}}}} all","productGroupID":"G{{{{key}}}}","hasVariant":[{each}]}}')
    return found.where(_ASKED).select("page_id", "question", "value", "key")


@register("summary_group_members", _GROUP_SQL.replace("{0}", "Product.").replace("{2}", "Product."))
def summary_group_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where each variant is a record of its own that names its group."""
    points = (',"inProductGroupWithID":"G{{key}}"', ',"isVariantOf":{"@type":"ProductGroup","productGroupID":"G{{key}}"}', ',"isVariantOf":{"@type":"ProductGroup","name":"{{name}} all"}')
    each = ",".join(_VARIANT % (k, k, p) for k, p in enumerate(points))
    found = _of_variants(spark, sf_dir, f'{{"@context":"https://schema.org","@graph":[{{"@type":"ProductGroup","name":"{{{{name}}}} all","productGroupID":"G{{{{key}}}}"}},{each}]}}')
    return found.where(_ASKED).select("page_id", "question", "value", "key")
