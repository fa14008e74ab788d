"""Queries of crawls, site files, feeds and fetch decisions, over files and links written from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrain.operators import audit, crawl, links, markup, readings
from loomgrain.operators.declared import parse
from loomgrain.plans import rendered
from loomgrain.plans.registry import register
from loomgrain.sources import robots, sitemaps
from loomgrain.sources.tables import kept, spread, table

_SHOP = "https://shop.example"


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of parts that link to the parts that were shipped with them, three for each."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"))
    n, p = p.count(), spread(p)
    rows = p.select("p", F.posexplode(F.array(*(F.expr(f"(p * 7 + {k * k + 1}) % {n}") for k in range(3)))).alias("ord", "t"))
    at = lambda c: F.concat(F.lit(f"{_SHOP}/p/"), F.col(c).cast("string"))
    return rows.select(at("p").alias("source"), "ord", at("t").alias("target"))


_EDGES = "(select p_partkey as p, unnest([0, 1, 2]) as k, (p_partkey * 7 + unnest([1, 2, 5])) % (select count(*) from part) as t from part)"


@register(
    "crawl_bfs_depth",
    f"""with recursive b(p, depth) as (select 0::bigint, 0 union select e.t, b.depth + 1 from b join {_EDGES} e on e.p = b.p where b.depth < 4)
 select '{_SHOP}/p/' || p as address, min(depth)::int as depth from b group by p""",
)
def crawl_bfs_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.crawl(_graph(spark, sf_dir), f"{_SHOP}/p/0", max_pages=None, max_depth=4).select("address", "depth")


@register(
    "crawl_order",
    f"""with recursive b(p, depth, path) as (select 0::bigint, 0, [0::bigint] union all select e.t, b.depth + 1, b.path || [e.k::bigint] from b join {_EDGES} e on e.p = b.p where b.depth < 3),
 f as (select p, min(struct_pack(d := depth, q := path)) as x from b group by p)
 select '{_SHOP}/p/' || p as address, x.d::int as depth, row_number() over (order by x) as nth from f qualify nth <= 12""",
)
def crawl_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twelve pages, in the order in which they are admitted."""
    taken = crawl.crawl(_graph(spark, sf_dir), f"{_SHOP}/p/0", max_pages=12, max_depth=3)
    return taken.select("address", "depth", F.row_number().over(Window.orderBy("place")).cast("long").alias("nth"))


@register(
    "crawl_scope",
    f"""select distinct '{_SHOP}/p/' || t as target from {_EDGES} where (t % 10) in (3, 5, 7) and t % 100 <> 13""",
)
def crawl_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = crawl.admitted(F.col("target"), "shop.example", include=("[357]$",), exclude=("(^|[^0-9])13$|[0-9]13$",))
    return _graph(spark, sf_dir).where(ok).select("target").distinct()


@register("links_followed", "select page_id, 'https://' || 'x.example' || l as address from (select page_id, unnest(list_distinct(regexp_extract_all(html, '<li><a href=\"([^\"]*)\"', 1))) as l from pages) where l similar to '/[A-Za-z]+'")
def links_followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of navigation that are plain words, from the tree and not from the text."""
    pages = table(spark, sf_dir, "pages").withColumn("url", F.lit("https://x.example/"))
    return links.followed(parse(pages, ())).where(F.col("address").rlike("^https://x.example/[A-Za-z]+$")).select("page_id", "address")


@register("batch_once", "select min(l_orderkey * 10 + l_linenumber) as ord, 'https://shop.example/p/' || l_partkey as address from lineitem group by l_partkey")
def batch_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.concat(F.lit("HTTPS://Shop.example:443/p/"), F.col("l_partkey").cast("string"), F.lit("#top")).alias("url"))
    return crawl.in_batch(urls)


@register("crawl_resumed", "select 'https://shop.example/p/' || p_partkey as address from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 49)")
def crawl_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda c: F.concat(F.lit(f"{_SHOP}/p/"), F.col(c).cast("string")).alias("address")
    return crawl.unfinished(table(spark, sf_dir, "part").select(at("p_partkey")), table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(at("l_partkey")))


def _site(key: str) -> Column:
    return F.concat(F.lit("s"), F.col(key).cast("string"), F.lit(".example"))


@register(
    "sitemap_urls",
    """select 'https://s' || (p_partkey % 10) || '.example/sitemap.xml' as file, 'url' as kind, 'https://s' || (p_partkey % 10) || '.example/p/' || p_partkey as address, case when p_size % 2 = 0 then '2024-01-' || lpad(cast(p_size % 28 + 1 as varchar), 2, '0') end as modified from part""",
)
def sitemap_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("s", F.col("p_partkey") % 10)
    modified = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("<lastmod>2024-01-"), F.lpad((F.col("p_size") % 28 + 1).cast("string"), 2, "0"), F.lit("</lastmod>"))).otherwise("")
    entry = F.concat(F.lit("<url><loc> https://"), _site("s"), F.lit("/p/"), F.col("p_partkey").cast("string"), F.lit("</loc>"), modified, F.lit("</url>\n"))
    files = p.groupBy("s").agg(F.concat_ws("", F.collect_list(entry)).alias("x")).select(F.concat(F.lit("https://"), _site("s"), F.lit("/sitemap.xml")).alias("file"), F.concat(F.lit('<?xml version="1.0"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), "x", F.lit("</urlset>")).alias("body"))
    return sitemaps.sitemap_urls(files).drop("ord")


@register("site_map", "select 'https://s.example/p/' || p_partkey as address, case when p_partkey % 3 = 1 then 'b' end as modified from part where p_partkey % 3 < 2")
def site_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two maps under an index; a third one is another site's."""
    p = table(spark, sf_dir, "part")
    row = lambda file, kind, address, modified=None: p.sparkSession.createDataFrame([(file, 0, kind, address, modified)], "file string, ord int, kind string, address string, modified string")
    index = "https://s.example/index.xml"
    files = row(index, "sitemap", "https://s.example/0.xml").unionByName(row(index, "sitemap", "https://s.example/1.xml")).unionByName(row(index, "sitemap", "https://other.example/2.xml"))
    k = F.col("p_partkey") % 3
    name = F.when(k < 2, F.concat(F.lit("https://s.example/"), k.cast("string"), F.lit(".xml"))).otherwise("https://other.example/2.xml")
    urls = p.select(name.alias("file"), F.lit(1).alias("ord"), F.lit("url").alias("kind"), F.concat(F.lit("https://s.example/p/"), F.col("p_partkey").cast("string")).alias("address"), F.when(k == 1, "b").alias("modified"))
    return crawl.map_site(kept(files.unionByName(urls)), [index], "s.example")


_FEED = "select 'https://s' || (o_orderkey % 20) || '.example/feed' as file, 'Order ' || o_orderkey as title, 'https://s' || (o_orderkey % 20) || '.example/o/' || o_orderkey as link, strftime(o_orderdate, '%Y-%m-%d') as published from orders"


@register("feed_items", f"select case cast(regexp_extract(file, 's(\\d+)\\.', 1) as int) % 3 when 0 then 'rss' when 1 then 'atom' else 'json' end as kind, file, title, link, published from ({_FEED})")
def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty feeds of three formats say the same of their orders."""
    o = table(spark, sf_dir, "orders").withColumn("s", F.col("o_orderkey") % 20)
    values = {"key": F.col("o_orderkey").cast("string"), "day": F.date_format("o_orderdate", "yyyy-MM-dd")}
    kind = F.col("s") % 3
    item = (
        F.when(kind == 0, rendered.filled("<item><title>Order {{key}}</title><link>/o/{{key}}</link><pubDate>{{day}}</pubDate></item>", **values))
        .when(kind == 1, rendered.filled('<entry><title>Order {{key}}</title><link href="/o/{{key}}"/><updated>{{day}}</updated></entry>', **values))
        .otherwise(rendered.filled('{"id":{{key}},"title":"Order {{key}}","url":"/o/{{key}}","date_published":"{{day}}"}', **values))
    )
    files = o.groupBy("s").agg(F.collect_list(item).alias("x")).select("s", F.concat(F.lit("https://"), _site("s"), F.lit("/feed")).alias("file"), "x")
    body = (
        F.when(kind == 0, F.concat(F.lit('<rss version="2.0"><channel>'), F.array_join("x", ""), F.lit("</channel></rss>")))
        .when(kind == 1, F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), F.array_join("x", ""), F.lit("</feed>")))
        .otherwise(F.concat(F.lit('{"version":"https://jsonfeed.org/version/1.1","items":['), F.array_join("x", ","), F.lit("]}")))
    )
    return sitemaps.feed_items(files.select("file", body.alias("body"))).select("kind", "file", "title", "link", "published")


def _part_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("s", F.col("p_partkey") % 5)
    path = F.concat(F.lit("/"), F.lower("p_type"), F.lit("/"), F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 2 == 0, ".html").otherwise(".php"))
    return p.select(_site("s").alias("site"), F.concat(F.lit("https://"), _site("s"), path).alias("url"))


_PART_URL = "'https://s' || (p_partkey % 5) || '.example/' || lower(p_type) || '/' || p_partkey || case when p_size % 2 = 0 then '.html' else '.php' end"


@register(
    "robots_verdicts",
    f"""select {_PART_URL} as url, 's' || (p_partkey % 5) || '.example' as site, case p_partkey % 5 when 0 then not (p_size % 2 = 1) when 1 then lower(p_type) <> 'economy' or p_size % 2 = 0 when 2 then true when 3 then false else true end as allowed from part""",
)
def robots_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern with an anchor, an allow that is longer than the disallow, a group of another agent, one that refuses all, and no file."""
    files = [("s0.example", "User-agent: *\nDisallow: /*.php$"), ("s1.example", "# ours\nUser-Agent: *\nDisallow: /\n\nUser-agent: loom\nDisallow: /economy\nAllow: /economy/*.html"), ("s2.example", "User-agent: other\nDisallow: /"), ("s3.example", "User-agent: a\nUser-agent: *\nDisallow: /\nCrawl-delay: 3")]
    return robots.verdicts(_part_urls(spark, sf_dir), robots.robots_rules(spark.createDataFrame(files, "site string, text string")), "loombot")


@register(
    "tdm_reserved",
    f"""select {_PART_URL} as url, case when p_partkey % 5 = 0 then lower(p_type) <> 'economy' else true end as reserved, case when p_partkey % 5 = 1 then 'https://policy.example/' end as policy, 'tdmrep.json' as source from part where p_partkey % 5 = 0 or p_partkey % 5 = 1 and p_size % 2 = 0""",
)
def tdm_reserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = [("s0.example", '[{"location":"/economy/*","tdm-reservation":0},{"location":"/","tdm-reservation":1}]'), ("s1.example", '[{"tdm-reservation":1},{"location":"/*.html$","tdm-reservation":"1","tdm-policy":"https://policy.example/"}]'), ("s2.example", "{}")]
    return robots.tdm_reserved(_part_urls(spark, sf_dir), robots.tdm_rules(spark.createDataFrame(files, "site string, text string")))


@register(
    "crawler_agents",
    """select 's' || i || '.example' as site, unnest(['gptbot', 'ccbot', 'claude-user']) as agent, unnest([i <> 0, i <> 1, i <> 1]) as allowed, unnest([i <> 2, i = 2, false]) as named from range(3) t(i)""",
)
def crawler_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = [("s0.example", "User-agent: GPTBot\nDisallow: /"), ("s1.example", "User-agent: *\nDisallow: /\nUser-agent: gptbot\nAllow: /"), ("s2.example", "User-agent: CCBot\nDisallow: /private\n")]
    found = audit.crawler_verdicts(robots.robots_rules(spark.createDataFrame(files, "site string, text string")))
    return found.where(F.col("agent").isin("gptbot", "ccbot", "claude-user")).select("site", "agent", "allowed", "named")


@register(
    "polite_schedule",
    """with recursive t as (select 's' || (user_id % 7) as site, event_id as seq, cast(epoch(ts) - epoch(timestamp '2024-01-01') as double) as ready from events),
 n as (select *, case when site = 's3' then 5.0 else 1.0 end as d, row_number() over (partition by site order by seq) as i from t)
 select site, seq, round(max(ready - i * d) over (partition by site order by seq rows unbounded preceding) + i * d, 3) as start from n""",
)
def polite_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    ready = F.expr("cast(unix_micros(cast(ts as timestamp)) - unix_micros(timestamp '2024-01-01 00:00:00') as double) / 1e6")
    tasks = e.select(F.concat(F.lit("s"), (F.col("user_id") % 7).cast("string")).alias("site"), F.col("event_id").alias("seq"), ready.alias("ready"))
    found = crawl.scheduled(tasks, spark.createDataFrame([("s3", 5.0), ("s4", 0.2)], "site string, delay double"))
    return found.select("site", "seq", F.round("start", 3).alias("start"))


@register(
    "archive_as_of",
    """select o_custkey as url, o_orderdate as at, l.ts, l.capture from orders o asof left join (select c_custkey as url, timestamp '1995-01-01' + to_days(cast(c_custkey % 700 as int)) as ts, c_name as capture from customer) l on o.o_custkey = l.url and o.o_orderdate >= l.ts""",
)
def archive_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("url"), F.expr("timestamp_ntz '1995-01-01 00:00:00' + make_dt_interval(cast(c_custkey % 700 as int))").alias("ts"), F.col("c_name").alias("capture"))
    wanted = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("url"), F.col("o_orderdate").cast("timestamp_ntz").alias("at"))
    return crawl.as_of(captures, wanted)


@register(
    "why_climb",
    """select 'https://x.example/' || page_id as url, case page_id % 5 when 0 then 'challenge' when 1 then 'refused' when 2 then 'script' end as reason from pages where length(html) > 1500""",
)
def why_climb(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 5
    html = F.when(k == 0, "<html><title>Just a moment...</title>").when(k == 2, '<html><div id="app"></div><script src="/a.js"></script>').otherwise(F.concat(F.lit("<p>"), F.repeat(F.lit("word "), 60)))
    fetched = table(spark, sf_dir, "pages").where(F.length("html") > 1500).select(F.concat(F.lit("https://x.example/"), F.col("page_id").cast("string")).alias("url"), F.when(k == 1, 403).when(k == 3, 404).otherwise(200).alias("status"), html.alias("html"), F.lit(False).alias("declares"))
    return crawl.why_climb(fetched)


@register(
    "fetch_retries",
    """select 'u' || o_orderkey as address, o_orderkey % 4 + 1 as attempt, o_orderkey % 3 = 0 and o_orderkey % 4 < 2 as retry,
 case when o_orderkey % 3 = 0 and o_orderkey % 4 < 2 then case when o_orderkey % 6 = 0 then 7.0 else power(2.0, o_orderkey % 4) end end as wait from orders""",
)
def fetch_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    fetches = o.select(F.concat(F.lit("u"), key.cast("string")).alias("address"), (key % 4 + 1).alias("attempt"), F.when(key % 3 == 0, 503).when(key % 3 == 1, 404).otherwise(200).alias("status"), F.when(key % 6 == 0, 7).alias("retry_after"))
    return crawl.retried(fetches).drop("status")


@register(
    "answer_budget",
    """with s as (select o_custkey, o_orderkey, sum(length(o_orderpriority)) over (partition by o_custkey order by o_orderkey) as x from orders)
 select o_custkey, o_orderkey, (select count(*) from s s2 where s2.o_custkey = s.o_custkey and s2.x > 40) as n_left_out from s where x <= 40""",
)
def answer_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.within_budget(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority"), "o_custkey", "o_orderkey", F.length("o_orderpriority"), 40).drop("o_orderpriority")


@register(
    "header_rights",
    """select p_partkey as page_id, unnest(['robots', 'robots', 'tdm-reservation', 'usage', 'link-canonical', 'link-alternate']) as kind, unnest(['*', 'googlebot', '*', 'train-ai', '*', 'de']) as agent,
 unnest(['noindex', 'nofollow', cast(p_size % 2 as varchar), 'n', '/p/' || p_partkey, '/de,x/' || p_partkey]) as value from part""",
)
def header_rights(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    link = F.concat(F.lit("</p/"), key, F.lit('>; rel="canonical", </de,x/'), key, F.lit(">; rel=alternate; hreflang=de"))
    headers = F.array(pair("X-Robots-Tag", F.lit("noindex")), pair("x-robots-tag", F.lit("googlebot: nofollow")), pair("TDM-Reservation", (F.col("p_size") % 2).cast("string")), pair("Content-Usage", F.lit("train-ai=n, search=maybe")), pair("Link", link))
    return readings.header_declarations(p.select(F.col("p_partkey").alias("page_id"), headers.alias("headers")))


@register("products_json", "select 's' || (p_partkey % 10) as file, cast(p_partkey as varchar) as id, p_name as title, 'P' || p_partkey as sku, cast(cast(p_retailprice as decimal(12,2)) as varchar) as price from part")
def products_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("s", F.col("p_partkey") % 10)
    item = rendered.filled('{"id":{{key}},"title":"{{name}}","variants":[{"sku":"P{{key}}","price":{{price}},"available":true}]}', key=F.col("p_partkey").cast("string"), name=F.col("p_name"), price=rendered.money("p_retailprice"))
    files = p.groupBy("s").agg(F.concat_ws(",", F.collect_list(item)).alias("x")).select(F.concat(F.lit("s"), F.col("s").cast("string")).alias("file"), F.concat(F.lit('{"products":['), "x", F.lit("]}")).alias("body"))
    return readings.products_json(files).select("file", "id", "title", "sku", "price")


@register("host_links", "select nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '') as host, sum(len(regexp_extract_all(html, '<li><a href=\"([^\"]*)\"', 1)))::bigint as n_links from pages group by all")
def host_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return markup.page_facts(pages).groupBy("host").agg(F.sum("n_links").alias("n_links"))
