"""Queries over ``pages`` as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgrain.operators import markup
from loomgrain.plans.registry import register
from loomgrain.sources.tables import table


def _cleaned(expression: str) -> str:
    text = f"trim(regexp_replace({expression}, '\\s+', ' ', 'g'))"
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{sign}')"
    return f"nullif({text}, '')"


_TITLE = _cleaned("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")
_LANG = _cleaned("""regexp_extract(html, '(?is)<html[^>]*?\\slang="([^"]*)"', 1)""")
_H1 = _cleaned("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")
_HOST = "nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '')"
_LINKS = """regexp_extract_all(html, '<li><a href="([^"]*)"', 1)"""
_FACTS = f"""select page_id, url, {_HOST} as host, {_TITLE} as title, {_LANG} as lang, {_H1} as h1,
 coalesce(len({_LINKS}), 0)::bigint as n_links from pages"""


@register("page_facts", _FACTS)
def page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.page_facts(table(spark, sf_dir, "pages"))


@register("nav_links", f"select page_id, generate_subscripts(l, 1)::int - 1 as ord, unnest(l) as href from (select page_id, {_LINKS} as l from pages)")
def nav_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.nav_links(table(spark, sf_dir, "pages"))


@register(
    "host_report",
    f"""select host, count(*) as n_pages, count(distinct title) as n_titles, round(avg(n_links), 6) as mean_links
 from ({_FACTS}) group by host""",
)
def host_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.host_report(table(spark, sf_dir, "pages"))
