"""Queries of rows, contracts and differences, over listing pages written from ``customer``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrain.operators import contract, diff, extract, rows
from loomgrain.plans import rendered
from loomgrain.plans.registry import register
from loomgrain.sources.tables import kept, spread, table

#: Customers on a page.
_PAGE = 20
_BAL = "cast(cast(abs(c_acctbal) as decimal(12,2)) as varchar)"
_SEEN = f"(select *, c_custkey // {_PAGE} as page_id, c_custkey % {_PAGE} as row_ix, {_BAL} as bal, count(*) over (partition by c_custkey // {_PAGE}) as n from customer)"


def _balance() -> Column:
    """An amount without a sign, since one with a minus reads as none."""
    return F.abs("c_acctbal").cast("decimal(12,2)").cast("string")


def _listings(spark: SparkSession, sf_dir: str, name_class: str = "name", bal: Column | None = None, order: str = "name bal", dealt: bool = True) -> DataFrame:
    """Pages of twenty customers, with the class of names, the balance and the order of the columns as asked."""
    c = table(spark, sf_dir, "customer").withColumn("page_id", F.expr(f"c_custkey div {_PAGE}"))
    cells = {
        "name": rendered.filled(f'<a class="{name_class}" href="/c/{{{{key}}}}">{{{{name}}}}</a>', key=F.col("c_custkey").cast("string"), name=F.col("c_name")),
        "bal": F.concat(F.lit('<span class="bal">'), _balance() if bal is None else bal, F.lit("</span>")),
    }
    item = F.concat(F.lit('<li class="row">'), *(cells[x] for x in order.split()), F.lit("<i>"), F.col("c_mktsegment"), F.lit("</i></li>"))
    pages = c.groupBy("page_id").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", item.alias("h")))), lambda x: x["h"])).alias("list"))
    html = F.concat(F.lit('<html><body><nav><ul><li>a<li>b<li>c</ul></nav><div class="page"><ol class="list">'), F.col("list"), F.lit("</ol></div></body></html>"))
    # spread again: the aggregate's few bytes end in one partition, and the parse would be one task
    pages = pages.select(F.lit("shop").alias("extractor"), "page_id", F.lit("https://shop.example/list").alias("url"), html.alias("html"))
    return spread(pages) if dealt else pages


@register(
    "induce_rows",
    f"""select page_id, cast(row_ix as int) as row_ix, unnest(['a.name', 'a.name@href', 'span.bal', 'i']) as path,
 unnest([c_name, 'https://shop.example/c/' || c_custkey, {_BAL}, c_mktsegment]) as value from {_SEEN} where n >= 3""",
)
def induce_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.rows_long(rows.induced(_listings(spark, sf_dir))).drop("extractor")


@register(
    "select_rows",
    f"""select page_id, 'balance' as name, cast(row_ix as int) as nth, {_BAL} as value, '/html[1]/body[1]/div[1]/ol[1]/li[' || (row_ix + 1) || ']/span[1]' as place from {_SEEN}
 union all select page_id, 'link', cast(row_ix as int), '/c/' || c_custkey, '/html[1]/body[1]/div[1]/ol[1]/li[' || (row_ix + 1) || ']/a[1]' from {_SEEN}""",
)
def select_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.selected(_listings(spark, sf_dir), {"balance": "css:ol.list > li span.bal", "link": "xpath://ol[@class='list']/li/a/@href"})


@register(
    "select_table",
    f"""select page_id, cast(row_ix as int) as row_ix, unnest(['who', 'segment']) as path, unnest([c_name, c_mktsegment]) as value from {_SEEN}""",
)
def select_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.rows_long(rows.selected_rows(_listings(spark, sf_dir), "css:li.row", {"who": "css:a.name", "segment": "xpath://i", "none": "css:b"})).drop("extractor")


_MISSING_BAL = "c_custkey % 4 = 0"


@register(
    "compile_profile",
    f"""with r as (select * from {_SEEN} where n >= 3), cells as (
 select page_id, row_ix, unnest(['a.name', 'a.name@href', 'i', 'span.bal']) as path, unnest([c_name, 'https://shop.example/c/' || c_custkey, c_mktsegment, case when {_MISSING_BAL} then null else {_BAL} end]) as value from r)
 select 'shop' as extractor, path, round(1 - count(value) / (select count(*) from r), 4) as missing,
 case path when 'a.name' then 'LNP' when 'i' then 'L' when 'span.bal' then 'NP' end as shape,
 case when path = 'span.bal' then 'amount' end as reads,
 (select list(v order by p, k) from (select c2.value as v, min(c2.page_id) as p, min(c2.page_id * 1000 + c2.row_ix) as k from cells c2 where c2.path = cells.path and c2.value is not null group by c2.value order by k limit 5)) as samples
 from cells group by path""",
)
def compile_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    bal = F.when(F.expr(_MISSING_BAL), "").otherwise(_balance())
    columns = contract.learn(kept(rows.induced(_listings(spark, sf_dir, bal=bal))))[1]
    return columns.select("extractor", "path", "missing", "shape", "reads", "samples")


def _drifted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A contract, and later pages of which every third says a word where the balance was and every fifth one balance in all rows."""
    listing, columns = contract.learn(kept(rows.induced(_listings(spark, sf_dir))))
    bal = F.when(F.col("page_id") % 3 == 0, "on request").when(F.col("page_id") % 5 == 0, "7.50").otherwise(_balance())
    return kept(contract.replay(_listings(spark, sf_dir, bal=bal), listing)), listing, columns


_LATER = f"(select page_id, count(*) as n, count(distinct bal) as d, count(distinct c_mktsegment) as m from {_SEEN} group by page_id)"


@register(
    "run_checks",
    f"""select page_id, 'rows' as kind, 'rows' as name, cast(n as double) as measured, true as ok from {_LATER}
 union all select page_id, 'field', 'span.bal', 1.0, true from {_LATER}
 union all select page_id, 'reads', 'span.bal', case when page_id % 3 = 0 then 0.0 else 1.0 end, page_id % 3 <> 0 from {_LATER} where n >= 3
 union all select page_id, 'values', 'span.bal', case when page_id % 3 = 0 or page_id % 5 = 0 or d = 1 then 0.0 else 1.0 end, not (page_id % 3 = 0 or page_id % 5 = 0 or d = 1) from {_LATER} where n >= 5""",
)
def run_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contract.checks(*_drifted(spark, sf_dir))
    return found.where("kind = 'rows' or name = 'span.bal' and kind in ('field', 'reads', 'values')").drop("extractor")


@register("drift_flagged", f"select page_id, not (n >= 3 and page_id % 3 = 0 or n >= 5 and (page_id % 5 = 0 or d = 1)) and (n < 5 or m > 1) as ok from {_LATER}")
def drift_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is sound where all its checks pass; a segment that is the same in five rows or more is a drift too."""
    return contract.verdicts(contract.checks(*_drifted(spark, sf_dir))).select("page_id", "ok")


@register(
    "heal_moves",
    """select * from (values ('kept', 'span.bal', 'span.bal', 5, 5), ('kept', 'i', 'i', (select count(distinct c_mktsegment) from customer)::int, (select count(distinct c_mktsegment) from customer)::int),
 ('moved', 'a.name', 'a.title', 5, 5), ('moved', 'a.name@href', 'a.title@href', 5, 5)) t(kind, name, path, seen, samples)""",
)
def heal_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = contract.learn(kept(rows.induced(_listings(spark, sf_dir))))[1]
    later = kept(rows.induced(_listings(spark, sf_dir, name_class="title", order="bal name")))
    return contract.heal(columns, later).select("kind", "name", "path", F.col("seen").cast("int").alias("seen"), F.col("samples").cast("int").alias("samples"))


@register("healed_contract", "select * from (values ('span.bal', 'span.bal', 'amount'), ('i', 'i', null), ('a.name', 'a.title', null), ('a.name@href', 'a.title@href', null)) t(name, path, reads)")
def healed_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = contract.learn(kept(rows.induced(_listings(spark, sf_dir))))[1]
    later = kept(rows.induced(_listings(spark, sf_dir, name_class="title", order="bal name")))
    return contract.healed(columns, later, contract.heal(columns, later)).select("name", "path", "reads")


def _answers(spark: SparkSession, sf_dir: str, price: Column, extra: str = "") -> DataFrame:
    p = spread(table(spark, sf_dir, "part"))
    html = rendered.filled(
        '<html><script type="application/ld+json">{"@context":"https://schema.org","@type":"Product","name":"{{name}}","sku":"P{{key}}","offers":{"price":"{{price}}","priceCurrency":"USD"}}</script>' + extra,
        name=F.col("p_name"), key=F.col("p_partkey").cast("string"), price=price,
    )
    pages = p.select(F.col("p_partkey").alias("page_id"), F.lit("https://x.example/").alias("url"), html.alias("html"))
    return extract.summary_long(extract.extract(pages, parts=("candidates",)))


@register(
    "diff_kinds",
    """select p_partkey as page_id, 'price' as question, 'changed' as kind from part where p_partkey % 6 = 0
 union all select p_partkey, 'price', 'rewritten' from part where p_partkey % 6 = 1
 union all select p_partkey, 'description', 'added' from part""",
)
def diff_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = rendered.money("p_retailprice")
    after = F.when(F.col("p_partkey") % 6 == 0, (F.col("p_retailprice") + 2).cast("decimal(12,2)").cast("string")).when(F.col("p_partkey") % 6 == 1, F.concat(F.lit("USD "), price)).otherwise(price)
    found = diff.compare(_answers(spark, sf_dir, price), _answers(spark, sf_dir, after, '<meta name="description" content="new">'))
    return found.select("page_id", "question", "kind")


@register(
    "summary_contract",
    """select p_partkey as page_id, 'summary' as kind, unnest(['title', 'price', 'sku', 'type', 'currency']) as name,
 unnest([true, p_partkey % 4 <> 0, true, true, p_partkey % 4 <> 0]) as ok from part""",
)
def summary_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that all pages answered, held against pages of which every fourth lost its offer."""
    keyed = lambda df: df.withColumn("extractor", F.lit("shop"))
    before = kept(keyed(_answers(spark, sf_dir, rendered.money("p_retailprice"))))
    pages = keyed(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id")))
    learnt = contract.learn_answers(before, pages)
    after = before.where("page_id % 4 <> 0 or question not in ('price', 'currency')")
    return contract.answer_checks(after, pages, learnt).where("kind = 'summary'").select("page_id", "kind", "name", "ok")
