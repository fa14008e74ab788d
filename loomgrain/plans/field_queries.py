"""Queries of pages about one thing, learnt from examples, of written contracts and of contracts as JSON, over pages written from ``part`` and ``customer``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrain.operators import contract, fields, rows, written
from loomgrain.plans import rendered
from loomgrain.plans.contract_queries import _BAL, _SEEN, _balance, _listings
from loomgrain.plans.registry import register
from loomgrain.sources.tables import kept, measured, spread, table

_MONEY = "cast(cast(p_retailprice as decimal(12,2)) as varchar)"
_DETAIL = (
    '<html><head><title>Shop</title></head><body><nav><ul><li>a<li>b<li>c</ul></nav><div class="thing"><h1 class="{{title_class}}">{{name}}</h1>'
    '<dl class="facts"><dt>Brand</dt><dd>{{brand}}</dd><dt>{{size_label}}</dt><dd>{{size}}</dd></dl><p class="cost">Price: {{price}} USD</p><a class="more" href="/m/{{key}}">More</a></div></body></html>'
)


def _details(spark: SparkSession, sf_dir: str, title_class: str = "title", size_label: Column | str = "Size", price: Column | None = None) -> DataFrame:
    """A page for each part: a heading, a list of labels and values, a text that its label opens, a link."""
    p = spread(table(spark, sf_dir, "part"))
    label = F.lit(size_label) if isinstance(size_label, str) else size_label
    html = rendered.filled(
        _DETAIL, title_class=F.lit(title_class), name=F.col("p_name"), brand=F.col("p_brand"), size=F.col("p_size").cast("string"), size_label=label,
        price=rendered.money("p_retailprice") if price is None else price, key=F.col("p_partkey").cast("string"),
    )
    return p.select(F.lit("part").alias("extractor"), F.col("p_partkey").alias("page_id"), F.lit("https://shop.example/p").alias("url"), html.alias("html"))


def _learnt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields learnt from what a person said of the first five pages."""
    p = table(spark, sf_dir, "part").where("p_partkey <= 5")
    said = {"name": F.col("p_name"), "brand": F.col("p_brand"), "size": F.col("p_size").cast("string"), "price": F.concat(F.lit("$"), rendered.money("p_retailprice")), "link": F.concat(F.lit("https://shop.example/m/"), F.col("p_partkey").cast("string")), "colour": F.lit("none of this page")}
    examples = p.select(F.lit("part").alias("extractor"), F.col("p_partkey").alias("page_id"), F.explode(F.create_map(*(x for k, v in said.items() for x in (F.lit(k), v)))).alias("name", "example"))
    pages = _details(spark, sf_dir).where("page_id <= 5")
    return fields.learn(fields.page_texts(pages), examples)


@register(
    "learn_fields",
    """select * from (values ('name', 'place', 'html>body>div.thing>h1.title', 'text'), ('brand', 'label', null, 'text'), ('size', 'label', null, 'text'),
 ('price', 'place', 'html>body>div.thing>p.cost', 'rest'), ('link', 'place', 'html>body>div.thing>a.more@href', 'address')) t(name, anchor, path, form)""",
)
def learn_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places where they tell a field, labels where several values stand at one place; what no page says isn't learnt."""
    found = _learnt(spark, sf_dir)
    return found.select("name", "anchor", F.when(F.col("anchor") == "place", F.col("path")).alias("path"), "form")


@register(
    "page_fields_run",
    f"""select p_partkey as page_id, unnest(['name', 'brand', 'size', 'price', 'link']) as name,
 unnest([p_name, p_brand, cast(p_size as varchar), {_MONEY} || ' USD', 'https://shop.example/m/' || p_partkey]) as value from part""",
)
def page_fields_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.replay(fields.page_texts(_details(spark, sf_dir)), _learnt(spark, sf_dir)).select("page_id", "name", "value")


@register(
    "page_fields_drift",
    """select p_partkey as page_id, 'size' as name, 'field' as kind from part where p_partkey % 3 = 0
 union all select p_partkey, 'price', 'reads' from part where p_partkey % 7 = 0""",
)
def page_fields_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third page has another label, every seventh a word in place of the price: all checks that fail."""
    label = F.when(F.col("p_partkey") % 3 == 0, "Dimension").otherwise("Size")
    price = F.when(F.col("p_partkey") % 7 == 0, "on request, no").otherwise(rendered.money("p_retailprice"))
    pages = kept(_details(spark, sf_dir, size_label=label, price=price))
    found = fields.checks(fields.page_texts(pages), pages.select("extractor", "page_id"), _learnt(spark, sf_dir))
    return found.where("not ok").select("page_id", "name", "kind")


@register(
    "heal_fields",
    """select * from (values ('kept', 'brand', null), ('kept', 'price', 'html>body>div.thing>p.cost'), ('kept', 'link', 'html>body>div.thing>a.more@href'),
 ('moved', 'name', 'html>body>div.thing>h1.heading'), ('vanished', 'size', null)) t(kind, name, path)""",
)
def heal_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A heading's class changed: the place that holds the samples is found again. A label changed whose values stand at a place of several: it is gone."""
    learnt = _learnt(spark, sf_dir)
    pages = kept(_details(spark, sf_dir, title_class="heading", size_label="Dimension").where("page_id <= 40"))
    found = fields.heal(kept(fields.page_texts(pages)), pages.select("extractor", "page_id"), learnt)
    return found.select("kind", "name", F.when(~F.col("path").endswith("dd"), F.col("path")).alias("path"))


@register(
    "learn_wanted",
    f"""select page_id, cast(row_ix as int) as row_ix, unnest(['who', 'owes', 'link', 'segment']) as name,
 unnest([c_name, {_BAL}, 'https://shop.example/c/' || c_custkey, c_mktsegment]) as value from {_SEEN} where n >= 3""",
)
def learn_wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows in which the example of the page's second customer stands, with its columns named as asked."""
    c = table(spark, sf_dir, "customer").where("c_custkey % 20 = 2 or c_custkey = 2")
    examples = c.select(F.expr("c_custkey div 20").alias("page_id"), F.create_map(F.lit("who"), F.col("c_name"), F.lit("owes"), F.concat(F.lit("$ "), _balance()), F.lit("link"), F.concat(F.lit("/c/"), F.col("c_custkey").cast("string")), F.lit("segment"), F.col("c_mktsegment")).alias("wanted"))
    # spread behind the join, whose few bytes may end in one task
    pages = spread(_listings(spark, sf_dir, dealt=False).join(examples, "page_id"))
    return rows.rows_long(rows.wanted(pages)).select("page_id", "row_ix", F.col("path").alias("name"), "value")


# --- written contracts


def _selectors(spark: SparkSession, bal: str = "css:span.bal") -> DataFrame:
    return spark.createDataFrame([("shop", "css:li.row", {"who": "css:a.name", "link": "css:a.name::attr(href)", "owes": bal, "segment": "xpath://i"})], "extractor string, rows string, fields map<string,string>")


@register(
    "written_learn",
    f"""with r as (select * from {_SEEN}) select 'shop' as extractor, unnest(['who', 'link', 'owes', 'segment']) as name, 0.0::double as missing, unnest(['LNP', 'LNP', 'NP', 'L']) as shape, unnest([null, null, 'amount', null]) as reads, count(*) as n_rows from r""",
)
def written_learn(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kept(written.read(_listings(spark, sf_dir), _selectors(spark)))
    n = found.groupBy("extractor").agg(F.sum(F.size("rows")).alias("n_rows"))
    return written.learn(found)[1].select("extractor", "name", F.col("missing").cast("double").alias("missing"), "shape", "reads").join(n, "extractor")


def _written(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return written.learn(kept(written.read(_listings(spark, sf_dir), _selectors(spark))))


@register(
    "written_drift",
    f"""select page_id, 'owes' as name, 'reads' as kind from (select page_id, count(*) as n from {_SEEN} group by page_id) where page_id % 3 = 0 and n >= 3
 union all select page_id, 'owes', 'shape' from (select page_id, count(*) as n from {_SEEN} group by page_id) where page_id % 3 = 0 and n >= 5
 union all select page_id, 'owes', 'values' from (select page_id, count(*) as n, count(distinct bal) as d from {_SEEN} group by page_id) where (page_id % 3 = 0 or d = 1) and n >= 5
 union all select page_id, 'segment', 'values' from (select page_id, count(*) as n, count(distinct c_mktsegment) as d from {_SEEN} group by page_id) where d = 1 and n >= 5""",
)
def written_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third page says a word where the balance was; all failed checks."""
    bal = F.when(F.expr("(c_custkey div 20) % 3 = 0"), "on request").otherwise(_balance())
    found = written.checks(kept(written.read(_listings(spark, sf_dir, bal=bal), _selectors(spark))), *_written(spark, sf_dir))
    return found.where("not ok").select("page_id", "name", "kind")


@register("written_broken", f"select page_id, unnest(['owes', 'owes']) as name, unnest(['selector', 'field']) as kind from (select distinct page_id from {_SEEN})")
def written_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A selector that can't be read is a failed check, and no error."""
    found = written.checks(kept(written.read(_listings(spark, sf_dir), _selectors(spark, "css:span..["))), *_written(spark, sf_dir))
    return found.where("not ok and kind <> 'values'").select("page_id", "name", "kind")


@register("written_heal", "select * from (values ('broken', 'who'), ('broken', 'link'), ('kept', 'owes'), ('kept', 'segment')) t(kind, name)")
def written_heal(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = _written(spark, sf_dir)[1]
    later = kept(written.read(_listings(spark, sf_dir, name_class="title"), _selectors(spark)))
    return written.heal(columns, later, _selectors(spark)).select("kind", "name")


@register("contract_json", f"select page_id, kind, name, ok from (select page_id, 'rows' as kind, 'rows' as name, true as ok from {_SEEN} group by page_id union all select page_id, 'field', unnest(['a.name', 'a.name@href', 'i', 'span.bal']), true from {_SEEN} group by page_id)")
def contract_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks by a contract that went through its JSON."""
    listing, columns = contract.learn(kept(rows.induced(_listings(spark, sf_dir))))
    told = written.to_json(listing, columns, _learnt(spark, sf_dir), _selectors(spark))
    listing, columns, _, _ = written.from_json(measured(told))
    found = contract.checks(kept(contract.replay(_listings(spark, sf_dir), listing)), listing, columns)
    return found.where("kind in ('rows', 'field')").select("page_id", "kind", "name", "ok")
