"""Contracts of pages about one thing: fields learnt from examples, replayed, checked and healed.

A field stands at a place, or behind a label where the place alone doesn't tell it, as in a list of labels and values. All steps are joins on
what pages say (kernels.texts), keyed by ``extractor``, so all sites are learnt, checked and healed in one plan.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrain.functions import scalars
from loomgrain.kernels.texts import texts
from loomgrain.operators.contract import KEPT, SAMPLES
from loomgrain.operators.rows import _pages
from loomgrain.sources.tables import measured

_ARROW = pa.schema([
    ("extractor", pa.string()), ("page_id", pa.int64()), ("ord", pa.int32()), ("path", pa.string()), ("form", pa.string()), ("n_same", pa.int32()), ("depth", pa.int32()), ("value", pa.string()), ("label", pa.string()), ("n_label", pa.int32()),
])
SCHEMA = "extractor string, page_id long, ord int, path string, form string, n_same int, depth int, value string, label string, n_label int"


def page_texts(pages: DataFrame) -> DataFrame:
    """SCHEMA's rows for all that ``pages`` (extractor, page_id, url, html) say, of one parse each."""

    def one(extractor: str | None, page_id: int | None, url: str | None, html: str | None) -> list[dict]:
        return [{"extractor": extractor, "page_id": page_id, **row} for row in texts(html, url)]

    columns = ["extractor", "page_id", "url", "html"]
    return pages.select(*columns).mapInArrow(lambda b: _pages(b, columns, one, _ARROW), SCHEMA)


def _keys(value: Column) -> Column:
    """What two texts share that say the same: their squeezed text, or the amount that both are."""
    return F.array_distinct(F.array_compact(F.array(F.concat(F.lit("t:"), scalars.squeezed(value)), F.concat(F.lit("n:"), scalars.worth(value)))))


def _profile(held: DataFrame) -> DataFrame:
    """extractor, name, shape, reads and samples of the values that were learnt from."""
    v = F.col("value")
    own = scalars.shape(v)
    first = held.groupBy("extractor", "name", "value").agg(F.min("page_id").alias("at"))
    some = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), 1, SAMPLES)
    order = Window.partitionBy("extractor", "name").orderBy("at", "value")
    samples = first.withColumn("k", F.row_number().over(order)).where(F.col("k") <= SAMPLES).groupBy("extractor", "name").agg(some.alias("samples"))
    told = held.groupBy("extractor", "name").agg(
        F.min(own).alias("low"), F.max(own).alias("high"), F.count_distinct("page_id").alias("n"), F.bool_and(scalars.amount(v).isNotNull()).alias("amounts"), F.bool_and(scalars.iso_date(v).isNotNull()).alias("dates"), F.max(F.col("form") == "address").alias("address")
    )
    sure = (F.col("n") > 1) & ~F.col("address")
    return told.join(samples, ["extractor", "name"]).select(
        "extractor", "name", F.when(sure & (F.col("low") == F.col("high")) & (F.col("low") != ""), F.col("low")).alias("shape"), F.when(sure, F.when(F.col("amounts"), "amount").when(F.col("dates"), "date")).alias("reads"), "samples"
    )


def learn(said: DataFrame, examples: DataFrame) -> DataFrame:
    """extractor, name, anchor, path, form, label, shape, reads, samples of every field that its examples tell.

    ``said`` is page_texts()'s; ``examples`` has extractor, page_id, name and example. A place counts that stands once on each page of an
    example and says it on all of them: the deepest, then the first. Where there is none, a label does that stands once and has the example behind
    it on all of them. A field that neither tells is left out; see unlearnt().
    """
    wanted = examples.select("extractor", "page_id", "name", F.explode(_keys(F.col("example"))).alias("key"))
    asked = examples.groupBy("extractor", "name").agg(F.count_distinct("page_id").alias("n_asked"))
    held = measured(said.withColumn("key", F.explode(_keys(F.col("value")))).join(measured(wanted), ["extractor", "page_id", "key"]).drop("key").distinct())

    def anchored(anchor: str, once: Column, keys: list[str]) -> DataFrame:
        each = held.where(once).groupBy("extractor", "name", *keys).agg(F.count_distinct("page_id").alias("n"), F.max("depth").alias("depth"), F.min("ord").alias("first"), F.min("label").alias("low"), F.max("label").alias("high"), F.count("label").alias("n_labels"), F.min("path").alias("some_path"))
        sure = each.join(asked, ["extractor", "name"]).where("n = n_asked")
        one = F.when((F.col("low") == F.col("high")) & (F.col("n_labels") == F.col("n")), F.col("low"))
        return sure.select("extractor", "name", F.lit(anchor).alias("anchor"), F.col("some_path").alias("path") if "path" not in keys else "path", "form", one.alias("label"), "depth", "first")

    by_place = anchored("place", F.col("n_same") == 1, ["path", "form"])
    by_label = anchored("label", (F.col("n_label") == 1) & F.col("label").isNotNull(), ["label", "form"])
    rank = F.struct(F.col("anchor") == "label", F.col("form") == "rest", -F.col("depth"), "first", "path")
    best = by_place.unionByName(by_label).groupBy("extractor", "name").agg(F.min_by(F.struct("anchor", "path", "form", "label"), rank).alias("b")).select("extractor", "name", "b.*")
    values = held.join(best.select("extractor", "name", "anchor", F.col("path").alias("at"), F.col("form").alias("as"), F.col("label").alias("said")), ["extractor", "name"])
    values = values.where((F.col("form") == F.col("as")) & F.when(F.col("anchor") == "place", F.col("path") == F.col("at")).otherwise((F.col("label") == F.col("said")) & (F.col("n_label") == 1)))
    return measured(best.join(_profile(values), ["extractor", "name"]))


def unlearnt(examples: DataFrame, fields: DataFrame) -> DataFrame:
    """extractor and name of what the examples ask for and no place or label tells."""
    return examples.select("extractor", "name").distinct().join(fields, ["extractor", "name"], "left_anti")


def replay(said: DataFrame, fields: DataFrame) -> DataFrame:
    """extractor, page_id, name, path, value, label of each field on each page that has it once."""
    own = measured(fields).select("extractor", "name", "form", "anchor", F.when(F.col("anchor") == "place", F.col("path")).otherwise(F.col("label")).alias("at"))
    at = lambda anchor, once, text: F.when(F.col(once) == 1, F.struct(F.lit(anchor).alias("anchor"), F.col(text).alias("at")))
    # a text is asked for at its place and behind its label at once, so that pages are read once
    each = F.explode(F.array_compact(F.array(at("place", "n_same", "path"), at("label", "n_label", "label")))).alias("a")
    return said.select("extractor", "page_id", "form", "path", "value", "label", each).select("*", "a.*").join(own, ["extractor", "form", "anchor", "at"]).select("extractor", "page_id", "name", "path", "value", "label")


def checks(said: DataFrame, pages: DataFrame, fields: DataFrame) -> DataFrame:
    """extractor, page_id, kind, name and ok: whether each field is found, has its label before it, reads and keeps its shape.

    ``pages`` has extractor and page_id: a page that says nothing fails too. Pages of an extractor without fields aren't checked.
    """
    fields = measured(fields)
    asked = pages.select("extractor", "page_id").join(fields.select("extractor", "name", "anchor", F.col("label").alias("said"), "shape", "reads"), "extractor")
    m = asked.join(replay(said, fields).hint("merge"), ["extractor", "page_id", "name"], "left")
    v, has = F.col("value"), F.col("value").isNotNull()
    read = F.when(F.col("reads") == "amount", scalars.amount(v).isNotNull()).otherwise(scalars.iso_date(v).isNotNull())
    each = F.array(
        F.struct(F.lit("field").alias("kind"), has.alias("ok")),
        F.when(has & (F.col("anchor") == "place") & F.col("said").isNotNull(), F.struct(F.lit("label").alias("kind"), F.col("label").eqNullSafe(F.col("said")).alias("ok"))),
        F.when(has & F.col("reads").isNotNull(), F.struct(F.lit("reads").alias("kind"), read.alias("ok"))),
        F.when(has & F.col("shape").isNotNull(), F.struct(F.lit("shape").alias("kind"), scalars.fits(v, F.col("shape")).alias("ok"))),
    )
    return m.select("extractor", "page_id", "name", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("c")).select("extractor", "page_id", "c.kind", "name", "c.ok")


def heal(said: DataFrame, pages: DataFrame, fields: DataFrame) -> DataFrame:
    """extractor, kind, name, path, label and seen: where each field is on pages as they are now.

    kept: it is found on KEPT of the pages, with its label, and fits; moved: its label, or else the place that holds most of its samples, tells where it
    went; ambiguous: two places hold as many; vanished: none. seen: pages or samples that speak for it.
    """
    n = pages.groupBy("extractor").agg(F.count_distinct("page_id").alias("n_pages"))
    fields = measured(fields)
    own = fields.select("extractor", "name", "anchor", F.col("path").alias("old"), F.col("label").alias("said"), "form", "shape", "samples")
    fit = F.col("shape").isNull() | scalars.fits(F.col("value"), F.col("shape"))
    sound = replay(said, fields).join(own, ["extractor", "name"]).where(fit & (F.col("said").isNull() | F.col("label").eqNullSafe(F.col("said"))))
    stays = sound.groupBy("extractor", "name").agg(F.count_distinct("page_id").alias("seen"), F.min("path").alias("path")).join(n, "extractor").where(F.col("seen") >= KEPT * F.col("n_pages"))
    stays = measured(stays.join(own.select("extractor", "name", "said"), ["extractor", "name"]).select("extractor", F.lit("kept").alias("kind"), "name", "path", F.col("said").alias("label"), "seen"))
    left = measured(own.join(stays, ["extractor", "name"], "left_anti"))
    at_label = said.where("n_label = 1").join(left.where("said is not null").withColumn("label", F.col("said")), ["extractor", "label", "form"]).where(fit)
    at_label = at_label.groupBy("extractor", "name", "path", "label").agg(F.count_distinct("page_id").alias("seen")).join(n, "extractor").where(F.col("seen") >= KEPT * F.col("n_pages"))
    by_label = at_label.groupBy("extractor", "name").agg(F.max_by(F.struct("path", "label", "seen"), F.struct("seen", "path")).alias("b")).select("extractor", F.lit("moved").alias("kind"), "name", "b.path", "b.label", "b.seen")
    left = measured(left.join(by_label, ["extractor", "name"], "left_anti"))
    sample = left.select("extractor", "name", "form", F.explode("samples").alias("sample")).withColumn("key", F.explode(_keys(F.col("sample"))))
    met = said.where("n_same = 1").withColumn("key", F.explode(_keys(F.col("value")))).join(sample, ["extractor", "form", "key"])
    places = met.groupBy("extractor", "name", "path").agg(F.count_distinct("sample").alias("seen"), F.max("depth").alias("depth"), F.max("label").alias("label"))
    deepest = places.groupBy("extractor", "name", "seen", "depth").agg(F.count("*").alias("rivals"), F.min("path").alias("path"), F.min("label").alias("label"))
    best = deepest.groupBy("extractor", "name").agg(F.max_by(F.struct("path", "label", "seen", "rivals"), F.struct("seen", "depth")).alias("b"))
    by_sample = best.select("extractor", F.when(F.col("b.rivals") > 1, "ambiguous").otherwise("moved").alias("kind"), "name", "b.path", "b.label", "b.seen")
    gone = left.join(by_sample, ["extractor", "name"], "left_anti").select("extractor", F.lit("vanished").alias("kind"), "name", F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("label"), F.lit(0).cast("long").alias("seen"))
    return stays.unionByName(by_label).unionByName(by_sample).unionByName(gone)


def healed(fields: DataFrame, changes: DataFrame) -> DataFrame:
    """The fields' table after heal(): kept ones as they were, moved ones at their new place; what is ambiguous or gone is left out."""
    told = changes.where("kind in ('kept', 'moved')").select("extractor", "name", "kind", F.col("path").alias("now"))
    both = fields.join(told, ["extractor", "name"])
    moved = (F.col("kind") == "moved") & (F.col("anchor") == "place")
    return both.withColumn("path", F.when(moved, F.col("now")).otherwise(F.col("path"))).select(fields.columns)
