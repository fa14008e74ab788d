"""Two readings of the same pages compared: a full outer join by page and question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrain.functions import scalars


def _meaning(question: Column, value: Column) -> Column:
    return (
        F.when(question.startswith("price"), scalars.amount(value).try_cast("decimal(38,10)").cast("string"))
        .when(question.isin("published", "modified"), scalars.iso_date(value))
        .when(question == "currency", scalars.currency(value))
        .when(question == "gtin", scalars.gtin(value))
    )


def _money(question: Column, value: Column, declared: Column) -> Column:
    """A price's currency: what is written around its number, else what the page declares."""
    written = F.when(F.trim(value).rlike(r"^[+-]?\d+(?:\.\d+)?[eE][+-]?\d+$"), "").otherwise(F.regexp_replace(value, r"[\d.,'\s]", ""))
    return F.when(question.startswith("price"), F.coalesce(scalars.currency(written), declared, F.lower(written)))


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """page_id, question, kind (added, removed, changed, rewritten), before and after of every answer that differs.

    Both have page_id, question, value; a question is answered once a page. An answer is rewritten where both texts have one meaning,
    a price also in one currency.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        # a page's answers are few; its declared currency travels with them, by a window and no join, so that pages are read once
        paid = F.max(F.when(F.col("question") == "currency", F.col("value"))).over(Window.partitionBy("page_id"))
        told = df.select("page_id", "question", F.col("value").alias(name), paid.alias("paid"))
        return told.select("page_id", "question", name, scalars.currency(F.when(F.col("question").startswith("price"), F.col("paid"))).alias(f"{name}_currency"))

    both = side(before, "before").join(side(after, "after"), ["page_id", "question"], "full")
    q, old, new = F.col("question"), F.col("before"), F.col("after")
    same = (_meaning(q, old) == _meaning(q, new)) & _money(q, old, F.col("before_currency")).eqNullSafe(_money(q, new, F.col("after_currency")))
    kind = F.when(old.isNull(), "added").when(new.isNull(), "removed").when(F.coalesce(same, F.lit(False)), "rewritten").otherwise("changed")
    return both.where(~old.eqNullSafe(new)).select("page_id", "question", kind.alias("kind"), "before", "after")


def compare_declared(before: DataFrame, after: DataFrame) -> DataFrame:
    """page_id, part, kind, before and after of declared links or rights: each side has page_id, part and address or directive as ``value``.

    The values of a part are compared as sorted lists.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("page_id", "part").agg(F.to_json(F.array_sort(F.collect_set("value"))).alias(name))

    both = side(before, "before").join(side(after, "after"), ["page_id", "part"], "full").where(~F.col("before").eqNullSafe(F.col("after")))
    return both.select("page_id", "part", F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed").alias("kind"), "before", "after")
