"""What plans must not do as tables grow: broadcast pages, parse them twice, or leave the work to one task."""

import re

import pytest

import __spark_entry__  # noqa: F401  registers the queries
from loomgrain.plans.registry import QUERIES


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _parses(df):
    """How often a plan hands pages to Python, cached frames included."""
    return len(re.findall(r"\bMapInArrow\b", _plan(df)))


@pytest.mark.parametrize("name", ["audit_conditions", "audit_verdicts", "audit_missing_required"])
def test_the_audit_reads_a_page_once_and_joins_nothing(spark, tiny, name):
    df = QUERIES[name](spark, tiny)
    assert _parses(df) == 2  # the parse and the rules
    assert "Join" not in _plan(df) and "Broadcast" not in _plan(df)


def _pages_broadcast(df):
    """Whether a parse stands below a broadcast in the plan."""
    depth = None
    for line in _plan(df).splitlines():
        at = len(re.match(r"[\s:|+-]*", line)[0])
        if depth is not None and at <= depth:
            depth = None
        if "MapInArrow" in line and depth is not None:
            return True
        if "BroadcastExchange" in line and depth is None:
            depth = at
    return False


@pytest.mark.parametrize(("name", "parses"), [("page_fields_run", 1), ("page_fields_drift", 1)])
def test_fields_are_broadcast_and_pages_are_not(spark, tiny, name, parses):
    df = QUERIES[name](spark, tiny)
    assert not _pages_broadcast(df)
    assert _parses(df) == parses


@pytest.mark.parametrize(("name", "parses"), [("link_relations", 1), ("og_arrays", 1), ("diff_kinds", 2), ("conflicts_published", 1), ("conflicts_price", 1)])
def test_pages_are_parsed_once(spark, tiny, name, parses):
    assert _parses(QUERIES[name](spark, tiny)) == parses


def test_answers_that_are_learnt_from_are_kept(spark, tiny):
    assert "InMemoryTableScan" in _plan(QUERIES["summary_contract"](spark, tiny))


@pytest.mark.parametrize("name", ["learn_wanted", "record_paths", "crawl_scope"])
def test_work_on_pages_is_dealt_to_more_tasks_than_cores(spark, tiny, name):
    dealt = re.findall(r"RoundRobinPartitioning\((\d+)\)", _plan(QUERIES[name](spark, tiny)))
    assert dealt and int(dealt[0]) > spark.sparkContext.defaultParallelism


def test_a_wanted_listing_is_dealt_behind_its_join(spark, tiny):
    plan = _plan(QUERIES["learn_wanted"](spark, tiny))
    assert plan.index("MapInArrow") < plan.index("RoundRobinPartitioning") < plan.index("Join")


def test_an_address_listed_again_is_taken_apart_once(spark, tiny):
    plan = _plan(QUERIES["batch_once"](spark, tiny))
    assert len(re.findall(r"\bHashAggregate\b", plan)) == 4


def test_selectors_are_broadcast_and_pages_stay_where_they_are(spark):
    from pyspark.sql import functions as F

    from loomgrain.operators import written
    from loomgrain.plans.field_queries import _selectors

    pages = spark.range(10).select(F.lit("shop").alias("extractor"), F.col("id").alias("page_id"), F.lit("https://x/").alias("url"), F.lit('<li class="row"><a class="name">n</a>').alias("html"))
    plan = _plan(written.read(pages, _selectors(spark)))
    assert "BuildRight" in plan and "hashpartitioning" not in plan


@pytest.mark.parametrize("name", ["run_checks", "written_drift", "written_broken", "written_heal", "healed_contract", "contract_json"])
def test_contracts_are_broadcast_and_rows_of_pages_are_not(spark, tiny, name):
    df = QUERIES[name](spark, tiny)
    assert not _pages_broadcast(df)
    spark.catalog.clearCache()
