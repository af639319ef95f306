"""What the plans must look like: columns and filters at the scan, no cross joins, one top-k."""

from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


def plan(spark, name):
    return entry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def schemas(text):
    return [line.split("ReadSchema:")[1] for line in text.split("\n") if "ReadSchema:" in line]


@pytest.mark.parametrize("name", ["facet_filter", "facet_values", "metadata_desc", "audio_filter", "facet_years"])
def test_lists_do_not_read_texts(spark, name):
    assert all("text:" not in s for s in schemas(plan(spark, name)))


def test_filters_reach_the_scan(spark):
    assert "EqualTo(version,TLV)" in plan(spark, "facet_filter")
    assert "EqualTo(sermon_id,57-0000-recueil)" in plan(spark, "point_lookup")


@pytest.mark.parametrize("name", ["search_phrase", "fts_phrase", "search_page2"])
def test_pages_are_one_top_k(spark, name):
    assert "TakeOrderedAndProject" in plan(spark, name)


CORE = [n for n in entry.queries() if not (n[0] == "p" and n[1].isdigit())]


@pytest.mark.parametrize("name", CORE)
def test_no_cross_joins_and_no_python(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "Python" not in text and "Pandas" not in text
    assert "MapInArrow" not in text or name in ("quote_locations", "citation_colours", "quote_first_tokens")
