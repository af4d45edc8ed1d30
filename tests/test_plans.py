"""Plans keep their shape: filters and columns reach the scan, small sides are broadcast, nothing is nested-loop joined by accident."""

import re

import pytest

from tessella.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_columns_are_pruned(spark):
    text = plan(spark, "hist_colors")
    assert "props" not in text and "event_type" not in text
    assert re.search(r"ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,value:double>", text)


def test_filters_reach_the_scan(spark):
    assert re.search(r"PushedFilters: \[.*GreaterThan\(value,50", plan(spark, "resume_anti_join"))
    assert re.search(r"PushedFilters: \[.*LessThan\(vec_id,8", plan(spark, "hamming_dictionary"))


@pytest.mark.parametrize("name", ["bayer_nearest_palette", "rgb565_codes", "ycbcr_fixed", "color_hex", "ycbcr_float", "padded_tiles", "jpeg_tables"])
def test_projections_do_not_shuffle(spark, name):
    assert "Exchange" not in plan(spark, name)


@pytest.mark.parametrize("name", ["dct_fixed_forward", "dct_float_forward", "expgolomb_bits"])
def test_block_kernels_do_not_shuffle(spark, name):
    text = plan(spark, name)
    assert "Exchange" not in text and "MapInArrow" in text


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_no_row_at_a_time_python(spark, name):
    if name.startswith("stream"):
        pytest.skip("runs as it is built")
    text = plan(spark, name)
    assert "BatchEvalPython" not in text and "CartesianProduct" not in text


def test_undominated_is_no_self_join(spark):
    assert "BroadcastNestedLoopJoin" not in plan(spark, "pareto_settings")
