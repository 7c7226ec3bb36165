"""Plans: filters and columns reach the scan, joins on intervals are equi-joins, native operators run no Python."""

from __future__ import annotations

import pytest

from tidemark import plans

DATA = "/root/testdata/sf0.001"


def plan(spark, name: str) -> str:
    return plans.QUERIES[name](spark, DATA)._jdf.queryExecution().toString()


@pytest.mark.parametrize(("name", "pushed"), [("p7_confidence_filter", "GreaterThanOrEqual(value,30.0)"), ("rel_semi_join", "EqualTo(o_orderpriority,1-URGENT)")])
def test_filters_reach_the_scan(spark, name, pushed):
    assert pushed in plan(spark, name)


@pytest.mark.parametrize(("name", "columns"), [("rel_forecast_revenue", {"l_quantity", "l_extendedprice", "l_discount", "l_shipdate"}), ("so6_unit_dedupe", {"doc_id", "text"}), ("a10_scoring_units", {"l_orderkey", "o_orderkey", "o_orderpriority"})])
def test_columns_are_pruned(spark, name, columns):
    import re

    read = {c.split(":")[0] for s in re.findall(r"ReadSchema: struct<([^>]*)>", plan(spark, name)) for c in s.split(",") if c}
    assert read == columns


@pytest.mark.parametrize("name", ["j1_overlay_link", "j6_frame_snap", "j3_exact_windows", "j14_conflicts", "rel_asof_join", "j12_stray_adoption", "r4_phrase_check", "r31_claims_to_requirements", "j15_jaccard_pairs", "j17_contradicting_topics", "j4_phrase_ocr", "f5_phrase_ratio", "f14_restore_spaces", "f32_brand_correction", "r7_figure_fidelity"])
def test_no_nested_loops(spark, name):
    p = plan(spark, name)
    assert "NestedLoop" not in p
    assert "CartesianProduct" not in p


@pytest.mark.parametrize("name", ["a1_interval_union", "k2_quota_top_k", "r17_score_by_order", "f12_content_tokens", "j1_overlay_link", "p4_segment_filter"])
def test_no_python(spark, name):
    p = plan(spark, name)
    assert not any(x in p for x in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroups"))
