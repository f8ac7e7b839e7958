import pytest

from maskwright.plans import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, scans", [("anonymize_text", 3), ("merge_greedy", 3), ("ph_dictionary", 3), ("ph_assign", 3), ("stats_by_label", 3), ("det_email", 1), ("det_url", 1), ("det_card", 1), ("det_iban_grouped", 3)])
def test_each_detector_scans_a_text_once(spark, name, scans):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == scans
