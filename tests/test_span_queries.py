"""What the span queries shuffle, and to how many tasks keys are dealt."""

import pytest

from maskwright.plans import QUERIES


@pytest.mark.parametrize("name", ["merge_trim_extend", "model_spans"])
def test_spans_are_made_after_the_shuffle(spark, tmp_path, name):
    spark.createDataFrame([(1, 2, 3, 1)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    gathered = [x for x in plan.splitlines() if "partial_collect_list" in x]
    assert gathered and not any("model" in x for x in gathered)


@pytest.mark.parametrize("name", ["det_cf", "det_iban_compact", "det_iban_grouped"])
def test_keys_of_one_small_file_go_to_all_tasks(spark, tmp_path, name):
    spark.range(1, 400).withColumnRenamed("id", "c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    d = QUERIES[name](spark, str(tmp_path))
    assert d.count() == 399 and d.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
