"""Steps that hold a table's keys are dealt into partitions whose number grows with the table."""

import re

import pytest

from murmur.plans import registry
from murmur.sources import views

SOURCE = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["inserted_segments", "policy_fan_out", "station_demand", "mention_documents"])
def test_partitions_grow_with_the_table(spark, name):
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        dealt = {}
        for limit in ("64k", "4k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
            splits = spark.read.parquet(f"{SOURCE}/lineitem.parquet").rdd.getNumPartitions()
            plan = registry.queries()[name](spark, SOURCE)._jdf.queryExecution().optimizedPlan().toString()
            dealt[splits] = {int(n) for n in re.findall(r"RepartitionByExpression \[.*?\], (\d+)", plan)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    assert len(dealt) == 2
    for splits, numbers in dealt.items():
        assert views.PER_SPLIT * splits in numbers, dealt
