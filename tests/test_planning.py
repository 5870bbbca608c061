"""Plans against the one-by-one rule, for different block sizes and partitionings."""

import random

import pytest
from pyspark.sql import functions as F

from assayer.operators import planning as P


def greedy(costs, limit, budget):
    plan, batch, used = [], [], 0
    for i, c in enumerate(costs):
        if batch and (len(batch) == limit or used + c > budget):
            plan.append(batch)
            batch, used = [], 0
        batch.append(i)
        used += c
    return plan + ([batch] if batch else [])


@pytest.mark.parametrize("block_rows,per_group,limit", [(8, 2, 8), (17, 3, 5), (40, 1000, 3), (5000, 10, 64)])
def test_plan_equals_the_sequential_rule(spark, block_rows, per_group, limit):
    rng = random.Random(block_rows)
    costs = [rng.choice([1, 5, 30, 90, 400]) for _ in range(403)]
    rows = spark.createDataFrame([(0, i, i, c) for i, c in enumerate(costs)], "epoch int, ord long, id long, cost long")
    plan = P.plan_updates(rows.repartition(7), limit, 300, block_rows=block_rows, blocks_per_group=per_group)
    got = {}
    for r in plan.collect():
        got.setdefault(r["update"], []).append((r["pos"], r["ord"]))
    want = greedy(costs, limit, 300)
    assert [[o for _p, o in sorted(got[u])] for u in range(len(want))] == want
    assert len(got) == len(want)


def test_order_does_not_depend_on_partitions(spark):
    ids = spark.range(500)
    a = P.epoch_order(ids.repartition(3), 1, 2).orderBy("epoch", "ord").collect()
    b = P.epoch_order(ids.repartition(16), 1, 2).orderBy("epoch", "ord").collect()
    assert a == b and [r["ord"] for r in a[:500]] == list(range(500))
    assert [r["id"] for r in a[:500]] != [r["id"] for r in a[500:]]


def test_rank_loads_are_balanced(spark):
    rows = spark.range(64).select(
        F.lit(0).alias("epoch"), F.lit(0).cast("long").alias("update"), F.col("id").cast("int").alias("pos"), "id",
        ((F.col("id") * 37) % 91 + 1).alias("cost"))
    loads = [r["s"] for r in P.assign_ranks(rows, 4).groupBy("rank").agg(F.sum("cost").alias("s")).collect()]
    assert len(loads) == 4 and max(loads) <= sum(loads) / 4 + 91


def test_stored_costs_must_match(spark):
    costs = spark.createDataFrame([("a", 3), ("b", 4)], "id string, cost int")
    ok = {"records": 2, "dataset_sha256": "d"}
    assert P.check_costs(costs, ok, dict(ok)).count() == 2
    with pytest.raises(ValueError, match="do not match"):
        P.check_costs(costs, ok, {"records": 2, "dataset_sha256": "e"})
    with pytest.raises(ValueError, match="incomplete"):
        P.check_costs(costs.filter("id = 'a'"), ok, dict(ok))


def test_long_stages_run_in_methods_that_the_jvm_compiles(spark):
    """the scoring stage of metric_score_scale is one generated method of 14,921 bytes, which HotSpot only interprets."""
    from assayer.plans import fixtures
    from assayer.session import HUGE_METHOD

    before = spark.conf.get(HUGE_METHOD)
    try:
        for given, wanted in (("65535", "8000"), ("20000", "20000")):
            spark.conf.set(HUGE_METHOD, given)
            fixtures.table(spark, "/root/testdata/sf0.001", "lineitem")
            assert spark.conf.get(HUGE_METHOD) == wanted
    finally:
        spark.conf.set(HUGE_METHOD, before)


def test_a_task_gets_enough_rows_of_lineitem(spark):
    from assayer.plans import fixtures

    rows = fixtures.table(spark, "/root/testdata/sf0.1", "lineitem")
    cores = spark.sparkContext.defaultParallelism
    assert rows.rdd.getNumPartitions() == max(cores, -(-rows.count() // fixtures.ROWS_OF["lineitem"]))
