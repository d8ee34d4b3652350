from pyspark.sql import functions as F

from trolley.plans import joins


def _broadcasts(df):
    return "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()


def test_static_bound_needs_no_job(spark):
    top = spark.range(1000).orderBy(F.desc("id")).limit(5)
    assert joins.static_max_rows(top) == 5
    assert joins.static_max_rows(spark.range(10).agg(F.sum("id"))) == 1
    assert joins.is_bounded(top, 10)


def test_counted_bound_and_fallback(spark):
    big = spark.range(50).filter(F.col("id") % 2 == 0).selectExpr("id", "id * 2 AS v")
    assert joins.bounded_rows(big, 100) == 25
    assert joins.bounded_rows(big, 10) is None
    probe = spark.range(50).withColumnRenamed("id", "k")
    small_side = joins.checked_broadcast(big, 100)
    assert _broadcasts(probe.join(small_side, probe.k == small_side.id))
    with_limit = joins.checked_broadcast(big, 10)  # over the bound: no hint
    assert not joins.is_bounded(big, 10)
    assert probe.join(with_limit, probe.k == with_limit.id).count() == 25
