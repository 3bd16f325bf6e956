"""Fixed points: lineage cuts with bounded estimates, components over both paths."""

from pyspark.sql import functions as F

from tesserae.plans.fixpoint import components, cut


def test_cut_keeps_the_size_estimate(spark):
    state = spark.range(1000).select(F.col("id").alias("k"), F.col("id").alias("v"))
    other = cut(state)
    for _ in range(25):
        state = cut(state.join(other.withColumnRenamed("v", "w"), "k").select("k", F.least("v", "w").alias("v")))
        assert int(state._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < 1 << 24
    assert state.count() == 1000


def test_components_of_a_long_path(spark):
    # Ids are scattered, so that neighbours on the path lie in different partitions.
    path = spark.range(9999).select((F.col("id") * 7919 % 10007).alias("u"), ((F.col("id") + 1) * 7919 % 10007).alias("v")).repartition(8)
    extra = spark.createDataFrame([(20000, 20001), (20003, 20003), (20001, 20000)], "u long, v long")
    alone = spark.createDataFrame([(30000,)], "node long")
    want = {i * 7919 % 10007: 0 for i in range(10000)} | {20000: 20000, 20001: 20000, 20003: 20003, 30000: 30000}
    for most in (1 << 20, 0):
        got = {r["node"]: r["component"] for r in components(path.unionByName(extra), alone, one_task=most).collect()}
        assert got == want
    assert components(path.limit(0)).count() == 0


def test_components_of_a_long_path_in_order(spark):
    # Labels that only pass from neighbour to neighbour need more than 60 rounds here.
    path = spark.range(3000).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")).repartition(4)
    got = components(path.unionByName(path.selectExpr("u + 10000 AS u", "v + 10000 AS v")), one_task=1000).collect()
    assert {(r["component"], r["node"] >= 10000) for r in got} == {(0, False), (10000, True)} and len(got) == 6002
