"""Copies of a row enter the trees' samples independently of each other."""

from pyspark.sql import functions as F

from raregrain.operators.anomaly import _tree_samples


def test_copies_have_their_share_of_every_sample(spark):
    hot = spark.range(10_000).select(F.lit(7).cast("bigint").alias("key"), F.array(F.lit(1.0), F.lit(2.0)).alias("x"))
    rest = spark.range(20_000).select((F.col("id") + 100).alias("key"), F.array(F.rand(1), F.rand(2)).alias("x"))
    samples = _tree_samples(hot.unionByName(rest), 20, 256, 30_000, 42).groupBy("tree").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x")[0] == 1.0).alias("hot"))
    found = samples.collect()
    assert len(found) == 20 and all(r.n == 256 and 45 <= r.hot <= 125 for r in found)
    assert abs(sum(r.hot for r in found) / (20 * 256) - 1 / 3) < 0.05
