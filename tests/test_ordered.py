"""Ordered folds over many small keys."""

from pyspark.sql import functions as F

from parley.operators.ordered import fold_in_order


def test_many_small_keys_keep_all_partitions(spark):
    rows = spark.range(400).select((F.col("id") % 100).alias("k"), F.col("id").alias("v"))
    summed = fold_in_order(rows, ["k"], ["v"], lambda key, own: [(key[0], [r["v"] for r in own])], "k long, vs array<long>")
    tasks = summed.select("k", "vs", F.spark_partition_id().alias("task")).collect()
    assert {r.k: r.vs for r in tasks} == {k: [k, k + 100, k + 200, k + 300] for k in range(100)}
    assert len({r.task for r in tasks}) == int(spark.conf.get("spark.sql.shuffle.partitions"))
