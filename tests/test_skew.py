"""Joins with frequent keys."""

import random

from pyspark.sql import functions as F

from harborwatch.operators.skew import frequency_split_join


def test_equals_a_plain_join_and_spreads_the_frequent_key(spark):
    rng = random.Random(3)
    rows = [(0 if rng.random() < 0.6 else rng.randrange(1, 400), i) for i in range(5000)]
    table = spark.createDataFrame(rows, "k int, i int").repartition(8)
    counted = table.groupBy("k").agg(F.count(F.lit(1)).alias("n"), (F.max("i") % 7).alias("v")).filter("k % 5 <> 3")
    joined = frequency_split_join(table, counted, ["k"], "n", frequent=100)
    want = table.join(counted, "k")
    assert sorted(map(tuple, joined.select("k", "i", "n", "v").collect())) == sorted(
        map(tuple, want.select("k", "i", "n", "v").collect()))
    # The frequent key's rows stay in the eight parts they came in.
    sizes = sorted(r["count"] for r in joined.filter("k = 0").groupBy(F.spark_partition_id()).count().collect())
    assert len(sizes) == 8 and sizes[-1] < 3 * sizes[4]


def test_empty_sides(spark):
    table = spark.createDataFrame([(1, 2)], "k int, i int")
    counted = spark.createDataFrame([], "k int, n long")
    assert frequency_split_join(table, counted, ["k"], "n").count() == 0
    assert frequency_split_join(table.limit(0), counted, ["k"], "n").count() == 0
