"""Numbers by key are 1 to n, each once, also where ranges are sampled and rows have more than their key."""

from pyspark.sql import functions as F

from granary.operators import select


def test_numbers_are_each_given_once(spark):
    rows = spark.range(0, 200_000, 1, 8).select(F.xxhash64("id").alias("k"), F.md5(F.col("id").cast("string")).alias("t"))
    n = select.numbered(rows, "k").agg(F.count("*"), F.count_distinct("ord"), F.min("ord"), F.max("ord"), F.max("t")).first()
    assert tuple(n)[:4] == (200_000, 200_000, 1, 200_000)
