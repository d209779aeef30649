"""Range-partitioned numbering equals a plain row_number, also for a hot group."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from carrierbook.operators.numbering import number_rows


import pytest


@pytest.mark.parametrize("parts", [16, None])
def test_numbering_matches_row_number_with_hot_group(spark, parts):
    df = spark.range(0, 20000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 97).alias("g"),  # group 0 holds a third
        (F.col("id") * 7919 % 20011).alias("k"), F.col("id"))
    got = number_rows(df, ["k", "id"], group=["g"], start=1, out="n", num_partitions=parts)
    w = Window.partitionBy("g").orderBy("k", "id")
    want = df.withColumn("n", F.row_number().over(w).cast("bigint"))
    assert got.select("id", "n").exceptAll(want.select("id", "n")).count() == 0
    assert got.count() == 20000


def test_numbering_global_offset(spark):
    df = spark.range(0, 5000).select((F.col("id") * 31 % 5003).alias("k"))
    got = number_rows(df, ["k"], start=101, out="n", num_partitions=8)
    assert got.agg(F.min("n"), F.max("n"), F.countDistinct("n")).first() == (101, 5100, 5000)
    ns = [r["n"] for r in got.orderBy("k").select("n").collect()]
    assert ns == list(range(101, 5101))
