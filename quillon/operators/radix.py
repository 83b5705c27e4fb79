"""Radix partitioning, its histogram and prefix sum, pair join and value index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.bits import low_bits
from quillon.plans.lower import hinted


def bucket(column: Column, bits: int) -> Column:
    return low_bits(column, bits)


def second_bucket(column: Column, bits: int, bits2: int) -> Column:
    return low_bits(F.shiftrightunsigned(column, bits), bits2)


def radix_partition(df: DataFrame, column: str, bits: int, bits2: int | None = None) -> DataFrame:
    """``df`` with ``bucket`` (and ``bucket2``) columns."""
    out = df.withColumn("bucket", bucket(F.col(column), bits))
    return out if bits2 is None else out.withColumn("bucket2", second_bucket(F.col(column), bits, bits2))


def clustered(df: DataFrame, column: str, bits: int, bits2: int | None = None, n: int | None = None) -> DataFrame:
    """Really partitioned: rows of a bucket in one Spark partition, buckets ascending in it, then second buckets.

    The first pass deals rows by bucket, the second orders each partition by the next
    bits; both are one exchange and one sort.
    """
    out = radix_partition(df, column, bits, bits2)
    placed = out.repartition(n, "bucket") if n else out.repartition("bucket")
    return placed.sortWithinPartitions("bucket", *([] if bits2 is None else ["bucket2"]))


def layout(placed: DataFrame) -> DataFrame:
    """``(bucket, n, n_partitions, n_falls)`` of a clustered frame as it lies.

    n_falls counts the rows whose bucket (or second bucket) is less than that of the row
    before them in their partition: 0 if the partitioning is in order.
    """
    key = F.struct(*(c for c in ("bucket", "bucket2") if c in placed.columns))
    rows = placed.select("bucket", key.alias("key"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    fell = F.coalesce((F.col("key") < F.lag("key").over(Window.partitionBy("part").orderBy("at"))).cast("bigint"), F.lit(0))
    rows = rows.select("bucket", "part", fell.alias("fell"))
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), F.countDistinct("part").alias("n_partitions"), F.sum("fell").alias("n_falls"))


def histogram(df: DataFrame, column: str, bits: int) -> DataFrame:
    """``(bucket, n)``: per-task partial counts merged by one tiny shuffle."""
    return df.groupBy(bucket(F.col(column), bits).alias("bucket")).agg(F.count("*").alias("n"))


def prefix_sum(hist: DataFrame) -> DataFrame:
    """``(bucket, start)``: exclusive running sum.

    One task sees the histogram, whose size 2**bits does not depend on the data.
    """
    w = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return hist.select("bucket", F.coalesce(F.sum("n").over(w), F.lit(0)).cast("bigint").alias("start"))


def largest_partition(hist: DataFrame) -> DataFrame:
    return hist.agg(F.max("n").alias("max_n"))


def pair_join(r: DataFrame, s: DataFrame, hint: str | None = None) -> DataFrame:
    """All pairs ``(r_id, s_id)`` with equal values, from ``(id, value)`` inputs of two columns each."""
    left = r.toDF("r_id", "value")
    right = s.toDF("s_id", "value")
    return left.join(hinted(right, hint), "value").select("r_id", "s_id")


#: Row ids that one page of a value's index spans.
PAGE = 4_096


def value_index(df: DataFrame, value: str, row_id: str, page: int = PAGE) -> DataFrame:
    """``(value, page, ids, n)``: the sorted row ids of each value, in pages of ``page`` consecutive id numbers.

    A page holds at most ``page`` distinct ids, so a value that holds any share of all
    rows is spread over many rows and tasks.
    """
    rows = df.select(F.col(value).alias("value"), F.floor(F.col(row_id) / F.lit(page)).cast("bigint").alias("page"), F.col(row_id).alias("id"))
    return rows.groupBy("value", "page").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("n", F.size("ids").cast("bigint"))


def value_counts(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))


def value_lookup(df: DataFrame, value: str, wanted: int, row_id: str) -> DataFrame:
    """Row ids with ``value = wanted``: a filter that reaches the Parquet scan."""
    return df.filter(F.col(value) == F.lit(wanted)).select(row_id)
