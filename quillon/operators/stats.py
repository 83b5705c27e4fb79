"""Column statistics: one aggregation over the table, or the metastore's ANALYZE."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ColumnStats:
    min: float
    max: float
    count: float
    distinct: float


def column_stats(df: DataFrame, exact: bool = True) -> DataFrame:
    """Rows ``(col, min, max, count, distinct)``, one per column of ``df``.

    exact=False counts distinct values with a sketch: at scale one map-side pass of
    constant state.  The exact form unpivots to (column, value) pairs and
    aggregates those, which costs one shuffle of the distinct pairs.
    """
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("col"), F.col(f"`{c}`").cast("bigint").alias("v")) for c in df.columns)))
    rows = df.select(pairs.alias("p")).select("p.col", "p.v")
    if not exact:
        return rows.groupBy("col").agg(F.min("v").alias("min"), F.max("v").alias("max"), F.count("v").alias("count"), F.approx_count_distinct("v").alias("distinct"))
    per_value = rows.groupBy("col", "v").agg(F.count("v").alias("n"))
    return per_value.groupBy("col").agg(F.min("v").alias("min"), F.max("v").alias("max"), F.sum("n").alias("count"), F.count("v").alias("distinct"))


def collect_stats(df: DataFrame, exact: bool = True) -> dict[str, ColumnStats]:
    """The statistics as driver objects: one small row per column."""
    return {r["col"]: ColumnStats(r["min"] or 0, r["max"] or 0, r["count"], r["distinct"]) for r in column_stats(df, exact).collect()}


def analyze_table(spark: SparkSession, table: str) -> None:
    """Statistics of a catalog table for Spark's own cost-based optimizer."""
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS")
