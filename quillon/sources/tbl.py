"""Pipe-delimited integer tables (``.tbl``): a pipe after every field, the last included."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read(spark: SparkSession, path: str, n_columns: int) -> DataFrame:
    fields = [T.StructField(f"c{i}", T.LongType()) for i in range(n_columns)]
    schema = T.StructType([*fields, T.StructField("_end", T.StringType())])
    return spark.read.csv(path, sep="|", schema=schema, mode="FAILFAST").select(*(f.name for f in fields))


def write(df: DataFrame, path: str) -> None:
    from pyspark.sql import functions as F

    df.select(F.concat(*(F.concat(F.col(f"`{c}`").cast("string"), F.lit("|")) for c in df.columns)).alias("value")).write.text(path)


def ddl(name: str, n_columns: int) -> str:
    """The matching SQL table definition and COPY statement."""
    columns = ",".join(f"c{i} bigint" for i in range(n_columns))
    return f"CREATE TABLE {name} ({columns});\ncopy {name} from '{name}.tbl' delimiter '|';\n"
