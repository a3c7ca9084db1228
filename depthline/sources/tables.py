"""Dataset reading by suffix and the sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depthline.functions.fixed_point import csv_double
from depthline.schema import SNAPSHOT


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path) if path.endswith(".parquet") else spark.read.csv(path, header=True, inferSchema=True)


def csv_rows(snapshots: DataFrame) -> DataFrame:
    """The snapshot columns as text, in order."""
    kinds = dict(snapshots.dtypes)
    return snapshots.select(*[(csv_double(F.col(c)) if kinds[c] == "double" else F.col(c).cast("string")).alias(c) for c in SNAPSHOT])


def write_csv(snapshots: DataFrame, path: str) -> None:
    csv_rows(snapshots).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_parquet(df: DataFrame, path: str, *partition_by: str) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).option("compression", "zstd").parquet(path)


def convert(spark: SparkSession, csv_path: str, parquet_path: str | None = None) -> str:
    out = parquet_path or csv_path.removesuffix(".csv") + ".parquet"
    write_parquet(read_dataset(spark, csv_path), out)
    return out
