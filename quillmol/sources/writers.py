"""Results as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_long(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Parquet by method; existing output stays unless overwrite."""
    df.write.mode("overwrite" if overwrite else "ignore").partitionBy("method").parquet(path)


def write_wide_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """CSV with a header, in order of pos: range partitions keep the order over files."""
    df.orderBy("pos").drop("pos").write.mode("overwrite" if overwrite else "ignore").option("header", True).csv(path)


def output_name(stem: str, method: str) -> str:
    return f"{stem.rstrip('_')}__{method}.csv"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_log(df: DataFrame, path: str) -> None:
    """A small CSV of one file, in place of an older one: a row for each job of a driver."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_timings(df: DataFrame, path: str) -> None:
    """Appends (variant, method, status, elapsed_s)."""
    df.write.mode("append").json(path)
