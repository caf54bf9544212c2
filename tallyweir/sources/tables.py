"""Parquet tables of one folder, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def stream_table(spark: SparkSession, folder: str, name: str, max_files: int) -> DataFrame:
    """The table as a stream, ``max_files`` files at a time. The path is a pattern, as only patterns may name a file."""
    schema = table(spark, folder, name).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    return reader.parquet(f"{folder.rstrip('/')}/{name}.parque[t]")


def arriving(spark: SparkSession, rows: DataFrame, path: str, files: int) -> DataFrame:
    """A stream of rows that are written to ``files`` files first, a file in each micro-batch."""
    rows.repartition(files).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
