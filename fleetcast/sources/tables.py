"""Readers: declared CSV sources, parquet layers, catalog tables and partitioned JDBC."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


@dataclass(frozen=True)
class CsvSource:
    """A declared CSV source and the layer table it fills."""

    name: str
    path: str
    table: str
    schema: T.StructType
    timestamp_format: str = "yyyy-MM-dd HH:mm:ss"
    date_format: str = "yyyy-MM-dd"


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Scan one parquet table of a folder."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def read_layer(spark: SparkSession, root: str, layer: str, names: list[str]) -> dict[str, DataFrame]:
    """All named tables of a layer (``bronze``, ``silver``, ``gold``) as a dict."""
    return {n: spark.read.parquet(f"{root.rstrip('/')}/{layer}/{n}") for n in names}


def read_csv_source(spark: SparkSession, source: CsvSource) -> DataFrame:
    """Typed CSV scan; splits of large files are read in parallel."""
    return (
        spark.read.schema(source.schema)
        .option("header", True)
        .option("timestampFormat", source.timestamp_format)
        .option("timestampNTZFormat", source.timestamp_format)
        .option("dateFormat", source.date_format)
        .csv(source.path)
    )


def preview_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw CSV with inferred column types, for a first look at an unknown file."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def read_matrix(spark: SparkSession, location: str, source: str = "parquet") -> DataFrame:
    """Feature matrix from a parquet folder or a catalog table."""
    if source == "parquet":
        return spark.read.parquet(location)
    if source == "table":
        return spark.table(location)
    raise ValueError(f"unknown source {source!r}, expected 'parquet' or 'table'")


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str,
    lower: int,
    upper: int,
    partitions: int,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """Database table in parallel ranges of a numeric column (needs the driver jar)."""
    return spark.read.jdbc(
        url,
        table,
        column=partition_column,
        lowerBound=lower,
        upperBound=upper,
        numPartitions=partitions,
        properties=properties or {},
    )
