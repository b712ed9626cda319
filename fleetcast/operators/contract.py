"""Schema contracts: save, load, compare, detect drift."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetcast.operators.stats import profile


def column_types(df: DataFrame) -> DataFrame:
    """(column, type) of a table."""
    rows = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "column string, type string")


def build_contract(tables: Mapping[str, DataFrame], *, counts: bool = False) -> DataFrame:
    """Columns of several tables: (source, column, type, non_null, n_unique).

    Names and types come from the schemas, without a scan; ``counts`` adds the exact counts of a profile.
    """
    out = None
    for name, df in tables.items():
        if counts:
            told = profile(df)
        else:
            nothing = F.lit(None).cast("long")
            told = column_types(df).withColumns({"non_null": nothing, "n_unique": nothing})
        part = told.select(F.lit(name).alias("source"), "column", "type", "non_null", "n_unique")
        out = part if out is None else out.unionByName(part)
    return out


def save_contract(contract: DataFrame, path: str) -> None:
    """Write a contract (a few rows per table) as JSON."""
    contract.coalesce(1).write.mode("overwrite").json(path)


def load_contract(spark: SparkSession, path: str) -> DataFrame:
    """Read a saved contract."""
    return spark.read.schema(
        "source string, column string, type string, non_null long, n_unique long"
    ).json(path)


def schema_text(df: DataFrame) -> str:
    """Schema as JSON text."""
    return df.schema.json()


def schema_from_text(text: str) -> T.StructType:
    """Schema from its JSON text."""
    return T.StructType.fromJson(json.loads(text))


def compare_schemas(reference: DataFrame, current: DataFrame) -> DataFrame:
    """(column, change) for columns added, removed or retyped between two (column, type) tables."""
    ref = reference.select("column", F.col("type").alias("old_type"))
    new = current.select("column", F.col("type").alias("new_type"))
    change = (
        F.when(F.col("old_type").isNull(), "added")
        .when(F.col("new_type").isNull(), "removed")
        .when(F.col("old_type") != F.col("new_type"), "retyped")
    )
    return ref.join(new, "column", "full_outer").withColumn("change", change).filter("change is not null")


def schema_drift(reference: DataFrame, current: DataFrame) -> DataFrame:
    """Differences of two contracts, including whole sources that appeared or vanished."""
    ref = reference.select("source", "column", F.col("type").alias("old_type"))
    new = current.select("source", "column", F.col("type").alias("new_type"))
    old_sources = reference.select("source").distinct().withColumn("_was", F.lit(True))
    new_sources = current.select("source").distinct().withColumn("_is", F.lit(True))
    pairs = ref.join(new, ["source", "column"], "full_outer")
    placed = pairs.join(old_sources, "source", "left").join(new_sources, "source", "left")
    change = (
        F.when(F.col("_was").isNull(), "new_source")
        .when(F.col("_is").isNull(), "vanished_source")
        .when(F.col("old_type").isNull(), "added")
        .when(F.col("new_type").isNull(), "removed")
        .when(F.col("old_type") != F.col("new_type"), "retyped")
    )
    return (
        placed.withColumn("change", change)
        .filter("change is not null")
        .select("source", "column", "change", "old_type", "new_type")
    )
