"""Joins whose small side is measured before it is broadcast, and small frame helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from fleetcast.session import scratch_dir

#: a side is broadcast only if its counted rows times its row width stay below this
BROADCAST_BYTES = 32 << 20


def row_bytes(schema: T.StructType, text: int = 64) -> int:
    """Width taken for one row: 16 bytes a field, ``text`` for strings and binaries."""
    wide = (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType)
    return 16 + sum(text if isinstance(f.dataType, wide) else 16 for f in schema)


def measured_join(big: DataFrame, small: DataFrame, on, how: str, limit: int = BROADCAST_BYTES, row_width: int | None = None) -> DataFrame:
    """Join with ``small`` broadcast only if it is counted to fit; a shuffle join beyond.

    ``small`` should be staged, since it is counted first. ``row_width`` gives the bytes of a row where they are
    known better than from the schema. AQE splits skewed keys of the shuffle join.
    """
    fits = small.count() * (row_width or row_bytes(small.schema)) <= limit
    return big.join(F.broadcast(small) if fits else small, on, how)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = f"_{name}"
    return name


def input_columns(df: DataFrame, **roles: str) -> DataFrame:
    """Only the columns that play a role, under the role's name; other columns cannot clash."""
    return df.select(*[F.col(f"`{c}`").alias(role) for role, c in roles.items()])


def fold_ascii(c: Column) -> Column:
    """A-Z to a-z, everything else as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def new_folder(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
