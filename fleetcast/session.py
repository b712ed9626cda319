"""Session defaults and reliable staging of intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.util import inheritable_thread_target

T = TypeVar("T")

_local_scratch: dict[str, str] = {}
_shipped: set[str] = set()


def build_session(master: str = "local[*]", app: str = "fleetcast", **conf: str) -> SparkSession:
    """A session with the settings every operator relies on (UTC, AQE, Arrow)."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    session = builder.getOrCreate()
    ship_package(session)
    return session


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers, which import the Arrow functions by name.

    Needed where it is not installed on every machine. ``spark-submit --py-files`` does the same.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="fleetcast-")) / "fleetcast.zip"  # read by the driver, which serves it
    with zipfile.ZipFile(archive, "w") as out:
        for f in sorted(package.rglob("*.py")):
            out.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for staged tables.

    The cluster names it in ``spark.checkpoint.dir``. A temporary folder is used only
    when nothing is configured *and* the session is local; a cluster session without the
    setting is refused, since executors could not all see a machine-local path.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="fleetcast-")
    return _local_scratch[app]


def in_parallel(tasks: Sequence[Callable[[], T]], most: int = 4) -> list[T]:
    """Results of independent pieces of work, their Spark jobs submitted from driver threads."""
    if len(tasks) < 2:
        return [task() for task in tasks]
    with ThreadPoolExecutor(min(most, len(tasks))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(task)) for task in tasks]]


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as parquet and read it back.

    Cuts lineage in a way that survives executor loss, fixes any choice that a recomputation
    could make differently (range-partition bounds), and keeps column pruning and
    filter pushdown for the readers.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
