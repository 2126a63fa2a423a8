"""Session defaults, table access and lineage cuts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("papyrine")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the given data folder."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts: ``spark.checkpoint.dir`` of the session.

    Only where that setting is absent, as in tests on one machine, a local folder is made.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        path = tempfile.mkdtemp(prefix="papyrine-checkpoints-")
    sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded_rows(df: DataFrame, limit: int) -> list | None:
    """The rows of ``df`` if there are at most ``limit`` of them, else None.

    At most ``limit + 1`` rows ever reach the driver, so callers can try the broadcast
    form of an operator and fall back to its partitioned form beyond the bound.
    """
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def fan_out(df: DataFrame, *keys) -> DataFrame:
    """Spread the rows over all cores before a costly per-row step.

    A file split holds many rows of cheap input; a Python step over them is CPU bound, so
    parallelism has to follow the cores instead of the bytes.
    """
    n = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *[F.col(k) if isinstance(k, str) else k for k in keys]) if keys else df.repartition(n)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable by the Python workers of the executors.

    One small task per session asks whether they have it already, by installation or PYTHONPATH; if
    not, it is sent as a zip through Spark's own file distribution, which also serves
    executors that join later.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    name = __name__.partition(".")[0]

    def has(_) -> list[bool]:
        import importlib.util

        return [importlib.util.find_spec(name) is not None]

    n = max(1, min(64, sc.defaultParallelism))
    if not all(sc.parallelize(range(n), n).mapPartitions(has).collect()):
        import shutil
        from pathlib import Path

        root = Path(__file__).resolve().parent
        built = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix=f"{name}-"), name), "zip", root_dir=root.parent, base_dir=root.name)
        sc.addPyFile(built)
    _SHIPPED.add(sc.applicationId)
