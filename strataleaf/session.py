"""Session helpers: local sessions for tests, and tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[tuple[SparkSession, str]] = []
_TOLD: set[str] = set()
_OWN: dict[str, str] = {}
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: str | int = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine with the settings the engine expects anywhere (UTC, AQE)."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("strataleaf")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, as the cluster names it in spark.checkpoint.dir. Only a local session that names
    none gets a temporary folder; any other raises RuntimeError, as executors would each write to a disk of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="strataleaf-")
            atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
        base = _OWN[app]
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A place in the shared folder that is removed when this process ends, or before by :func:`drop`."""
    path = f"{shared_folder(spark)}/strataleaf-{os.getpid()}/{name}-{uuid.uuid4().hex[:12]}"
    _MADE.append((spark, path))
    return path


def store(df: DataFrame, name: str = "t") -> str:
    """Write ``df`` as a table in the shared folder; its path. The session is told once to
    remove shuffle files as soon as a query is over, so those of what was written go at once."""
    spark = df.sparkSession
    if spark.sparkContext.applicationId not in _TOLD:
        _TOLD.add(spark.sparkContext.applicationId)
        spark.conf.set(_CLEAN, "true")
    path = new_path(spark, name)
    df.write.parquet(path)
    return path


def materialise(df: DataFrame, name: str = "t") -> DataFrame:
    """:func:`store` ``df`` and read it back: lineage ends there, so a lost executor costs a re-read and not a
    recomputation. ``stored_at`` of the result is its path."""
    path = store(df, name)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many parts as the session runs tasks, if it has fewer: for work in Python over a table in few files. A table of many
    files isn't moved."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def drop(*tables: DataFrame | str) -> None:
    """Remove stored tables that nothing reads any more, through the file system they are in."""
    for t in tables:
        path = t if isinstance(t, str) else getattr(t, "stored_at", None)
        for entry in [e for e in _MADE if e[1] == path]:
            _MADE.remove(entry)
            _remove(*entry)


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    for spark, path in _MADE:
        try:
            _remove(spark, path)
        except Exception:  # the session has ended before; a local folder can still be removed
            shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
