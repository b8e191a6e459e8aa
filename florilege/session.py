"""Sessions, table loading and staging in the cluster's shared folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN_FOLDERS: dict[str, str] = {}
#: Staged tables that are still there, by application.
_STAGED: dict[str, list[str]] = {}


def build_session(app: str = "florilege", master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("FLORILEGE_DRIVER_MEMORY", "8g"))
    )
    for name, value in conf.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for staged tables: spark.checkpoint.dir of the session.

    Only a session that runs on this machine alone may fall back to a temporary folder; on a
    cluster without spark.checkpoint.dir this raises, as a machine-local folder would lose rows.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named:
        return f"{named.rstrip('/')}/florilege-{context.applicationId}"
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    key = context.applicationId
    if key not in _OWN_FOLDERS:
        _OWN_FOLDERS[key] = tempfile.mkdtemp(prefix="florilege-")
        atexit.register(_remove, _OWN_FOLDERS[key])
    return f"file://{_OWN_FOLDERS[key]}"


def _remove(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def stage(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors.

    The table stays until ``unstage``, the end of a ``staging`` block or the end of the application.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    key = spark.sparkContext.applicationId
    if key not in _STAGED:
        _STAGED[key] = []
        atexit.register(_drop_all, spark)
    _STAGED[key].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._florilege_path = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more; other tables are left alone."""
    for df in tables:
        path = getattr(df, "_florilege_path", None)
        if path:
            _delete(df.sparkSession, path)


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """What is staged inside is deleted at the end: write or collect results inside, as they read staged tables lazily."""
    key = spark.sparkContext.applicationId
    before = set(_STAGED.get(key, ()))
    try:
        yield
    finally:
        for path in [p for p in _STAGED.get(key, ()) if p not in before]:
            _delete(spark, path)


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of a path, whatever its scheme."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _delete(spark: SparkSession, path: str) -> None:
    fs, target = hadoop_path(spark, path)
    fs.delete(target, True)
    paths = _STAGED.get(spark.sparkContext.applicationId, [])
    if path in paths:
        paths.remove(path)


def _drop_all(spark: SparkSession) -> None:
    try:
        for path in list(_STAGED.get(spark.sparkContext.applicationId, ())):
            _delete(spark, path)
    except Exception:  # noqa: BLE001 - the session may have ended before the interpreter
        pass
