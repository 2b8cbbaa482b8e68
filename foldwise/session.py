"""Session helpers: sane defaults for tests and benches, and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: Removes a query's shuffle files at its end.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_written: dict[str, list[str]] = {}  # application id -> scratch tables
_scopes = threading.local()  # scratch tables of this thread's open scopes


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "foldwise", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the deployment and is read, never replaced; without it there
    is no folder that all executors see, which is an error. Only a session whose executors
    are threads of this process (master ``local``) gets a private folder instead, removed at
    the end.
    """
    sc = spark.sparkContext
    path = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="foldwise-ckpt-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A unique sub-path of the shared checkpoint folder for written intermediate tables."""
    path = os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    for scope in getattr(_scopes, "open", []):
        scope.append(path)
    return path


@contextmanager
def tidy_shuffles(spark: SparkSession):
    """Within it, the shuffle files of a write go when the write has ended. Else they stay until the driver's JVM
    happens to collect the plan, so a chain of written tables keeps the shuffles of all of them on disk."""
    before = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        spark.conf.unset(TIDY) if before is None else spark.conf.set(TIDY, before)


@contextmanager
def scratch_scope(spark: SparkSession):
    """Scratch tables that this thread writes within it go at its end, with their shuffle files, all but those
    that the yielded list names (tables). Not for threads that run beside others: the shuffle setting is the session's."""
    paths: list[str] = []
    keep: list[DataFrame] = []
    _scopes.open = [*getattr(_scopes, "open", []), paths]
    try:
        with tidy_shuffles(spark):
            yield keep
    finally:
        _scopes.open = _scopes.open[:-1]
        kept = {os.path.basename(os.path.dirname(f)) for df in keep for f in df.inputFiles()}
        held = _written.get(spark.sparkContext.applicationId, [])
        for p in paths:
            if os.path.basename(p) not in kept and p in held:
                _delete(spark, p)
                held.remove(p)


def release_tables(*tables: DataFrame) -> None:
    """Delete the scratch tables behind ``tables``, which nothing reads again."""
    for df in tables:
        spark = df.sparkSession
        names = {os.path.basename(os.path.dirname(f)) for f in df.inputFiles()}
        paths = _written.get(spark.sparkContext.applicationId, [])
        for p in [p for p in paths if os.path.basename(p) in names]:
            _delete(spark, p)
            paths.remove(p)


def _delete(spark: SparkSession, p: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(p)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release_scratch(spark: SparkSession) -> int:
    """Delete the scratch tables of this application; returns how many. For callers that are
    done with all results so far (results are lazy and may still read them)."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        _delete(spark, p)
    return len(paths)
