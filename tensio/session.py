"""Session helpers: a local session for tests/bench and checkpoint-dir handling."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

_shipped: set[str] = set()
_scope: ContextVar[str | None] = ContextVar("tensio_stage_scope", default=None)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers (once per application).

    Python functions that run on executors refer to the package by name.  It is sent along
    as a zip, the way ``--py-files`` does it, so executors need no installation.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the package must be installed or added as an artifact
        return
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = os.path.join(tempfile.mkdtemp(prefix="tensio-package-"), "tensio_package")
    sc.addPyFile(shutil.make_archive(copy, "zip", root, "tensio"))
    _shipped.add(sc.applicationId)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tensio") -> SparkSession:
    """A local session configured the way the tests and ``bench.py`` expect."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("TENSIO_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the folder for stage tables: the reliable checkpoint directory, or the folder of the
    ``stage_scope`` around the call.  A directory is set only when the cluster names none.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is used as is; it is an
    error if it is unset there.  Only a local master takes a fresh temporary directory.
    """
    if _scope.get():
        return _scope.get()
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server's spark.checkpoint.dir applies
        return spark.conf.get("spark.checkpoint.dir", "")
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="tensio-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


@contextmanager
def stage_scope(spark: SparkSession) -> Iterator[str]:
    """Stage tables written inside the ``with`` block go to a folder that is deleted at its end.

    Operators write tables that several later steps read, and return frames that read them, so
    results must be collected or written to their own place inside the block.
    """
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/scope-{uuid.uuid4().hex}"
    token = _scope.set(folder)
    try:
        yield folder
    finally:
        _scope.reset(token)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
