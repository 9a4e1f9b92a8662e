"""Sessions with sound defaults, and this package on every executor."""

from __future__ import annotations

import os
import re
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"}


def session(name: str = "tracewright", **conf: str) -> SparkSession:
    return SparkSession.builder.appName(name).config(map=DEFAULTS | conf).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, once a context."""
    context = spark.sparkContext
    if getattr(context, "_sent_package", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    name = os.path.basename(root)
    packed = os.path.join(tempfile.mkdtemp(prefix="package-"), f"{name}.zip")
    with zipfile.ZipFile(packed, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith((".py", ".csv")):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join(name, os.path.relpath(full, root)))
    context.addPyFile(packed)
    context._sent_package = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own where the session names none and all runs on this machine, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="checkpoints-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at


def unused(df: DataFrame, name: str) -> str:
    """The name, with marks behind it until no column of df is called so (names don't tell cases apart)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


_scratch = threading.local()
#: What this process has stored, and for which application.
_every: list[tuple[str, str]] = []


def stored(spark: SparkSession, df: DataFrame, name: str, by: str | list[str] | None = None) -> DataFrame:
    """The rows of df, written to the shared folder and read back; cuts lineage and survives lost executors. by: columns of few values, each of which can then be read alone."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    for paths in getattr(_scratch, "open", []):
        paths.append(path)
    _every.append((spark.sparkContext.applicationId, path))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """What this thread stores within the block is deleted at its end, but for the paths that are taken off the list.

    Whatever is read after the block must stand in a table that was taken off, or have been written elsewhere.
    """
    paths: list[str] = []
    _scratch.open = [*getattr(_scratch, "open", []), paths]
    try:
        yield paths
    finally:
        _scratch.open = [x for x in _scratch.open if x is not paths]
        remove(spark, paths)


def remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def sweep(spark: SparkSession) -> int:
    """Deletes all that this session's application has stored in the shared folder, once its results are written elsewhere; how many tables."""
    own = [path for app, path in _every if app == spark.sparkContext.applicationId]
    remove(spark, own)
    _every[:] = [x for x in _every if x[1] not in set(own)]
    return len(own)
