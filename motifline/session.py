"""Session helpers: shared checkpoint folder, written intermediate tables, package shipping."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}
_SCRATCH: list[list[DataFrame]] = []
#: No marker files and, in folders of the local file system (others ignore the setting), no checksum files. Without its native
#: library Hadoop starts a process for each local file, to set permissions; until its exec it shares the memory of its executor.
_PLAIN_FILES = {
    "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem",
    "fs.file.impl.disable.cache": "true",
    "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false",
}
#: Tables of known length are written by one task for so many rows, but for so many tasks at least.
TASK_ROWS, LEAST_TASKS = 50_000, 12


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a private one only where that is unset and all runs on one machine."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[sc.applicationId] = tempfile.mkdtemp(prefix="motifline-")
        sc.setCheckpointDir(_LOCAL_DIRS[sc.applicationId])
    return _LOCAL_DIRS[sc.applicationId]


def few_tasks(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of about so many rows, in no more partitions than they need."""
    return df.coalesce(max(LEAST_TASKS, -(-rows // TASK_ROWS)))


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder as Parquet and read it back.

    Cuts the lineage like ``checkpoint()``, but the copy is columnar, compressed and prunable, and it
    survives the loss of any executor. ``rows``: about how many there are, if known, so that few go to few files.
    """
    spark = df.sparkSession
    df = df if rows is None else few_tasks(df, rows)
    path = f"{checkpoint_dir(spark)}/motifline-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.options(**_PLAIN_FILES).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._motifline_path = path
    for made in _SCRATCH:
        made.append(out)
    return out


@contextmanager
def scratch() -> Iterator[set[DataFrame]]:
    """Deletes at its end every table that was written inside, but those that were added to its set."""
    made: list[DataFrame] = []
    kept: set[DataFrame] = set()
    _SCRATCH.append(made)
    try:
        yield kept
    finally:
        _SCRATCH.remove(made)
        for df in made:
            if df not in kept:
                discard(df)


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Tables written inside leave no shuffle files behind, which else stay until the driver collects their plans."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def discard(df: DataFrame) -> None:
    """Delete a table written by :func:`materialize` that nothing reads any more."""
    path = getattr(df, "_motifline_path", None)
    if path:
        spark = df.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def discard_all(spark: SparkSession) -> None:
    """Delete every table that this session has written with :func:`materialize`; what still reads one fails."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark)}/motifline-{spark.sparkContext.applicationId}")
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver found it (local and test clusters).

    On a real cluster the package is installed on the executors or passed with ``--py-files``.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
