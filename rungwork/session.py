"""Session helpers: lineage cuts in the shared folder and table loading."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_LOCAL_DIR: list[str] = []
_RUN_DIRS: set[str] = set()
_KEPT: dict[tuple[str, str, str], tuple[tuple, tuple[str, StructType]]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset and the master is local."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL_DIR:
        _LOCAL_DIR.append("file://" + tempfile.mkdtemp(prefix="rungwork-"))
        atexit.register(_remove, _LOCAL_DIR[0])
    return _LOCAL_DIR[0]


def _remove(url: str) -> None:
    shutil.rmtree("/" + url.removeprefix("file:").lstrip("/"), ignore_errors=True)


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and return a scan of it.

    The result has no lineage before the table, survives the loss of executors and keeps column pruning.
    """
    return _read(df.sparkSession, *_write(df, partition_by))


def _write(df: DataFrame, partition_by: tuple[str, ...]) -> tuple[str, StructType]:
    path = f"{run_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path, df.schema


def _read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def run_dir(spark: SparkSession) -> str:
    """This application's own folder within the shared one; it may go when the application has ended.

    A folder of the ``file`` scheme is removed at the end of the driver.
    """
    at = f"{shared_dir(spark)}/rungwork-{spark.sparkContext.applicationId}"
    if at.startswith("file:") and at not in _RUN_DIRS:
        _RUN_DIRS.add(at)
        atexit.register(_remove, at)
    return at


def kept(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame], *partition_by: str) -> DataFrame:
    """The table ``name`` derived from a data directory, built and written once in this application.

    It is built anew if the files of the directory have changed or the written table is gone. ``forget`` drops all.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    seen = _fingerprint(sf_dir)
    if key in _KEPT and _KEPT[key][0] == seen:
        try:
            return _read(spark, *_KEPT[key][1])
        except AnalysisException:  # removed meanwhile
            pass
    at = _write(build(), partition_by)
    _KEPT[key] = (seen, at)
    return _read(spark, *at)


def forget() -> None:
    """Derived tables are built anew from now on."""
    _KEPT.clear()


def _fingerprint(sf_dir: str) -> tuple:
    """Names, sizes and times of a directory's files where the driver can see them; else nothing."""
    root = sf_dir.removeprefix("file://")
    out = []
    for folder, _, names in os.walk(root):
        for n in sorted(names):
            st = os.stat(os.path.join(folder, n))
            out.append((folder, n, st.st_size, st.st_mtime_ns))
    return tuple(out)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores, for work that costs far more than a shuffle.

    ``df`` is a scan, filtered or projected. Only one that is left in fewer partitions is shuffled, so never a large one.
    """
    try:
        cores = df.sparkSession.sparkContext.defaultParallelism
        few = df.rdd.getNumPartitions() < cores
    except PySparkException:  # a remote session tells no number of partitions
        return df
    return df.repartition(cores) if few else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
