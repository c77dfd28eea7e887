"""Readers of the Parquet tables and small helpers on sessions.

A table that is absent under the folder raises Spark's own path error; an
empty table yields an empty frame with the file's schema.
"""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Scan one table; only the named columns reach the Parquet reader."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _files(spark, path)
    return bool(system.exists(where))


def fingerprint(spark: SparkSession, path: str) -> str:
    """Hash of the names, sizes and times of a table's files: a name for what is derived from their present state."""
    system, where = _files(spark, path)
    found = sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in system.listStatus(where))
    return hashlib.sha256(repr(found).encode()).hexdigest()[:16]


def one_per_key(df: DataFrame, *keys: str) -> DataFrame:
    """Drop exact copies of rows (same key, same content).

    ``distinct`` hashes whole rows, so partial aggregation removes copies
    before the shuffle and no sort is needed. Frames with map or variant
    columns, which cannot be grouped, fall back to ``dropDuplicates`` on keys.
    """
    kinds = {kind for _, kind in df.dtypes}
    if any("map<" in k or "variant" in k for k in kinds):
        return df.dropDuplicates(list(keys))
    return df.distinct()


#: Removes the shuffle files of an execution when it ends; what follows reads the checkpoint instead.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session without one gets its own, a cluster without one is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named or (named := spark.sparkContext.getCheckpointDir()):
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if spark.sparkContext.applicationId not in _LOCAL:
        path = tempfile.mkdtemp(prefix="paperloom-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _LOCAL[spark.sparkContext.applicationId] = path
    return _LOCAL[spark.sparkContext.applicationId]


#: Temporary folders of local sessions (one process, one disk), removed when it ends.
_LOCAL: dict[str, str] = {}


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the cluster's shared folder (``spark.checkpoint.dir``).

    The shuffle files behind the checkpoint are no longer needed and are removed; the
    checkpoint itself goes when its frame is no longer referenced.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    # Read by Spark's cleaner each time; it removes checkpoints of frames that are gone.
    context._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        # The setting is read when a frame is made, hence the new one.
        return df.select("*").checkpoint(eager=True)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def has_rows(df: DataFrame) -> bool:
    return bool(df.select(F.lit(1)).head(1))
