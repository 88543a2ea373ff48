"""Tables in the shared folder: how every loop of this package cuts its lineage."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCAL: str | None = None
_WRITTEN: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset and all runs on this machine, one here."""
    global _LOCAL
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _LOCAL is None:
        _LOCAL = "file://" + tempfile.mkdtemp(prefix="seqtide-")
    return _LOCAL


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table that outlives lost executors; removed by forget() or when the application ends.

    The shuffles that made it go at once; without the setting they stay on the executors' disks
    until the driver happens to collect its garbage.
    """
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/seqtide-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    _note(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._seqtide_path = path
    return out


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its plan by a reliable checkpoint, which keeps the partitioning that written() loses.

    An adaptive plan does not tell its partitioning, so this one plan is a fixed one: give it
    only what is cached or read already, without a shuffle to adapt.
    """
    spark, adaptive = df.sparkSession, "spark.sql.adaptive.enabled"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    before = spark.conf.get(adaptive)
    spark.conf.set(adaptive, "false")
    try:
        out = df.checkpoint()
    finally:
        spark.conf.set(adaptive, before)
    file = out._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        out._seqtide_path = file.get()
        _note(spark, out._seqtide_path)
    return out


def forget(*tables: DataFrame | None) -> None:
    """Remove tables of written() or checkpointed() that nothing reads any more; others are passed over."""
    for df in tables:
        path = getattr(df, "_seqtide_path", None)
        if path in _WRITTEN:
            _remove(_WRITTEN.pop(path), path)


def _note(spark: SparkSession, path: str) -> None:
    if not _WRITTEN:
        atexit.register(_clean)  # before Spark's own, which stops the context
    _WRITTEN[path] = spark


def _remove(spark: SparkSession, path: str) -> None:
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    to.getFileSystem(spark._jsc.hadoopConfiguration()).delete(to, True)


def _clean() -> None:
    for path, spark in _WRITTEN.items():
        if spark.sparkContext._jsc is not None:
            _remove(spark, path)
    if _LOCAL:
        shutil.rmtree(_LOCAL.removeprefix("file://"), ignore_errors=True)
