"""Readers of the driver's tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table by name; Spark prunes its columns and pushes filters into it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; unset, one of this machine in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _own.setdefault(spark.sparkContext.applicationId, "") or _fresh(spark)


def _fresh(spark: SparkSession) -> str:
    path = _own[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="textquarry-")
    return path


_stored: dict[str, list[str]] = {}


#: For rows of megabytes: a row group, which a task writes and reads at once, ends at 8 MB, looked at after every row rather than after a hundred.
WIDE = {"compression": "zstd", "parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}


def stored(df: DataFrame, tag: str, wide: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read back, which cuts lineage; it stays until ``clear``, since results are lazy.

    ``wide`` stands for rows of megabytes, of which a task then holds a few at a time (WIDE).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.options(**WIDE if wide else {}).parquet(path)
    _stored.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete all that this application has ``stored``; call it when results that read it are written."""
    for path in _stored.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)


def drop(df: DataFrame) -> None:
    """Delete the table that ``stored`` gave as ``df``, which no result reads."""
    spark = df.sparkSession
    held = _stored.get(spark.sparkContext.applicationId, [])
    names = {f.rsplit("/", 2)[-2] for f in df.inputFiles()}
    for path in [p for p in held if p.rsplit("/", 1)[-1] in names]:
        held.remove(path)
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
