"""Shared storage: where jobs cut lineage so that they survive the loss of executors."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or on a local master, where it may be unset, a new one.

    A cluster without it is refused: a folder of the driver's machine would lose what executors write.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        refuse_cluster(spark.sparkContext.master)
        if not _own_folder:
            _own_folder.append("file://" + tempfile.mkdtemp(prefix="polymera-"))
            atexit.register(_forget, spark, _own_folder[0])
        found = _own_folder[0]
    return found.rstrip("/")


def refuse_cluster(master: str) -> None:
    """Raise unless executors share the driver's machine."""
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")


def _forget(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, if the session still lives."""
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session is already gone at exit; the folder is then left to its owner
        pass


def new_folder(spark: SparkSession, what: str) -> str:
    """A fresh folder in the shared one, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/polymera-{what}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def forget(df: DataFrame) -> None:
    """Delete the files of a written() table that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/polymera-" in path:
            _forget(spark, path)


def clean(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that are no longer referred to, which it does when the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


def written(df: DataFrame, what: str, compression: str | None = None) -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder and read it again."""
    spark = df.sparkSession
    path = new_folder(spark, what)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)
