"""Intermediate tables in a folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Where that is unset a temporary one is made, which goes when Python ends; but only where driver and
    executors are one machine: a cluster's executors would write to disks of their own, so there it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_riskloom_dir", None)
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that driver and executors share (master: {master})")
        folder = tempfile.mkdtemp(prefix="riskloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = spark._riskloom_dir = "file://" + folder
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, remembered for `clear`."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not hasattr(spark, "_riskloom_paths"):
        spark._riskloom_paths = []
    spark._riskloom_paths.append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    It is computed once and cuts the lineage: later jobs survive the loss of any executor without
    running what came before again.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._riskloom_path = path
    return out


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint that keeps the partitioning: what groups by the same key needs no shuffle.

    Under adaptive execution a plan's partitioning is not known, so the checkpoint is made without it.
    """
    spark, key = df.sparkSession, "spark.sql.adaptive.enabled"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    before = spark.conf.get(key, "true")
    spark.conf.set(key, "false")
    try:
        return df.select("*").checkpoint()  # a new plan, made under this setting
    finally:
        spark.conf.set(key, before)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if path in getattr(spark, "_riskloom_paths", []):
        spark._riskloom_paths.remove(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of `materialise` that nothing reads any more: what was made of them has been written."""
    for df in tables:
        _delete(df.sparkSession, df._riskloom_path)


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this session; results that aren't written yet can't be computed after that."""
    for path in list(getattr(spark, "_riskloom_paths", [])):
        _delete(spark, path)
