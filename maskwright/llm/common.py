"""Helpers shared by the training-data operators: shared scratch tables, clash-free columns, cells."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where none is set, one of our own in local mode (tests), and an error on a
    cluster, whose machines don't see each other's folders."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        path = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="maskwright-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{path}")
        path = f"file://{path}"
    elif not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder, for small tables inside loops; freed when no longer used."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def take(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under our names, so that no other column of the caller can clash."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def crc_mod(column: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the fold rule of labelled rows."""
    return F.crc32(column.cast("string").cast("binary")) % n


def labelled_ids(labels: DataFrame, label_col: str, train: Column, limit: int) -> DataFrame:
    """(id, label): at most ``limit`` labelled rows of the training folds, the first in hash order of the id."""
    rows = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & train).select(F.col("doc_id").alias("id"), F.col(label_col).cast("int").alias("label"))
    return rows.orderBy(F.xxhash64("id"), "id", "label").limit(limit)
