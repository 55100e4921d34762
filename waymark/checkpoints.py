"""Reliable checkpoints in the folder that the session names.

The folder is ``spark.checkpoint.dir``, which all executors share.  Only a local master may
do without it (tests, a laptop): there a temporary folder is made; elsewhere its lack raises.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_open: list[list[str]] = []


def folder(spark: SparkSession) -> str:
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="waymark-"))
    return context.getCheckpointDir().get()


def reliable(df: DataFrame) -> DataFrame:
    """df read back from a checkpoint.  Its partitions keep their rows, order and number,
    so this also fixes a range partitioning."""
    folder(df.sparkSession)
    done = df.checkpoint(eager=True)
    if _open:
        file = done._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            _open[-1].append(file.get())
    return done


def write_out(df: DataFrame) -> DataFrame:
    """Write a large result to the shared folder as Parquet and read it again."""
    path = f"{folder(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder of whatever file system holds it."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the checkpoints made inside when it ends well; what is to stay must be written
    inside.  For one thread at a time."""
    _open.append([])
    try:
        yield
    finally:
        made = _open.pop()
    for path in made:
        remove(spark, path)
