"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Take spark.checkpoint.dir from the session; only where it is unset (tests) make a temporary folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="checkpoints-"))


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and return a frame that reads it from there."""
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class _Here(threading.local):
    def __init__(self) -> None:
        self.cleaning, self.held = 0, []


_here = _Here()


@contextmanager
def cleaning() -> Iterator[None]:
    """What `kept` and `Rounds` write inside leaves no shuffle files; else they stay until the driver happens to collect its
    garbage."""
    _here.cleaning += 1
    try:
        yield
    finally:
        _here.cleaning -= 1


def _written(df: DataFrame, path: str, mode: str) -> DataFrame:
    conf = df.sparkSession.conf
    before = conf.get(CLEANED, "false")
    if _here.cleaning:
        conf.set(CLEANED, "true")
    try:
        df.write.mode(mode).parquet(path)
    finally:
        if _here.cleaning:
            conf.set(CLEANED, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared checkpoint folder and read it back: lineage is cut as by
    `cut`, in compressed columns. For what is large or read in part. The table stays until the folder is cleared, or
    `passing` drops it."""
    use_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    for held in _here.held[-1:]:
        held.append(path)
    return _written(df, path, "errorifexists")


def passing(spark: SparkSession, make: Callable[[], DataFrame], write: Callable[[DataFrame], DataFrame] = kept) -> DataFrame:
    """write(make()); the tables that `kept` makes on the way to make's frame are dropped then, and shuffles as by `cleaning`."""
    with cleaning():
        _here.held.append([])
        try:
            df = make()
        finally:
            held = _here.held.pop()
        out = write(df)
    for path in held:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Rounds:
    """A cut for loops whose state is joined with sums over itself.

    A checkpoint carries its plan's estimated size, which squares with such a join: after some twenty rounds the number alone
    has millions of digits. Here a round is a Parquet table in the shared folder, so its size is that of its files. Rounds
    take turns on `keep` tables; a frame must not be read after `keep` more rounds.
    """

    def __init__(self, spark: SparkSession, keep: int = 2):
        use_checkpoint_dir(spark)
        self.spark, self.keep, self.n = spark, keep, 0
        self.folder = f"{spark.sparkContext.getCheckpointDir()}/rounds-{uuid.uuid4().hex}"

    def __call__(self, df: DataFrame) -> DataFrame:
        path, self.n = f"{self.folder}/{self.n % self.keep}", self.n + 1
        return _written(df, path, "overwrite")
