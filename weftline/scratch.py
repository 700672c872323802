"""Lineage cuts that survive the loss of executors: written tables in the shared checkpoint folder."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Only in local mode, where there are no other machines, may that setting
    be missing (tests): a temporary folder serves then."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return str(current.get())
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="weftline-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def materialise(df: DataFrame, name: str = "cut") -> DataFrame:
    """Writes df as Parquet under the shared folder and reads it back, so that later stages neither recompute it
    nor depend on one executor's disk. ``purge`` removes what this session has written."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/weftline-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, dict]:
    """``materialise``, and aggregates of df taken while it is written."""
    seen = Observation()
    written = materialise(df.observe(seen, *[c.alias(n) for n, c in measures.items()]), name)
    return written, seen.get


def purge(spark: SparkSession, since: int = 0, spare: int = 0) -> int:
    """Deletes the tables that ``materialise`` wrote; call it once no result that reads them is needed. since: how many of the
    first stay; spare: how many of the last."""
    gone = _written[since : len(_written) - spare]
    del _written[since : len(_written) - spare]
    jvm, n = spark.sparkContext._jvm, 0
    for name in gone:
        path = jvm.org.apache.hadoop.fs.Path(name)
        n += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return n


@contextlib.contextmanager
def leaving(last: int) -> Iterator[None]:
    """Of the tables that are written inside, only the last ones stay."""
    before = len(_written)
    yield
    spark = SparkSession.getActiveSession()
    if spark is not None:
        purge(spark, before, last)


@atexit.register
def _purge_all() -> None:
    """Whoever ends a session in good order leaves nothing behind."""
    with contextlib.suppress(Exception):  # the session may be gone
        spark = SparkSession.getActiveSession()
        if spark is not None and _written:
            purge(spark)
