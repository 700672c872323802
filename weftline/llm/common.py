"""What the training-data operators share: reading tables, words, clash-free column selection."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as every operator here counts them: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: ASCII white space as characters, for trim functions.
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only, whatever the locale."""
    return F.translate(c, UPPER, LOWER)


def narrow(docs: DataFrame, *wanted: str) -> DataFrame:
    """Only the wanted columns: extra columns can then not clash with those that an operator adds."""
    return docs.select(*[docs[c] for c in wanted])


#: Rows of an Arrow batch of texts. A batch is held several times over, in the JVM and in Python, and a text may be long.
TEXTS_PER_BATCH = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """df, after lowering the session's Arrow batch size to TEXTS_PER_BATCH if it is higher (by default it is ten times that)."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= TEXTS_PER_BATCH:
        conf.set(name, str(TEXTS_PER_BATCH))
    return df


def give_back() -> None:
    """Returns freed memory to the system at the end of a task: Python workers outlive it, and another stage's worker may need
    the room."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim is not None:
        trim(0)
