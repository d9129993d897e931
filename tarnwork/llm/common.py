"""What the corpus operators share: tables, columns by exact name, written stages."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ..written import delete, new_path

#: Rows of texts that Spark hands to Python at once; its own default would let a task hold thousands of long texts twice.
BATCH_ROWS = "1000"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """Ships the package."""
    ship(spark)


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """While a stage is written, Arrow batches are small enough for long texts, unless the session chose a size itself."""
    before = spark.conf.get(_BATCH)
    if before == "10000":
        spark.conf.set(_BATCH, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def tidy() -> None:
    """Gives freed memory back to the system: a Python worker outlives its task, and the next stage needs the room."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(df: DataFrame, name: str) -> int:
    """Position of a column: an exact match wins over one that differs in case only."""
    if name in df.columns:
        return df.columns.index(name)
    found = [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if not found:
        raise ValueError(f"no column {name} in {df.columns}")
    return found[0]


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the wanted columns, renamed: pick(docs, id="doc_id"). Other columns may clash freely."""
    at = {new: column(df, old) for new, old in wanted.items()}
    plain = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"_{i}").alias(new) for new, i in at.items()])


def replace_columns(df: DataFrame, *names: str) -> DataFrame:
    """Without the columns that an operator is about to add (its own win over the input's)."""
    lower = {n.lower() for n in names}
    keep = [(i, c) for i, c in enumerate(df.columns) if c.lower() not in lower]
    plain = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"_{i}").alias(c) for i, c in keep])


def stash(df: DataFrame, what: str, *parts: str, path: str | None = None) -> DataFrame:
    """Writes a stage to the shared folder and reads it again: lineage ends here, so a lost executor repeats no more than this stage.

    parts: columns by whose values the files are kept apart, so that some can be deleted earlier.
    """
    spark = df.sparkSession
    prepare(spark)
    path = path or new_path(spark, what)
    with small_batches(spark):
        df.write.partitionBy(*parts).parquet(path)
    release(spark)
    again = spark.read.schema(df.schema).parquet(path)
    again._stash_path = path
    return again


def unstash(*frames: DataFrame, part: str = "") -> None:
    """Deletes stages, or one part of each (such as "kind=1"), that nothing reads any more."""
    for df in frames:
        delete(df.sparkSession, f"{df._stash_path}/{part}" if part else df._stash_path)


#: Seconds that pass between two requests to collect garbage, at least: short stages leave little behind.
RELEASE_EVERY = 3.0
_released = 0.0


def release(spark: SparkSession) -> None:
    """Shuffle files go when the driver's JVM collects the plans that own them; written stages ask for it now and then."""
    import gc
    import time

    global _released
    if time.monotonic() - _released < RELEASE_EVERY:
        return
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    _released = time.monotonic()
