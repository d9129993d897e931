"""Written intermediate results: the folder that all executors share, and tables in it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from .session import ship


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in spark.checkpoint.dir.

    Only a local master, whose executors are threads of the driver, may go without: it gets a temporary folder.
    """
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_shared_dir", None)
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = sc._shared_dir = "file://" + tempfile.mkdtemp(prefix="shared-")
    return where.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def in_blocks(spark: SparkSession, blocks: Iterator, run: Callable[[object], DataFrame], schema: str) -> DataFrame:
    """The rows of ``run(sent)`` for each block of a stated query set, sent as a broadcast.

    One block stays a lazy plan. Of several each is run and written before the next one is sent, and its broadcast is given up, so that
    neither the plan nor what the driver and the executors hold grows with their number.
    """
    ship(spark)
    first = next(blocks, None)
    if first is None:
        return spark.createDataFrame([], schema)
    second = next(blocks, None)
    if second is None:
        return run(spark.sparkContext.broadcast(first))
    path = new_path(spark, "blocks")
    waiting = [first, second]
    while waiting:
        sent = spark.sparkContext.broadcast(waiting.pop(0))
        found = run(sent)
        found.write.mode("append").parquet(path)
        sent.destroy()
        if not waiting and (more := next(blocks, None)) is not None:
            waiting.append(more)
    return spark.read.schema(found.schema).parquet(path)
