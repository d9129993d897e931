"""Reachability over dependencies: which nodes lead to which, and over how many links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..written import delete, new_path


def closure(edges: DataFrame, starts: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(start, node, hops): every node that can be reached from each start, with the least number of links; the start itself at 0.

    edges: (a, b); starts: (start). Semi-naive: a round follows only the links of nodes found in the round before, and keeps what wasn't
    known for that start. Each round is written, so that the plan doesn't grow with the rounds and a lost executor repeats one of them. Links
    and rounds meet in plain joins, so a node with very many links is split by Spark like any hot key; a node is passed on once for each start
    however many ways lead to it. Cycles end, as nothing is found twice. Defined cases: rows without an end are no links, repeated ones
    count once; a null start is none; a start without links reaches itself only; max_hops: no longer ways.
    """
    spark = edges.sparkSession
    base = new_path(spark, "closure")
    links = edges.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()
    links.write.parquet(f"{base}/links")
    links = spark.read.schema(links.schema).parquet(f"{base}/links")
    found = starts.select("start").filter("start IS NOT NULL").distinct().select("start", F.col("start").alias("node"), F.lit(0).alias("hops"))
    found.write.parquet(f"{base}/round=0")
    written, hops = [f"{base}/round=0"], 0
    schema = found.schema
    while max_hops is None or hops < max_hops:
        hops += 1
        known = spark.read.schema(schema).parquet(*written)
        last = spark.read.schema(schema).parquet(written[-1])
        step = last.join(links, last["node"] == links["a"]).select("start", F.col("b").alias("node")).distinct()
        new = step.join(known.select("start", "node"), ["start", "node"], "left_anti").select("start", "node", F.lit(hops).alias("hops"))
        path = f"{base}/round={hops}"
        new.write.parquet(path)
        if spark.read.schema(schema).parquet(path).isEmpty():
            break
        written.append(path)
    delete(spark, f"{base}/links")
    return spark.read.schema(schema).parquet(*written)
