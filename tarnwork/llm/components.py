"""Connected components of links between long ids, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, unstash

#: Links that a task contracts at once.
CHUNK = 1_000_000


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the nodes that aren't the smallest themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while (label[label] != label).any():
            label = label[label]
        open_links = label[x] != label[y]
        x, y = x[open_links], y[open_links]
    below = label != np.arange(len(nodes))
    return nodes[below], nodes[label[below]]


def contract(links: DataFrame) -> DataFrame:
    """The same components from fewer links: each task replaces a chunk of links by a star for each component in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= CHUNK:
                yield star(held)
                held, n = [], 0
        if held:
            yield star(held)

    def star(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = (np.concatenate([h.column(i).to_numpy(zero_copy_only=False) for h in held]) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in local_roots(a, b)], names=["a", "b"])

    return links.select("a", "b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, label) for each node of the links (a, b): label is the component's smallest node.

    Every round writes its links and starts from the written ones. A hub's links meet its one smallest neighbour in a
    join whose sides are both plain exchanges, so that Spark can split the hub's partition.
    """
    links = stash(contract(links.filter("a <> b")), "links")
    state = None
    while True:
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stash(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = stash(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(), "large")
        least2 = stash(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        joined = large.join(least2, "a")
        small = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least2.select("a", F.col("m").alias("b")))
        new = stash(small.distinct(), "links")
        now = tuple(new.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())
        unstash(links, least, large, least2)
        links = new
        if now == state:
            break
        state = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("label"))
