"""Sharding by a Feistel permutation with cycle walking over global row numbers.

The shard and slot of a row follow from its global row number, the number of rows and the seed alone:
``place = permute(number)``, ``shard = place % shards``, ``slot = place // shards``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, pick, replace_columns, stash, table

SHARDS = 16
SEED = 20240607
ROUNDS = 6
ADDED = ("row_number", "shard", "slot")


def _keys(seed: int, rounds: int) -> list[int]:
    return [int.from_bytes(hashlib.sha256(f"{seed}/{i}".encode()).digest()[:8], "little") for i in range(rounds)]


def permute(numbers: np.ndarray, total: int, seed: int = SEED, rounds: int = ROUNDS) -> np.ndarray:
    """The Feistel permutation of 0..total-1: a value that lands outside walks on along its cycle until it lands inside."""
    half = max(1, (max(total - 1, 1).bit_length() + 1) // 2)
    mask, keys = np.uint64((1 << half) - 1), _keys(seed, rounds)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for key in keys:
            z = (right + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z ^= z >> np.uint64(31)
            left, right = right, left ^ (z & mask)
        return (left << np.uint64(half)) | right

    out = once(numbers.astype(np.uint64))
    outside = np.flatnonzero(out >= np.uint64(total))
    while len(outside):
        out[outside] = once(out[outside])
        outside = outside[out[outside] >= np.uint64(total)]
    return out.astype(np.int64)


def number_rows(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """Rows numbered from 0 without gaps in the given order, and how many there are.

    A range sort, a written stage (so that the numbers can't change when a task runs again), and one count
    for each partition: nothing that grows with the rows comes to the driver. Rows that tie in all of
    ``order`` are told apart by their place in the input only to spread them over partitions.
    """
    spread = df.withColumn("_tie", F.monotonically_increasing_id())
    by = [*order, "_tie"]
    ranged = spread.repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie")
    held = stash(ranged.withColumn("_place", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_place", 33)
    counts = sorted((r[0], r[1]) for r in held.groupBy(part.alias("p")).count().collect())
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    offsets = df.sparkSession.createDataFrame(starts or [(0, 0)], "_part long, _start long")
    numbered = held.withColumn("_part", part).join(F.broadcast(offsets), "_part", "left")
    within = F.col("_place").bitwiseAND((1 << 33) - 1)
    return numbered.withColumn("row_number", F.col("_start") + within).drop("_part", "_start", "_place"), total


def shard_rows(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` plus row_number, shard and slot; shard counts differ by one at most.

    Rows are numbered by id, then by the text's CRC-32 and length, so the same table gives the same shards in
    any partitioning. Defined cases: null ids come first; rows equal in id and text are interchangeable;
    an empty table gives an empty table; input columns named like the added ones are replaced.
    """
    rest = replace_columns(docs, *ADDED)
    names = rest.columns
    plain = rest.toDF(*[f"c{i}" for i in range(len(names))])
    text = F.coalesce(F.col(f"c{column(rest, text_col)}"), F.lit(""))
    plain = plain.withColumn("_crc", F.crc32(text.cast("binary"))).withColumn("_len", F.octet_length(text))
    numbered, total = number_rows(plain, [f"c{column(rest, id_col)}", "_crc", "_len"])

    @F.pandas_udf("long")
    def place(n: pd.Series) -> pd.Series:
        return pd.Series(permute(n.to_numpy(), total, seed))

    spot = numbered.drop("_crc", "_len").withColumn("_spot", place("row_number"))
    out = spot.withColumn("shard", (F.col("_spot") % shards).cast("int")).withColumn("slot", F.expr(f"_spot div {shards}")).drop("_spot")
    return out.toDF(*names, *ADDED)


def op10_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 by the law ``rows``: doc_id, size long, text_crc32 long, law string, shard int, slot long, grown_shard int (null).

    Defined cases: as for ``shard_rows``; a null text counts as empty.
    """
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    text = F.coalesce("text", F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    # The sizes and checksums stand in for the text, so that only they are sorted; they order rows as the texts would.
    keyed = sized.withColumn("text", F.concat_ws("/", "text_crc32", "size"))
    return shard_rows(keyed).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
