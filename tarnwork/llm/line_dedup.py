"""Line dedup: normalised lines are exploded and hashed, documents counted for each hash, common lines dropped, and texts reassembled by position.

A line's hash goes out once for each document that has it, and Spark adds the counts up before and after the shuffle, so a line that is
in a third of all documents is one row for each task. Which hashes are common then has to reach the texts. The commonest ``SENT_KEYS`` are
sent to the executors, and a text whose lines are all settled by them is reassembled where it lies, without a shuffle. Any others stay a
table: lines that a bitmap of them lets through are exploded with their positions, joined and brought back to their texts. None of those
can be hot, as every one of ``SENT_KEYS`` others is at least as common.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, pick, replace_columns, stash, table, unstash

MIN_DOCS, MIN_CHARS = 10, 1
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hashes of 16 bytes that are sent, at most, and bits of the bitmap of all others, at most: 16 MB together.
SENT_KEYS, FILTER_BITS = 500_000, 1 << 26
ADDED = ("n_lines", "n_dropped", "kept_text")


def line_keys(lines: Column) -> Column:
    """Each line without blanks at its ends, A-Z in lower case."""
    return F.transform(lines, lambda x: F.translate(F.btrim(x, F.lit(BLANKS)), UPPER, LOWER))


def line_hashes(lines: Column, min_chars: int = MIN_CHARS) -> Column:
    """128 bits in hex for each line; empty for one that is too short to be dropped."""
    return F.transform(line_keys(lines), lambda k: F.when(F.char_length(k) >= min_chars, F.md5(k.cast("binary"))).otherwise(F.lit("")))


def common_lines(docs: DataFrame, text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Hashes of lines that at least ``min_docs`` rows have, with the number of these rows: key, n."""
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    once = docs.select(F.explode(F.array_distinct(line_hashes(lines, min_chars))).alias("key")).filter("key <> ''")
    return once.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs)


def numbers(hex_keys: pa.Array) -> np.ndarray:
    """Rows of two 64-bit numbers for strings of 32 hex digits."""
    raw = b"".join(x.encode() for x in hex_keys.to_pylist())
    return np.frombuffer(bytes.fromhex(raw.decode()), ">u8").reshape(-1, 2).astype(np.uint64)


class Known:
    """What the executors get: the commonest hashes, and a bitmap of the others (``bits`` 0: there are none)."""

    def __init__(self, sent: np.ndarray, bits: int, bitmap: np.ndarray) -> None:
        order = np.lexsort((sent[:, 1], sent[:, 0]))
        self.high, self.low = sent[order, 0].copy(), sent[order, 1].copy()
        self.bits, self.bitmap = bits, bitmap

    def settle(self, keys: np.ndarray) -> np.ndarray:
        """1 for a hash that is among those sent, 2 for one that may be among the others, else 0."""
        out = np.zeros(len(keys), np.int8)
        if len(self.high):
            at = np.searchsorted(self.high, keys[:, 0])
            todo = np.arange(len(keys))
            while len(todo):  # hashes that agree in their first half lie side by side
                todo = todo[at[todo] < len(self.high)]
                todo = todo[self.high[at[todo]] == keys[todo, 0]]
                found = self.low[at[todo]] == keys[todo, 1]
                out[todo[found]] = 1
                todo = todo[~found]
                at[todo] += 1
        if self.bits:
            spot = (keys[:, 0] >> np.uint64(4)) & np.uint64(self.bits - 1)
            perhaps = (self.bitmap[(spot >> np.uint64(3)).astype(np.int64)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1
            out[(out == 0) & (perhaps == 1)] = 2
        return out


def _spot(bits: int) -> Column:
    """The bitmap's bit for a hash: the first 15 hex digits, modulo the number of bits."""
    return F.conv(F.substring("key", 1, 15), 16, 10).cast("long").bitwiseAND(bits - 1)


def known_of(common: DataFrame, others: DataFrame | None, n_others: int) -> Known:
    """The hashes of ``common`` themselves, of ``others`` (written, or None) a bitmap, made by Spark in parts of 4 KB."""
    bits, bitmap = 0, np.zeros(0, np.uint8)
    if n_others:
        bits = min(FILTER_BITS, 1 << max(15, (16 * n_others - 1).bit_length()))
        bitmap = np.zeros(bits // 8, np.uint8)
        spots = others.select(_spot(bits).alias("spot"))
        parts = spots.groupBy(F.shiftright("spot", 15).alias("part")).agg(F.expr("bitmap_construct_agg(spot & 32767)").alias("bits"))
        for r in parts.collect():
            part = np.frombuffer(bytes(r["bits"]), np.uint8)
            bitmap[r["part"] * 4096 : r["part"] * 4096 + len(part)] = part
    return Known(numbers(common.select("key").toArrow()["key"].combine_chunks()), bits, bitmap)


def drop_common_lines(docs: DataFrame, text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """All rows and columns of ``docs`` plus n_lines (before dropping), n_dropped and kept_text.

    A line's key is the line without blanks (space, tab to carriage return) at its ends, A-Z lower-cased. Lines whose key has at least
    ``min_chars`` characters and is found in at least ``min_docs`` rows go from every row; the others stay, as they were, joined by a
    line feed. Defined cases: every row is a document of its own, whatever its id; a null or empty text is one empty line; a line counts
    once for a document however often it is there; a text that loses all lines is empty; an empty table gives an empty table; input
    columns named like the added ones are replaced by them.
    """
    spark = docs.sparkSession
    rest = replace_columns(docs, *ADDED)
    names = rest.columns
    plain = rest.toDF(*[f"c{i}" for i in range(len(names))])
    text = F.coalesce(F.col(f"c{column(rest, text_col)}"), F.lit(""))
    common = stash(common_lines(plain.select(text.alias("text")), "text", min_docs, min_chars), "common-lines")
    n = common.count()
    sent, others = common, None
    if n > SENT_KEYS:
        sent = stash(common.orderBy(F.desc("n"), "key").limit(SENT_KEYS), "sent-lines")
        others = stash(common.join(sent.select("key"), "key", "left_anti").select("key"), "other-lines")
    known = spark.sparkContext.broadcast(known_of(sent, others, max(0, n - SENT_KEYS)))

    @F.arrow_udf("array<tinyint>")
    def settle(hashes: pa.Array) -> pa.Array:
        flat = hashes.flatten()
        full = np.flatnonzero(pa.compute.binary_length(flat).to_numpy(zero_copy_only=False))
        out = np.zeros(len(flat), np.int8)
        out[full] = known.value.settle(numbers(flat.take(pa.array(full))))
        sizes = pa.compute.list_value_length(hashes).to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(out))

    lines = F.split(text, "\n")
    seen = plain.withColumn("_marks", settle(line_hashes(lines, min_chars)))

    def assembled(df: DataFrame, goes) -> DataFrame:
        """goes: whether the line at a position is dropped."""
        kept = F.filter(F.col("_lines"), lambda x, i: ~goes(i))
        out = df.withColumn("_lines", lines).withColumn("_kept", kept)
        n_lines, n_kept = F.size("_lines").cast("long"), F.size("_kept").cast("long")
        return out.select(*plain.columns, n_lines, n_lines - n_kept, F.array_join("_kept", "\n")).toDF(*names, *ADDED)

    marked = lambda i: F.get("_marks", i) == 1
    if others is None:
        return assembled(seen, marked)
    open_ = F.exists("_marks", lambda m: m == 2)
    of_text = F.sha2(text.cast("binary"), 256)
    # What goes follows from the text alone, so equal texts are settled once.
    narrow = seen.filter(open_).select(of_text.alias("_sha"), line_hashes(lines, min_chars).alias("hashes"), "_marks").dropDuplicates(["_sha"])
    asked = narrow.select("_sha", F.posexplode(F.arrays_zip("hashes", "_marks")).alias("pos", "x")).filter("x._marks = 2").select("_sha", "pos", F.col("x.hashes").alias("key"))
    late = stash(asked.join(others, "key", "left_semi").groupBy("_sha").agg(F.sort_array(F.collect_list("pos")).alias("_late")), "late-lines")
    unstash(others, sent)
    back = seen.filter(open_).withColumn("_sha", of_text).join(late, "_sha", "left")
    # By position, so that a text of many lines needn't look for each of them in a list.
    flags = F.when(F.col("_late").isNull(), F.array()).otherwise(F.col("_late"))
    spread = F.map_from_arrays(flags, flags)
    later = back.withColumn("_late", spread)
    return assembled(seen.filter(~open_), marked).unionByName(assembled(later, lambda i: marked(i) | F.map_contains_key("_late", i)))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without lines that ten documents have: doc_id, n_lines long, n_dropped long, kept_sha256 string. Defined cases: as for ``drop_common_lines``."""
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    return drop_common_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP12_SQL = f"""
WITH lines AS (
  SELECT doc_id, i, x[i] AS line, translate(trim(x[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key
  FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents) s) p),
common AS (SELECT key FROM lines WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS})
SELECT doc_id, count(*) AS n_lines, count(common.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE common.key IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN common ON lines.key = common.key GROUP BY doc_id
"""
