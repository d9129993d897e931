"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Each level only looks at rows whose group at the level before has more than one row. Which groups these are travels to the scan as a
bitmap whose size follows their number, up to ``FILTER_BITS`` bits; with more groups than such a bitmap tells apart, they
are joined. A row that a bitmap lets through by chance is merely hashed in full, and the full hash alone decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, pick, replace_columns, stash, table, unstash

#: 2**26 bits: 2,048 rows of 4 KB, so 8 MB is the most that is ever broadcast here. A bitmap has ``BITS_EACH`` bits for each group.
FILTER_BITS, BITS_EACH = 1 << 26, 16
PREFIX_BYTES = 64
ADDED = ("keep_id", "group_size", "kept", "text_sha256")


def flagged(df: DataFrame, keys: DataFrame, key: Column, flag: str, most_bits: int | None = None) -> DataFrame:
    """df with a boolean column that is true wherever ``key`` is among ``keys`` (a written table of distinct longs, key), and rarely elsewhere."""
    n = keys.count()
    bits = 1 << max(15, (BITS_EACH * n - 1).bit_length())
    if bits > (most_bits or FILTER_BITS):
        named = df.withColumn("_key", key)
        return named.join(keys.select(F.col("key").alias("_key"), F.lit(True).alias(flag)), "_key", "left").withColumn(flag, F.coalesce(flag, F.lit(False))).drop("_key")
    spot = F.pmod(F.col("key"), F.lit(bits))
    bitmap = keys.groupBy(F.shiftright(spot, 15).alias("_part")).agg(F.expr(f"bitmap_construct_agg(pmod(key, {bits}L) & 32767)").alias("_bits"))
    own = F.pmod(key, F.lit(bits))
    here = df.withColumn("_part", F.shiftright(own, 15)).withColumn("_at", own.bitwiseAND(32767).cast("int"))
    out = here.join(F.broadcast(bitmap), "_part", "left")
    byte = F.conv(F.hex(F.expr("substring(_bits, _at div 8 + 1, 1)")), 16, 10).cast("int")
    bit = F.shiftright(byte, 0).bitwiseAND(F.expr("shiftleft(1, _at % 8)")) != 0
    return out.withColumn(flag, F.coalesce(bit, F.lit(False))).drop("_part", "_at", "_bits")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_bytes: int = PREFIX_BYTES, digests: bool = False) -> DataFrame:
    """All rows and columns of ``docs`` plus keep_id, group_size, kept and text_sha256.

    Of rows with equal text the one with the largest id is kept. text_sha256 is null where an earlier level
    already told the row apart (its text was never hashed in full). digests: every row gets its text_sha256, in place of the
    text, which is left out, so that no text is shuffled. Defined cases: a null text counts as empty;
    a null id sorts below every other id; of rows equal in id and text exactly one is kept; an empty table gives
    an empty table; input columns named like the added ones (in any case) are replaced by them.
    """
    rest = replace_columns(docs, *ADDED)
    at = column(rest, text_col)
    shown = [i for i in range(len(rest.columns)) if not (digests and i == at)]
    plain = rest.toDF(*[f"c{i}" for i in range(len(rest.columns))])
    own, the_id = [F.col(f"c{i}") for i in shown], f"c{column(rest, id_col)}"
    text = F.coalesce(F.col(f"c{at}"), F.lit(""))
    length, prefix = F.octet_length(text), F.xxhash64(F.octet_length(text), F.substring(text.cast("binary"), 1, prefix_bytes))

    narrow = stash(plain.select(length.alias("len"), prefix.alias("pre")), "exact-narrow")
    lengths = stash(narrow.groupBy("len").count().filter("count > 1").select(F.xxhash64("len").alias("key")).distinct(), "exact-lengths")
    same_len = flagged(narrow, lengths, F.xxhash64("len"), "more").filter("more")
    prefixes = stash(same_len.groupBy("len", "pre").count().filter("count > 1").select(F.col("pre").alias("key")).distinct(), "exact-prefixes")
    unstash(narrow)

    marked = flagged(plain, prefixes, prefix, "_more")
    digest = F.sha2(text.cast("binary"), 256).alias("text_sha256")
    alone = marked.filter(~F.col("_more")).select(
        *own, F.col(the_id).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), digest if digests else F.lit(None).cast("string").alias("text_sha256")
    )
    hashed = marked.filter("_more").select(*own, digest)
    # Written, so that the join below has a plain exchange on either side and Spark can split a hot group's partition.
    groups = stash(hashed.groupBy("text_sha256").agg(F.max(the_id).alias("keep_id"), F.count("*").alias("group_size")), "exact-groups")
    among_equals = F.row_number().over(Window.partitionBy("text_sha256", the_id).orderBy(F.lit(1)))
    together = (
        hashed.withColumn("_nth", among_equals)
        .join(groups, "text_sha256")
        .withColumn("kept", F.col(the_id).eqNullSafe(F.col("keep_id")) & (F.col("_nth") == 1))
        .select(*alone.columns)
    )
    return alone.unionByName(together).toDF(*(rest.columns[i] for i in shown), *ADDED)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the largest doc_id of its equal texts: doc_id, keep_id, group_size long, kept boolean, text_sha256 string. Defined cases: as for ``exact_dedup``."""
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    return exact_dedup(docs, digests=True).select("doc_id", *ADDED)


OP6_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
