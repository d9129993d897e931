"""Importance resampling towards a target: features are counted and weighed once for each distinct text, noise is drawn for each document.

Equal texts are folded by grouping whole texts; a text's features are hashed once, its counts multiplied by the number of its copies, and its
weight is joined back to all rows that have it. Only then every document draws its own noise, and the highest scores are drawn.
The features (runs of one to three words) are hashed by CRC-32, which is linear: the checksum of "a b" follows from those of "a " and "b" by a
table for the length of "b", so that a word is hashed once and a run of words costs a few array look-ups.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, pick, replace_columns, small_batches, stash, table, tidy, unstash
from .sharding import number_rows

BUCKETS, GRAMS = 10_000, 3
PERCENT, MIN_WORDS, SEED = 5, 20, 42
#: Bytes of text that are hashed together, unless a single text is longer.
TOGETHER = 2_000_000
#: Lengths of words, in bytes, that have a table; longer words are hashed one by one.
LENGTHS = 64
ADDED = ("n_features", "weight", "score", "rank")

#: ASCII digits and letters stay, A-Z lower-cased; bytes of other characters stay; all else parts words.
_PLAIN = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


@cache
def _shifts() -> np.ndarray:
    """For n zero bytes appended to what has a checksum: what each value of each of its four bytes becomes, at [(4 n + byte) * 256 + value]."""
    step = np.array([zlib.crc32(bytes([v])) ^ zlib.crc32(b"\0") for v in range(256)], np.uint32)  # the linear part alone
    rows = [np.concatenate([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])]
    for _ in range(LENGTHS):
        c = rows[-1]
        rows.append((c >> np.uint32(8)) ^ step[c & np.uint32(255)])
    return np.concatenate(rows)


def _shift(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    tables, base = _shifts(), n << 10
    out = tables[base + (crc & np.uint32(255))]
    for k in (1, 2, 3):
        out ^= tables[base + 256 * k + ((crc >> np.uint32(8 * k)) & np.uint32(255))]
    return out


class Hasher:
    """Buckets of all runs of one to three words of several texts at once; a word's checksums are kept over calls, up to a bound."""

    KEEP = 200_000

    def __init__(self) -> None:
        self.start()

    def start(self) -> None:
        self.ids: dict[bytes, int] = {b"\0": 0}
        self.words, self.alone, self.spaced, self.sizes = [b"\0"], [0], [0], [0]

    def look(self, words: list[bytes]) -> np.ndarray:
        for w in set(words) - self.ids.keys():
            self.ids[w] = len(self.words)
            self.words.append(w)
            self.alone.append(crc := zlib.crc32(w))
            self.spaced.append(zlib.crc32(b" ", crc))
            self.sizes.append(len(w))
        return np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))

    def buckets(self, texts: Iterable[str | None], buckets: int = BUCKETS) -> tuple[np.ndarray, list[np.ndarray]]:
        """Number of words of each text; and for one, two and three words the bucket of the run that starts at each place, ``buckets`` where none does.

        The places of a text are its words and one more, which starts nothing.
        """
        if len(self.words) > self.KEEP:
            self.start()
        joined = b" \0 ".join((t or "").encode().translate(_PLAIN) for t in texts) + b" \0"
        at = self.look(joined.split())
        ends = np.flatnonzero(at == 0)
        counts = np.diff(np.concatenate([[-1], ends])) - 1
        alone, spaced, sizes = np.array(self.alone, np.uint32)[at], np.array(self.spaced, np.uint32)[at], np.array(self.sizes, np.int64)[at]
        none = at == 0
        one = np.where(none, buckets, alone % np.uint32(buckets)).astype(np.int64)
        out, n = [one], len(at)
        long = np.flatnonzero(sizes >= LENGTHS)
        short = np.minimum(sizes, LENGTHS - 1)
        # before: checksum of all words of the run but the last, each with a space after it
        before, gap = spaced, none
        for k in range(1, GRAMS):
            m = max(n - k, 0)
            gap = gap[:m] | none[k:]
            crc = _shift(before[:m], short[k:]) ^ alone[k:]
            starts = np.unique(np.concatenate([long - j for j in range(1, k + 1)])) if len(long) else long
            for i in starts[(starts >= 0) & (starts < m)]:
                if not gap[i]:
                    crc[i] = zlib.crc32(b" ".join(self.words[x] for x in at[i : i + k + 1]))
            found = np.full(n, buckets, np.int64)
            found[:m] = np.where(gap, buckets, crc % np.uint32(buckets))
            out.append(found)
            if k + 1 < GRAMS:
                before = _shift(before[:m], short[k:] + 1) ^ spaced[k:]
        return counts, out


def parts(batch: pa.RecordBatch, name: str = "text") -> Iterator[tuple[int, list[str | None]]]:
    """Texts of a batch, some megabytes at a time, and the row of the first."""
    texts, low, size = batch[name].to_pylist(), 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > TOGETHER:
            yield low, texts[low:i]
            low, size = i, 0
        size += len(t or "")
    if low < len(texts):
        yield low, texts[low:]


def fold(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct texts with the number of rows that have them: sha, text, n. Null counts as empty. Written; equal texts meet within a task first."""
    whole = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return stash(whole.groupBy("text").agg(F.count("*").alias("n")).select(_sha("text"), "text", "n"), "distinct-texts")


def _sha(name: str) -> Column:
    return F.unhex(F.sha2(F.col(name).cast("binary"), 256)).alias("sha")


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all rows: of distinct texts, times their copies. A task lets out one row for each bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total = Hasher(), np.zeros(buckets + 1, np.int64)
        for batch in batches:
            copies = batch["n"].to_numpy(zero_copy_only=False)
            for low, some in parts(batch):
                words, grams = hasher.buckets(some, buckets)
                of_place = np.repeat(copies[low : low + len(some)], words + 1).astype(np.float64)
                for g in grams:
                    total += np.bincount(g, of_place, buckets + 1).astype(np.int64)
        tidy()
        full = np.flatnonzero(total[:buckets])
        yield pa.record_batch({"bucket": pa.array(full), "n": pa.array(total[full])})

    with small_batches(texts.sparkSession):
        rows = texts.select("text", "n").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(all_counts: np.ndarray, target_counts: np.ndarray) -> np.ndarray:
    """For each bucket floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets))))."""
    s_all, t_all, buckets = int(all_counts.sum()), int(target_counts.sum()), len(all_counts)
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets)))) for s, t in zip(all_counts.tolist(), target_counts.tolist())], np.int64)


def weigh(texts: DataFrame, gain: np.ndarray) -> DataFrame:
    """sha, n_words, n_features and weight of each distinct text."""
    sent = texts.sparkSession.sparkContext.broadcast(np.concatenate([gain, [0]]))
    buckets = len(gain)

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, gain = Hasher(), sent.value
        for batch in batches:
            sizes, sums = [], []
            for _, some in parts(batch):
                words, grams = hasher.buckets(some, buckets)
                each = sum(gain[g] for g in grams)
                begins = np.concatenate([[0], np.cumsum(words + 1)[:-1]])
                sizes.append(words)
                sums.append(np.add.reduceat(each, begins))
            words = np.concatenate([*sizes, np.zeros(0, np.int64)]).astype(np.int64)
            features = words + np.maximum(words - 1, 0) + np.maximum(words - 2, 0)
            yield pa.record_batch({"sha": batch["sha"], "n_words": pa.array(words), "n_features": pa.array(features), "weight": pa.array(np.concatenate([*sums, np.zeros(0, np.int64)]).astype(np.int64))})
        tidy()

    return texts.select("sha", "text").mapInArrow(weights, "sha binary, n_words long, n_features long, weight long")


def noise(the_id: Column, seed: int = SEED) -> Column:
    """A document's own Gumbel noise in thousandths, from the hash of seed and id (null: the id \"null\")."""
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(the_id.cast("string"), F.lit("null"))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((drawn + 0.5) / 4294967296.0))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, buckets: int = BUCKETS,
    id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", keep_text: bool = True,
) -> DataFrame:
    """All rows and columns of ``docs`` plus n_features, weight, score and rank (1, 2, 3... by score; null where a row isn't drawn).

    Of rows with at least ``min_words`` words the ``percent`` hundredths with the highest scores are drawn, ties to the smaller id.
    keep_text: false leaves the text out, so that it isn't shuffled. Defined cases: a null text counts as empty, has no feature and weight 0;
    a null id draws the noise of the word null and comes before other ids; rows equal in id and text get the same score and follow each other;
    without a target text every bucket's gain follows from the corpus alone; an empty table gives an empty table; input columns named like
    the added ones are replaced by them.
    """
    rest = replace_columns(docs, *ADDED)
    names, at = rest.columns, column(rest, text_col)
    shown = [i for i in range(len(names)) if keep_text or i != at]
    plain = rest.toDF(*[f"c{i}" for i in range(len(names))])
    own = plain.withColumn("_text", F.coalesce(F.col(f"c{at}"), F.lit("")))
    texts, aims = fold(plain, f"c{at}"), fold(pick(target, text=target_text_col))
    gain = gains(bucket_counts(texts, buckets), bucket_counts(aims, buckets))
    weights = stash(weigh(texts, gain), "weights")
    unstash(texts, aims)
    the_id = F.col(f"c{column(rest, id_col)}")
    back = own.withColumn("sha", _sha("_text")).select(*[f"c{i}" for i in shown], the_id.alias("_id"), "sha").join(weights, "sha")
    scored = back.withColumn("_score", F.col("weight") + noise(the_id, seed)).withColumn("_out", F.col("n_words") < min_words).withColumn("_down", -F.col("_score"))
    numbered, _ = number_rows(scored.drop("sha", "n_words"), ["_out", "_down", "_id"])
    drawn = percent * numbered.filter("NOT _out").count() // 100
    rank = F.when(~F.col("_out") & (F.col("row_number") < drawn), F.col("row_number") + 1)
    return numbered.select(*[f"c{i}" for i in shown], "n_features", "weight", "_score", rank).toDF(*[names[i] for i in shown], *ADDED)


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents resampled towards the benchmark: doc_id, n_features, weight, score, rank, all long. Defined cases: as for ``resample``."""
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    return resample(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
