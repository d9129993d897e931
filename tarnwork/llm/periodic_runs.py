"""Periodic runs by probing a harmonic grid: words at jp and (j + 1)p are compared, survivors extended by chunks of an array.

A run of period p and at least ``repeats`` periods holds ``repeats`` points of the grid 0, p, 2p, ... in a row, all with the same word. So each
period costs one comparison in p words, n/1 + n/2 + n/3 + ... in all, and only where all these comparisons hold the words around are
compared one by one, a chunk at a time. Periods go up; grid points inside a run found for a divisor of the period are skipped, and so are
those inside the run just found. Several documents are probed together, longest first, each closed by a mark that is equal to nothing; a
period is tried only on the front part that is long enough for it. A text is whole in one task and needs no other, so there is no shuffle.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, pick, replace_columns, stash, table, tidy

SHORTEST, REPEATS = 6, 4
#: Bytes of text that are probed together, unless a single text is longer.
TOGETHER = 4_000_000
RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"
ADDED = ("runs", "collapsed")


def _right(ids: np.ndarray, i: int, p: int) -> int:
    """The first place from i on whose word differs from that p later."""
    size = max(64, p)
    while True:
        later = ids[i + p : i + p + size]
        differs = ids[i : i + len(later)] != later
        k = int(differs.argmax()) if len(differs) else 0
        if len(differs) and differs[k]:
            return i + k
        i += len(later)
        if len(later) < size:
            return i
        size *= 2


def _left(ids: np.ndarray, i: int, p: int) -> int:
    """The start of the stretch of places, ending before i, whose words equal those p later."""
    size = max(64, p)
    while i > 0:
        low = max(0, i - size)
        differs = (ids[low:i] != ids[low + p : i + p])[::-1]
        k = int(differs.argmax())
        if differs[k]:
            return i - k
        i, size = low, 2 * size
    return 0


def _whole(ids: np.ndarray, points: np.ndarray, p: int, span: int) -> np.ndarray:
    """Of the points those from which on ``span`` words equal the words p later, compared a chunk at a time for all points at once."""
    low, size = 0, 16
    while low < span and len(points):
        chunk = np.arange(low, min(low + size, span))
        step = max(1, 1_000_000 // len(chunk))
        left = []
        for k in range(0, len(points), step):
            some = points[k : k + step]
            spots = some[:, None] + chunk
            left.append(some[(ids[spots] == ids[spots + p]).all(axis=1)])
        points, low, size = np.concatenate(left), low + size, min(2 * size, 1_000_000)
    return points


def find_runs(ids: np.ndarray, lengths: list[int], shortest: int = SHORTEST, repeats: int = REPEATS) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of all runs in ``ids``: parts of these lengths, longest first, each followed by a number found nowhere else."""
    ends = np.cumsum(np.array(lengths, np.int64) + 1) if len(lengths) else np.zeros(0, np.int64)
    starts, stops, periods = (np.zeros(16, np.int64) for _ in range(3))
    found, seen, usable = 0, set(), len(lengths)
    for p in range(1, (lengths[0] if len(lengths) else 0) // repeats + 1):
        least = max(shortest, repeats * p)
        while usable and lengths[usable - 1] < least:
            usable -= 1
        if not usable:
            return
        grid = ids[: ends[usable - 1] : p]
        same = grid[1:] == grid[:-1]
        if len(same) < repeats - 1:
            continue
        hits = same[: len(same) - repeats + 2]
        for k in range(1, repeats - 1):
            hits = hits & same[k : len(same) - repeats + 2 + k]
        if not hits.any():
            continue
        points = np.flatnonzero(hits) * p
        inside = np.flatnonzero(p % periods[:found] == 0) if found else ()
        if len(inside):
            low = np.searchsorted(points, starts[inside])
            high = np.searchsorted(points, stops[inside] - (repeats - 1) * p)
            covered = np.zeros(len(points) + 1, np.int64)
            np.add.at(covered, low, 1)
            np.add.at(covered, np.maximum(low, high), -1)
            points = points[np.cumsum(covered)[:-1] == 0]
        points = _whole(ids, points, p, (repeats - 2) * p + 1)
        k = 0
        while k < len(points):
            x = int(points[k])
            low, high = _left(ids, x, p), _right(ids, x, p)
            if high + p - low >= least and (low, high + p) not in seen:
                seen.add((low, high + p))
                if found == len(starts):
                    starts, stops, periods = (np.concatenate([a, np.zeros_like(a)]) for a in (starts, stops, periods))
                starts[found], stops[found], periods[found] = low, high + p, p
                found += 1
                yield low, high + p, p
            k = max(k + 1, int(np.searchsorted(points, high)))


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but space and tab to carriage return."""
    return (text or "").encode().split()


def repeated_end(words: list[bytes], seed: int) -> list[bytes]:
    """Words that from a place on are the repetition of a stretch, both drawn from the seed, if it is divisible by ten; else the words themselves."""
    n, g = len(words), seed // 10
    if seed % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*words[:a], *(words[a + (i - a) % p] for i in range(a, n))]


def collapse(texts: list[list[bytes]], shortest: int = SHORTEST, repeats: int = REPEATS) -> tuple[list[list[tuple[int, int, int]]], list[bytes]]:
    """For texts given as words: their runs as (start, length, period), by start and period; and the kept words, joined by a space."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    code = defaultdict(count().__next__)
    parts, begins, at = [], [], 0
    for k, i in enumerate(order):
        begins.append(at)
        parts += [np.fromiter(map(code.__getitem__, texts[i]), np.int32, len(texts[i])), np.array([-k - 1], np.int32)]
        at += len(texts[i]) + 1
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, end, period in find_runs(ids, [len(texts[i]) for i in order], shortest, repeats):
        k = int(np.searchsorted(begins, start, "right")) - 1
        runs[order[k]].append((start - begins[k], end - start, period))
    kept = []
    for words, own in zip(texts, runs):
        own.sort(key=lambda r: (r[0], r[2]))
        if own:
            stays = np.ones(len(words), bool)
            for start, length, period in own:
                stays[start + period : start + length] = False
            words = compress(words, stays)
        kept.append(b" ".join(words))
    return runs, kept


def _batches(texts: list[str | None]) -> Iterator[range]:
    low, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > TOGETHER:
            yield range(low, i)
            low, size = i, 0
        size += len(t or "")
    if low < len(texts):
        yield range(low, len(texts))


def collapse_runs(docs: DataFrame, text_col: str = "text", shortest: int = SHORTEST, repeats: int = REPEATS, seed: Column | None = None) -> DataFrame:
    """All rows and columns of ``docs`` plus runs (by start, then period) and collapsed (the text without repeated periods, words joined by one space).

    A run is a stretch of words with smallest period q and a length of at least ``shortest`` and ``repeats`` times q that no neighbouring word
    extends; of each run the first q words stay, unless another run drops them. seed: a column of longs; where it is divisible by ten the end
    of the text is repeated first (``repeated_end``), to plant runs. Defined cases: a null, empty or blank text has no run and collapses to the
    empty text; repeated rows and ids are rows like others; a null seed plants nothing; an empty table gives an empty table; input columns
    named like the added ones are replaced by them.
    """
    rest = replace_columns(docs, *ADDED)
    names = rest.columns
    plain = rest.toDF(*[f"c{i}" for i in range(len(names))])

    @F.arrow_udf(f"struct<runs:{RUN},collapsed:string>")
    def found(texts: pa.Array, seeds: pa.Array) -> pa.Array:
        given, drawn = texts.to_pylist(), seeds.to_pylist()
        runs, kept = [], []
        for part in _batches(given):
            words = [words_of(given[i]) if drawn[i] is None else repeated_end(words_of(given[i]), drawn[i]) for i in part]
            own, left = collapse(words, shortest, repeats)
            runs += own
            kept += left
        sizes = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
        flat = np.array([x for r in runs for x in r], np.int64).reshape(-1, 3)
        rows = pa.StructArray.from_arrays([pa.array(flat[:, k].copy()) for k in range(3)], ["start", "length", "period"])
        out = pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), rows), pa.array(kept, pa.binary()).cast(pa.string())], ["runs", "collapsed"])
        tidy()
        return out

    made = plain.withColumn("_made", found(F.col(f"c{column(rest, text_col)}"), F.lit(None).cast("long") if seed is None else seed))
    return made.select(*plain.columns, "_made.runs", "_made.collapsed").toDF(*names, *ADDED)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's periodic runs, with the ends of some repeated as the contract says: doc_id, n_runs, start, length, period, exponent_milli long, runs_sha256, collapsed_sha256 string.

    start to exponent_milli are those of the run with most periods (ties: smallest start, then period), null without a run.
    Defined cases: as for ``collapse_runs``; a null id plants nothing.
    """
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    marked = docs.select("doc_id", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("_seed"), "text")
    made = collapse_runs(marked.select("doc_id", F.col("_seed").alias("seed"), "text"), seed=F.col("c1"))
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    longest = F.aggregate("runs", none, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))
    shown = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[x].cast("string") for x in ("start", "length", "period")]), F.lit("\n"))), "")
    out = made.select("doc_id", "runs", longest.alias("best"), F.sha2(shown.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return stash(
        out.select(
            "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"best.{x}").alias(x) for x in ("start", "length", "period")],
            F.expr("1000L * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
        ),
        "periodic-runs",
    )
