"""Exact top-k by inner product over a written cluster index that skips what can't matter.

Centroids are fitted on a bounded sample of the rows; every row goes to the cell of its nearest centroid, and rows are written in the order of their
cell and of their distance from its centroid. A task reads them in pages, up to ``PAGE`` rows of one cell that follow each other, and takes from each the
range of these distances and the longest vector. What a query can gain from a page
is bounded by the triangle inequality: q.x = q.c + q.(x - c) <= q.c + |q| high, and |q - x| is at least the gap between |q - c| and the page's range.
Against it stands the query's k-th best score: first that over the sample, which is part of the rows, then the running one of the task. In a page
that is left, rows are scored on the first coordinates of a rotation fitted on the sample (most of the variance first); Cauchy-Schwarz
bounds the rest, and only rows that still may count are scored in full, on the vectors as they are. So the rows are those of ``dense.top_k``.

Queries reach the tasks in blocks of bounded size, as by ``dense``, and a task lets out its best k rows for each of them. So what a task holds, one batch
of rows, one block and part of the scores of one page, grows neither with the rows nor with the queries. A cell with a third of
all rows is many pages that are dealt out like any others. On data without clusters (random directions) no page can be skipped, and only
the coordinates left out of most scores are saved.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship
from ..written import in_blocks
from .dense import _Best, _blocks

CELLS, PAGE = 256, 512
#: Scores that a task holds at once, and pairs of vectors that it multiplies one by one at once.
SCORES, PAIRS = 1_000_000, 20_000
#: Rows that the centroids and the rotation are fitted on, at most: those with the smallest hash of their id.
SAMPLE = 20_000
#: Shares of the rotated coordinates after which rows are given up.
STEPS = (0.5, 0.875)
ODD = -1  # the cell of vectors with a NaN or an infinite number, which nothing bounds
ROWS = "cell int, far double, vec_id bigint, vector binary"
FOUND = "query_id bigint, vec_id bigint, score double, met bigint, scored bigint"


@dataclass
class Index:
    """A written index: rows in order, and what was fitted. ``dims``: only vectors of that length are in it."""

    rows: DataFrame
    centroids: np.ndarray
    rotation: np.ndarray
    sample: np.ndarray
    page: int
    n_rows: int

    @property
    def dims(self) -> int:
        return self.centroids.shape[1]


def _vectors(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    rows = np.flatnonzero(column.value_lengths().fill_null(-1).to_numpy() == dims)
    flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return rows, flat.reshape(len(rows), dims)


def _nearest(m: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each vector and the distance, the latter computed without cancellation."""
    cell = np.argmax(m @ centroids.T - 0.5 * (centroids**2).sum(1), axis=1)
    return cell, np.linalg.norm(m - centroids[cell], axis=1)


def fit(sample: np.ndarray, cells: int, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, rotation) of a sample: k-means from evenly spaced rows, principal axes."""
    fine = sample[np.isfinite(sample).all(axis=1)]
    if not len(fine):
        return np.zeros((1, sample.shape[1])), np.eye(sample.shape[1])
    centroids = fine[np.unique(np.linspace(0, len(fine) - 1, min(cells, len(fine))).astype(int))].copy()
    for _ in range(rounds):
        cell, _ = _nearest(fine, centroids)
        sums, n = np.zeros_like(centroids), np.bincount(cell, minlength=len(centroids))
        np.add.at(sums, cell, fine)
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    _, axes = np.linalg.eigh(fine.T @ fine)
    return centroids, axes[:, ::-1].copy()


def build(rows: DataFrame, path: str, cells: int = CELLS, page: int = PAGE, sample: int = SAMPLE) -> Index:
    """Index of rows (vec_id, embedding), written under ``path``. Vectors that are null or not as long as most of the sample are left out."""
    spark = rows.sparkSession
    ship(spark)
    some = [r[0] for r in rows.filter("embedding IS NOT NULL").select("embedding", F.xxhash64("vec_id").alias("h")).orderBy("h").limit(sample).select("embedding").collect()]
    lengths = [len(v) for v in some]
    dims = max(set(lengths), key=lengths.count) if lengths else 1
    seen = np.array([v for v in some if len(v) == dims], np.float64).reshape(-1, dims)
    centroids, rotation = fit(seen, cells)
    sent = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, m = _vectors(b.column(1), dims)
            cell, far = _nearest(np.nan_to_num(m, nan=0.0, posinf=0.0, neginf=0.0), sent.value)
            cell[~np.isfinite(m).all(axis=1)] = ODD
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(far), b.column(0).take(pa.array(at)), pa.array([x.tobytes() for x in m], pa.binary())], names=["cell", "far", "vec_id", "vector"])

    assigned = rows.select("vec_id", "embedding").mapInArrow(assign, ROWS)
    assigned.repartitionByRange("cell", "far", "vec_id").sortWithinPartitions("cell", "far", "vec_id").write.parquet(f"{path}/rows")
    fitted = "dims int, page int, centroids binary, rotation binary, sample binary"
    spark.createDataFrame([(dims, page, centroids.tobytes(), rotation.tobytes(), seen.tobytes())], fitted).write.parquet(f"{path}/fitted")
    return reopen(spark, path)


def reopen(spark: SparkSession, path: str) -> Index:
    """The index written under ``path``."""
    f = spark.read.parquet(f"{path}/fitted").first()
    shaped = lambda x: np.frombuffer(bytes(x), np.float64).reshape(-1, f.dims)
    rows = spark.read.schema(ROWS).parquet(f"{path}/rows")
    return Index(rows, shaped(f.centroids), shaped(f.rotation), shaped(f.sample), f.page, rows.count())


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each row of scores, minus infinity where there are fewer finite ones."""
    ranked = np.where(np.isfinite(scores), scores, -np.inf)
    return np.partition(ranked, -k, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(scores), -np.inf)


def _bound(along: np.ndarray, norm: np.ndarray, away: np.ndarray, low, high, longest) -> np.ndarray:
    """The most that q.x can be: along q.c, norm |q|, away |q - c|; x at low to high from c, no longer than ``longest``."""
    gap = np.maximum(0, np.maximum(away - high, low - away))
    return np.minimum(along + norm * high, 0.5 * (norm**2 + longest**2 - gap**2))


def _pages(cell: np.ndarray, page: int) -> Iterator[slice]:
    """Runs of one cell, in pieces of at most ``page`` rows."""
    ends = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
    for low, high in zip(ends[:-1], ends[1:]):
        for at in range(low, high, page):
            yield slice(at, min(at + page, high))


def _products(q: np.ndarray, x: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """The inner product of each pair, always summed in the same order: equal vectors get equal scores wherever they lie, which a matrix product doesn't promise."""
    parts = [(q[row[i : i + PAIRS]] * x[col[i : i + PAIRS]]).sum(1) for i in range(0, len(row), PAIRS)]
    return np.concatenate(parts) if parts else np.zeros(0)


def search(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, met, scored): candidates of queries (query_id, embedding), at most k of each from a task, and rows without a vec_id that count pairs.

    met: pairs of a query and a row whose page wasn't skipped; scored: pairs scored in full.
    """
    spark, dims, page = queries.sparkSession, index.dims, index.page
    ship(spark)
    fitted = spark.sparkContext.broadcast((index.centroids, index.rotation))
    sample = spark.sparkContext.broadcast(index.sample)

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query with its k-th best score over the sample."""
        for b in batches:
            at, q = _vectors(b.column(1), dims)
            least = np.full(len(q), -np.inf)
            for part in range(0, len(q), 64):
                least[part : part + 64] = _kth(q[part : part + 64] @ sample.value.T, k) if len(sample.value) else -np.inf
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(least)], names=["query_id", "embedding", "least"])

    def run(sent) -> DataFrame:
        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (centroids, rotation), (names, asked, more) = fitted.value, sent.value
            best, least = _Best(len(names), k), more["least"].copy()
            odd = ~np.isfinite(asked).all(axis=1)
            norm, turned = np.linalg.norm(asked, axis=1), np.where(odd[:, None], 0, asked) @ rotation
            cuts = [0, *(max(1, int(dims * s)) for s in STEPS)]
            rest = [np.linalg.norm(turned[:, m:], axis=1) for m in cuts]
            now = along = away = None
            met = scored = 0
            for b in batches:
                cells, far, ids = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                vectors = np.frombuffer(b"".join(b.column(3).to_pylist()), np.float64).reshape(b.num_rows, dims)
                for at in _pages(cells, page):
                    cell, x, own = int(cells[at.start]), vectors[at], ids[at]
                    some = np.arange(len(names))
                    if cell != ODD:
                        if cell != now:
                            now, along, away = cell, asked @ centroids[cell], np.linalg.norm(asked - centroids[cell], axis=1)
                        longest = np.linalg.norm(x, axis=1).max()
                        some = np.flatnonzero(~(_bound(along, norm, away, far[at.start], far[at.stop - 1], longest) < least - _slack(least, norm, longest)) | odd)
                        xr = x @ rotation
                        left = [np.linalg.norm(xr[:, m:], axis=1) for m in cuts]
                    met += len(some) * len(x)
                    step = max(1, SCORES // len(x))
                    for part in (some[i : i + step] for i in range(0, len(some), step)):
                        alive = np.ones((len(part), len(x)), bool)
                        if cell != ODD:
                            bar = np.where(odd[part], -np.inf, least[part] - _slack(least[part], norm[part], longest))
                            known = np.zeros((len(part), len(x)))
                            for n in range(1, len(cuts)):
                                known += turned[part, cuts[n - 1] : cuts[n]] @ xr[:, cuts[n - 1] : cuts[n]].T
                                alive &= ~(known + rest[n][part, None] * left[n] < bar[:, None])
                                if not (stays := alive.any(axis=1)).all():
                                    part, bar, known, alive = part[stays], bar[stays], known[stays], alive[stays]
                        scored += int(alive.sum())
                        if cell != ODD:
                            alive &= ~(asked[part] @ x.T < bar[:, None])
                            stays = alive.any(axis=1)
                            part, alive = part[stays], alive[stays]
                        if not len(part):
                            continue
                        full = np.full(alive.shape, -np.inf)
                        row, col = np.nonzero(alive)
                        full[row, col] = _products(asked, x, part[row], col)
                        best.add(part, own, full, alive)
                        last = np.where(best.full[part, -1] & np.isfinite(best.scores[part, -1]), best.scores[part, -1], -np.inf)
                        least[part] = np.maximum(least[part], last)
            found = best.rows(names, 0).drop_columns("variant")
            none = pa.array(np.zeros(found.num_rows, np.int64))
            yield pa.RecordBatch.from_arrays([*found.columns, none, none], names=["query_id", "vec_id", "score", "met", "scored"])
            counts = zip((None, None, None, met, scored), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in counts], names=["query_id", "vec_id", "score", "met", "scored"])

        return index.rows.mapInArrow(score, FOUND)

    kind = queries.schema["embedding"].dataType.simpleString()
    started = queries.filter("embedding IS NOT NULL").select(F.col("query_id").cast("long"), "embedding").mapInArrow(start, f"query_id bigint, embedding {kind}, least double")
    return in_blocks(spark, _blocks(started, ["least"]), run, FOUND)


def _slack(least: np.ndarray, norm: np.ndarray, longest: float) -> np.ndarray:
    """Room for rounding, so that no bound that is equal but for its last digits gives up a row."""
    return 1e-9 * (1 + np.abs(np.where(np.isfinite(least), least, 0))) + 1e-13 * (norm**2 + longest**2)


def top_k(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, rk) as by ``dense.top_k``: highest scores first, NaN last, ties by id; vectors of another length take no part."""
    best = Window.partitionBy("query_id").orderBy(F.isnan("score"), F.desc("score"), "vec_id")
    found = search(index, queries, k).filter("vec_id IS NOT NULL").select("query_id", "vec_id", "score")
    return found.withColumn("rk", F.row_number().over(best)).filter(F.col("rk") <= k)


def work(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """One row: pairs of a query and a row, those whose page wasn't skipped, and those scored in full."""
    n = queries.filter(F.size("embedding") == index.dims).count()
    counts = search(index, queries, k).agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("met", "scored")))
    return counts.select(F.lit(n * index.n_rows).cast("long").alias("pairs"), "met", "scored")
