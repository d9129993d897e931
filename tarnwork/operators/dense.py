"""Dense retrieval: inner products of a stated set of query vectors with all rows, and what a ranking is worth.

Queries reach the tasks in blocks of bounded size, large enough that one pass over the rows serves very many of them; a task multiplies each
of its batches with the block, part by part, and lets out only what can still matter: its best ``k`` rows for each query, its best gold row,
or a count. So neither pairs nor full rankings are ever shuffled, and several variants (numbers of components) share a pass.
Rankings are by score, highest first, NaN last, ties by id. Vectors that are null or of another length than the query take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from ..written import in_blocks

#: Numbers (8 bytes each) in the query vectors that the tasks get at once, and scores that a task holds at once.
BLOCK_NUMBERS, SCORES = 4_000_000, 4_000_000


def _matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows, their vectors): rows with a vector of the length sought."""
    rows = np.flatnonzero(column.value_lengths().fill_null(-1).to_numpy() == dims)
    flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return rows, flat.reshape(len(rows), dims)


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _blocks(queries: DataFrame, extra: list[str]) -> Iterator[tuple]:
    """(ids, vectors, other columns) of queries of one length each; queries of different lengths come in different blocks."""
    held: dict[int, list[tuple]] = {}

    def close(rows: list[tuple]) -> tuple:
        ids, vectors, *more = zip(*rows, strict=True)
        return np.array(ids), np.array(vectors, np.float64), dict(zip(extra, map(np.array, more), strict=True))

    for row in queries.filter("embedding IS NOT NULL").select("query_id", "embedding", *extra).toLocalIterator():
        mine = held.setdefault(len(row.embedding), [])
        mine.append(tuple(row))
        if sum(n * len(rows) for n, rows in held.items()) >= BLOCK_NUMBERS:
            n = max(held, key=lambda n: n * len(held[n]))
            yield close(held.pop(n))
    for rows in held.values():
        yield close(rows)


class _Best:
    """The best k (score, id) of each query and variant so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.ids, self.scores, self.full = np.zeros((n, k), np.int64), np.full((n, k), -np.inf), np.zeros((n, k), bool)

    def add(self, at: slice, ids: np.ndarray, scores: np.ndarray, valid: np.ndarray | None = None) -> None:
        n, k = len(scores), self.k
        old = self.full[at].shape[1]
        value = np.concatenate([self.scores[at], scores], 1)
        ranked = np.where(np.isnan(value), -np.inf, value)
        known = np.concatenate([self.full[at], np.ones(scores.shape, bool) if valid is None else valid], 1)
        ranked[~known] = -np.inf
        last = np.partition(ranked, ranked.shape[1] - k, axis=1)[:, ranked.shape[1] - k]
        row, col = np.nonzero((ranked >= last[:, None]) & known)  # the best k and all that tie with the last of them
        own, score = np.where(col < old, self.ids[at][row, np.minimum(col, old - 1)], ids[np.maximum(col - old, 0)]), value[row, col]
        order = np.lexsort((own, -np.where(np.isnan(score), -np.inf, score), np.isnan(score), row))
        row, own, score = row[order], own[order], score[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        row, own, score, nth = row[nth < k], own[nth < k], score[nth < k], nth[nth < k]
        new_ids, new_scores, full = np.zeros((n, k), np.int64), np.full((n, k), -np.inf), np.zeros((n, k), bool)
        new_ids[row, nth], new_scores[row, nth], full[row, nth] = own, score, True
        self.ids[at], self.scores[at], self.full[at] = new_ids, new_scores, full

    def rows(self, queries: np.ndarray, variant: int) -> pa.RecordBatch:
        row, col = np.nonzero(self.full)
        cols = [pa.array(queries[row], pa.int64()), pa.array(np.full(len(row), variant), pa.int32()), pa.array(self.ids[row, col], pa.int64()), pa.array(self.scores[row, col], pa.float64())]
        return pa.RecordBatch.from_arrays(cols, names=["query_id", "variant", "vec_id", "score"])


class _Counts:
    def __init__(self, n: int):
        self.n = np.zeros(n, np.int64)

    def rows(self, queries: np.ndarray, variant: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(queries, pa.int64()), pa.array(np.full(len(queries), variant), pa.int32()), pa.array(self.n, pa.int64())], names=["query_id", "variant", "n"])


def _pass(queries: DataFrame, corpus: DataFrame, extra: list[str], start: Callable, work: Callable, schema: str, variants: list[int | None], unit: bool) -> DataFrame:
    """``work(state, part, block, variant, scores, columns)`` over all batches, for each part of the queries and each variant."""

    def run(sent) -> DataFrame:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, vectors, more = sent.value
            states = [start(len(ids)) for _ in variants]
            asked = [_unit(vectors[:, :d]) if unit else vectors[:, :d] for d in variants]
            for b in batches:
                rows, m = _matrix(b.column(b.schema.get_field_index("embedding")), vectors.shape[1])
                if not len(rows):
                    continue
                cols = {n: b.column(i).to_numpy(zero_copy_only=False)[rows] for i, n in enumerate(b.schema.names) if n != "embedding"}
                step = max(1, SCORES // len(rows))
                for v, d in enumerate(variants):
                    there = (_unit(m[:, :d]) if unit else m[:, :d]).T
                    for i in range(0, len(ids), step):
                        part = slice(i, i + step)
                        work(states[v], part, (ids, more), v, asked[v][part] @ there, cols)
            for v, state in enumerate(states):
                yield state.rows(ids, v)

        return corpus.mapInArrow(scan, schema)

    return in_blocks(corpus.sparkSession, _blocks(queries, extra), run, schema)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id", "variant").orderBy(F.isnan("score"), F.desc("score"), "vec_id")
    return found.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= k)


_FOUND = "query_id long, variant int, vec_id long, score double"


def top_k(queries: DataFrame, corpus: DataFrame, k: int, dims: int | None = None, unit: bool = False) -> DataFrame:
    """(query_id, vec_id, score, rk): the best k rows of the corpus (vec_id, embedding) for each query (query_id, embedding).

    dims: only the first so many components count. unit: vectors are brought to length one first. Defined cases: a query without a vector
    finds nothing; fewer than k rows give as many; equal scores go by id; a repeated row counts as often as it is there.
    """

    def work(state: _Best, part: slice, _, __, scores: np.ndarray, cols: dict) -> None:
        state.add(part, cols["vec_id"], scores)

    found = _pass(queries, corpus.select("vec_id", "embedding"), [], lambda n: _Best(n, k), work, _FOUND, [dims], unit)
    return _ranked(found, k).drop("variant")


def rank_variants(queries: DataFrame, corpus: DataFrame, variants: list[int | None], unit: bool = False, itself: bool = False) -> DataFrame:
    """(query_id, variant, first_rank, rr, top1): for each number of components the rank of the first gold row, without sorting any ranking.

    Gold are the corpus rows (vec_id, embedding, label) with the query's label. A query (query_id, embedding, label) doesn't find the row with
    its own id, unless ``itself`` says that the two kinds of ids have nothing to do with each other. The first pass finds each query's best
    gold row, the second counts the rows before it. Defined cases: queries without a gold row, label or vector are left out.
    """
    kinds = len(variants)

    def best_gold(state: _Best, part: slice, block, _, scores: np.ndarray, cols: dict) -> None:
        ids, more = block
        gold = cols["label"][None, :] == more["label"][part][:, None]
        if not itself:
            gold &= cols["vec_id"][None, :] != ids[part][:, None]
        state.add(part, cols["vec_id"], scores, gold)

    own = corpus.select("vec_id", "embedding", "label")
    asked = queries.filter("label IS NOT NULL")
    gold = _ranked(_pass(asked, own.filter("label IS NOT NULL"), ["label"], lambda n: _Best(n, 1), best_gold, _FOUND, variants, unit), 1)
    each = [F.max(F.when(F.col("variant") == v, F.col(c))).alias(f"{c}_{v}") for v in range(kinds) for c in ("vec_id", "score")]
    known = asked.join(gold.groupBy("query_id").agg(*each), "query_id")

    def before(state: _Counts, part: slice, block, v: int, scores: np.ndarray, cols: dict) -> None:
        ids, more = block
        g, gold_id = more[f"score_{v}"][part][:, None].astype(np.float64), more[f"vec_id_{v}"][part][:, None]
        earlier = cols["vec_id"][None, :] < gold_id
        ahead = np.where(np.isnan(g), ~np.isnan(scores) | earlier, (scores > g) | ((scores == g) & earlier))
        if not itself:
            ahead &= cols["vec_id"][None, :] != ids[part][:, None]
        state.n[part] += ahead.sum(1)

    extra = [f"{c}_{v}" for v in range(kinds) for c in ("vec_id", "score")]
    counts = _pass(known, own, extra, _Counts, before, "query_id long, variant int, n long", variants, unit)
    rank = (F.sum("n") + 1).alias("first_rank")
    return counts.groupBy("query_id", "variant").agg(rank).withColumn("rr", 1.0 / F.col("first_rank")).withColumn("top1", F.col("first_rank") == 1)


def reciprocal_ranks(queries: DataFrame, corpus: DataFrame, dims: int | None = None, unit: bool = False, itself: bool = False) -> DataFrame:
    """(query_id, first_rank, rr, top1) with all or the first ``dims`` components; see ``rank_variants``."""
    return rank_variants(queries, corpus, [dims], unit, itself).drop("variant")


def summarise(ranks: DataFrame) -> DataFrame:
    """One row: number of queries, mean reciprocal rank, share of queries whose first row is gold; the latter two null without queries."""
    return ranks.agg(F.count("*").alias("n_queries"), F.round(F.avg("rr"), 9).alias("mrr"), F.round(F.avg(F.col("top1").cast("double")), 9).alias("hit1"))


def compare_variants(ranks: DataFrame, a: int = 0, b: int = 1) -> DataFrame:
    """Two variants of one frame (query_id, variant, rr, top1), query by query: a passes if its first row is gold and its reciprocal rank is strictly greater."""
    each = [F.max(F.when(F.col("variant") == v, F.col(c))).alias(f"{c}_{n}") for n, v in (("a", a), ("b", b)) for c in ("rr", "top1")]
    both = ranks.groupBy("query_id").agg(*each).filter("rr_a IS NOT NULL AND rr_b IS NOT NULL")
    return both.withColumn("passes", F.col("top1_a") & (F.col("rr_a") > F.col("rr_b")))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """As ``compare_variants``, from two frames (query_id, rr, top1)."""
    cols = ["query_id", "rr", "top1"]
    return compare_variants(a.select(*cols, F.lit(0).alias("variant")).unionByName(b.select(*cols, F.lit(1).alias("variant"))))


def encode(texts: DataFrame, load, id_col: str, text_col: str = "text") -> DataFrame:
    """(id_col, embedding): texts through an encoder, brought to length one. ``load()`` is called once in each Python worker and returns a
    function from a list of strings to a matrix. A null text counts as empty; a vector of zeros stays one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for b in batches:
            m = _unit(np.asarray(model([x or "" for x in b.column(1).to_pylist()]), np.float64)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(m), pa.list_(pa.float32()))], names=[id_col, "embedding"])

    ship(texts.sparkSession)
    return texts.select(id_col, text_col).mapInArrow(run, f"{id_col} {dict(texts.dtypes)[id_col]}, embedding array<float>")


def evaluate(queries: DataFrame, cards: DataFrame, models: list) -> DataFrame:
    """(query_id, variant, first_rank, rr, top1) of each encoder, from texts: cards and queries are encoded, ranked and measured.

    queries: (query_id, text, gold), gold being the card_id sought; cards: (card_id, text); models: one ``load`` for each variant. Null
    texts are encoded as empty ones; a query whose gold is null or no card's id is left out; without cards or queries there is no row.
    """
    out = None
    for v, load in enumerate(models):
        own = encode(cards, load, "card_id").select(F.col("card_id").cast("long").alias("vec_id"), "embedding", F.col("card_id").cast("long").alias("label"))
        asked = encode(queries, load, "query_id").join(queries.select("query_id", F.col("gold").cast("long").alias("label")), "query_id")
        ranks = reciprocal_ranks(asked, own, itself=True).withColumn("variant", F.lit(v))
        out = ranks if out is None else out.unionByName(ranks)
    return out


def replicate(texts: DataFrame, stored: DataFrame, load, id_col: str, text_col: str = "text", tolerance: float = 1e-6) -> DataFrame:
    """One row: texts encoded again and held against the stored vectors (id_col, embedding): how many there are, how many agree in every
    component, and how many are missing on either side."""
    again = encode(texts, load, id_col, text_col).select(id_col, F.col("embedding").alias("again"))
    both = stored.select(id_col, "embedding").join(again, id_col, "full")
    off = F.array_max(F.zip_with("embedding", "again", lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
    same = (F.size("embedding") == F.size("again")) & (off <= tolerance)
    lone = F.col("embedding").isNull() | F.col("again").isNull()
    n = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0))
    return both.agg(F.count("*").alias("n"), n(same).alias("n_same"), n(lone).alias("n_missing"))
