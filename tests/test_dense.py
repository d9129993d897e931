import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwork.functions import unit
from tarnwork.operators import dense


def frames(spark, vectors, labels, asked):
    rows = [(i, v, y) for i, (v, y) in enumerate(zip(vectors, labels))]
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    return corpus.filter(F.col("vec_id").isin(asked)).select(F.col("vec_id").alias("query_id"), "embedding", "label"), corpus


def test_ties_go_by_id_and_nan_last(spark):
    q, c = frames(spark, [[1.0, 0.0], [0.5, 0.0], [0.5, 1.0], [float("nan"), 0.0], None, [1.0]], [0] * 6, [0])
    got = [(r.vec_id, r.rk) for r in dense.top_k(q, c, 10).orderBy("rk").collect()]
    assert got == [(0, 1), (1, 2), (2, 3), (3, 4)]


def test_zero_vector_at_length_one_is_zero(spark):
    q, c = frames(spark, [[3.0, 4.0], [0.0, 0.0], [6.0, 8.0]], [0, 0, 0], [0])
    got = {r.vec_id: r.score for r in dense.top_k(q, c, 3, unit=True).collect()}
    assert got == pytest.approx({0: 1.0, 2: 1.0, 1: 0.0})
    row = spark.range(1).select(unit(F.array(F.lit(0.0), F.lit(0.0))).alias("z"), unit(F.array(F.lit(3.0), F.lit(4.0))).alias("u"), unit(F.lit(None).cast("array<float>")).alias("n")).first()
    assert row.z == [0.0, 0.0] and row.u == pytest.approx([0.6, 0.8]) and row.n is None


def brute(vectors, labels, q, dims=None):
    s = [(-float(np.dot(vectors[q][:dims], v[:dims])), i) for i, v in enumerate(vectors) if i != q]
    order = [i for _, i in sorted(s)]
    return next((k + 1 for k, i in enumerate(order) if labels[i] == labels[q]), None)


def test_reciprocal_rank_against_full_sort(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK_NUMBERS", 12)
    monkeypatch.setattr(dense, "SCORES", 100)
    rng = np.random.default_rng(3)
    vectors = np.round(rng.normal(size=(60, 6)), 1).astype(np.float32).tolist()  # coarse, so that scores tie
    labels = rng.integers(0, 12, 60).tolist()
    labels[7] = 99  # has no gold row
    asked = [0, 7, 11, 30, 59]
    q, c = frames(spark, vectors, labels, asked)
    for dims in (None, 2):
        got = {r.query_id: r.first_rank for r in dense.reciprocal_ranks(q, c, dims).collect()}
        want = {i: brute(np.array(vectors, np.float64), labels, i, dims) for i in asked}
        assert got == {k: v for k, v in want.items() if v}


def test_both_first_is_no_win(spark):
    one = spark.createDataFrame([(1, 1.0, True), (2, 1.0, True), (3, 0.5, False)], "query_id long, rr double, top1 boolean")
    two = spark.createDataFrame([(1, 1.0, True), (2, 0.5, False), (3, 0.2, False)], "query_id long, rr double, top1 boolean")
    assert {r.query_id: r.passes for r in dense.compare(one, two).collect()} == {1: False, 2: True, 3: False}
    row = dense.summarise(one).first()
    assert (row.n_queries, row.hit1) == (3, pytest.approx(2 / 3, abs=1e-8)) and row.mrr == pytest.approx(2.5 / 3, abs=1e-8)


def test_encoder(spark):
    texts = spark.createDataFrame([(1, "ab"), (2, None)], "id int, text string")
    got = {r.id: r.embedding for r in dense.encode(texts, lambda: lambda xs: [[len(x), 2.0 * len(x)] for x in xs], "id").collect()}
    assert got[2] == [0.0, 0.0] and got[1][1] == pytest.approx(2 / math.sqrt(5), abs=1e-6)


def test_empty_query_set(spark):
    q, c = frames(spark, [[1.0]], [0], [5])
    assert dense.top_k(q, c, 3).count() == 0 and dense.reciprocal_ranks(q, c).count() == 0


def test_queries_in_several_blocks(spark, monkeypatch):
    """Blocks that are run one after the other give what one block gives; queries of another length look among their like."""
    rng = np.random.default_rng(8)
    vectors = np.round(rng.normal(size=(40, 4)), 1).astype(np.float32).tolist() + [[1.0, 2.0], [0.5, 2.0]]
    q, c = frames(spark, vectors, [0] * 42, [0, 3, 5, 9, 40])
    want = sorted(map(tuple, dense.top_k(q, c, 3).collect()))
    monkeypatch.setattr(dense, "BLOCK_NUMBERS", 4)
    assert sorted(map(tuple, dense.top_k(q, c, 3).collect())) == want
    assert {w[1] for w in want if w[0] == 40} == {40, 41}


def test_evaluation_from_texts(spark):
    cards = spark.createDataFrame([(0, "b b"), (1, "a"), (2, "a b")], "card_id int, text string")
    asked = spark.createDataFrame([(7, "a", 1), (8, "zzz", 2)], "query_id int, text string, gold int")

    def letters():
        return lambda xs: [[x.count("a"), x.count("b")] for x in xs]

    got = {(r.query_id, r.variant): r.first_rank for r in dense.evaluate(asked, cards, [letters, lambda: lambda xs: [[1.0]] * len(xs)]).collect()}
    assert got == {(7, 0): 1, (7, 1): 2, (8, 0): 3, (8, 1): 3}


def test_replication(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "c")], "id int, text string")
    load = lambda: lambda xs: [[1.0, len(x)] for x in xs]
    stored = dense.encode(texts.filter("id < 3"), load, "id")
    assert tuple(dense.replicate(texts, stored, load, "id").first()) == (3, 2, 1)
    other = lambda: lambda xs: [[len(x), 1.0] for x in xs]
    assert tuple(dense.replicate(texts, stored, other, "id").first()) == (3, 1, 1)
