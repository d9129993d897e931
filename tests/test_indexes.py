"""The written indexes: pruned top-k against the full pass, trigrams against plain containment; and reachability."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnwork.operators import dense, graph, lexical, pruned, trigrams


def vectors(spark, m, extra=()):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)


def same(spark, rows, index, asked, k):
    queries = rows.filter(F.col("vec_id").isin(asked)).select(F.col("vec_id").alias("query_id"), "embedding")
    want = dense.top_k(queries, rows, k).collect()
    got = pruned.top_k(index, queries, k).collect()
    show = lambda found: sorted((r.query_id, r.rk, r.vec_id, f"{r.score:.9g}") for r in found)
    assert show(got) == show(want)
    return pruned.work(index, queries, k).first()


def test_clusters_are_skipped(spark, tmp_path):
    """Of vectors in clusters, one of which has a third of all, few are met and fewer scored; the rows are those of the full pass."""
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(40, 16)) * 3
    m = centers[np.concatenate([np.zeros(1000, int), rng.integers(0, 40, 2000)])] + rng.normal(size=(3000, 16)) * 0.1
    rows = vectors(spark, m)
    index = pruned.build(rows, f"file://{tmp_path}/v", cells=64, page=100)
    done = same(spark, rows, index, list(range(0, 3000, 100)), 5)
    assert done.pairs == 30 * 3000 and done.scored <= done.met and 3 * done.scored < done.pairs and 2 * done.met < done.pairs
    again = pruned.reopen(spark, f"file://{tmp_path}/v")
    assert again.n_rows == 3000 and same(spark, rows, again, [0, 100], 3) is not None


def test_ties_oddities_and_small_tables(spark, tmp_path):
    """Equal vectors and scores, zeros, NaN, other lengths and nulls; fewer rows than k; no rows."""
    rng = np.random.default_rng(3)
    m = np.round(rng.normal(size=(60, 4)) * rng.choice([1, 5, 40], size=(60, 1)))  # whole numbers, so that ties are exact
    m[10:20] = m[5]
    m[20] = 0
    m[21, 2] = np.nan
    rows = vectors(spark, m, [(100, None), (101, [1.0, 2.0]), (102, [])])
    index = pruned.build(rows, f"file://{tmp_path}/a", cells=8, page=7, sample=30)
    same(spark, rows, index, [0, 5, 12, 20, 40], 4)
    same(spark, rows, index, [0, 5], 100)
    few = vectors(spark, m[:2])
    same(spark, few, pruned.build(few, f"file://{tmp_path}/b"), [0, 1], 5)
    none = pruned.build(few.filter("vec_id < 0"), f"file://{tmp_path}/c")
    assert none.n_rows == 0 and pruned.top_k(none, few.select(F.col("vec_id").alias("query_id"), "embedding"), 3).count() == 0


def test_a_task_lets_out_its_best_only(spark, tmp_path, monkeypatch):
    """Of many pages a task gives k rows for each query, also if queries come in several blocks; equal vectors in different pages tie by id."""
    rng = np.random.default_rng(7)
    m = rng.normal(size=(1500, 8))
    m[rng.permutation(1500)[:300]] = m[0]
    rows = vectors(spark, m)
    index = pruned.build(rows, f"file://{tmp_path}/v", cells=4, page=7, sample=5)
    asked = list(range(0, 1500, 50))
    queries = rows.filter(F.col("vec_id").isin(asked)).select(F.col("vec_id").alias("query_id"), "embedding")
    let_out = pruned.search(index, queries, 5).filter("vec_id IS NOT NULL").count()
    assert 5 * len(asked) <= let_out <= 5 * len(asked) * index.rows.rdd.getNumPartitions()
    same(spark, rows, index, asked, 5)
    monkeypatch.setattr(dense, "BLOCK_NUMBERS", 100)
    same(spark, rows, index, asked, 5)


def test_trigrams(spark, tmp_path):
    rng = random.Random(4)
    texts = [None, "", "a", "ab", "é", "日本語の文", "x😀y😀z", *("".join(rng.choice("abcé ") for _ in range(rng.randint(0, 40))) for _ in range(200))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    index = trigrams.build(docs, f"file://{tmp_path}/t", "doc_id")
    asked = ["a", "é", "ab", "abc", "cab", "bcaé", "日本", "本語の", "😀y😀", "zz", "abcabcabc", "c a", "", None]
    phrases = spark.createDataFrame(list(enumerate(asked)), "query_id long, phrase string")
    got = sorted((r.query_id, r.id) for r in trigrams.phrase_hits(trigrams.reopen(spark, f"file://{tmp_path}/t"), phrases, docs, "doc_id").collect())
    assert got == sorted((q, i) for q, w in enumerate(asked) for i, t in enumerate(texts) if w and t and w in t)
    queries = spark.createDataFrame([(0, "abc zz"), (1, "  "), (2, None), (3, "a é"), (4, "日本 bcaé bcaé")], "query_id long, text string")
    show = lambda df: sorted(map(tuple, df.select("query_id", "n_hits").collect()))
    assert show(trigrams.count_hits(index, queries, docs, "doc_id")) == show(lexical.count_hits(queries, docs))


@pytest.mark.parametrize("chars", [1, 12, 100_000])
def test_a_chunk_is_inverted_as_a_whole(chars, monkeypatch):
    """The grams and places of a chunk, sorted together, are those of its texts one by one: short texts, few and very many different characters."""
    monkeypatch.setattr(trigrams, "GROUP_CHARS", chars)
    rng = random.Random(8)
    chunks = [["".join(rng.choice("abé日😀\0 ") for _ in range(rng.choice([1, 2, 3, 4, 9]))) for _ in range(rng.randint(1, 12))] for _ in range(100)]
    chunks.append(["".join(map(chr, range(32, 3000))), "ab", "a"])  # too many for 32 bits
    if chars > 12:
        chunks.append(["".join(map(chr, range(0x10000, 0x10FFFF))), "ab", "a", "ab"])  # too many for 64
    for texts in chunks:
        want: dict[int, list[int]] = {}
        for i, t in enumerate(texts):
            for g in trigrams.grams(t).tolist():
                want.setdefault(g, []).append(i)
        found, ends, places = trigrams._inverted(pa.array(texts))
        assert (np.diff(found) > 0).all()
        assert {int(g): p.tolist() for g, p in zip(found, np.split(places, ends[:-1]), strict=True)} == want


def test_only_candidates_are_looked_at(spark, tmp_path):
    docs = spark.range(500).selectExpr("id AS doc_id", "concat('common words ', repeat(chr(97 + cast(id % 26 as int)), 4), ' rare', id) AS text")
    index = trigrams.build(docs, f"file://{tmp_path}/t", "doc_id")
    found = trigrams.candidates(index, spark.createDataFrame([("rare77",), ("absent words",)], "word string")).collect()
    assert {("rare77", 77)} <= {tuple(r) for r in found} and len(found) < 30


@pytest.mark.parametrize("most", [None, 2])
def test_closure(spark, most):
    rng = random.Random(5)
    edges = [(rng.randint(0, 40), rng.randint(0, 40)) for _ in range(60)] + [(0, i) for i in range(30)] + [(1, None), (None, 2), (3, 3), (50, 51), (51, 50)]
    starts = [0, 7, 50, 99, None, 7]
    got = {(r.start, r.node): r.hops for r in graph.closure(spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame([(s,) for s in starts], "start long"), most).collect()}
    want = {}
    for s in {x for x in starts if x is not None}:
        level, seen = {s}, {s: 0}
        for hop in range(1, (most or 100) + 1):
            level = {b for a, b in edges if a in level and b is not None} - seen.keys()
            seen |= {n: hop for n in level}
        want |= {(s, n): h for n, h in seen.items()}
    assert got == want


def test_the_trigram_index_is_compact(spark, tmp_path):
    """Postings of a common gram take bits, not rows: an index of texts that share their grams is far smaller than them, and in chunks and blocks finds the same."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 5))) for _ in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 400))) for _ in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    index = trigrams.build(docs, f"file://{tmp_path}/t", "doc_id")
    assert index.postings.count() <= 2 * index.counts.count() + 2
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < sum(map(len, texts)) / 2
    queries = spark.createDataFrame([(q, " ".join(rng.sample(words, 3)) + " nowhere") for q in range(30)], "query_id long, text string")
    show = lambda df: sorted(map(tuple, df.select("query_id", "n_hits").collect()))
    want = show(lexical.count_hits(queries, docs))
    assert show(trigrams.count_hits(index, queries, docs, "doc_id")) == want
    was, trigrams.BLOCK_WORDS = trigrams.BLOCK_WORDS, 20
    try:
        assert show(trigrams.count_hits(trigrams.build(docs, f"file://{tmp_path}/u", "doc_id", most=50), queries, docs, "doc_id")) == want
    finally:
        trigrams.BLOCK_WORDS = was
