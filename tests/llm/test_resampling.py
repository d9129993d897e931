"""Resampling against a plain computation."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from tarnwork.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall((text or "").translate(LOW))


def features(text):
    w = words_of(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def resampled(docs, target, percent=5, min_words=20):
    """(id, n_features, weight, score, rank), for rows of id and text."""
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(features(x))
    for x in target:
        t.update(features(x))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000)))) for b in range(10000)]
    rows = []
    for i, x in docs:
        f = features(x)
        h = int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(x))])
    long = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for k, r in enumerate(long[: percent * len(long) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in rows]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    some = ["a", "Bb", "x" * 63, "x" * 64, "x" * 65, "y" * 300, "é" * 40, "q1", "-", "日本"]
    return [None, "", " ", "Hello, World 9x", "é Ünï ß　x", *(" ".join(rng.choice(some) for _ in range(rng.randint(0, 30))) for _ in range(150))]


def test_buckets(texts, monkeypatch):
    hasher, at = resampling.Hasher(), 0
    counts, grams = hasher.buckets(texts)
    for text, n in zip(texts, counts):
        w = words_of(text)
        assert len(w) == n
        for k in range(3):
            want = [zlib.crc32(" ".join(w[i : i + k + 1]).encode()) % 10000 for i in range(n - k)]
            assert grams[k][at : at + n + 1].tolist() == want + [10000] * (n + 1 - len(want))
        at += n + 1
    monkeypatch.setattr(resampling.Hasher, "KEEP", 3)  # starts anew, with the same buckets
    again = resampling.Hasher()
    again.buckets(texts)
    assert all((a == b).all() for a, b in zip(again.buckets(texts)[1], grams))


def test_against_plain_computation(spark, texts, monkeypatch):
    monkeypatch.setattr(resampling, "TOGETHER", 200)
    given = list(enumerate([*texts, *texts[20:60], *[texts[30]] * 50]))
    target = [texts[10], texts[30], None, texts[10]]
    docs = spark.createDataFrame(given, "doc_id long, text string").repartition(5)
    got = resampling.resample(docs, spark.createDataFrame([(x,) for x in target], "text string"), percent=30, min_words=10)
    assert got.columns == ["doc_id", "text", "n_features", "weight", "score", "rank"]
    assert sorted(tuple(r)[:1] + tuple(r)[2:] for r in got.collect()) == sorted(resampled(given, target, 30, 10))
    assert {r.doc_id: r.text for r in got.collect()} == dict(given)


def test_awkward_rows(spark, awkward, awkward_rows, nothing):
    target = spark.createDataFrame([("one two",)], "text string")
    got = resampling.resample(awkward, target, percent=50).collect()
    assert got[0].__fields__ == [*(c for c in awkward.columns if c != "score"), *resampling.ADDED]
    want = resampled([r[:2] for r in awkward_rows], ["one two"], 50)
    assert sorted(map(str, ((r[0], r["n_features"], r["weight"]) for r in got))) == sorted(str(w[:3]) for w in want)
    # Rows that tie in id and text may change places, so ranks are compared as a list.
    assert sorted((r["rank"], r[0] or -1, r["weight"]) for r in got if r["rank"]) == sorted((w[4], w[0] or -1, w[2]) for w in want if w[4])
    assert resampling.resample(nothing, target).count() == 0
    assert resampling.resample(awkward, nothing).count() == len(awkward_rows)
