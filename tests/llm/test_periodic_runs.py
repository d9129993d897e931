"""Runs against a search through all stretches."""

import random

import pytest

from tarnwork.llm.periodic_runs import collapse, collapse_runs, repeated_end


def all_runs(words):
    out = set()
    for p in range(1, len(words) // 4 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(6, 4 * p):
                stretch = words[i : j + p]
                if not any(stretch[q:] == stretch[:-q] for q in range(1, p)):
                    out.add((i, j + p - i, p))
            i = max(i + 1, j)
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept(words, runs):
    stays = [True] * len(words)
    for start, length, period in runs:
        stays[start + period : start + length] = [False] * (length - period)
    return b" ".join(w for w, s in zip(words, stays) if s)


def nested(rng):
    words = []
    for _ in range(rng.randint(0, 6)):
        words += [rng.choice("abc"[: rng.randint(1, 3)]).encode() for _ in range(rng.randint(1, 5))] * rng.randint(1, 8)
    return words


def test_against_all_stretches():
    rng = random.Random(3)
    for _ in range(400):
        texts = [nested(rng) for _ in range(rng.randint(1, 6))]
        runs, left = collapse(texts)
        assert runs == [all_runs(w) for w in texts] and left == [kept(w, r) for w, r in zip(texts, runs)]


@pytest.mark.parametrize("words, want", [
    ("a a a a a", []),  # shorter than six
    ("a a a a a a", [(0, 6, 1)]),
    ("x a b a b a b a b y", [(1, 8, 2)]),
    ("x a b a b a b a y", []),  # three and a half periods
    ("a b a b a b a b a b a b", [(0, 12, 2)]),  # not again with period 4 or 6
    ("a a a a a a b " * 4, [(0, 6, 1), (0, 28, 7), (7, 6, 1), (14, 6, 1), (21, 6, 1)]),
])
def test_rules(words, want):
    assert collapse([words.encode().split()])[0][0] == want


def test_repeated_end():
    words = [b"%d" % i for i in range(20)]
    assert repeated_end(words, 11) == words and repeated_end([], 30) == []
    assert repeated_end(words, 420) == words[:2] + [words[2 + i % (1 + 18 // 5)] for i in range(18)]  # g 42: a 2, p 1 + 18 // (3 + 2)


def test_long_texts_take_little_time():
    """A single word, and a word that is often interrupted, for 20,000 words; no pair of places is looked at twice for each period."""
    one, broken = [b"a"] * 20_000, ([b"a"] * 50 + [b"b"]) * 400
    runs, left = collapse([one, broken])
    assert runs[0] == [(0, 20_000, 1)] and left[0] == b"a"
    assert len(runs[1]) == 401 and (0, 20_400, 51) in runs[1] and len(left[1].split()) == 2


def test_awkward_rows(spark, awkward, awkward_rows, nothing):
    docs = awkward.repartition(2)
    got = collapse_runs(docs)
    assert got.columns == [*docs.columns, "runs", "collapsed"]
    plain = sorted((str(r[0]), b" ".join((r[1] or "").encode().split()).decode()) for r in awkward_rows)
    assert sorted((str(r[0]), r["collapsed"]) for r in got.collect()) == plain
    assert collapse_runs(nothing).count() == 0
    clash = spark.createDataFrame([(1, "a " * 9, "old")], "doc_id long, text string, Runs string")
    row = collapse_runs(clash).first()
    assert (row.text, [tuple(x) for x in row.runs], row.collapsed) == ("a " * 9, [(0, 9, 1)], "a")
