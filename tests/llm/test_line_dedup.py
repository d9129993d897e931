"""Lines that many documents have, against plain counts."""

import random
from collections import Counter

import pytest

from tarnwork.llm import line_dedup

LOW = str.maketrans(line_dedup.UPPER, line_dedup.LOWER)


def plain(texts, min_docs, min_chars=1):
    key = lambda x: x.strip(line_dedup.BLANKS).translate(LOW)
    n = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")})
    goes = {k for k, v in n.items() if v >= min_docs and len(k) >= min_chars}
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        left = [x for x in lines if key(x) not in goes]
        out.append((len(lines), len(lines) - len(left), "\n".join(left)))
    return out


def texts(seed, n=300):
    rng = random.Random(seed)
    lines = ["", " ", "Share\t", " share", "SHARE", "é", "É", "a b", "a  b", "x" * 500, *(f"line {i}" for i in range(150))]
    made = ["\n".join(rng.choice(lines) for _ in range(rng.randint(0, 12))) for _ in range(n)]
    return [None, "", "\n", "\n\n", "Share", *made, made[0], made[1], made[1], "\n".join(f"line {i}" for i in range(150)) * 3]


def rows(df):
    return [(r.n_lines, r.n_dropped, r.kept_text) for r in df.orderBy("i").collect()]


@pytest.mark.parametrize("sent, bits", [(500_000, 1 << 26), (20, 1 << 26), (0, 1 << 15), (7, 1 << 15)])
def test_against_plain_counts(spark, monkeypatch, sent, bits):
    """Whether the common lines are sent, or most or all of them are joined, the rows are the same."""
    monkeypatch.setattr(line_dedup, "SENT_KEYS", sent)
    monkeypatch.setattr(line_dedup, "FILTER_BITS", bits)
    given = texts(4)
    docs = spark.createDataFrame(list(enumerate(given)), "i long, text string").repartition(5)
    assert rows(line_dedup.drop_common_lines(docs)) == plain(given, 10)


def test_bitmap_lets_strangers_through_and_they_stay(spark, monkeypatch):
    """With a bitmap that is full everything is looked up in the table, and nothing else goes."""
    monkeypatch.setattr(line_dedup.Known, "settle", lambda self, keys: line_dedup.np.full(len(keys), 2, "int8"))
    given = texts(9, 60)
    docs = spark.createDataFrame(list(enumerate(given)), "i long, text string").repartition(3)
    monkeypatch.setattr(line_dedup, "SENT_KEYS", 0)
    assert rows(line_dedup.drop_common_lines(docs, min_docs=3)) == plain(given, 3)


def test_shortest_and_threshold(spark):
    given = ["a\nlong line", "a\nLong line ", "a\nother"]
    docs = spark.createDataFrame(list(enumerate(given)), "i long, text string")
    assert rows(line_dedup.drop_common_lines(docs, min_docs=2, min_chars=2)) == [(2, 1, "a"), (2, 1, "a"), (2, 0, "a\nother")]
    assert rows(line_dedup.drop_common_lines(docs, min_docs=4)) == plain(given, 4)


def test_awkward_rows(spark, awkward, awkward_rows, nothing):
    got = line_dedup.drop_common_lines(awkward, min_docs=4)
    assert got.columns == [*awkward.columns, *line_dedup.ADDED]
    want = sorted((str(r[0]), *p) for r, p in zip(awkward_rows, plain([r[1] for r in awkward_rows], 4)))
    assert sorted((str(r[0]), r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got.collect()) == want
    assert any(w[2] for w in want)
    assert line_dedup.drop_common_lines(nothing).count() == 0
    clash = spark.createDataFrame([(1, "a", 5)], "i long, text string, N_Lines int")
    assert line_dedup.drop_common_lines(clash).columns == ["i", "text", *line_dedup.ADDED]
