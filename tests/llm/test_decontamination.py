import random

import pytest

from tarnwork.llm import decontamination as dc

from .helpers import prose


def brute(text, item):
    d, b = dc.words_of(text), dc.words_of(item)
    n = min(len(b), 12)
    misses = 2 if n == 12 else int(n >= 6)
    return n > 0 and any(sum(x == y for x, y in zip(d[i : i + n], b[j : j + n])) >= n - misses for i in range(len(d) - n + 1) for j in range(len(b) - n + 1))


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(8)
    items = [(i, prose(rng, rng.randint(12, 30))) for i in range(12)] + [(50, prose(rng, 8)), (51, prose(rng, 3)), (52, None), (53, ""), (54, "")]
    items.append((60, items[0][1]))
    docs = []
    for i in range(60):
        words = prose(rng, rng.randint(5, 80)).split()
        if i % 3 == 0:
            part = rng.choice(items[:14])[1].upper().split()
            for _ in range(rng.randint(0, 4)):
                part[rng.randrange(len(part))] = prose(rng, 1)
            at = rng.randint(0, len(words))
            words[at:at] = [w + rng.choice(("", ",", ".")) for w in part[rng.randint(0, 3) :]]
        docs.append((i, " ".join(words)))
    docs += [(100, None), (101, ""), (None, items[1][1]), (7, items[2][1]), (7, items[2][1])]
    return items, docs, spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string").repartition(3)


@pytest.mark.parametrize("block_words", [dc.BENCHMARK_WORDS, 40])
def test_against_brute_force(tables, block_words):
    items, docs, benchmark, df = tables
    named = [(i, t) for i, t in items if i != 60 and t]
    want = sorted((str(d), i) for d, text in docs for i, t in named if text and brute(text, t))
    got = dc.find_leaks(df, benchmark, block_words=block_words).collect()
    assert sorted((str(r.doc_id), r.item_id) for r in got) == want and len(want) > 10
    assert all(0 <= r.first_word < r.end_word and 0 < r.covered_words <= r.item_words for r in got)
    clean = dc.decontaminate(df, benchmark, block_words=block_words)
    assert clean.columns == df.columns
    assert sorted(map(str, clean.select("doc_id", "text").collect())) == sorted(map(str, [r for r in df.select("doc_id", "text").collect() if not any(r.text and brute(r.text, t) for _, t in named)]))


def test_any_two_misses_in_a_window_are_seen():
    item = [b"w%d" % i for i in range(12)]
    index = dc.Index([(1, item)])
    for a in range(12):
        for b in range(a, 12):
            doc = [b"x" if i in (a, b) else w for i, w in enumerate(item)]
            assert index.search([b"y", *doc]), (a, b)
    assert not index.search([b"x" if i in (0, 5, 9) else w for i, w in enumerate(item)])


def test_short_items():
    item = [b"w%d" % i for i in range(7)]
    index = dc.Index([(1, item), (2, [b"a", b"b"]), (3, [b"w1"])])
    for a in range(7):
        assert 1 in [hit[0] for hit in index.search([b"q", *(b"x" if i == a else w for i, w in enumerate(item)), b"q"])]
    assert not dc.Index([(1, item)]).search([b"x" if i in (1, 5) else w for i, w in enumerate(item)])
    assert [hit[0] for hit in index.search([b"b", b"a", b"b"])] == [2] and not index.search([b"a", b"x"])
    assert [hit[0] for hit in dc.Index([(1, item), (2, [b"a", b"b"])], shortest=6).search([b"a", b"b", *item])] == [1]


def test_scripts_without_spaces():
    assert dc.words_of("\u4f60\u597d ab,c") == ["\u4f60".encode(), "\u597d".encode(), b"ab", b"c"]
    item = "\u5929\u5730\u7384\u9ec4\u5b87\u5b99\u6d2a\u8352\u65e5\u6708\u76c8\u6603\u8fb0"
    assert dc.Index([(1, dc.words_of(item))]).search(dc.words_of("x" + item[:5] + "\u6545" + item[6:] + "y"))


def test_a_very_long_text_is_searched_to_its_end(spark):
    rng = random.Random(2)
    item, long = prose(rng, 20), prose(rng, 200_000)
    df = spark.createDataFrame([(1, long + " " + item), (2, long)], "doc_id long, text string")
    got = dc.find_leaks(df, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.first_word, r.end_word) for r in got] == [(1, 200_000, 200_020)]


def test_empty_tables(spark, nothing, tables):
    _, _, benchmark, df = tables
    assert dc.find_leaks(nothing, benchmark).count() == 0 and dc.find_leaks(df, benchmark.filter("1 = 0")).count() == 0
    assert dc.decontaminate(df, benchmark.filter("1 = 0")).count() == df.count()
