import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwork.llm import toxicity

from .helpers import prose

STEMS = ("grub", "zwick", "fopp", "knav")


@pytest.fixture(scope="module")
def labelled(spark):
    """Toxic texts hold a few words with a bad stem and any ending; some endings are never seen in training."""
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(900):
        words = prose(rng, rng.randint(30, 150)).split()
        toxic = rng.random() < 0.2
        for _ in range(max(2, len(words) // 25) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(STEMS) + prose(rng, 1))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    labels += [(5, None), (None, 1), (10_000, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int")


@pytest.fixture(scope="module")
def model(labelled):
    return toxicity.train(*labelled)


def test_held_out_accuracy(labelled, model):
    docs, labels = labelled
    rows = toxicity.score(docs, model).join(labels.filter("toxic IS NOT NULL"), "doc_id").filter(toxicity.fold(F.col("doc_id")) == 0).collect()
    right = sum(r.predicted == r.toxic for r in rows)
    assert len(rows) > 100 and right / len(rows) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_folds_follow_the_contract(spark):
    import zlib

    got = spark.createDataFrame([(i,) for i in range(200)], "i long").select("i", toxicity.fold(F.col("i")).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.i).encode()) % 5 for r in got)


def test_held_out_labels_teach_nothing(labelled, model):
    docs, labels = labelled
    other = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.train(docs, other)
    assert again.sent.value == model.sent.value and (again.slopes == model.slopes).all() and again.intercept == model.intercept


def test_awkward_rows(awkward, awkward_rows, nothing, model):
    got = toxicity.score(awkward, model)
    assert got.columns == ["doc_id", "text", "TEXT", "kept", "shard", "group_id", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == len(awkward_rows) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    assert toxicity.score(nothing, model).count() == 0


def test_without_labels(spark, labelled):
    docs, labels = labelled
    model = toxicity.train(docs, labels.filter("1 = 0"))
    assert {r.predicted for r in toxicity.score(docs.limit(5), model).collect()} == {0}


WORDS = [("abab", 3, 1), ("abba", 2, 0), ("ba", 0, 4), ("c", 1, 1)]


class Plain:
    """Interpolated Kneser-Ney by its definition, from the counted words alone."""

    def __init__(self, order, shared, discount=0.75):
        self.order, self.shared, self.d = order, shared, discount
        self.counts = {order: ({}, {})}
        for w, *n in WORDS:
            x = "\x02" * (order - 1) + w + "\x03"
            for i in range(len(w) + 1):
                for y in (0, 1):
                    if n[y]:
                        g = x[i : i + order]
                        self.counts[order][y][g] = self.counts[order][y].get(g, 0) + n[y]
        for k in range(order - 1, 0, -1):
            up = self.counts[k + 1]
            if k > shared:
                self.counts[k] = tuple(self.left(up[y]) for y in (0, 1))
            else:
                self.counts[k] = (self.left({**up[0], **up[1]}),) * 2

    @staticmethod
    def left(up):
        found = {}
        for g in up:
            found[g[1:]] = found.get(g[1:], 0) + 1
        return found

    def p(self, g, y):
        if not g:
            return toxicity.UNSEEN
        c = {k: v for k, v in self.counts[len(g)][y].items() if k[:-1] == g[:-1]}
        if not c:
            return self.p(g[1:], y)
        return (max(c.get(g, 0) - self.d, 0) + self.d * len(c) * self.p(g[1:], y)) / sum(c.values())


def test_probabilities_against_the_definition(spark):
    words = spark.createDataFrame(WORDS, "word string, c0 long, c1 long")
    plain = Plain(3, 1)
    for n, (seen, _) in enumerate(toxicity.probabilities(toxicity.gram_counts(words, 3), 3, 1), 1):
        rows = seen.collect()
        assert {r.gram for r in rows} == set(plain.counts[n][0]) | set(plain.counts[n][1])
        for r in rows:
            assert (r.p0, r.p1) == (pytest.approx(plain.p(r.gram, 0)), pytest.approx(plain.p(r.gram, 1)))
    alphabet = "abc\x03"  # and as many others as UNSEEN leaves room for, all alike
    for ctx in ("\x02\x02", "\x02a", "ab", "ba", "zz", "bz"):
        for y in (0, 1):
            total = sum(plain.p(ctx + c, y) for c in alphabet) + (1 / toxicity.UNSEEN - len(alphabet)) * plain.p(ctx + "?", y)
            assert total == pytest.approx(1)


def test_word_probabilities(spark):
    rows = [("idiot", 1, 40), ("the", 900, 100), ("rare", 0, 1), ("plain", 5, 0)]
    got = {r.gram: r.value for r in toxicity.word_ratios(spark.createDataFrame(rows, "word string, c0 long, c1 long")).collect()}
    total, p = 1047, ({}, {})
    for y in (0, 1):
        t, u = sum(r[1 + y] for r in rows), sum(r[1 + y] > 0 for r in rows)
        for r in rows:
            p[y][r[0]] = (max(r[1 + y] - 0.75, 0) + 0.75 * u * (r[1] + r[2]) / total) / t
        assert sum(p[y].values()) == pytest.approx(1)
    want = {w: np.log(p[1][w] / p[0][w]) for w in p[0]}
    assert got == pytest.approx(want) and {w for w, x in want.items() if x > 0} == {"idiot", "rare"}
    assert toxicity.word_ratios(spark.createDataFrame([("a", 0, 2)], "word string, c0 long, c1 long")).count() <= 1  # no ordinary text
    assert toxicity.word_ratios(spark.createDataFrame([], "word string, c0 long, c1 long")).count() == 0


def test_scores_against_plain_lookups(spark):
    words = spark.createDataFrame(WORDS, "word string, c0 long, c1 long")
    rows = toxicity.kneser_ney(toxicity.gram_counts(words, 3), 3, 1).collect()
    keys = toxicity._hash_all([r.gram for r in rows], [r.kind for r in rows])
    order = np.argsort(keys)
    speller = toxicity.Speller(keys[order], np.array([r.value for r in rows], np.float32)[order], 3)
    plain = Plain(3, 1)
    for w in ("abab", "ba", "aab", "c", "", "a" * 60):
        x = "\x02\x02" + w + "\x03"
        want = sum(np.log(plain.p(x[i - 2 : i + 1], 1) / plain.p(x[i - 2 : i + 1], 0)) for i in range(2, len(x)))
        assert speller.score([w, "ab"])[0] == pytest.approx(want, abs=1e-4)


def test_held_out_quality_on_the_tables(spark):
    """Figures of the contract's own split; about one toxic label in twenty has no sign at all in its text."""
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = toxicity.op4_toxicity(spark, d).filter("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").toPandas()
    ranks, n1 = rows["score"].rank(), int(rows["toxic"].sum())
    auc = (ranks[rows["toxic"] == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(rows) - n1))
    toxic = rows["toxic"] == 1
    assert auc >= 0.945
    assert rows["predicted"][toxic].mean() >= 0.88 and rows["predicted"][~toxic].mean() <= 0.02


def test_logistic():
    y = np.r_[np.zeros(50), np.ones(50)]
    slopes, cut = toxicity.logistic(np.stack([y, -y + np.arange(100) / 1e4], 1), y)
    assert slopes[0] > 0 and slopes[1] == 0 and -slopes[0] < cut < 0
    slopes, cut = toxicity.logistic(y[:, None], np.zeros(100))
    assert slopes.tolist() == [1.0] and cut < -5


def test_scores_do_not_depend_on_what_is_broadcast(spark, labelled, model):
    docs, labels = labelled
    known = docs.join(labels.filter("toxic IS NOT NULL"), "doc_id").withColumn("fit", toxicity.fold(F.col("doc_id")) > 1)
    rows = known.filter(toxicity.fold(F.col("doc_id")) != 0).select("toxic", "text", "fit")
    some = docs.limit(150).unionByName(spark.createDataFrame([(-1, None), (-2, "12 !"), (-3, "zwickzzq \U0001d4b3")], docs.schema))
    want = {r.doc_id: r.score for r in toxicity.score(some, toxicity.fit(rows)).collect()}
    few = toxicity.fit(rows, model_rows=500)
    got = toxicity.score(some, few)
    assert len(few.sent.value[0]) <= 500 * 8 and got.columns == ["doc_id", "text", "score", "predicted"]
    assert {r.doc_id: r.score for r in got.collect()} == pytest.approx(want, abs=1e-9)


def test_whole_scores_by_definition(spark):
    """Scores from counts of words and of their characters, by the formulas, for all stretches of each text."""
    rng, rows = random.Random(8), []
    for i in range(160):
        words = [rng.choice(("ab", "ba", "abab", "cab", "bb")) for _ in range(rng.randint(1, 40))]
        toxic = int(i % 4 == 0)
        words[0] = rng.choice(("zax", "zaz")) if toxic else words[0]
        rng.shuffle(words)
        rows.append((toxic, " ".join(words), i % 3 > 0))
    model = toxicity.fit(spark.createDataFrame(rows, "toxic int, text string, fit boolean"), order=toxicity.ORDER)
    texts = ["", "12", "zax", "ab ba cab", "zaz " * 3 + "ab " * 30, *(r[1] for r in rows[:20])]
    got = {r.i: r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "i long, text string"), model).collect()}

    counts = {}
    for toxic, text, fit in rows:
        for w in set(text.split()) if fit else ():
            counts.setdefault(w, [0, 0])[toxic] += 1
    total = [sum(c[y] for c in counts.values()) for y in (0, 1)]
    kinds = [sum(c[y] > 0 for c in counts.values()) for y in (0, 1)]
    p = lambda w, y: (max(counts[w][y] - 0.75, 0) + 0.75 * kinds[y] * sum(counts[w]) / sum(total)) / total[y]
    ratio = lambda w: np.log(p(w, 1) / p(w, 0)) if w in counts else 0.0
    global WORDS
    before, WORDS = WORDS, [(w, *c) for w, c in counts.items()]
    try:
        plain = Plain(toxicity.ORDER, toxicity.SHARED)
    finally:
        WORDS = before
    n = toxicity.ORDER - 1

    def lean(w):
        x = "\x02" * n + w + "\x03"
        found = sum(np.log(plain.p(x[i - n : i + 1], 1) / plain.p(x[i - n : i + 1], 0)) for i in range(n, len(x)))
        return min(max((found - toxicity.LEAN_FROM) / (toxicity.LEAN_WHOLLY - toxicity.LEAN_FROM), 0), 1)

    for i, text in enumerate(texts):
        words = toxicity.words_of(text)
        found = (0, 0, 0)
        if words:
            v = [ratio(w) for w in words]
            spans = [sum(v[a:b]) / (b - a + 1) for a in range(len(v)) for b in range(a + 1, min(a + toxicity.SPAN, len(v)) + 1)]
            found = (max(v), max(spans), np.sqrt(np.mean([lean(w) for w in words])))
        want = 1 / (1 + np.exp(-(np.dot(found, model.slopes) + model.intercept)))
        assert got[i] == pytest.approx(want, abs=1e-4)
