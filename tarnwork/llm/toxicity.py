"""Toxicity by class-conditional Kneser-Ney models of words and of their spelling.

Each class, toxic and ordinary, gets two interpolated Kneser-Ney models. One is over words, each counted once for each document of the
class that has it; its lower order is counted over both classes together, so a rare word falls back to a count that the classes share.
The other is over the characters of these words (order ``ORDER``, counts of distinct left contexts below the highest order); its orders up
to ``SHARED`` are shared too. So an expression speaks for a class as far as that class has it in several documents, and one never seen
before still does by its stem. The two log-likelihoods are compared stretch by stretch and by length, as an expression is as bad in a long text as
in a short one: the highest log ratio of a single word; the highest of a stretch of up to ``SPAN`` words, over the number of its words
and one neutral word more; and the share of words whose spelling is the toxic model's. A logistic function of the three, fitted on
labelled rows that the counts didn't use, gives the score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from math import sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, pick, replace_columns, stash, table, tidy

ORDER, SHARED, DISCOUNT = 6, 2, 0.75
#: Probability of a character that was never seen.
UNSEEN = 1 / 3000
#: A word's spelling counts as toxic in part from the first log ratio on, wholly from the second.
LEAN_FROM, LEAN_WHOLLY = 2.0, 4.0
#: Words of a stretch, at most.
SPAN = 20
#: Most words, grams and contexts that are broadcast (12 bytes each), the commonest; words that need others get them by a join.
MODEL_ROWS = 10_000_000
#: Rows that the logistic function is fitted on, at most; labels are broadcast up to this many rows, else shuffled.
CALIBRATION_ROWS, BROADCAST_LABELS = 50_000, 2_000_000
#: Words whose score a worker remembers, and texts that it looks at together.
REMEMBERED, TOGETHER = 300_000, 200
LONGEST_WORD = 64

_WORD = re.compile(r"[^\W\d_]{1,%d}" % LONGEST_WORD)


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case; runs over ``LONGEST_WORD`` letters count as several words."""
    return _WORD.findall(text.lower())


# ---------------------------------------------------------------- counting


def word_counts(labelled: DataFrame) -> DataFrame:
    """(word, c0, c1): ordinary and toxic texts that have the word; labelled: (toxic, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (Counter(), Counter())
        for b in batches:
            for y, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held[y].update(set(words_of(x.as_py() or "")))
                if len(held[0]) + len(held[1]) > 300_000:
                    yield rows(held)
                    held = (Counter(), Counter())
        if held[0] or held[1]:
            yield rows(held)

    def rows(held: tuple[Counter, Counter]) -> pa.RecordBatch:
        words = list(held[0].keys() | held[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([h[w] for w in words], pa.int64()) for h in held)], names=["word", "c0", "c1"])

    return labelled.select("toxic", "text").mapInArrow(count, "word string, c0 long, c1 long").groupBy("word").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def word_ratios(words: DataFrame, discount: float = DISCOUNT) -> DataFrame:
    """(kind, gram, value, n) with kind 'w': the log ratio of each word's probabilities in the two classes, over a lower order that they share."""
    kinds = [F.sum(F.expr(f"cast(c{y} > 0 AS long)")).alias(f"u{y}") for y in (0, 1)]
    sums = words.agg(F.sum("c0").alias("t0"), F.sum("c1").alias("t1"), *kinds).first()
    total = (sums.t0 or 0) + (sums.t1 or 0)

    def p(y: int) -> Column:
        shared = (F.col("c0") + F.col("c1")) / F.lit(float(total or 1))
        if not sums[f"t{y}"]:
            return shared
        return (F.greatest(F.col(f"c{y}") - discount, F.lit(0.0)) + discount * sums[f"u{y}"] * shared) / sums[f"t{y}"]

    return words.select(F.lit("w").alias("kind"), F.col("word").alias("gram"), F.log(p(1) / p(0)).alias("value"), (F.col("c0") + F.col("c1")).alias("n"))


def gram_counts(words: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, n0, n1): counts of the character strings of length ``order``; \\x02 pads a word's start, \\x03 ends it."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: tuple[dict, dict] = ({}, {})
            for w, *counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = "\x02" * (order - 1) + w + "\x03"
                grams = [x[i : i + order] for i in range(len(w) + 1)]
                for h, c in zip(held, counts, strict=True):
                    if c:
                        for g in grams:
                            h[g] = h.get(g, 0) + c
            keys = list(held[0].keys() | held[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([h.get(k, 0) for k in keys], pa.int64()) for h in held)], names=["gram", "n0", "n1"])

    return words.mapInArrow(split, "gram string, n0 long, n1 long").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _contexts(grams: DataFrame) -> DataFrame:
    """Totals and numbers of distinct continuations of each context."""
    kinds = [F.sum(F.expr(f"cast(n{y} > 0 AS long)")).alias(f"u{y}") for y in (0, 1)]
    return grams.groupBy(F.expr("substring(gram, 1, length(gram) - 1)").alias("ctx")).agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"), *kinds)


def probabilities(top: DataFrame, order: int = ORDER, shared: int = SHARED, discount: float = DISCOUNT) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 1 on: (gram, p0, p1, n) of the strings that occur, and (ctx, w0, w1, n): the weights with which a context falls back.

    A character that no text has gets ``UNSEEN`` at the bottom, so over an alphabet of 1 / UNSEEN characters all add up to one.
    """
    levels = {order: stash(top, f"grams{order}")}
    for n in range(order - 1, 0, -1):
        up = levels[n + 1]
        lower = up.groupBy(F.expr("substring(gram, 2)").alias("gram"))
        if n > shared:
            found = lower.agg(F.sum(F.expr("cast(n0 > 0 AS long)")).alias("n0"), F.sum(F.expr("cast(n1 > 0 AS long)")).alias("n1"))
        else:
            found = lower.agg(F.count("*").alias("n0")).withColumn("n1", F.col("n0"))
        levels[n] = stash(found, f"grams{n}")
    out, below = [], None
    for n in range(1, order + 1):
        ctx = _contexts(levels[n])
        rows = levels[n].withColumn("ctx", F.expr("substring(gram, 1, length(gram) - 1)")).join(ctx, "ctx")
        if below is None:
            rows = rows.withColumn("q0", F.lit(UNSEEN)).withColumn("q1", F.lit(UNSEEN))
        else:
            rows = rows.withColumn("low", F.expr("substring(gram, 2)")).join(below.select(F.col("gram").alias("low"), F.col("p0").alias("q0"), F.col("p1").alias("q1")), "low")

        def p(y: int) -> Column:
            seen = (F.greatest(F.col(f"n{y}") - discount, F.lit(0.0)) + discount * F.col(f"u{y}") * F.col(f"q{y}")) / F.col(f"t{y}")
            return F.when(F.col(f"t{y}") > 0, seen).otherwise(F.col(f"q{y}"))

        def weight(y: int) -> Column:
            return F.when(F.col(f"t{y}") > 0, discount * F.col(f"u{y}") / F.col(f"t{y}")).otherwise(1.0)

        below = stash(rows.select("gram", p(0).alias("p0"), p(1).alias("p1"), (F.col("n0") + F.col("n1")).alias("n")), f"p{n}")
        out.append((below, ctx.select("ctx", weight(0).alias("w0"), weight(1).alias("w1"), (F.col("t0") + F.col("t1")).alias("n"))))
    return out


def kneser_ney(top: DataFrame, order: int = ORDER, shared: int = SHARED, discount: float = DISCOUNT) -> DataFrame:
    """(kind, gram, value, n) of the two models together: kind 'r' has the log ratio of a string's probabilities, kind 'b' that of the weights with which a context falls back."""
    model = None
    for seen, fallback in probabilities(top, order, shared, discount):
        ratios = seen.select(F.lit("r").alias("kind"), "gram", F.log(F.col("p1") / F.col("p0")).alias("value"), "n")
        weights = fallback.select(F.lit("b").alias("kind"), F.col("ctx").alias("gram"), F.log(F.col("w1") / F.col("w0")).alias("value"), "n")
        both = ratios.unionByName(weights)
        model = both if model is None else model.unionByName(both)
    return model


# ---------------------------------------------------------------- scoring

#: What a text is judged by.
FEATURES = ("_word", "_span", "_lean")


def text_features(ratios: np.ndarray, leaning: np.ndarray, span: int = SPAN) -> tuple[float, float, float]:
    """From the log ratios of a text's words in order: the highest of a word, and the highest of a stretch over its length and one neutral word;
    and from how far their spelling leans, the square root of the mean. Without words all are 0."""
    n = len(ratios)
    if not n:
        return 0.0, 0.0, 0.0
    sums = np.concatenate([[0.0], np.cumsum(ratios)])
    best = max(float((sums[m:] - sums[:-m]).max()) / (m + 1) for m in range(1, min(span, n) + 1))
    return float(ratios.max()), best, sqrt(float(leaning.sum()) / n)


_MUL = np.uint64(0x9E3779B97F4A7C15)


def _at(codes: np.ndarray, at: np.ndarray, n: int, kind: int) -> np.ndarray:
    """A 64-bit hash of the ``n`` characters from each of the places ``at``; kind 0 for strings, 1 for contexts."""
    out = np.full(len(at), (n * 2 + kind + 1) * int(_MUL) % (1 << 64), np.uint64)
    for i in range(n):
        out = (out ^ codes[at + i].astype(np.uint64)) * _MUL
        out ^= out >> np.uint64(29)
    return out


def _hash_words(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w.encode(), 2) for w in words], np.uint64)


def _hash_all(grams: list[str], kinds: list[str]) -> np.ndarray:
    """Keys of rows of the model: kind 'r' for strings, 'b' for contexts, 'w' for words."""
    out, groups = np.empty(len(grams), np.uint64), {}
    words = [i for i, k in enumerate(kinds) if k == "w"]
    out[words] = _hash_words([grams[i] for i in words])
    for i, (g, k) in enumerate(zip(grams, kinds, strict=True)):
        if k != "w":
            groups.setdefault((len(g), int(k == "b")), []).append(i)
    for (n, k), which in groups.items():
        codes = np.frombuffer("".join(grams[i] for i in which).encode("utf-32-le"), np.uint32)
        out[which] = _at(codes, np.arange(len(which)) * n, n, k)
    return out


class Speller:
    """Log-likelihood ratios of words, from sorted hashes and values (12 bytes a row)."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, order: int = ORDER):
        self.keys, self.values, self.order = keys, values, order
        self.strong: dict[str, float] = {}
        self.lean: dict[str, float] = {}

    def _look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(h), bool), np.zeros(len(h), np.float32)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        hit = self.keys[at] == h
        return hit, np.where(hit, self.values[at], np.float32(0))

    def _spots(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words' padded characters, and for each own character its place and its word."""
        pad = self.order - 1
        codes = np.frombuffer("".join("\x02" * pad + w + "\x03" for w in words).encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        firsts = np.cumsum(sizes + pad) - sizes  # place of each word's first own character
        owner = np.repeat(np.arange(len(words)), sizes)
        spots = np.repeat(firsts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return codes, spots, owner

    def missing(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the words' strings and contexts that aren't in the table, each with its word's place."""
        keys, places = [], []
        codes, spots, owner = self._spots(words)
        for n in range(1, self.order + 1):
            for h in (_at(codes, spots - (n - 1), n, 0), _at(codes, spots - (n - 1), n - 1, 1)):
                lacks = ~self._look(h)[0]
                keys.append(h[lacks])
                places.append(owner[lacks])
        lacks = ~self._look(h := _hash_words(words))[0]
        return np.concatenate([*keys, h[lacks]]), np.concatenate([*places, np.flatnonzero(lacks)])

    def strength(self, words: list[str]) -> np.ndarray:
        """The words' own log ratios; 0 for one that no labelled text has."""
        return self._look(_hash_words(words))[1].astype(np.float64)

    def leaning(self, words: list[str]) -> np.ndarray:
        """How far each word's spelling is the toxic model's, from 0 to 1."""
        return np.clip((self.score(words) - LEAN_FROM) / (LEAN_WHOLLY - LEAN_FROM), 0, 1)

    def score(self, words: list[str]) -> np.ndarray:
        """Sum over a word's characters: the ratio of the longest known string that ends there, after the weights of the contexts fallen back from."""
        if not words:
            return np.zeros(0)
        codes, spots, owner = self._spots(words)
        total, left = np.zeros(len(spots)), np.arange(len(spots))
        for n in range(self.order, 0, -1):
            at = spots[left] - (n - 1)
            hit, value = self._look(_at(codes, at, n, 0))
            total[left] += value
            left, at = left[~hit], at[~hit]
            if not len(left):
                break
            total[left] += self._look(_at(codes, at, n - 1, 1))[1]
        return np.bincount(owner, total, len(words))

    def features(self, texts: list[str]) -> list[tuple[float, float, float]]:
        """``text_features`` of each text. Words that weren't met before are looked up for all the texts at once."""
        words = [words_of(x) for x in texts]
        strong, lean = self.strong, self.lean
        new = list(set().union(*words).difference(strong))
        if len(strong) + len(new) > REMEMBERED:
            strong.clear()
            lean.clear()
            new = list(set().union(*words))
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            strong.update(zip(part, self.strength(part).tolist(), strict=True))
            lean.update(zip(part, self.leaning(part).tolist(), strict=True))
        every = list(chain.from_iterable(words))
        ends = np.cumsum([0, *map(len, words)])
        ratios, leaning = (np.fromiter(map(d.__getitem__, every), np.float64, len(every)) for d in (strong, lean))
        return [text_features(ratios[i:j], leaning[i:j]) for i, j in zip(ends[:-1], ends[1:])]


class Both(Speller):
    """A speller that looks into two tables without common keys."""

    def __init__(self, one: Speller, other: Speller):
        super().__init__(one.keys, one.values, one.order)
        self.other = other

    def _look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        (hit, value), (hit2, value2) = super()._look(h), self.other._look(h)
        return hit | hit2, value + value2


class Model:
    """What scoring needs: the sent table, and the logistic function's slopes and intercept."""

    def __init__(self, spark: SparkSession, rows: pa.Table, rest: DataFrame | None = None):
        order = np.argsort(keys := rows["key"].to_numpy().view(np.uint64), kind="stable")
        self.sent = spark.sparkContext.broadcast((keys[order].tobytes(), rows["value"].to_numpy().astype(np.float32)[order].tobytes()))
        self.slopes, self.intercept, self.rest = np.ones(len(FEATURES)), 0.0, rest

    def _word_scores(self, texts: DataFrame) -> DataFrame:
        """(word, strong, lean) of the distinct words of the column ``text``, with the rows of ``rest``; the same as from one table of all rows."""
        sent = self.sent
        words = stash(word_counts(texts.select(F.lit(0).alias("toxic"), "text")).select("word"), "words")

        def lacks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            speller = Speller(*(np.frombuffer(x, t) for x, t in zip(sent.value, (np.uint64, np.float32), strict=True)))
            for b in batches:
                own = b.column(0).to_pylist()
                keys, places = speller.missing(own)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), b.column(0).take(pa.array(places))], names=["key", "word"])

        found = words.mapInArrow(lacks, "key long, word string").distinct().join(self.rest, "key")
        more = found.groupBy("word").agg(F.collect_list("key").alias("keys"), F.collect_list("value").alias("values"))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, values = (np.frombuffer(x, t) for x, t in zip(sent.value, (np.uint64, np.float32), strict=True))
            for b in batches:
                extra = [c.flatten().to_numpy(zero_copy_only=False) for c in b.columns[1:]]
                new, at = np.unique(extra[0].astype(np.int64).view(np.uint64), return_index=True)
                both = Both(Speller(keys, values), Speller(new, extra[1][at].astype(np.float32)))
                own = b.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(both.strength(own), pa.float64()), pa.array(both.leaning(own), pa.float64())], names=["word", "strong", "lean"])

        return words.join(more, "word", "left").select("word", "keys", "values").mapInArrow(score, "word string, strong double, lean double")

    def _joined_features(self, docs: DataFrame) -> DataFrame:
        """``features`` where not all rows are broadcast: distinct words are scored once each and joined to the documents that hold them."""
        rows = stash(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
        scores = stash(self._word_scores(rows), "word-scores")

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own, words, places = [], [], []
                for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    held: dict[str, list[int]] = {}
                    for k, w in enumerate(words_of(x.as_py() or "")):
                        held.setdefault(w, []).append(k)
                    own += [i] * len(held)
                    words += held.keys()
                    places += held.values()
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(words, pa.string()), pa.array(places, pa.list_(pa.int32()))], names=["_row", "word", "places"])

        @F.arrow_udf("struct<_word:double,_span:double,_lean:double>")
        def judge(texts: pa.Array) -> pa.Array:
            out = []
            for words in texts.to_pylist():
                n = sum(len(w["places"]) for w in words)
                ratios, leaning = np.zeros(n), np.zeros(n)
                for w in words:
                    ratios[w["places"]], leaning[w["places"]] = w["strong"], w["lean"]
                out.append(text_features(ratios, leaning))
            return pa.StructArray.from_arrays([pa.array([x[k] for x in out], pa.float64()) for k in range(3)], list(FEATURES))

        held = rows.select("_row", "text").mapInArrow(place, "_row long, word string, places array<int>")
        found = held.join(scores, "word").groupBy("_row").agg(F.collect_list(F.struct("places", "strong", "lean")).alias("words")).select("_row", judge("words").alias("_found"))
        return rows.join(found, "_row", "left").select(*docs.columns, *(F.coalesce(F.col(f"_found.{c}"), F.lit(0.0)).alias(c) for c in FEATURES))

    def features(self, docs: DataFrame) -> DataFrame:
        """docs with the columns of ``FEATURES``; docs must have the column text and any others."""
        if self.rest is not None:
            return self._joined_features(docs)
        sent, at = self.sent, docs.columns.index("text")

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, values = sent.value
            speller = Speller(np.frombuffer(keys, np.uint64), np.frombuffer(values, np.float32))
            for b in batches:
                for i in range(0, b.num_rows, TOGETHER):
                    part = b.slice(i, TOGETHER)
                    found = np.array(speller.features([x or "" for x in part.column(at).to_pylist()]))
                    yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(f.copy(), pa.float64()) for f in found.T)], names=[*b.schema.names, *FEATURES])
            tidy()

        added = [T.StructField(c, T.DoubleType()) for c in FEATURES]
        return docs.mapInArrow(score, T.StructType([*docs.schema.fields, *added]))


def fit(labelled: DataFrame, order: int = ORDER, model_rows: int = MODEL_ROWS) -> Model:
    """Fits on rows (toxic, text, fit): rows with fit true are counted, all of them; the others place the logistic function.

    Without a label of either class every score is 0.5 or lower.
    """
    spark = labelled.sparkSession
    words = word_counts(labelled.filter("fit"))
    words = stash(words, "labelled-words")
    model = kneser_ney(gram_counts(words, order), order).unionByName(word_ratios(words))
    model = stash(model, "kneser-ney")
    n, rest = model.count(), None
    if n > model_rows:
        steps = sorted(model.groupBy(F.floor(F.log2("n") * 4).alias("s")).count().collect(), reverse=True)
        total, least = 0, 1000
        for r in steps:
            if (total := total + r["count"]) > model_rows:
                break
            least = r["s"]
        common = F.floor(F.log2("n") * 4) >= least
        model, rest = model.filter(common), model.filter(~common)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, grams, values = (c.to_pylist() for c in b.columns)
            keys = _hash_all(grams, kinds)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(values, pa.float32())], names=["key", "value"])

    hash_rows = lambda m: m.select("kind", "gram", "value").mapInArrow(hashed, "key long, value float")
    fitted = Model(spark, hash_rows(model).toArrow(), rest=None if rest is None else stash(hash_rows(rest), "rare-grams"))
    held = labelled.filter(~F.col("fit")).select("toxic", "text")
    sample = held.orderBy(F.xxhash64("text")).limit(CALIBRATION_ROWS) if held.count() > CALIBRATION_ROWS else held
    sample = fitted.features(sample).select(*FEATURES, "toxic").toArrow()
    fitted.slopes, fitted.intercept = logistic(np.stack([sample[c].to_numpy() for c in FEATURES], 1), sample["toxic"].to_numpy().astype(float))
    return fitted


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes (not negative) and intercept of a lightly damped logistic regression, by Newton's method."""
    if not len(x) or y.min() == y.max():
        return np.ones(x.shape[1]), -8.0
    mid, wide = x.mean(0), x.std(0)
    wide[wide == 0] = 1.0
    use = np.ones(x.shape[1], bool)
    while True:
        z = np.c_[((x - mid) / wide)[:, use], np.ones(len(x))]
        w = np.zeros(z.shape[1])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(w)), z.T @ (y - p) - 1e-2 * w)
            w += np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-9:
                break
        if (w[:-1] >= 0).all():
            slopes = np.zeros(x.shape[1])
            slopes[use] = w[:-1] / wide[use]
            return slopes, float(w[-1] - slopes @ mid)
        use[np.flatnonzero(use)[w[:-1] < 0]] = False  # more of either never makes a text less toxic


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The model from all labelled documents (doc_id, text), (doc_id, toxic) outside fold 0.

    Folds 2 to 4 are counted, fold 1 places the logistic function. Rows without a label, id or text teach nothing; where an
    id has several labels the highest holds.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.filter(fold(F.col("doc_id")) != 0)
    if known.count() <= BROADCAST_LABELS:
        known = F.broadcast(known)
    rows = docs.filter("text IS NOT NULL").join(known, "doc_id").select((F.col("toxic") > 0).cast("int").alias("toxic"), "text", (fold(F.col("doc_id")) > 1).alias("fit"))
    return fit(rows)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus score and predicted.

    Defined cases: a null or empty text, or one without letters, has the score of a text whose words speak for neither side;
    repeated rows are scored row by row; an empty table gives an empty table; input columns named like the added ones are replaced.
    """
    rest = replace_columns(docs, "score", "predicted")
    names, at = rest.columns, column(rest, text_col)
    plain = rest.toDF(*[f"c{i}" if i != at else "text" for i in range(len(names))])
    total = F.lit(float(model.intercept))
    for c, slope in zip(FEATURES, model.slopes):
        total = total + F.col(c) * float(slope)
    value = 1 / (1 + F.exp(-total))
    out = model.features(plain).withColumn("score", value).withColumn("predicted", (F.col("score") >= 0.5).cast("int")).drop(*FEATURES)
    return out.toDF(*names, "score", "predicted")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document: doc_id, held_out boolean, score double, predicted int. Only labels outside fold 0 are learned from.

    Defined cases: as for ``train`` and ``score``; a document without an id isn't held out, as no label can name it.
    """
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    labels = pick(table(spark, sf_dir, "labels"), doc_id="doc_id", toxic="toxic")
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
