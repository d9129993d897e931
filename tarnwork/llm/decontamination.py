"""Benchmark decontamination by spaced seeds.

A document is contaminated by a benchmark item if the two have ``WINDOW`` words in a row of which at most ``MISSES`` differ, place by place.
The masks are all ways to look at half of the window's four blocks: two misses spoil two blocks at most, so of each such pair of windows
one mask at least sees only equal words, and their hashes meet. Hits are verified word by word. Items shorter than a window are sought whole:
from 6 words on with one word different (a mask for either half), below that unchanged.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..written import in_blocks
from .common import column, pick, prepare, stash, table, tidy

WINDOW, BLOCKS, MISSES = 12, 4, 2
#: An item of so many words at least, but shorter than a window, may have one word different.
ONE_MISS = 6
#: Items with fewer words are not sought. With 1, every item is; a larger number leaves items out that chance alone repeats.
SHORTEST = 1
#: Words of benchmark items that the tasks get at once; a larger benchmark takes several passes over the documents.
BENCHMARK_WORDS = 1_000_000
FILTER_BITS = 22

_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if chr(c).isalnum() or c > 0x7F else 0x20 for c in range(256))
#: Characters of scripts that are written without spaces: each counts as a word.
_UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")


def words_of(text: str | None) -> list[bytes]:
    """Words in lower case; white space and ASCII punctuation part them, and scripts without spaces are read character by character."""
    text = (text or "").lower()
    if not text.isascii() and _UNSPACED.search(text):
        text = _UNSPACED.sub(r" \1 ", text)
    return text.encode().translate(_FOLD).split()


def masks(size: int = WINDOW) -> tuple[list[np.ndarray], int]:
    """(the places that each mask looks at, how many words may differ) for windows of so many words."""
    if size < WINDOW:
        half = size // 2
        return ([np.arange(half), np.arange(half, size)], 1) if size >= ONE_MISS else ([np.arange(size)], 0)
    block = WINDOW // BLOCKS
    return [np.array([b * block + i for b in seen for i in range(block)]) for seen in combinations(range(BLOCKS), BLOCKS - MISSES)], MISSES


def _mix(codes: np.ndarray, starts: np.ndarray, mask: np.ndarray, salt: int) -> np.ndarray:
    h = np.full(len(starts), np.uint64((salt + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    for at in mask:
        h = (h ^ codes[starts + at].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
    return h


class Family:
    """The seeds of windows of one size: hashes by mask, where the window stands, and whose it is."""

    def __init__(self, size: int, codes: np.ndarray, starts: np.ndarray, owners: np.ndarray):
        self.size, (self.masks, self.misses) = size, masks(size)
        keys = np.concatenate([_mix(codes, starts, mask, salt) for salt, mask in enumerate(self.masks)])
        order = np.argsort(keys, kind="stable")
        self.keys, self.spots, self.owners = keys[order], np.tile(starts, len(self.masks))[order], np.tile(owners, len(self.masks))[order]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.keys >> np.uint64(64 - FILTER_BITS)] = True

    def pairs(self, codes: np.ndarray, known: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Verified (place in the document, place in the items, item), one row for each pair of windows."""
        none = np.zeros((0, 3), np.int64)
        if len(codes) < self.size:
            return none
        likely = np.flatnonzero(known[self.size :] - known[: -self.size] >= self.size - self.misses)
        if not len(likely):
            return none
        found = []
        for salt, mask in enumerate(self.masks):
            h = _mix(codes, likely, mask, salt)
            near = self.filter[h >> np.uint64(64 - FILTER_BITS)]
            h, at = h[near], likely[near]
            low, high = np.searchsorted(self.keys, h), np.searchsorted(self.keys, h, side="right")
            n = high - low
            which = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
            found.append(np.stack([np.repeat(at, n), self.spots[which], self.owners[which]], 1))
        pairs = np.unique(np.concatenate(found), axis=0)
        span = np.arange(self.size)
        same = (codes[pairs[:, :1] + span] == own[pairs[:, 1:2] + span]).sum(1)
        return pairs[same >= self.size - self.misses]


class Index:
    """Seeds of some benchmark items. Items: (id, words)."""

    def __init__(self, items: list[tuple[int, list[bytes]]], shortest: int = SHORTEST):
        self.ids = [i for i, _ in items]
        self.vocab: dict[bytes, int] = {}
        for _, words in items:
            for w in words:
                self.vocab.setdefault(w, len(self.vocab) + 1)
        sizes = np.array([len(w) for _, w in items], np.int64)
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.codes = np.fromiter((self.vocab[w] for _, ws in items for w in ws), np.int32, int(self.first[-1]))
        self.families = []
        for size in sorted({min(int(n), WINDOW) for n in sizes if n >= max(shortest, 1)}):
            mine = np.flatnonzero(sizes >= WINDOW) if size == WINDOW else np.flatnonzero(sizes == size)
            n = sizes[mine] - size + 1
            starts = np.repeat(self.first[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            self.families.append(Family(size, self.codes, starts, np.repeat(mine, n)))

    def search(self, words: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        """(item, first word, end, words of the item covered, words of the item) for each item found among a document's words."""
        codes = np.fromiter(map(self.vocab.get, words, repeat(0)), np.int32, len(words))
        known = np.concatenate([[0], np.cumsum(codes > 0)])
        out = []
        for family in self.families:
            pairs = family.pairs(codes, known, self.codes)
            for k in np.unique(pairs[:, 2]).tolist():
                mine = pairs[pairs[:, 2] == k]
                covered = np.zeros(self.first[k + 1] - self.first[k], bool)
                for q in np.unique(mine[:, 1] - self.first[k]):
                    covered[q : q + family.size] = True
                out.append((self.ids[k], int(mine[:, 0].min()), int(mine[:, 0].max()) + family.size, int(covered.sum()), len(covered)))
        return out


#: The seeds that this worker has built last, by the broadcast that they came with.
_built: dict[str, Index] = {}


def _index(sent: tuple[str, int, list]) -> Index:
    key, shortest, items = sent
    if key not in _built:
        _built.clear()
        _built[key] = Index(items, shortest)
    return _built[key]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Distinct items in blocks of bounded size. Of items with equal text the smallest id stands for all."""
    items = pick(benchmark, id=id_col, text=text_col).filter("text IS NOT NULL").groupBy("text").agg(F.min("id").alias("id"))
    block, held = [], 0
    for row in items.select("id", "text").toLocalIterator():
        words = words_of(row.text)
        block.append((row.id, words))
        held += len(words)
        if held >= most:
            yield block
            block, held = [], 0
    if block:
        yield block


def _sent(benchmark: DataFrame, id_col: str, text_col: str, most: int, shortest: int) -> Iterator[tuple[str, int, list]]:
    return ((uuid.uuid4().hex, shortest, items) for items in _blocks(benchmark, id_col, text_col, most))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_words: int = BENCHMARK_WORDS, shortest: int = SHORTEST) -> DataFrame:
    """One row for each document and benchmark item found in it: doc_id, item_id, first_word, end_word, covered_words, item_words.

    first_word and end_word bound all matching windows among the document's words. A benchmark over ``block_words`` is sought block by block.
    Defined cases: null or empty texts and items never match; repeated documents give repeated rows; of equal items the one with the
    smallest id is named; a document of any length is searched whole; an empty table gives none.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark, plain = docs.sparkSession, pick(docs, doc_id=id_col, text=text_col)
    prepare(spark)
    kinds = dict(plain.dtypes)["doc_id"], dict(pick(benchmark, id=item_col).dtypes)["id"]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, first_word long, end_word long, covered_words int, item_words int"
    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def searched(sent) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _index(sent.value)
            for b in batches:
                rows = [(doc, *hit) for doc, x in zip(b.column(0).to_pylist(), b.column(1), strict=True) if x.is_valid for hit in index.search(words_of(x.as_py()))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
            tidy()

        return plain.mapInArrow(run, schema)

    return in_blocks(spark, _sent(benchmark, item_col, item_text, block_words, shortest), searched, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_words: int = BENCHMARK_WORDS, shortest: int = SHORTEST) -> DataFrame:
    """The rows of ``docs``, all columns, in whose text no benchmark item is found.

    The search itself says which rows go, in one pass over the texts and without a join: a task holds one document and the seeds. With a
    benchmark over ``block_words`` what a block leaves is written before the next one is sought. Defined cases: rows with a null or
    empty text stay; of repeated rows all stay or all go; an empty table, or an empty benchmark, takes nothing away.
    """
    names, at = docs.columns, column(docs, text_col)
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    spark = docs.sparkSession
    prepare(spark)
    blocks = _sent(benchmark, item_col, item_text, block_words, shortest)
    block = next(blocks, None)
    while block is not None:
        after = next(blocks, None)
        plain = plain.mapInArrow(_cleaner(spark.sparkContext.broadcast(block), at), plain.schema)
        plain = plain if after is None else stash(plain, "clean")
        block = after
    return plain.toDF(*names)


def _cleaner(sent, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(sent.value)
        for b in batches:
            clean = [not (x.is_valid and index.search(words_of(x.as_py()))) for x in b.column(at)]
            yield b.filter(pa.array(clean, pa.bool_()))
        tidy()

    return run


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item found in it: doc_id, item_id, first_word long, end_word long, covered_words int, item_words int. Defined cases: as for ``find_leaks``."""
    return stash(find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")), "leaks")
