"""Removing repeated byte strings by threshold-bounded interval expansion on a Burrows-Wheeler transform.

The strings that can repeat at all are brought together by their anchors (see ``chunks``), in groups of bounded size. Over those of a span of
anchors a Burrows-Wheeler transform is built; from the intervals that sorting by the first 28 bytes gives (or from the empty string's), breadth
first, each interval is extended by one byte to the left. At depth d the intervals are the strings of d bytes that occur at least twice, and
where one begins for the first time, two neighbouring suffixes have exactly d - 1 bytes in common: common prefixes come out by increasing
value. Expansion stops at the minimum length; neighbours without a value by then have at least that many bytes in common.

1. Equal texts are folded; texts are dealt into chunks.
2. A chunk sends each of its anchors once. Anchors in two documents at least are hot.
3. A hot anchor of which more than ``WIDE`` contents would be sent is too much for one task (a sentence that is in every document, with
   other words around it). Its windows are looked at one by one: those in two documents at least go on, each under its own hash.
4. The contents of hot stretches, and those windows, meet span by span; the transform tells which strings are equal.
5. Each chunk learns the smallest id of each of its windows and removes what an earlier document has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import DONE, NOTE, WEIGHTS, WINDOW, Bytes, Chunk, beside, chunked, each_chunk, fold_equal, isin_sorted, mixed, notes, per_row, weighted, without
from .common import stash, table, unstash
from .spans import Columns, Layout, by_chunk, by_span, first_cut, groups, pack, pack_sorted, ranges, spans_for, unpack, unpack_sorted

#: Contents of one anchor that may meet in one task; with more, its windows go on one by one.
WIDE = 30_000
#: Bytes of contents in a span, and for one transform (a group that shares an anchor is never parted; it has WIDE contents at most).
SPAN_BYTES, TOGETHER = 4_000_000, 2_000_000


def suffix_order(symbols: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(order, rank, known): suffixes in the order of their first ``depth`` symbols or more, equal ones as they stand; and each suffix's rank by its first ``known`` symbols.

    Each is compared up to its own end only (``left`` symbols away). Prefixes double: 7, 14, 28 symbols and so on; ``known`` is the last
    length under ``depth``. Suffixes that agree in ``depth`` symbols have the same intervals up to that depth, so their order makes no difference.
    """
    n = len(symbols)
    key = np.zeros(n, np.int64)
    for t in range(7):
        key <<= 9
        there = symbols[t:].astype(np.int64)
        key[: n - t] |= np.where(t < left[: n - t], there, 0)
    have, known, rank = 7, 0, np.zeros(n, np.int64)
    while True:
        if have >= depth or have >= left.max(initial=0):
            return np.argsort(key, kind="stable"), rank, known
        known, rank = have, _dense(key)
        after = np.zeros(n, np.int64)
        after[: n - have] = np.where(have < left[: n - have], rank[have:] + 1, 0)
        key = rank * (n + 1) + after
        have *= 2


def _dense(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    new = np.ones(len(key), np.int64)
    new[:1] = 0
    new[1:] = key[order][1:] != key[order][:-1]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def common_prefixes(bwt: np.ndarray, first: np.ndarray, depth: int, rank: np.ndarray | None = None, known: int = 0, long: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(lcp, repeated): common prefix of each suffix with the one before it, -1 where it is at least ``depth``; and the places of suffixes whose first ``depth`` symbols occur again.

    bwt: symbol before each suffix (0: none). first: its first symbol. rank: if given, ranks of the suffixes by their first ``known`` symbols, from which
    the expansion starts, for those that are so ``long``, instead of the empty string; common prefixes under ``known`` then all show as ``known - 1``.
    """
    n = len(bwt)
    back = np.empty(n, np.int32)
    back[np.argsort(bwt, kind="stable")] = np.arange(n, dtype=np.int32)
    lcp = np.full(n, -1, np.int16)
    interval = np.zeros(n, np.int32)
    here = np.arange(n, dtype=np.int32)
    if known:
        new = np.ones(n, bool)
        new[1:] = rank[1:] != rank[:-1]
        lcp[new] = known - 1
        interval = np.cumsum(new, dtype=np.int32) - 1
        here = here[(np.bincount(interval)[interval] > 1) & long]
    from_ = np.empty(n, np.int32)
    for d in range(known + 1, depth + 1):
        here = here[bwt[here] > 0]
        there = back[here]
        from_.fill(-1)
        from_[there] = interval[here]
        there = np.flatnonzero(from_ >= 0)
        if not len(there):
            return lcp, there
        source, symbol = from_[there], first[there]
        new = np.ones(len(there), bool)
        new[1:] = (there[1:] != there[:-1] + 1) | (source[1:] != source[:-1]) | (symbol[1:] != symbol[:-1])
        begin = there[new]
        begin = begin[lcp[begin] < 0]
        lcp[begin] = d - 1
        number = np.cumsum(new, dtype=np.int32) - 1
        keep = np.bincount(number)[number] > 1
        here = there[keep].astype(np.int32)
        interval[here] = number[keep]
    return lcp, here


def window_ids(symbols: np.ndarray, sizes: np.ndarray, ids: np.ndarray, length: int = WINDOW) -> np.ndarray:
    """For each string of ``length`` bytes in the contents the smallest id of a content that has it."""
    windows = sizes - length + 1
    at = np.cumsum(windows) - windows
    out = np.repeat(ids, windows)
    ends = np.cumsum(sizes + 1) - 1  # each content ends with a 0
    n = int(ends[-1]) + 1 if len(ends) else 0
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    text = np.zeros(n, np.uint16)
    text[np.delete(np.arange(n), ends)] = symbols.astype(np.uint16) + 1
    left = ends[owner] - np.arange(n)
    order, rank, known = suffix_order(text, left, length)
    lcp, again = common_prefixes(text[order - 1], text[order], length, rank[order], known, left[order] >= known)
    if len(again):
        new = lcp[again] >= 0
        spot = order[again]
        low = np.minimum.reduceat(ids[owner[spot]], np.flatnonzero(new))
        within = spot - (ends[owner[spot]] - sizes[owner[spot]])
        out[at[owner[spot]] + within] = low[np.cumsum(new) - 1]
    return out



# ---------------------------------------------------------------- what goes between chunks and spans

ANCHORS = Layout(chunk=np.int64, contents=np.uint32, several=np.uint8)
WINDOWS = Layout(chunk=np.int64, several=np.uint8)
CONTENTS = Layout(lambda c: c["count"].astype(np.int64) + WINDOW - 1, chunk=np.int64, number=np.uint32, least=np.int64, count=np.uint8)
#: Notes for a chunk: its hot anchors, its anchors that are too hot, hot windows of the latter; what it sent, and what came back.
NARROW, TOO_HOT, HOT_WINDOWS, SENT, BACK = range(5)


def _distinct(key: np.ndarray, doc: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, how many different contents each has, whether several documents have it)."""
    if not len(key):
        return key, np.zeros(0, np.int64), np.zeros(0, bool)
    order = np.lexsort((content, key))
    key, doc, content = key[order], doc[order], content[order]
    at, _ = groups(key)
    new = np.ones(len(key), np.int64)
    new[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1])
    return key[at], np.add.reduceat(new, at), np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)


def anchor_entries(chunks: DataFrame, spans: int) -> DataFrame:
    have = first_cut(spans)

    def work(chunk: Chunk) -> Iterator[pa.RecordBatch]:
        h, first, count, doc = chunk.stretches()
        key, n, several = _distinct(h, doc, chunk.hashes(first, count + WINDOW - 1))
        yield ANCHORS.table(ANCHORS.rows({"key": key, "chunk": np.full(len(key), chunk.number), "contents": n.astype(np.uint32), "several": several.astype(np.uint8)}, have))

    return ANCHORS.exchange(each_chunk(chunks, Bytes, work, ANCHORS.schema), spans)


def _told(rows: list[tuple], what: int, chunk: np.ndarray, key: np.ndarray) -> None:
    for number, at in by_chunk(chunk):
        rows.append((what, number, len(at), pack_sorted(key[at])))


def hot_anchors(entries: DataFrame, wide: int) -> DataFrame:
    """Notes: each chunk's anchors that two documents have, apart by whether chunks would send more than ``wide`` contents of them in all."""

    def work(cols: Columns) -> Iterator[pa.RecordBatch]:
        order = np.argsort(cols["key"], kind="stable")
        key, chunk = cols["key"][order], cols["chunk"][order]
        _, number = groups(key)
        hot = (np.bincount(number) > 1) | (np.bincount(number, cols["several"][order]) > 0)
        many = hot & (np.bincount(number, cols["contents"][order]) > wide)
        rows: list[tuple] = []
        for what, chosen in ((NARROW, hot & ~many), (TOO_HOT, many)):
            mine = chosen[number]
            _told(rows, what, chunk[mine], key[mine])
        yield notes(rows)

    return by_span(entries, ANCHORS, work, NOTE)


def _keys(told: Iterator[dict]) -> dict[int, np.ndarray]:
    """The keys of each kind of note, sorted."""
    found: dict[int, list[np.ndarray]] = {}
    for row in told:
        found.setdefault(row["what"], []).append(unpack_sorted(row["a"], row["n"]))
    none = np.zeros(0, np.uint64)
    return {what: np.sort(np.concatenate(found[what])) if what in found else none for what in (NARROW, TOO_HOT, HOT_WINDOWS)}


def hot_windows(chunks: DataFrame, told: DataFrame, spans: int) -> DataFrame:
    """Notes: of each chunk's windows whose anchor is too hot, those that two documents have."""
    have = first_cut(spans)

    def work(chunk: Chunk, noted: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        wanted = _keys(noted)[TOO_HOT]
        h, first, count, _ = chunk.stretches()
        mine = isin_sorted(h, wanted)
        at = ranges(first[mine], count[mine])
        key, _, several = _distinct(own := chunk.hashes(at, WINDOW), chunk.doc_of(at), own)
        yield WINDOWS.table(WINDOWS.rows({"key": key, "chunk": np.full(len(key), chunk.number), "several": several.astype(np.uint8)}, have))

    def hot(cols: Columns) -> Iterator[pa.RecordBatch]:
        order = np.argsort(cols["key"], kind="stable")
        key, chunk = cols["key"][order], cols["chunk"][order]
        _, number = groups(key)
        mine = ((np.bincount(number) > 1) | (np.bincount(number, cols["several"][order]) > 0))[number]
        rows: list[tuple] = []
        _told(rows, HOT_WINDOWS, chunk[mine], key[mine])
        yield notes(rows)

    sent = beside(chunks, told.filter(F.col("what") == TOO_HOT), Bytes, work, WINDOWS.schema)
    return by_span(WINDOWS.exchange(sent, spans), WINDOWS, hot, NOTE)


def contents(chunks: DataFrame, told: DataFrame, spans: int) -> DataFrame:
    """Two kinds of rows. SENT: where the chunk's hot stretches begin, their windows, and the numbers of their contents. -1: distinct contents by
    span (in ``chunk``), with the smallest id in the chunk that has them."""
    have = first_cut(spans)

    def work(chunk: Chunk, noted: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        keys = _keys(noted)
        h, first, count, _ = chunk.stretches()
        mine, many = isin_sorted(h, keys[NARROW]), isin_sorted(h, keys[TOO_HOT])
        at = ranges(first[many], count[many])
        own = chunk.hashes(at, WINDOW) if len(at) else h[:0]
        hot = isin_sorted(own, keys[HOT_WINDOWS])
        key = np.concatenate([h[mine], own[hot]])
        first, count = np.concatenate([first[mine], at[hot]]), np.concatenate([count[mine], np.ones(int(hot.sum()), np.int64)])
        if not len(key):
            return
        size, ids = count + WINDOW - 1, chunk.ids[chunk.doc_of(first)]
        marks = [chunk.hashes(first, size, w) for w in WEIGHTS]
        order = np.lexsort((ids, count, marks[1], marks[0], key))
        new = np.zeros(len(order), bool)
        for a in (marks[0], marks[1], count, key):
            new[1:] |= a[order][1:] != a[order][:-1]
        new[0] = True
        number = np.empty(len(order), np.uint32)
        number[order] = np.cumsum(new) - 1
        yield notes([(SENT, chunk.number, len(key), pack(number), pack(first.astype(np.uint32)), pack(count.astype(np.uint8)))])
        lead = order[new]  # by key; of equal contents the one with the smallest id
        cols = {"key": key[lead], "chunk": np.full(len(lead), chunk.number), "number": number[lead], "least": ids[lead], "count": count[lead].astype(np.uint8)}
        cols["body"] = chunk.text[ranges(first[lead], size[lead])]
        yield notes([(-1, *row) for row in CONTENTS.rows(cols, have)])

    return stash(beside(chunks, told, Bytes, work, NOTE), "contents", "what")


def settle(sent: DataFrame, spans: int) -> DataFrame:
    """Notes: for each content that a chunk sent, the smallest id of each of its windows."""

    def work(cols: Columns) -> Iterator[pa.RecordBatch]:
        count = cols["count"].astype(np.int64)
        size = count + WINDOW - 1
        start = np.cumsum(size) - size
        marks = [_marks(cols["body"], start, size, w) for w in WEIGHTS]
        order = np.lexsort((cols["least"], count, marks[1], marks[0], cols["key"]))
        new = np.zeros(len(order), bool)
        for a in (marks[0], marks[1], count, cols["key"]):
            new[1:] |= a[order][1:] != a[order][:-1]
        new[:1] = True
        content = np.empty(len(order), np.int64)
        content[order] = np.cumsum(new) - 1
        lead = order[new]  # one entry for each content, with its smallest id
        _, group = groups(cols["key"][lead])
        shared = np.flatnonzero(np.bincount(group)[group] > 1)  # where an anchor has one content, all windows have its id
        windows = count[lead]
        at = np.cumsum(windows) - windows
        out = np.repeat(cols["least"][lead], windows)
        for part in _parts(group[shared], size[lead[shared]]):
            which = lead[shared[part]]
            body = cols["body"][ranges(start[which], size[which])]
            out[ranges(at[shared[part]], windows[shared[part]])] = window_ids(body, size[which], cols["least"][which])
        rows = []
        for chunk, mine in by_chunk(cols["chunk"]):
            n = windows[content[mine]]
            rows.append((BACK, chunk, len(mine), pack(cols["number"][mine]), pack(n.astype(np.uint8)), pack(out[ranges(at[content[mine]], n)])))
        yield notes(rows)

    names = dict(zip(("chunk", "n", "a", "b", "c", "d", "e", "f"), CONTENTS.names, strict=True))
    rows = sent.filter("what = -1").select(*(F.col(old).alias(new) for old, new in names.items()))
    back = stash(by_span(CONTENTS.exchange(rows, spans), CONTENTS, work, NOTE), "settled")
    unstash(sent, part="what=-1")
    return back


def _marks(body: np.ndarray, start: np.ndarray, size: np.ndarray, weight: int) -> np.ndarray:
    sums, inverse = weighted(body, weight)
    return mixed((sums[start + size] - sums[start]) * inverse[start])


def _parts(group: np.ndarray, size: np.ndarray) -> Iterator[slice]:
    """Whole groups, as many at a time as have ``TOGETHER`` bytes in all; at least one."""
    if not len(group):
        return
    ends = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, len(group))
    total, begin, held = np.cumsum(size), 0, 0
    for here, after in zip(ends, [*ends[1:], None], strict=True):
        if after is None or total[after - 1] - held > TOGETHER:
            yield slice(begin, int(here))
            begin, held = int(here), int(total[here - 1])


def remove(chunks: DataFrame, noted: DataFrame, with_text: bool) -> DataFrame:
    """The results of the chunks' documents (see ``chunks.without``)."""

    def work(chunk: Chunk, told: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        gone, back = np.zeros(0, np.int64), []
        number = first = count = gone
        for row in told:
            n = row["n"]
            if row["what"] == SENT:
                number, first, count = unpack(row["a"], n, np.uint32).astype(np.int64), unpack(row["b"], n, np.uint32).astype(np.int64), unpack(row["c"], n, np.uint8).astype(np.int64)
            else:
                each = unpack(row["b"], n, np.uint8).astype(np.int64)
                back.append((unpack(row["a"], n, np.uint32), each, unpack(row["c"], int(each.sum()), np.int64)))
        if len(number):
            total = np.zeros(int(number.max()) + 1, np.int64)
            for n, each, _ in back:
                total[n] = each
            at = np.cumsum(total) - total
            least = np.empty(int(total.sum()), np.int64)
            for n, each, ids in back:
                least[ranges(at[n], each)] = ids
            window = ranges(first, count)
            gone = window[least[ranges(at[number], count)] < chunk.ids[chunk.doc_of(window)]]
        yield without(chunk, gone, with_text)

    return stash(beside(chunks, noted, Bytes, work, DONE, all_chunks=True), "removed")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_units (bytes), n_removed, n_spans, kept_sha256, kept (the remaining bytes, if asked for).

    A byte goes if a string of 50 bytes that covers it also begins in a row with a smaller id. Defined cases: a null text is empty; a null id
    is larger than any other; rows with the same id don't remove from each other, unless another row has the string too; an empty table gives
    an empty table; other columns are left out.
    """
    rows, texts = fold_equal(docs, id_col, text_col)
    chunks = chunked(texts, Bytes, [])
    raw = chunks.agg(F.sum("raw")).first()[0] or 0
    spans = spans_for(raw // 15)
    told = stash(hot_anchors(anchor_entries(chunks, spans), WIDE), "hot", "what")
    n = {r.what: r.n for r in told.groupBy("what").agg(F.sum("n").alias("n")).collect()}
    if n.get(TOO_HOT):
        more = stash(hot_windows(chunks, told, spans_for(8 * n[TOO_HOT])), "hot-windows")
        n[HOT_WINDOWS] = more.agg(F.sum("n")).first()[0] or 0
        told = told.select(*more.columns).unionByName(more)
    spans = spans_for(70 * n.get(NARROW, 0) + WINDOW * n.get(HOT_WINDOWS, 0), SPAN_BYTES)
    sent = contents(chunks, told, spans)
    back = settle(sent, spans)
    done = remove(chunks, sent.filter(F.col("what") == SENT).select(*back.columns).unionByName(back), with_text)
    return per_row(rows, done)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its bytes removed that a 50-byte string covers which also starts in a document with a smaller doc_id.

    doc_id, n_bytes long, n_removed long, n_spans long, kept_sha256 string. Defined cases: as for ``remove_repeats``.
    """
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")
