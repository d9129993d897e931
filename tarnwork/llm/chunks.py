"""Texts in chunks of a few megabytes, and the anchors of the windows in them.

What the substring operators share. Symbols are bytes or words; a window is ``WINDOW`` of them in a row. Every window has an anchor: of the
runs of ``k`` symbols in it the one whose hash is least. Equal windows have equal anchors, and neighbouring windows mostly share theirs, so
a chunk has one *stretch* (anchor, windows in a row) for many windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, stash, tidy

WINDOW = 50
CHUNK_BYTES = 3_000_000
NO_ID = (1 << 63) - 1
#: Two odd numbers whose powers weight the bytes of a hashed range.
WEIGHTS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_INDEX_BITS = 28
_EMPTY = hashlib.sha256(b"").hexdigest()


def fold_equal(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """rows (id, h1, h2) of all documents, and (id, h1, h2, text) of one row for each text: the one with the smallest id.

    A null text counts as empty; a null id as larger than any other. Texts meet by 128 bits of hash, and texts of one group of
    copies never meet in one task: the join that picks the rows goes by id too.
    """
    plain = pick(docs, id=id_col, text=text_col)
    text = F.coalesce("text", F.lit(""))
    keyed = plain.select(F.coalesce(F.col("id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit(1)).alias("h2"), text.alias("text"))
    rows = stash(keyed.select("id", "h1", "h2"), "rows")
    first = rows.groupBy("h1", "h2").agg(F.min("id").alias("id"))
    return rows, keyed.join(first.hint("merge"), ["h1", "h2", "id"])


_FIELDS = "batch int, ids binary, h1 binary, h2 binary, sizes binary, raw long, data binary"
CHUNK_SQL = "chunk long, ids binary, h1 binary, h2 binary, sizes binary, raw long, data binary"
CHUNK = [c.split()[0] for c in CHUNK_SQL.split(", ")]


def chunked(texts: DataFrame, kind: type, bounds: list[int], first: int = 0, path: str | None = None) -> DataFrame:
    """Texts in chunks, written by batch: (batch, chunk, ids, h1, h2, sizes, raw, data). Inside a chunk the smallest id comes first.

    batch says between which of the id ``bounds`` the ids lie, counted from ``first``; no two chunks of an index have the same number.
    """
    most = CHUNK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        edges = np.array(bounds, np.int64)
        last = None
        for b in batches:
            at = {n: i for i, n in enumerate(b.schema.names)}
            ids, h1, h2 = (b.column(at[n]).to_numpy(zero_copy_only=False) for n in ("id", "h1", "h2"))
            for i, x in enumerate(b.column(at["text"])):
                key = (h1[i], h2[i], ids[i])
                if key == last:  # a repeated row
                    continue
                last = key
                batch = first + int(np.searchsorted(edges, ids[i], side="right"))
                mine = held.setdefault(batch, [[], [], [], [], 0])
                data = kind.join(x.as_py().encode())
                for store, v in zip(mine, (ids[i], h1[i], h2[i], data), strict=False):
                    store.append(v)
                mine[4] += len(data)
                if mine[4] >= most:
                    yield close(batch, held.pop(batch))
        for batch, mine in held.items():
            yield close(batch, mine)
        tidy()

    def close(batch: int, mine: list) -> pa.RecordBatch:
        order = np.argsort(np.array(mine[0], np.int64), kind="stable").tolist()
        ids, h1, h2, texts_ = ([m[i] for i in order] for m in mine[:4])
        raw = b"".join(texts_)
        cols = [batch, *(np.array(x, np.int64).tobytes() for x in (ids, h1, h2)), np.fromiter(map(len, texts_), np.int64).tobytes(), len(raw), pa.compress(raw, "zstd", asbytes=True)]
        kinds = [pa.int32(), *[pa.binary()] * 4, pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in _FIELDS.split(", ")])

    made = texts.sortWithinPartitions("h1", "h2", "id").mapInArrow(run, _FIELDS)
    place = F.monotonically_increasing_id()
    number = F.shiftleft(F.col("batch").cast("long"), 40) + F.shiftleft(F.shiftright(place, 33), 20) + place.bitwiseAND(0xFFFFF)
    return stash(made.withColumn("chunk", number), "chunks", "batch", path=path)


class Bytes:
    """Symbols are bytes."""

    k = 20

    @staticmethod
    def join(doc: bytes) -> bytes:
        return doc

    @staticmethod
    def symbols(docs: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None, np.ndarray]:
        return np.frombuffer(b"".join(docs), np.uint8), None, None, np.concatenate([[0], np.cumsum(sizes)])

    @staticmethod
    def kept(doc: bytes, removed: np.ndarray) -> bytes:
        return np.frombuffer(doc, np.uint8)[~removed].tobytes()


class Words:
    """Symbols are words, runs of bytes that aren't ASCII white space; a document is its words joined by one space."""

    k = 8

    @staticmethod
    def join(doc: bytes) -> bytes:
        return b" ".join(doc.split())

    @staticmethod
    def symbols(docs: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None, np.ndarray]:
        text = np.frombuffer(b"\n".join([*docs, b""]), np.uint8)
        word = (text != 0x20) & (text != 0x0A)
        edge = np.diff(word.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        at = np.concatenate([[0], np.cumsum(sizes + 1)])
        return text, start, end, np.searchsorted(start, at)

    @staticmethod
    def kept(doc: bytes, removed: np.ndarray) -> bytes:
        return b" ".join(w for w, r in zip(doc.split(), removed.tolist(), strict=True) if not r)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads a hash over all its bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(m: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(m))
    out[:1] = 1
    return np.multiply.accumulate(out)


def weighted(text: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums from which the hash of any range of bytes follows, and what divides the weight of its first place out."""
    each = (text.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    each ^= each >> np.uint64(31)
    each *= _powers(m, len(each))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each, dtype=np.uint64)])
    return sums, _powers(pow(m, -1, 1 << 64), len(sums))


class Chunk:
    """text: the bytes; first: number of each document's first symbol, and of all; start, end: where each symbol's bytes are."""

    def __init__(self, kind: type, row: dict):
        self.kind, self.number, self.ids = kind, row["chunk"], np.frombuffer(row["ids"], np.int64)
        self.h1, self.h2 = (np.frombuffer(row[c], np.int64) for c in ("h1", "h2"))
        text = pa.decompress(row["data"], row["raw"], "zstd", asbytes=True) if row["raw"] else b""
        sizes = np.frombuffer(row["sizes"], np.int64)
        ends = np.cumsum(sizes).tolist()
        self.docs = [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        self.text, self.start, self.end, self.first = kind.symbols(self.docs, sizes)
        self._sums: tuple[int, np.ndarray, np.ndarray] | None = None

    def __len__(self) -> int:
        return int(self.first[-1])

    def bounds(self, at: np.ndarray, count: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """Where the bytes of ``count`` symbols from ``at`` on begin and end."""
        return (at, at + count) if self.start is None else (self.start[at], self.end[at + count - 1])

    def hashes(self, at: np.ndarray, count: np.ndarray | int, weight: int = WEIGHTS[0]) -> np.ndarray:
        """Hash of ``count`` symbols from each of the places ``at``."""
        if self._sums is None or self._sums[0] != weight:
            self._sums = None
            self._sums = weight, *weighted(self.text, weight)
        _, sums, inverse = self._sums
        a, b = self.bounds(at, count)
        return mixed((sums[b] - sums[a]) * inverse[a])

    def doc_of(self, symbol: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, symbol, side="right") - 1

    def stretches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash of the anchor, first window, number of windows, document) of each stretch."""
        n, k = len(self), self.kind.k
        none = np.zeros(0, np.int64)
        sizes = np.diff(self.first)
        first = self.first[:-1][sizes >= WINDOW]  # a document's first window begins a stretch
        if not len(first):
            return none.astype(np.uint64), none, none, none
        begins, hashed, before = [], [], -1
        step = 1 << 18
        for at in range(0, n - WINDOW + 1, step):
            h = self.hashes(np.arange(at, min(at + step + WINDOW - k, n - k + 1)), k)
            spot = _least(h, WINDOW - k + 1)
            new = np.ones(len(spot), bool)
            new[1:] = spot[1:] != spot[:-1]
            new[0] = spot[0] + at != before
            new[first[np.searchsorted(first, at) : np.searchsorted(first, at + len(spot))] - at] = True
            before = spot[-1] + at
            begin = np.flatnonzero(new)
            begins.append(begin + at)
            hashed.append(h[spot[begin]])
        begin, hash_ = np.concatenate(begins), np.concatenate(hashed)
        doc = self.doc_of(begin)
        valid = begin <= self.first[doc + 1] - WINDOW
        begin, hash_, doc = begin[valid], hash_[valid], doc[valid]
        # A stretch ends where the next one begins or where its document's last window is.
        stop = np.minimum(np.append(begin[1:], n), self.first[doc + 1] - WINDOW + 1)
        return hash_, begin, stop - begin, doc


def _least(h: np.ndarray, wide: int) -> np.ndarray:
    """Place of the hash that comes first of each ``wide`` in a row. They are compared by a multiple, so that chosen hashes are spread like any others."""
    key = ((h * np.uint64(0x94D049BB133111EB)) >> np.uint64(_INDEX_BITS) << np.uint64(_INDEX_BITS)) | np.arange(len(h), dtype=np.uint64)
    have = 1
    while have * 2 <= wide:
        key = np.minimum(key[:-have], key[have:])
        have *= 2
    if have < wide:
        key = np.minimum(key[: len(key) - (wide - have)], key[wide - have :])
    return (key & np.uint64((1 << _INDEX_BITS) - 1)).astype(np.int64)


def isin_sorted(a: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``a`` are in the sorted array ``known``."""
    if not len(known):
        return np.zeros(len(a), bool)
    return known[np.minimum(np.searchsorted(known, a), len(known) - 1)] == a


# ---------------------------------------------------------------- chunks and what was found out about them


def each_chunk(chunks: DataFrame, kind: type, work: Callable[[Chunk], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``work`` on each chunk, where it lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield from work(Chunk(kind, {c: b.column(j)[i].as_py() for j, c in enumerate(CHUNK)}))
        tidy()

    return chunks.select(*CHUNK).mapInArrow(run, schema)


#: A note for a chunk: what it is about, and arrays whose meaning ``what`` tells.
NOTE = "what int, chunk long, n long, a binary, b binary, c binary, d binary, e binary, f binary"
_NOTE = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 6]
_NOTE_NAMES = [c.split()[0] for c in NOTE.split(", ")]


def notes(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (what, chunk, n, up to six binaries)."""
    cols = list(zip(*(r + (None,) * (9 - len(r)) for r in rows), strict=True)) if rows else [[] for _ in _NOTE]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _NOTE, strict=True)], names=_NOTE_NAMES)


def beside(chunks: DataFrame, noted: DataFrame, kind: type, work: Callable[[Chunk, Iterator[dict]], Iterator[pa.RecordBatch]], schema: str, all_chunks: bool = False) -> DataFrame:
    """``work(chunk, its notes)`` for each chunk that has notes (or for all).

    Both go to the chunk's task in one exchange and come out chunk first, so notes stream by and a chunk is there once. Where both have a
    column ``copy``, a chunk may be there several times, each copy with notes of its own.
    """
    said = _NOTE_NAMES[2:]
    copy = lambda df: F.col("copy") if "copy" in df.columns else F.lit(0).alias("copy")
    none = lambda names, kinds: [F.lit(None).cast(k).alias(c) for c, k in zip(names, kinds, strict=True)]
    left = chunks.select(F.lit(-1).alias("what"), copy(chunks), *CHUNK, *none(said, ["long", *["binary"] * 6]))
    right = noted.select("what", copy(noted), "chunk", *none(CHUNK[1:], [*["binary"] * 4, "long", "binary"]), *said)
    both = left.unionByName(right).repartition("chunk", "copy").sortWithinPartitions("chunk", "copy", "what")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (dict(zip(b.schema.names, (x[i].as_py() for x in b.columns), strict=True)) for b in batches for i in range(b.num_rows))
        row = next(rows, None)
        while row is not None:
            here, after = row, []

            def mine(here=here, after=after) -> Iterator[dict]:
                for r in rows:
                    if (r["chunk"], r["copy"]) != (here["chunk"], here["copy"]):
                        after.append(r)
                        return
                    yield r

            told = mine()
            if here["what"] == -1:
                first = next(told, None)
                if first is not None or all_chunks:
                    yield from work(Chunk(kind, here), _chain(first, told))
            for _ in told:
                pass
            row = after[0] if after else None
        tidy()

    return both.mapInArrow(run, schema)


def _chain(first: dict | None, rest: Iterator[dict]) -> Iterator[dict]:
    if first is not None:
        yield first
        yield from rest


# ---------------------------------------------------------------- results

DONE = "h1 long, h2 long, first_id long, n_units long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def without(chunk: Chunk, gone: np.ndarray, with_text: bool) -> pa.RecordBatch:
    """The result of each of the chunk's documents when the symbols of the windows ``gone`` are removed."""
    cover = np.zeros(len(chunk) + 1, np.int64)
    if len(gone):
        np.add.at(cover, gone, 1)
        np.add.at(cover, gone + WINDOW, -1)
    removed = np.cumsum(cover[:-1]) > 0
    touched = np.add.reduceat(removed, np.minimum(chunk.first[:-1], max(len(removed) - 1, 0))) if len(removed) else np.zeros(len(chunk.docs), np.int64)
    rows = []
    for i, doc in enumerate(chunk.docs):
        a, b = int(chunk.first[i]), int(chunk.first[i + 1])
        n = int(removed[a:b].sum()) if b > a and touched[i] else 0
        mine = removed[a:b]
        kept = chunk.kind.kept(doc, mine) if n else doc
        runs = int(mine[0]) + int((mine[1:] & ~mine[:-1]).sum()) if n else 0
        rows.append((int(chunk.h1[i]), int(chunk.h2[i]), int(chunk.ids[i]), b - a, n, runs, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
    kinds = [*[pa.int64()] * 6, pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in DONE.split(", ")])


def per_row(rows: DataFrame, done: DataFrame) -> DataFrame:
    """The result of every row: a later copy of a text is all gone, if it has a window at all."""
    later = (F.col("id") != F.col("first_id")) & (F.col("n_units") >= WINDOW)
    once = stash(done.dropDuplicates(["h1", "h2"]), "once")  # a repeated row may have come to two chunks
    joined = rows.join(once, ["h1", "h2"])
    return joined.select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"),
        "n_units",
        F.when(later, F.col("n_units")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(later, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(later, F.lit(_EMPTY)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        F.when(later, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
    )
