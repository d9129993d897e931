"""Hashed entries on their way to the tasks that own a span of the hashes.

Entries travel as rows that hold many of them: arrays sorted by a 64-bit ``key`` and packed by byte planes. The hashes are spread evenly,
so ``spans`` equal parts of them have about equal shares of the entries, and a task gets a span whole. A row is cut at the borders of at
most ``FAN`` spans at a time; where more are needed, tasks gather what they got and cut it again. So the number of rows follows the
number of entries, not the product of senders and receivers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import tidy

#: Entries that a span should have; parts that a row is cut into at once; entries that a task gathers before it cuts them.
TARGET, FAN, HELD = 1_000_000, 1024, 2_000_000

Columns = dict[str, np.ndarray]


def pack(a: np.ndarray) -> bytes:
    """An array's bytes by planes (all first bytes, all second bytes, ...), which compress far better than numbers one after the other."""
    return pa.compress(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes(), "zstd", asbytes=True) if len(a) else b""


def unpack(b: bytes, n: int, dtype) -> np.ndarray:
    if not n:
        return np.zeros(0, dtype)
    width = np.dtype(dtype).itemsize
    raw = np.frombuffer(pa.decompress(b, n * width, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, n).T).view(dtype).ravel()


def pack_sorted(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=a.dtype.type(0)))


def unpack_sorted(b: bytes, n: int, dtype=np.uint64) -> np.ndarray:
    return np.cumsum(unpack(b, n, dtype), dtype=dtype)


def spans_for(entries: int, target: int = 0) -> int:
    """Spans, a power of two, for so many entries."""
    return 1 << max(0, (-(-entries // (target or TARGET)) - 1)).bit_length()


def span_of(key: np.ndarray, spans: int) -> np.ndarray:
    return (key >> np.uint64(65 - spans.bit_length())).astype(np.int64) if spans > 1 else np.zeros(len(key), np.int64)


def joined(parts: list[Columns]) -> Columns:
    return {n: np.concatenate([p[n] for p in parts]) for n in parts[0]} if len(parts) > 1 else parts[0]


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of ranges, one range after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def first_cut(spans: int) -> int:
    """Spans that a sender cuts its entries for."""
    return min(spans, FAN)


class Layout:
    """Names and types of the arrays that a row holds beside the key.

    lengths: if given, there is also a ``body``, of which each entry has as many bytes as this function of the columns says.
    """

    def __init__(self, lengths: Callable[[Columns], np.ndarray] | None = None, **kinds):
        self.kinds, self.lengths = kinds, lengths
        self.names = ["span", "n", "key", *kinds, *["body"] * (lengths is not None)]
        self.schema = "span long, n long, " + ", ".join(f"{k} binary" for k in self.names[2:])

    def table(self, rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), *[pa.binary()] * (len(self.names) - 2)]
        cols = zip(*rows, strict=True) if rows else [[] for _ in types]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=self.names)

    def in_order(self, cols: Columns, order: np.ndarray) -> Columns:
        out = {k: a[order] for k, a in cols.items() if k != "body"}
        if self.lengths is not None:
            size = self.lengths(cols)
            out["body"] = cols["body"][ranges((np.cumsum(size) - size)[order], size[order])]
        return out

    def rows(self, cols: Columns, spans: int = 1) -> list[tuple]:
        """Rows of one span each, from columns in the order of the key."""
        n = len(cols["key"])
        if not n:
            return []
        span = span_of(cols["key"], spans)
        cuts = [0, *(np.flatnonzero(span[1:] != span[:-1]) + 1).tolist(), n]
        out = [(int(span[a]), b - a, pack_sorted(cols["key"][a:b]), *(pack(cols[k][a:b]) for k in self.kinds)) for a, b in zip(cuts, cuts[1:])]
        if self.lengths is None:
            return out
        ends = np.concatenate([[0], np.cumsum(self.lengths(cols))])[cuts].tolist()
        return [(*r, pa.compress(cols["body"][a:b].tobytes(), "zstd", asbytes=True)) for r, a, b in zip(out, ends, ends[1:], strict=False)]

    def read(self, batch: pa.RecordBatch) -> Iterator[tuple[int, Columns]]:
        at = {c: batch.schema.get_field_index(c) for c in self.names}
        for i in range(batch.num_rows):
            get = lambda c: batch.column(at[c])[i].as_py()  # noqa: E731,B023
            n = get("n")
            cols = {"key": unpack_sorted(get("key"), n), **{k: unpack(get(k), n, t) for k, t in self.kinds.items()}}
            if self.lengths is not None:
                cols["body"] = np.frombuffer(pa.decompress(get("body"), int(self.lengths(cols).sum()), "zstd", asbytes=True), np.uint8)
            yield get("span"), cols

    def cut(self, df: DataFrame, spans: int) -> DataFrame:
        """The rows gathered by the task and cut at the borders of ``spans`` spans; of more than ``FAN`` at once only if its rows already are of so much fewer."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[Columns] = []
            n = 0
            for b in batches:
                for _, cols in self.read(b):
                    held.append(cols)
                    n += len(cols["key"])
                    if n >= HELD:
                        yield flush(held)
                        held, n = [], 0
            if held:
                yield flush(held)
            tidy()

        def flush(held: list[Columns]) -> pa.RecordBatch:
            cols = joined(held)
            return self.table(self.rows(self.in_order(cols, np.argsort(cols["key"], kind="stable")), spans))

        return df.select(*self.names).mapInArrow(run, self.schema)

    def exchange(self, df: DataFrame, spans: int) -> DataFrame:
        """Rows of one span each, from rows that were cut for ``spans`` (a power of two), and so into ``FAN`` parts at most."""
        have = min(spans, FAN)
        while have < spans:
            have = min(spans, have * FAN)
            df = self.cut(df.repartition("span").sortWithinPartitions("span"), have)
        return df


def by_span(df: DataFrame, layout: Layout, work: Callable[[Columns], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``work`` on the entries of one span at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Columns] = []
        current = None
        for b in batches:
            for span, cols in layout.read(b):
                if held and span != current:
                    yield from work(joined(held))
                    held = []
                current = span
                held.append(cols)
        if held:
            yield from work(joined(held))
        tidy()

    return df.repartition("span").sortWithinPartitions("span").mapInArrow(run, schema)


def groups(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each group's first entry, number of each entry's group) of sorted keys."""
    new = np.ones(len(sorted_keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def by_chunk(chunk: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(chunk, places of its entries) for each chunk."""
    order = np.argsort(chunk, kind="stable")
    sorted_ = chunk[order]
    cuts = [0, *(np.flatnonzero(sorted_[1:] != sorted_[:-1]) + 1).tolist(), len(order)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield int(sorted_[a]), order[a:b]
