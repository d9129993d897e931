"""Packing documents into sequences: best fit, then a swap-based local search.

Pieces are dealt into groups of bounded size by a hash; each group is packed by best fit (longest first) and improved by
moving pieces, or exchanging one for one or two for one, between underfull bins. Every step raises the sum of squared
fills, so bins empty one after the other. The underfull bins of all groups, an eighth of a group's at most (the emptiest), are opened
again and packed together in the next round, until one group is left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, prepare, stash, table, tidy
from .tokens import default_path, pre_tokenizer

SEQUENCE = 1024
END_ID = 2
#: Pieces packed by one task.
GROUP = 20_000


def best_fit(lengths: np.ndarray, size: int = SEQUENCE) -> np.ndarray:
    """The bin of each piece: longest piece first, into the fullest bin that has room."""
    out = np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms, bins = 0, 0  # rooms: bit r is set if a bin has exactly r left
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fit = rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            b, room, bins = bins, size, bins + 1
        out[i] = b
        if left := room - n:
            by_room[left].append(b)
            rooms |= 1 << left
    return out


def _offers(lengths: np.ndarray, bins: np.ndarray, fill: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What an underfull bin can give: (tokens, bin, piece, second piece or -1), by tokens. Of pairs, one for each two lengths in a bin."""
    mine = np.flatnonzero(fill[bins] < size)
    mine = mine[np.lexsort((lengths[mine], bins[mine]))]
    b, n = bins[mine], lengths[mine]
    first = np.ones(len(mine), bool)
    first[1:] = (b[1:] != b[:-1]) | (n[1:] != n[:-1])
    second = np.zeros(len(mine), bool)  # two of a length may go together too
    second[1:] = ~first[1:] & first[:-1]
    few = mine[first | second]
    own = bins[few]
    partners = np.searchsorted(own, own, side="right") - np.arange(len(few)) - 1
    i = np.repeat(np.arange(len(few)), partners)
    j = np.arange(len(i)) - np.repeat(np.cumsum(partners) - partners, partners) + i + 1
    none = np.full(len(mine), -1)
    total, giver, one, two = (np.concatenate(x) for x in ((n, lengths[few[i]] + lengths[few[j]]), (b, own[i]), (mine, few[i]), (none, few[j])))
    order = np.argsort(total, kind="stable")
    return total[order], giver[order], one[order], two[order]


def _steps(lengths: np.ndarray, bins: np.ndarray, fill: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """For each place that could take more (a piece of an underfull bin that would go back, or its room as it is) the largest offer from a bin
    that is no fuller: (gain, taker, piece that goes back or -1, giver, piece, second piece or -1)."""
    total, giver, one, two = _offers(lengths, bins, fill, size)
    mine, underfull = np.flatnonzero(fill[bins] < size), np.flatnonzero((fill > 0) & (fill < size))
    back = np.concatenate([mine, np.full(len(underfull), -1)])
    taker = np.concatenate([bins[mine], underfull])
    less = np.concatenate([lengths[mine], np.zeros(len(underfull), lengths.dtype)])
    low = np.searchsorted(total, less, side="right")
    high = np.searchsorted(total, less + size - fill[taker], side="right") - 1
    found = np.full(len(less), -1)
    left, tries = np.flatnonzero(high >= low), 0
    at = high[left]
    while len(left) and tries < 64:  # the largest offers of all places at once
        good = (taker[left] != giver[at]) & (fill[taker[left]] >= fill[giver[at]])
        found[left[good]] = at[good]
        left, at, tries = left[~good], at[~good] - 1, tries + 1
        left, at = left[at >= low[left]], at[at >= low[left]]
    for t, top in zip(left.tolist(), at.tolist(), strict=True):  # all others of the few places that are left
        rest = slice(int(low[t]), top + 1)
        ok = np.flatnonzero((giver[rest] != taker[t]) & (fill[giver[rest]] <= fill[taker[t]]))
        if len(ok):
            found[t] = low[t] + ok[-1]
    t = np.flatnonzero(found >= 0)
    o = found[t]
    return total[o] - less[t], taker[t], back[t], giver[o], one[o], two[o]


def local_search(lengths: np.ndarray, bins: np.ndarray, size: int = SEQUENCE) -> np.ndarray:
    """Empties underfull bins: a piece or two go from one underfull bin to another that is at least as full, against none or one smaller piece.

    Each step takes ``gain`` tokens to the fuller of two bins, so the sum of squared fills grows with it and the search ends: at the least
    possible number of bins, or when no step between any two underfull bins is left. In a round all steps are looked for, and
    those that raise the sum most are taken, each bin once.
    """
    bins = bins.copy()
    fill = np.bincount(bins, lengths).astype(np.int64)
    least = -(-int(lengths.sum()) // size)
    while int((fill > 0).sum()) > least:
        gain, taker, back, giver, one, two = _steps(lengths, bins, fill, size)
        if not len(gain):
            break
        touched: set[int] = set()
        for k in np.argsort(-gain * (fill[taker] - fill[giver] + gain), kind="stable").tolist():
            to, of = int(taker[k]), int(giver[k])
            if to in touched or of in touched:
                continue
            touched |= {to, of}
            bins[one[k]] = to
            if two[k] >= 0:
                bins[two[k]] = to
            if back[k] >= 0:
                bins[back[k]] = of
            fill[to] += gain[k]
            fill[of] -= gain[k]
    return bins


def pack(lengths: np.ndarray, size: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """Bin (numbered from 0 without gaps) and offset of each piece."""
    bins = local_search(lengths, best_fit(lengths, size), size)
    bins = np.unique(bins, return_inverse=True)[1] if len(bins) else bins
    order = np.lexsort((-lengths, bins))
    ends = np.cumsum(lengths[order])
    starts = ends - lengths[order]
    first = np.r_[True, bins[order][1:] != bins[order][:-1]] if len(order) else np.zeros(0, bool)
    offsets = np.empty(len(lengths), np.int64)
    offsets[order] = starts - np.maximum.accumulate(np.where(first, starts, 0)) if len(order) else starts
    return bins, offsets


def token_pieces(docs: DataFrame, path: str | None = None, size: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document: its ids, then ``end_id``, cut only where longer than ``size``.

    A longer document's pieces are full but for the first. ids, if asked for, are little-endian unsigned 32-bit numbers.
    """
    path = path or default_path()
    prepare(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = pre_tokenizer(path)
        end = end_id.to_bytes(4, "little")
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for doc, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = tok.encode(x.as_py() or "").astype("<u4").tobytes() + end
                n = len(ids) // 4
                at, piece = 0, 0
                while at < n:
                    length = ((n - 1) % size + 1) if at == 0 else size
                    part = ids[4 * at : 4 * (at + length)]
                    for store, v in zip(out, (doc, piece, at, length, zlib.crc32(part), part), strict=True):
                        store.append(v)
                    at, piece = at + length, piece + 1
                if len(out[0]) >= 20_000:
                    yield rows(out)
                    out = ([], [], [], [], [], [])
            if out[0]:
                yield rows(out)
        tidy()

    def rows(out: tuple[list, ...]) -> pa.RecordBatch:
        cols = [pa.array(c, k) for c, k in zip(out, (id_kind, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
        return pa.RecordBatch.from_arrays(cols[: 5 + with_ids], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    from pyspark.sql.pandas.types import to_arrow_type

    id_kind = to_arrow_type(docs.schema["doc_id"].dataType)
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def _filler(level: int, last: bool, size: int):
    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "_row"], ascending=[False, True], ignore_index=True)
        lengths = rows["length"].to_numpy(np.int64)
        bins, offsets = pack(lengths, size)
        fills = np.bincount(bins, lengths).astype(np.int64)
        again = np.zeros(len(fills), bool)
        if not last:
            # An eighth of the bins at most, so that every round has fewer pieces.
            again[np.argsort(fills, kind="stable")[: len(fills) // 8]] = True
            again &= fills < size
        return pd.DataFrame({"_row": rows["_row"], "length": lengths, "sequence_id": (level << 48) + (int(key[0]) << 20) + bins, "offset": offsets, "again": again[bins]})

    return fill


def pack_documents(docs: DataFrame, path: str | None = None, size: int = SEQUENCE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Defined cases: a null or empty text is its end id alone; null ids and repeated rows are packed row by row; pieces that tie
    in length are placed in an order that is fixed by their rows; an empty table gives an empty table; other columns are left out.
    """
    spark = docs.sparkSession
    plain = pick(docs, doc_id=id_col, text=text_col)
    pieces = stash(token_pieces(plain, path, size, end_id).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    whole = pieces.filter(F.col("length") == size).withColumn("sequence_id", -1 - F.col("_row")).withColumn("offset", F.lit(0).cast("long"))

    placed, todo, level = [whole], pieces.filter(F.col("length") < size).select("_row", "length"), 0
    n = todo.count()
    while True:
        groups = max(1, -(-n // group))
        last = groups == 1

        dealt = todo.withColumn("_group", F.pmod(F.xxhash64("_row", F.lit(level)), F.lit(groups)))
        packed = stash(dealt.groupBy("_group").applyInPandas(_filler(level, last, size), "_row long, length long, sequence_id long, offset long, again boolean"), "packed")
        placed.append(packed.filter(~F.col("again")).select("_row", "sequence_id", "offset"))
        if last:
            break
        todo, level = packed.filter("again").select("_row", "length"), level + 1
        n = todo.count()
    where = placed[1]
    for p in placed[2:]:
        where = where.unionByName(p)
    some = pieces.filter(F.col("length") < size).join(where, "_row")
    cols = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return whole.select(*cols).unionByName(some.select(*cols))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1,024 tokens of ``byte_bpe_50k.json``, with id 2 at each document's end.

    doc_id, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long. Defined cases: as for ``pack_documents``.
    """
    return pack_documents(table(spark, sf_dir, "documents"))
