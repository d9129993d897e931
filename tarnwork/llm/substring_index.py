"""Removing repeated runs of words with a log-structured fingerprint index.

The index is a folder. It holds the texts of all batches so far in chunks, and two kinds of immutable runs of hashes, each run a written
table in the order of the hashes. *Anchor* runs hold hashes of 8-word windows, one of which is chosen in every 50-word window (see
``chunks``): a twentieth of all, each with the chunk that has it, or a mark that two documents have it. *Window* runs hold the hashes of
the 50-word windows around such hot anchors, each with its place in the texts: windows that no other document can have are never stored.

A batch is put into chunks. Its anchors are merge-joined with the anchor runs; those met again, in the index or in the batch, are hot. Where
an anchor of the index was alone until now, its holder's windows are added. The batch's windows around hot anchors are merge-joined with
the window runs and each other. What a task has gathered of a batch is joined there first, so that of an anchor or a window which is in
every chunk one entry for each task goes on, and hits point at many places. Hits are verified word by word against the text at the place found, which is all that is read of
earlier texts. Then the batch's hashes become runs; ``GROWTH`` runs of one level are merged into one of the next.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..written import delete, new_path
from .chunks import CHUNK, CHUNK_SQL, DONE, NOTE, WINDOW, Chunk, Words, beside, chunked, each_chunk, fold_equal, isin_sorted, notes, per_row, without
from .common import prepare, stash, table, tidy, unstash
from .spans import Columns, Layout, by_chunk, by_span, first_cut, groups, joined, pack, pack_sorted, ranges, spans_for, unpack, unpack_sorted

BATCHES = 3
#: Entries that a task gathers before it joins them with each other.
GATHERED = 1_000_000
#: Runs of one level that are merged into one of the next.
GROWTH = 2
#: Requests for the text of one chunk that one copy of it answers.
REQUESTS = 2000
#: The holder of an anchor that two documents have.
HOT = -1
#: Stand before every id for windows that a run has, and for windows of the index's texts that no run has yet.
IN_RUN, EARLIER = -(1 << 63), -(1 << 63) + 1

ANCHORS = Layout(holder=np.int64, kind=np.uint8)
WINDOWS = Layout(chunk=np.int64, spot=np.uint32, id=np.int64)
ANCHOR_RUN, WINDOW_RUN = Layout(holder=np.int64), Layout(chunk=np.int64, spot=np.uint32)
#: Kinds of an anchor entry: of one document of the batch, of several, of several whose chunks know it already, of the index.
ALONE, SEVERAL, TOLD, KNOWN = range(4)
#: Notes for chunks: hot anchors; places whose words the chunk already has in an earlier place; hits; requests and answers. RUN: rows of a new run.
HOT_ANCHORS, SAME, HITS, WANTED, GIVEN, RUN, ENTRIES = range(7)


def _sorted(cols: Columns, *by: str) -> Columns:
    order = np.lexsort([cols[b] for b in reversed(by)])
    return {k: a[order] for k, a in cols.items()}


def _recut(df: DataFrame, run: Layout, full: Layout, spans: int, **more) -> DataFrame:
    """Rows of a run, cut for this merge, with constants in the columns that only a batch needs."""
    have = first_cut(spans)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, cols in run.read(b):
                yield full.table(full.rows(cols | {k: np.full(len(cols["key"]), v, full.kinds[k]) for k, v in more.items()}, have))

    return df.select(*run.names).mapInArrow(cut, full.schema)


def _gathered(noted: DataFrame, layout: Layout, join: Callable[[Columns], list[tuple]]) -> DataFrame:
    """Notes in which the ENTRIES that a task has at hand are replaced by what ``join`` makes of them; other notes pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Columns] = []
        n = 0
        for b in batches:
            mine = pc.equal(b.column(0), ENTRIES)
            others = b.filter(pc.invert(mine))
            if others.num_rows:
                yield others
            own = b.filter(mine)
            for _, cols in layout.read(pa.RecordBatch.from_arrays(own.columns[1 : 1 + len(layout.names)], names=layout.names)):
                held.append(cols)
                n += len(cols["key"])
                if n >= GATHERED:
                    yield notes(join(joined(held)))
                    held, n = [], 0
        if held:
            yield notes(join(joined(held)))
        tidy()

    return noted.mapInArrow(run, NOTE)


# ---------------------------------------------------------------- anchors


def _anchor_entries(chunks: DataFrame, spans: int) -> DataFrame:
    """ENTRIES: a batch's anchors, one for each task. HOT_ANCHORS: those that a task has already found in two documents."""
    have = first_cut(spans)

    def work(chunk: Chunk) -> Iterator[pa.RecordBatch]:
        h, _, _, doc = chunk.stretches()
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        at, _ = groups(h)
        last = np.append(at[1:], len(h)) - 1 if len(at) else at
        kind = np.where(doc[at] != doc[last], SEVERAL, ALONE).astype(np.uint8)
        yield notes([(ENTRIES, *r) for r in ANCHORS.rows({"key": h[at], "holder": np.full(len(at), chunk.number), "kind": kind})])

    def join(cols: Columns) -> list[tuple]:
        cols = _sorted(cols, "key", "holder")
        key, holder = cols["key"], cols["holder"]
        at, number = groups(key)
        hot = (np.bincount(number) > 1) | (np.bincount(number, cols["kind"] == SEVERAL) > 0)
        told = hot[number]
        rows = [(HOT_ANCHORS, chunk, len(mine), pack_sorted(key[told][mine])) for chunk, mine in by_chunk(holder[told])]
        return rows + [(ENTRIES, *r) for r in ANCHORS.rows({"key": key[at], "holder": holder[at], "kind": np.where(hot, TOLD, ALONE).astype(np.uint8)}, have)]

    return _gathered(each_chunk(chunks, Words, work, NOTE), ANCHORS, join)


def _merge_anchors(cols: Columns) -> Iterator[pa.RecordBatch]:
    """Notes HOT_ANCHORS for chunks, of the batch and of the index, whose windows are wanted; and the rows of the batch's run."""
    cols = _sorted(cols, "key", "kind")
    key, holder, kind = cols["key"], cols["holder"], cols["kind"]
    at, number = groups(key)
    known, fresh = kind == KNOWN, kind != KNOWN
    n_fresh = np.bincount(number, fresh)
    in_index = np.bincount(number, known) > 0
    hot_before = np.bincount(number, known & (holder == HOT)) > 0
    hot = (n_fresh > 0) & (in_index | (n_fresh > 1) | (np.bincount(number, kind == TOLD) > 0))
    wanted = hot[number] & ((kind == ALONE) | (known & ~hot_before[number]))
    rows = [(HOT_ANCHORS, chunk, len(mine), pack_sorted(key[wanted][mine])) for chunk, mine in by_chunk(holder[wanted])]
    new = (n_fresh > 0) & ~hot_before & (~in_index | hot)  # not in the index, or no longer alone
    if new.any():
        first = at[new]
        rows += [(RUN, *r) for r in ANCHOR_RUN.rows({"key": key[first], "holder": np.where(hot[new], HOT, holder[first])})]
    yield notes(rows)


# ---------------------------------------------------------------- windows


def _windows(chunks: DataFrame, told: DataFrame, earlier: bool) -> DataFrame:
    """ENTRIES: windows around hot anchors, each with the earliest place that the task has. SAME: other places in a chunk, each with the first
    there. HITS: a batch's first places in chunks for which the task has an earlier one."""

    def work(chunk: Chunk, noted: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        wanted = np.sort(np.concatenate([unpack_sorted(r["a"], r["n"]) for r in noted]))
        h, first, count, _ = chunk.stretches()
        mine = isin_sorted(h, wanted)
        spot = np.sort(ranges(first[mine], count[mine]))
        key = chunk.hashes(spot, WINDOW)
        order = np.argsort(key, kind="stable")  # ids grow inside a chunk, so the first place has the smallest
        key, spot = key[order], spot[order]
        at, number = groups(key)
        lead = spot[at][number] if len(at) else spot
        is_lead = spot == lead
        ids = chunk.ids[chunk.doc_of(spot)]
        cols = {"key": key[is_lead], "chunk": np.full(int(is_lead.sum()), chunk.number), "spot": spot[is_lead].astype(np.uint32), "id": np.full(int(is_lead.sum()), EARLIER) if earlier else ids[is_lead]}
        rows = [(ENTRIES, *r) for r in WINDOWS.rows(cols)]
        if not earlier and not is_lead.all():
            other = ~is_lead
            rows.append((SAME, chunk.number, int(other.sum()), pack(spot[other].astype(np.uint32)), pack(lead[other].astype(np.uint32))))
        yield notes(rows)

    def join(cols: Columns) -> list[tuple]:
        cols, _, lead, hit = _led(cols)
        stay = ~hit & ((cols["id"] != EARLIER) | (lead == np.arange(len(lead))))  # with the id of the place before: a smaller id may turn up elsewhere
        return _hits(cols, lead, hit) + [(ENTRIES, *r) for r in WINDOWS.rows({k: a[stay] for k, a in cols.items()})]

    return _gathered(beside(chunks, told, Words, work, NOTE), WINDOWS, join)


def _led(cols: Columns) -> tuple[Columns, np.ndarray, np.ndarray, np.ndarray]:
    """(windows in order, place of each group's first one, that of each one's group, which of the batch have a smaller id before them)."""
    cols = _sorted(cols, "key", "id", "chunk", "spot")
    at, number = groups(cols["key"])
    lead = at[number] if len(at) else number
    ids = cols["id"]
    return cols, at, lead, (ids > EARLIER) & (ids > ids[lead])


def _hits(cols: Columns, lead: np.ndarray, hit: np.ndarray) -> list[tuple]:
    chunk, spot = cols["chunk"], cols["spot"]
    return [(HITS, own, len(mine), pack(spot[hit][mine]), pack(chunk[lead[hit]][mine]), pack(spot[lead[hit]][mine])) for own, mine in by_chunk(chunk[hit])]


def _merge_windows(cols: Columns) -> Iterator[pa.RecordBatch]:
    """Notes HITS: windows of the batch's chunks with the place of an earlier equal hash; and the rows of the batch's run."""
    cols, at, lead, hit = _led(cols)
    key, chunk, spot, ids = (cols[c] for c in ("key", "chunk", "spot", "id"))
    rows = _hits(cols, lead, hit)
    new = at[ids[at] != IN_RUN]
    rows += [(RUN, *r) for r in WINDOW_RUN.rows({"key": key[new], "chunk": chunk[new], "spot": spot[new]})]
    yield notes(rows)


# ---------------------------------------------------------------- verification


def _requests(hits: DataFrame) -> DataFrame:
    """Notes WANTED for the chunks whose words are sought: (own chunk in ``a``, own spots, spots there, windows in a row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        current = None
        for b in batches:
            for own, n, *packed in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if held and own != current:
                    yield flush(current, held)
                    held = []
                current = own
                held.append(tuple(unpack(x, n, t) for x, t in zip(packed, (np.uint32, np.int64, np.uint32), strict=True)))
        if held:
            yield flush(current, held)

    def flush(own: int, held: list[tuple]) -> pa.RecordBatch:
        spot, target, there = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((spot, target))
        spot, target, there = spot[order].astype(np.int64), target[order], there[order].astype(np.int64)
        new = np.ones(len(spot), bool)
        new[1:] = (target[1:] != target[:-1]) | (spot[1:] != spot[:-1] + 1) | (there[1:] != there[:-1] + 1)
        at = np.flatnonzero(new)
        count = np.diff(np.append(at, len(spot)))
        rows = []
        for chunk, mine in by_chunk(target[at]):
            rows.append((WANTED, chunk, len(mine), own.to_bytes(8, "little"), *(pack(x[mine].astype(np.uint32)) for x in (spot[at], there[at], count))))
        return notes(rows)

    return hits.repartition("chunk").sortWithinPartitions("chunk").select("chunk", "n", "a", "b", "c").mapInArrow(run, NOTE)


def _answers(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Notes GIVEN for the asking chunks: own spots, windows in a row, and the words there with their sizes. A chunk that very many ask is copied."""
    counts = stash(wanted.groupBy("chunk").agg(F.count("*").alias("n")), "wanted-counts")
    held, asked = chunks.join(counts.select("chunk"), "chunk", "left_semi"), wanted
    much = counts.filter(F.col("n") > REQUESTS).select("chunk", F.ceil(F.col("n") / REQUESTS).cast("int").alias("copies"))
    if not much.isEmpty():
        copies = F.coalesce("copies", F.lit(1))
        asked = asked.join(much, "chunk", "left").withColumn("copy", F.pmod(F.xxhash64("a"), copies).cast("int"))
        held = held.join(much, "chunk", "left").withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)))

    def work(chunk: Chunk, told: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        for row in told:
            n = row["n"]
            there, count = (unpack(row[c], n, np.uint32).astype(np.int64) for c in "cd")
            a, b = chunk.bounds(there, count + WINDOW - 1)
            body = chunk.text[ranges(a, b - a)].tobytes()
            yield notes([(GIVEN, int.from_bytes(row["a"], "little"), n, row["b"], row["d"], pack(b - a), pa.compress(body, "zstd", asbytes=True))])

    return beside(held, asked, Words, work, NOTE)


def _equal(chunk: Chunk, spot: np.ndarray, count: np.ndarray, body: bytes, size: np.ndarray) -> np.ndarray:
    """The windows, of ``count`` in a row from each spot on, whose words are those given."""
    a, b = chunk.bounds(spot, count + WINDOW - 1)
    text, at, out = chunk.text, np.cumsum(size) - size, []
    same_size = (b - a) == size
    other = np.frombuffer(body, np.uint8)
    for i in range(len(spot)):
        if same_size[i] and (text[a[i] : b[i]] == other[at[i] : at[i] + size[i]]).all():
            out.append((spot[i], count[i]))
        else:  # a hash that two different windows have: look at each window's words
            own, there = text[a[i] : b[i]].tobytes().split(), other[at[i] : at[i] + size[i]].tobytes().split()
            out += [(spot[i] + k, 1) for k in range(count[i]) if own[k : k + WINDOW] == there[k : k + WINDOW]]
    found = np.array(out, np.int64).reshape(-1, 2)
    return ranges(found[:, 0], found[:, 1])


def _same_here(chunk: Chunk, spot: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Which places have the same words as the places ``lead`` of the same chunk."""
    order = np.argsort(spot)
    s, t = spot[order], lead[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1] + 1) | (t[1:] != t[:-1] + 1)
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(s)))
    a, b = chunk.bounds(t[at], count + WINDOW - 1)
    body = chunk.text[ranges(a, b - a)].tobytes()
    return np.isin(spot, _equal(chunk, s[at], count, body, b - a))


def _remove(chunks: DataFrame, noted: DataFrame, with_text: bool) -> DataFrame:
    def work(chunk: Chunk, told: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        found, spot, lead = [none], none, none
        for row in told:
            n = row["n"]
            if row["what"] == SAME:
                spot, lead = (unpack(row[c], n, np.uint32).astype(np.int64) for c in "ab")
            else:
                own, count = (unpack(row[c], n, np.uint32).astype(np.int64) for c in "ab")
                size = unpack(row["c"], n, np.int64)
                found.append(_equal(chunk, own, count, pa.decompress(row["d"], int(size.sum()), "zstd", asbytes=True), size))
        gone = np.unique(np.concatenate(found))
        if len(spot):
            same = _same_here(chunk, spot, lead)
            spot, lead = spot[same], lead[same]
            later = chunk.ids[chunk.doc_of(spot)] > chunk.ids[chunk.doc_of(lead)]
            gone = np.union1d(gone, spot[later | isin_sorted(lead, gone)])
        yield without(chunk, gone, with_text)

    return stash(beside(chunks, noted, Words, work, DONE, all_chunks=True), "removed")


# ---------------------------------------------------------------- the index


class FingerprintIndex:
    """An index in a folder; ``FingerprintIndex(spark, path)`` opens what is there or begins a new one.

    ``state`` lists the written tables that count: the texts, and the runs of each kind as (path, level, entries). A new state is written when
    a batch is whole, so a batch that fails leaves the index as it was.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        prepare(spark)
        self.spark, self.path = spark, (path or new_path(spark, "fingerprints")).rstrip("/")
        self.state: dict = {"batches": 0, "texts": [], "anchors": [], "windows": []}
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/state")
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        whole = [n for n in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/state/{n}/_SUCCESS"))]
        if whole:
            self.state = json.loads(spark.read.text(f"{self.path}/state/{max(whole)}").first().value)

    @property
    def batches(self) -> int:
        return self.state["batches"]

    def _save(self) -> None:
        state = self.spark.createDataFrame([(json.dumps(self.state),)], "value string")
        state.coalesce(1).write.mode("overwrite").text(f"{self.path}/state/{self.batches:010d}")

    def _run(self, path: str, layout: Layout) -> DataFrame:
        return _rows(self.spark.read.schema(NOTE).parquet(path), layout)

    def _recut_runs(self, name: str, layout: Layout, full: Layout, spans: int, **more) -> list[DataFrame]:
        return [_recut(self._run(path, layout), layout, full, spans, **more) for path, _, _ in self.state[name]]

    def _keep_run(self, name: str, noted: DataFrame) -> None:
        """Takes the rows RUN of a written table as a run of the lowest level."""
        n = noted.filter(F.col("what") == RUN).agg(F.sum("n")).first()[0]
        if n:
            self.state[name].append([f"{noted._stash_path}/what={RUN}", 0, n])

    def _entries(self, name: str) -> int:
        return sum(n for _, _, n in self.state[name])

    def add(self, chunks: DataFrame, with_text: bool = False) -> DataFrame:
        """Takes a batch of written chunks into the index; gives the results of its documents (see ``chunks.without``)."""
        mark = f"{self.path}/{self.batches:010d}"
        raw = chunks.agg(F.sum("raw")).first()[0] or 0
        texts = self.state["texts"]
        earlier = self.spark.read.schema(CHUNK_SQL).parquet(*texts) if texts else None

        spans = spans_for(self._entries("anchors") + raw // 100)
        known = self._recut_runs("anchors", ANCHOR_RUN, ANCHORS, spans, kind=KNOWN)
        near = stash(_anchor_entries(chunks, spans), "anchors", "what")
        entries = ANCHORS.exchange(_union([_rows(near.filter(F.col("what") == ENTRIES), ANCHORS), *known]), spans)
        met = stash(by_span(entries, ANCHORS, _merge_anchors, NOTE), "", "what", path=f"{mark}-anchors")
        unstash(near, part=f"what={ENTRIES}")
        told = near.unionByName(met).filter(F.col("what") == HOT_ANCHORS)

        found = _windows(chunks, told, False)
        if earlier is not None:
            wanted = stash(told.select("chunk").distinct(), "chunks-wanted")
            found = found.unionByName(_windows(earlier.join(wanted, "chunk", "left_semi"), told, True))
        found = stash(found, "windows", "what")
        rows = _rows(found.filter(F.col("what") == ENTRIES), WINDOWS)
        spans = spans_for(self._entries("windows") + (rows.agg(F.sum("n")).first()[0] or 0))
        known = self._recut_runs("windows", WINDOW_RUN, WINDOWS, spans, id=IN_RUN)
        entries = WINDOWS.exchange(_union([_recut(rows, WINDOWS, WINDOWS, spans), *known]), spans)
        merged = stash(by_span(entries, WINDOWS, _merge_windows, NOTE), "", "what", path=f"{mark}-windows")
        unstash(found, part=f"what={ENTRIES}")

        wanted = stash(_requests(found.unionByName(merged).filter(F.col("what") == HITS)), "wanted")
        held = chunks.select(*CHUNK) if earlier is None else chunks.select(*CHUNK).unionByName(earlier)
        given = _answers(held, wanted)
        done = _remove(chunks, found.filter(F.col("what") == SAME).select(*given.columns).unionByName(given), with_text)

        self._keep_run("anchors", met)
        self._keep_run("windows", merged)
        self.state["texts"] = [*texts, chunks._stash_path]
        self.state["batches"] += 1
        old = self.compact()
        self._save()
        for path in old:
            delete(self.spark, path)
        unstash(near, found, wanted)
        for noted, what in ((met, HOT_ANCHORS), (merged, HITS)):
            unstash(noted, part=f"what={what}")
        return done

    def compact(self) -> list[str]:
        """Merges the runs of a level, when there are ``GROWTH``, into one of the next, level by level; gives the paths that are no longer needed."""
        old: list[str] = []
        for name, layout in (("anchors", ANCHOR_RUN), ("windows", WINDOW_RUN)):
            level = 0
            while any(r[1] >= level for r in self.state[name]):
                mine = [r for r in self.state[name] if r[1] == level]
                if len(mine) >= GROWTH:
                    spans = spans_for(sum(r[2] for r in mine))
                    rows = layout.exchange(_union([_recut(self._run(r[0], layout), layout, layout, spans) for r in mine]), spans)
                    made = stash(by_span(rows, layout, _compacted(layout), NOTE), "", path=f"{self.path}/{self.batches:010d}-{name}-{level + 1}")
                    n = made.agg(F.sum("n")).first()[0]
                    self.state[name] = [r for r in self.state[name] if r[1] != level] + [[made._stash_path, level + 1, n]]
                    old += [r[0] for r in mine]
                level += 1
        return old

    def delete(self) -> None:
        delete(self.spark, self.path)


def _compacted(layout: Layout):
    def work(cols: Columns) -> Iterator[pa.RecordBatch]:
        cols = _sorted(cols, "key", *layout.kinds)  # HOT comes before any holder
        at, _ = groups(cols["key"])
        yield notes([(RUN, *r) for r in layout.rows({k: a[at] for k, a in cols.items()})])

    return work


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _rows(noted: DataFrame, layout: Layout) -> DataFrame:
    """Notes as rows of a layout."""
    return noted.select(*(F.col(old).alias(new) for old, new in zip(("chunk", "n", "a", "b", "c", "d"), layout.names, strict=False)))


def add_documents(index: FingerprintIndex, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 1, with_text: bool = False) -> DataFrame:
    """Takes documents into the index, in ``batches`` by increasing id, and gives one row for each: doc_id, n_units (words), n_removed,
    n_spans, kept_sha256, kept (the remaining words joined by a space, if asked for).

    A word goes if a window of 50 words that covers it also begins in a row with a smaller id, or in a document that the index already has.
    Defined cases: a null text has no words; a null id is larger than any other; rows with the same id don't remove from each other, unless
    another row has the window too; an empty table gives an empty table; other columns are left out.
    """
    rows, texts = fold_equal(docs, id_col, text_col)
    cuts = sorted(set(rows.approxQuantile("id", [i / batches for i in range(1, batches)], 0.01))) if batches > 1 else []
    first = index.batches
    chunks = chunked(texts, Words, [int(c) for c in cuts], first, f"{index.path}/{first:010d}-texts")
    done = []
    for batch in range(first, first + len(cuts) + 1):
        part = chunks.filter(F.col("batch") == batch)
        part._stash_path = f"{chunks._stash_path}/batch={batch}"
        done.append(index.add(part, with_text))
    return per_row(rows, _union(done))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, with_text: bool = False) -> DataFrame:
    """``add_documents`` to an index of its own, which is given up again."""
    index = FingerprintIndex(docs.sparkSession)
    out = add_documents(index, docs, id_col, text_col, batches, with_text)
    index.delete()
    return out


def op9_substring_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its words removed that a 50-word window covers which also starts in a document with a smaller doc_id.

    doc_id, n_words long, n_removed long, kept_sha256 string. Defined cases: as for ``add_documents``.
    """
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", "kept_sha256")
