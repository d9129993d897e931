"""SimHash near-deduplication with pivot distance tables.

A fingerprint is one or more 64-bit lanes. Reference fingerprints (pivots) turn each into a row of Hamming distances. By the triangle
inequality two fingerprints at most ``d`` apart differ by at most ``d`` in each of these distances, so pairs whose largest
coordinate difference is greater are discarded, and what survives is verified bit by bit.

Which pairs are looked at at all doesn't come from these distances: random fingerprints are about equally far from any reference, so a few
distances let most strangers through (figures in the README). Pairs meet in buckets of agreeing bits: a fingerprint is cut into ``s`` segments, of
which at most ``d`` can differ, so two within the bound agree in ``s - d`` segments and meet under one of ``C(s, d)`` keys, each the
fingerprint's bits under a mask. No pair within the bound is missed, and none has to be sought among all others. Inside a bucket the
tables order and discard.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import acos, ceil, comb, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, pick, prepare, replace_columns, stash, table, tidy, unstash
from .components import components, local_roots
from .exact_dedup import flagged

SEED = 42
#: Spread references whose distances are compared before verification.
PIVOTS = 16
#: A bucket with more members is compared in cells of two such blocks, each a task's work of its own.
BLOCK = 2048
LANE = 1 << 64
_LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))


def _words(text: str | None) -> list[bytes]:
    """Runs of bytes that aren't ASCII white space, A-Z in lower case."""
    return (text or "").encode().translate(_LOWER).split()


def _shingles(words: list[bytes], k: int, seed: int) -> np.ndarray:
    """XXH64 of each run of k words (of all, if fewer)."""
    digest = xxhash.xxh64_intdigest
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= k:
        return np.array([digest(b" ".join(words), seed)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-k]])
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), (ends[k - 1 :] - 1).tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint: each bit that is set in over half of the hashes; a text of any length takes bounded memory."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].astype("<u8", copy=False)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = SEED) -> DataFrame:
    """docs (id, text) as (id, fp): fp is the 64-bit fingerprint as a signed long; without words it is zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([majority(_shingles(_words(x.as_py()), shingle, seed)) for x in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    prepare(docs.sparkSession)
    return docs.select("id", "text").mapInArrow(run, f"id {dict(docs.dtypes)['id']}, fp long")


def pivots(lanes: int, n: int = PIVOTS) -> np.ndarray:
    """Spread references, fixed for good: (n, lanes) 64-bit numbers."""
    return np.array([[xxhash.xxh64_intdigest(f"pivot/{i}/{j}") for j in range(lanes)] for i in range(n)], np.uint64)


def segments(n: int, distance: int) -> list[int]:
    """Masks of the segments, as few as leave less than about one stranger in a bucket of ``n`` fingerprints."""
    s = distance + 2
    while 64 * (s - distance) / s < log2(max(n, 2)) + 2 and comb(s, distance) < 100:
        s += 1
    edges = [round(64 * i / s) for i in range(s + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]


def _signed(x: int) -> int:
    return x - LANE if x >= LANE >> 1 else x


def exact_keys(nodes: DataFrame, n: int, distance: int) -> DataFrame:
    """(key, node) under which every pair of nodes at most ``distance`` bits apart meets."""
    masks, base = segments(n, distance), int(pivots(1, 1)[0, 0])
    keys = []
    for t, kept in enumerate(combinations(masks, len(masks) - distance)):
        packed = F.col("node").bitwiseXOR(F.lit(_signed(base))).bitwiseAND(F.lit(_signed(sum(kept))))
        keys.append(F.xxhash64(F.lit(t), packed))
    return nodes.select(F.explode(F.array(*keys)).alias("key"), "node")


def links(keys: DataFrame, lanes: DataFrame, n_lanes: int, distance: int, block: int = BLOCK) -> DataFrame:
    """(a, b) between nodes that share a key and are at most ``distance`` bits apart; enough of them to connect all such nodes.

    lanes: (node, lanes binary). Buckets of one node go at once. A bucket over ``block`` is dealt into cells of two blocks. A cell is put in the
    order of the pivot distance that spreads it most, and only neighbours within ``distance`` in it are looked at; the other
    distances discard, the bits verify, and only the links of a spanning forest come out.
    """
    members = shared(keys).join(lanes, "node")
    blocks = F.ceil(F.col("n") / block).cast("long")
    members = members.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("node", F.lit(7)), "blocks"))
    cells = members.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    side = F.when(F.col("mine") == F.col("other"), -1).otherwise(F.when(F.col("mine") < F.col("other"), 0).otherwise(1)).cast("int")
    cells = cells.select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell"), side.alias("side"), "node", "lanes")
    refs = pivots(n_lanes)

    def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
        cell, side, node = (t[c].to_numpy() for c in ("cell", "side", "node"))
        own = _lanes(t["lanes"], n_lanes)
        far = np.stack([np.bitwise_count(own ^ r).sum(1, dtype=np.int16) for r in refs], 1)
        lead = int(np.argmax(far.std(0))) if len(far) else 0
        order = np.lexsort((far[:, lead], cell))
        cell, side, node, own, far = cell[order], side[order], node[order], own[order], far[order]
        end = np.searchsorted(cell, cell, side="right")
        first, others = far[:, lead], [p for p in range(far.shape[1]) if p != lead]
        active, found = np.arange(len(cell)), []
        for step in range(1, len(cell)):
            active = active[end[active] > active + step]
            active = active[first[active + step] - first[active] <= distance]  # in order, so what is too far now stays too far
            if not len(active):
                break
            a, b = active, active + step
            near = (side[a] != side[b]) | (side[a] < 0)
            a, b = a[near], b[near]
            for p in others:
                near = np.abs(far[a, p] - far[b, p]) <= distance
                a, b = a[near], b[near]
            near = np.bitwise_count(own[a] ^ own[b]).sum(1, dtype=np.int16) <= distance
            found.append((node[a[near]], node[b[near]]))
            if sum(len(f[0]) for f in found) > 4_000_000:
                found = [local_roots(*map(np.concatenate, zip(*found, strict=True)))]
        if found:
            yield _pairs(*local_roots(*map(np.concatenate, zip(*found, strict=True))))

    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(lambda batches: _whole(batches, "cell", compare), "a long, b long")


def _lanes(column: pa.ChunkedArray, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, n)


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b)], names=["a", "b"])


def _whole(batches: Iterator[pa.RecordBatch], key: str, work: Callable[[pa.Table], Iterator[pa.RecordBatch]], rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    """``work`` on about so many rows at a time, never on a part of a cell (of two blocks at most)."""
    rest: list[pa.RecordBatch] = []
    waiting = 0
    for b in batches:
        rest.append(b)
        waiting += b.num_rows
        if waiting < rows:
            continue
        t = pa.Table.from_batches(rest).combine_chunks()
        cell = t[key].to_numpy()
        cut = int(np.flatnonzero(cell != cell[-1])[-1]) + 1 if cell[0] != cell[-1] else 0  # the last cell may go on in the next batch
        if cut:
            yield from work(t.slice(0, cut))
        rest = t.slice(cut).to_batches()
        waiting = t.num_rows - cut
    if rest:
        yield from work(pa.Table.from_batches(rest))
    tidy()


def shared(keys: DataFrame) -> DataFrame:
    """The rows (key, ...) whose key has several nodes, and the number n of them."""
    counts = stash(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "bucket-sizes")
    return keys.join(counts, "key")


def spanning(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Places of the links of a lightest spanning forest: in each round every tree takes its lightest link to another."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    order = np.argsort(weight, kind="stable")
    x, y = at[: len(a)][order], at[len(a) :][order]
    label, kept, left = np.arange(len(nodes)), np.zeros(len(a), bool), np.arange(len(a))
    while len(left := left[label[x[left]] != label[y[left]]]):
        best = np.full(len(nodes), len(a))
        np.minimum.at(best, label[x[left]], left)
        np.minimum.at(best, label[y[left]], left)
        chosen = np.unique(best[best < len(a)])
        kept[chosen] = True
        below, low = local_roots(label[x[chosen]], label[y[chosen]])
        to = np.arange(len(nodes))
        to[below] = low
        label = to[label]
    return order[kept]


def link_components(prints: DataFrame, distance: int = 3) -> DataFrame:
    """prints (id, fp), written, as (id, fp, component): the smallest id reachable over links of at most ``distance`` bits.

    Only distinct fingerprints are compared. Defined cases: an id may repeat, each of its rows has its own fingerprint's component; null ids
    take part and are nobody's component unless all are null; equal smallest ids are one component's name; no rows give no rows.
    """
    classes = stash(prints.groupBy(F.col("fp").alias("node")).agg(F.min("id").alias("rep")), "classes")
    nodes = classes.select("node")
    own = nodes.select("node", F.expr("unhex(lpad(hex(node), 16, '0'))").alias("lanes"))
    found = links(exact_keys(nodes, classes.count(), distance), own, 1, distance)
    return _spread(prints, classes, components(found), "fp")


def _spread(prints: DataFrame, classes: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    named = classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = stash(named, "named")
    least = stash(named.groupBy("label").agg(F.min("rep").alias("component")), "least")
    named = stash(named.join(least, "label").select(F.col("node").alias(key), "component"), "named")
    return prints.join(named, key)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every document and the smallest doc_id reachable over at most 3 differing bits: doc_id, fingerprint string, component_id.

    Defined cases: a text without words, or null, has fingerprint zero and is linked like any other; repeated rows are repeated; as for
    ``link_components`` otherwise.
    """
    docs = pick(table(spark, sf_dir, "documents"), id="doc_id", text="text")
    linked = link_components(stash(fingerprints(docs), "prints"))
    return linked.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


# ---------------------------------------------------------------- near copies by similarity

#: Lanes of a fingerprint over shingles of five words, 64 bits each; they only discard. The first few of them choose what is verified first.
SHINGLE_LANES, FIRST_LANES = 8, 4
#: Share of bits that differ in two sets which are alike to 0.8, and in sets of fewer than 16 shingles (simulated: 0.152 and 0.188 at most).
DIFFERING, DIFFERING_SMALL = 0.153, 0.19
#: Of each bucket, neighbours in the order of a pivot distance that are looked at first; pairs of them up to so many differing bits are verified.
NEIGHBOURS, FIRST_BITS = 16, 64
#: Keys at the head of its list that a text carries into each bucket, to tell whether a pair also meets in an earlier one.
HEAD = 4
#: Documents whose shingles are counted to tell the common ones, and the most that are told; both only save work.
SAMPLE, COMMON = 20_000, 1_000_000
ADDED = ("group_id", "kept")


def common_shingles(texts: DataFrame, shingle: int, sample: int = SAMPLE, most: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that a sample of the column ``text`` repeats, and how common each is. Any such table gives the same pairs."""
    rate = max(1, texts.count() // sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for x in b.column(0):
                held.append(np.unique(_shingles(_words(x.as_py()), shingle, SEED)))
                n += len(held[-1])
                if n > 1_000_000:
                    yield rows(held)
                    held, n = [], 0
        if held:
            yield rows(held)
        tidy()

    def rows(held: list[np.ndarray]) -> pa.RecordBatch:
        found, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n, pa.int64())], names=["h", "n"])

    some = texts.filter(F.pmod(F.xxhash64("text", F.lit(5)), F.lit(rate)) == 0).select("text")
    found = some.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 2")
    found = stash(found.select("h", F.floor(F.log2("n") * 2).cast("int").alias("step")), "common")
    total, least = 0, 1000
    for r in sorted(found.groupBy("step").count().collect(), reverse=True):
        if (total := total + r["count"]) > most:
            break
        least = r["step"]
    told = found.filter(F.col("step") >= least).toArrow()
    h = told["h"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], told["step"].to_numpy().astype(np.uint8)[order]


def shingle_keys(docs: DataFrame, shingle: int, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """docs (id, text) as (id, node, size, lanes, keys): a hash that stands for the set of shingles, their number, the lanes, and the rarest ``size - ceil(similarity * size) + 1`` of them."""
    sent = docs.sparkSession.sparkContext.broadcast(tuple(x.tobytes() for x in common))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, steps = (np.frombuffer(x, t) for x, t in zip(sent.value, (np.uint64, np.uint8), strict=True))
        for b in batches:
            for start in range(0, b.num_rows, 200):  # sets of long texts are long too
                part, nodes, sizes, lanes, sets = b.slice(start, 200), [], [], [], []
                for x in part.column(1):
                    wide = np.unique(_shingles(_words(x.as_py()), shingle, SEED))
                    nodes.append(xxhash.xxh64_intdigest(wide.tobytes(), SEED))
                    lanes.append(np.array([majority(_remix(wide, i)) for i in range(SHINGLE_LANES)], "<u8").tobytes())
                    if len(known):
                        at = np.minimum(np.searchsorted(known, wide), len(known) - 1)
                        wide = wide[np.argsort(np.where(known[at] == wide, steps[at], 0), kind="stable")]
                    sizes.append(len(wide))
                    sets.append(wide[: len(wide) - ceil(similarity * len(wide) - 1e-9) + 1].view(np.int64))
                flat = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(lanes, pa.binary()), flat], names=["id", "node", "size", "lanes", "keys"])
        tidy()

    return docs.select("id", "text").mapInArrow(run, f"id {dict(docs.dtypes)['id']}, node long, size int, lanes binary, keys array<long>")


def some_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """docs (id, text) as (id, node, shingles), all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 200):
                part = b.slice(start, 200)
                sets = [np.unique(_shingles(_words(x.as_py()), shingle, SEED)) for x in part.column(1)]
                nodes = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64)
                ends = np.cumsum([0, *map(len, sets)])
                flat = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(nodes.view(np.int64)), flat], names=["id", "node", "shingles"])
        tidy()

    return docs.select("id", "text").mapInArrow(run, f"id {dict(docs.dtypes)['id']}, node long, shingles array<long>")


def sets_of(nodes: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles) of distinct nodes (node), written.

    docs: (id, text). Only texts of these nodes are read again, of equal sets the one with the id ``rep``; they are told by a
    bitmap of bounded size, and what it lets through by chance goes in the join.
    """
    wanted = stash(nodes.join(classes.select("node", "rep"), "node"), "wanted")
    reps = stash(wanted.select(F.xxhash64("rep").alias("key")).distinct(), "wanted-ids")
    read = some_sets(flagged(docs, reps, F.xxhash64("id"), "_wanted").filter("_wanted"), shingle).join(wanted.withColumnRenamed("node", "_node"), (F.col("node") == F.col("_node")) & F.col("id").eqNullSafe(F.col("rep")))
    read = stash(read.groupBy("node").agg(F.first("shingles").alias("shingles")), "compared-sets")
    unstash(wanted)
    return read


def _alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    same = len(np.intersect1d(x, y, assume_unique=True))
    return same >= similarity * (len(x) + len(y) - same) - 1e-9


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are at least ``similarity`` alike, written. docs: (id, text)."""
    pairs = stash(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    read = sets_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), classes, docs, shingle)
    both = pairs.join(read.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(read.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            alike = []
            for x, y in zip(t.column(2), t.column(3), strict=True):
                alike.append(_alike(x.values.to_numpy(), y.values.to_numpy(), similarity))
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], names=["a", "b"]).filter(pa.array(alike, pa.bool_()))
        tidy()

    out = stash(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "alike")
    unstash(pairs, read)
    return out


def discard_bits(size: np.ndarray, similarity: float, lanes: int = SHINGLE_LANES) -> np.ndarray:
    """Differing bits up to which a pair, the smaller set of so many shingles, may be alike enough: six standard deviations and more above the mean at 0.8."""
    share = np.where(size < 16, DIFFERING_SMALL, DIFFERING) * acos(2 * similarity / (1 + similarity)) / acos(2 * 0.8 / 1.8)
    return 64 * lanes * share + 6.2 * np.sqrt(64 * lanes * share * (1 - share))


def _likely(members: DataFrame, similarity: float, block: int) -> DataFrame:
    """(a, b): of each bucket, in blocks, the links of a forest of near neighbours. members: (key, node, n, size, lanes); nothing relies on their being complete."""
    part = F.pmod(F.xxhash64("node", F.lit(7)), F.ceil(F.col("n") / block).cast("long"))
    cells = members.select(F.xxhash64("key", part).alias("cell"), "node", "size", F.substring("lanes", 1, 8 * FIRST_LANES).alias("lanes"))
    refs = pivots(FIRST_LANES, 2)

    def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
        cell, node, size = (t[c].to_numpy() for c in ("cell", "node", "size"))
        own, found = _lanes(t["lanes"], FIRST_LANES), []
        for r in refs:
            order = np.lexsort((np.bitwise_count(own ^ r).sum(1), cell))
            for step in range(1, NEIGHBOURS + 1):
                a, b = order[:-step], order[step:]
                near = cell[a] == cell[b]
                a, b = a[near], b[near]
                near = similarity * np.maximum(size[a], size[b]) <= np.minimum(size[a], size[b])
                a, b = a[near], b[near]
                bits = np.bitwise_count(own[a] ^ own[b]).sum(1, dtype=np.int16)
                near = bits <= FIRST_BITS
                found.append((node[a[near]], node[b[near]], bits[near]))
        a, b, bits = (np.concatenate(x) for x in zip(*found, strict=True))
        kept = spanning(a, b, bits)
        yield _pairs(a[kept], b[kept])

    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(lambda batches: _whole(batches, "cell", compare), "a long, b long")


def _apart(members: DataFrame, own: DataFrame, similarity: float, block: int) -> DataFrame:
    """(CELLS): nodes that in a cell may be alike enough to one with another label; each such pair has a key, that they share, in whose cell both are.

    members: (key, pos, node, label); own: (node, size, lanes, head). Of each bucket the commonest label's nodes are only compared with the others. A bucket
    over ``block`` is dealt into cells: blocks of the others with each other and with blocks of the commonest. Nodes come out, not their pairs, of which
    a group of texts that are all nearly alike enough has as many as its square.
    """
    counts = members.groupBy("key", "label").agg(F.count("*").alias("n"))
    tops = counts.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("top"), F.max("n").alias("most"), F.sum("n").alias("n"), F.count("*").alias("labels"))
    tops = stash(tops.filter("labels > 1").select("key", "top", "most", (F.col("n") - F.col("most")).alias("rest")), "mixed-keys")
    dealt = members.join(tops, "key").join(own, "node").withColumn("common", F.col("label") == F.col("top"))
    dealt = dealt.withColumn("bo", F.ceil(F.col("rest") / block).cast("int")).withColumn("bm", F.ceil(F.col("most") / block).cast("int"))
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("node", F.lit(7)), F.when(F.col("common"), F.col("bm")).otherwise(F.col("bo"))).cast("int"))
    cells = F.expr(f"""CASE WHEN rest + most <= {block} THEN array(struct(0 AS x, 0 AS y, -1 AS side))
        WHEN common THEN transform(sequence(0, bo - 1), i -> struct(i AS x, bo + mine AS y, 1 AS side))
        ELSE concat(transform(sequence(0, bo - 1), i -> struct(least(i, mine) AS x, greatest(i, mine) AS y, CASE WHEN i = mine THEN -1 WHEN i > mine THEN 0 ELSE 1 END AS side)),
                    transform(sequence(0, bm - 1), j -> struct(mine AS x, bo + j AS y, 0 AS side))) END""")
    cells = dealt.withColumn("cell", F.explode(cells))
    cells = cells.select(F.xxhash64("key", "cell.x", "cell.y").alias("cell"), "cell.side", "common", "key", "pos", "node", "label", "size", "lanes", "head")

    def find(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t, pairs = _in_cells(t, similarity)
        met = np.zeros(t.num_rows, bool)
        for a, b in pairs(np.unique(t["label"].to_numpy(), return_inverse=True)[1]):
            met[a] = met[b] = True
        yield from t.filter(pa.array(met)).to_batches()

    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(lambda batches: _whole(batches, "cell", find), CELLS)


#: A node in a cell, as ``_apart`` compares it.
CELLS = "cell long, side int, common boolean, key long, pos int, node long, label long, size int, lanes binary, head binary"


def _in_cells(t: pa.Table, similarity: float) -> tuple[pa.Table, Callable[[np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]]]:
    """Whole cells in order, and their pairs of rows that may be alike enough, for an array of groups in which a pair need not be told; the caller may join groups on the way."""
    t = t.take(pa.array(np.lexsort((t["common"].to_numpy(), t["cell"].to_numpy()))))
    cell, side, key, pos, size = (t[c].to_numpy() for c in ("cell", "side", "key", "pos", "size"))
    other, bits = ~t["common"].to_numpy(), _lanes(t["lanes"], SHINGLE_LANES)
    head = np.frombuffer(b"".join(t["head"].to_pylist()), ">i8").reshape(-1, HEAD).astype(np.int64)
    far = np.stack([np.bitwise_count(bits ^ r).sum(1, dtype=np.int16) for r in pivots(SHINGLE_LANES, 4)], 1)
    bound = discard_bits(size, similarity)
    end = np.searchsorted(cell, cell, side="right")

    def pairs(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        active = np.flatnonzero(other)
        for step in range(1, len(cell)):
            active = active[end[active] > active + step]
            if not len(active):
                break
            a, b = active, active + step
            near = ((side[a] != side[b]) | (side[a] < 0)) & (group[a] != group[b])
            a, b = a[near], b[near]
            small, large = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
            least = np.ceil(similarity / (1 + similarity) * (small + large) - 1e-9)  # shingles that they must share
            near = (small >= similarity * large - 1e-9) & (np.minimum(size[a] - pos[a], size[b] - pos[b]) >= least)
            a, b = a[near], b[near]
            most = np.maximum(bound[a], bound[b])
            near = (np.abs(far[a] - far[b]) <= most[:, None]).all(1)
            a, b, most = a[near], b[near], most[near]
            near = np.bitwise_count(bits[a] ^ bits[b]).sum(1, dtype=np.int16) <= most
            a, b = a[near], b[near]
            same = (head[a][:, :, None] == head[b][:, None, :]).any(2) & (head[a] != NO_KEY)
            near = ~same.any(1) | (head[a, same.argmax(1)] == key[a])  # a pair that meets under an earlier key is left to that one
            if near.any():
                yield a[near], b[near]

    return t, pairs


def _verified_in_cells(cells: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of the pairs in cells (CELLS) that are alike enough by their sets (node, shingles), as many as connect all such; a pair that is connected by now isn't looked at."""

    def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t, pairs = _in_cells(t, similarity)
        node, shingles = t["node"].to_numpy(), t["shingles"]
        names, group = np.unique(t["label"].to_numpy(), return_inverse=True)
        root, out = np.arange(len(names)), []

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        for a, b in pairs(group):
            joined = False
            for i, j in zip(a.tolist(), b.tolist(), strict=True):
                x, y = top(group[i]), top(group[j])
                if x != y and _alike(shingles[i].values.to_numpy(), shingles[j].values.to_numpy(), similarity):
                    root[max(x, y)] = min(x, y)
                    out.append((node[i], node[j]))
                    joined = True
            if joined:
                while (root[root] != root).any():
                    root[:] = root[root]
                group[:] = root[group]
        if out:
            yield _pairs(*map(np.array, zip(*out, strict=True)))

    both = cells.join(sets, "node").select(*cells.columns, "shingles")
    return both.repartition("cell").sortWithinPartitions("cell").mapInArrow(lambda batches: _whole(batches, "cell", compare, 10_000), "a long, b long")


#: Fills the head of a short list of keys.
NO_KEY = -(1 << 63)


def similar_links(classes: DataFrame, docs: DataFrame, similarity: float, shingle: int = 5, block: int = BLOCK) -> DataFrame:
    """(node, label) of the groups connected by pairs of nodes at least ``similarity`` alike; no such pair is missed.

    classes: (node, rep, size, lanes, keys), keys being the first ``size - ceil(similarity * size) + 1`` shingles in an order
    that all sets share: two sets with none of these in common can't be alike enough, and the first that they share must come so early in
    both that enough can follow. Likely pairs are verified first, which connects most groups; then all pairs that are still apart.
    """
    some = stash(shared(classes.select(F.posexplode("keys").alias("pos", "key"), "node")), "members")
    head = F.concat(*(F.expr(f"unhex(lpad(hex(coalesce(try_element_at(keys, {i + 1}), {NO_KEY}L)), 16, '0'))") for i in range(HEAD)))
    own = classes.select("node", "size", "lanes", head.alias("head"))
    first = verified(_likely(some.select("key", "node", "n").join(own.select("node", "size", "lanes"), "node"), similarity, block), classes, docs, similarity, shingle)
    labels = components(first)
    named = some.select("key", "pos", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    met = stash(_apart(named, own, similarity, block), "apart")
    sets = sets_of(met.select("node").distinct(), classes, docs, shingle)
    second = stash(_verified_in_cells(met, sets, similarity), "alike")
    unstash(some, met, sets)
    return components(first.union(second)) if not second.isEmpty() else labels


def _remix(h: np.ndarray, lane: int) -> np.ndarray:
    z = h + np.uint64((lane * 0x9E3779B97F4A7C15) % LANE)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def near_dedup(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` plus group_id (smallest id of the group) and kept (one row of each group).

    Near copies are texts whose sets of five-word shingles have a Jaccard similarity of ``similarity`` or more; groups are
    connected through near copies. Candidates share one of their rarest shingles, which all near copies do.
    Defined cases: texts without words, null ones included, are no copies of each other and stay; a null id is smallest;
    of rows equal in id and text one stays; an empty table gives an empty table; input columns named like the added ones are replaced.
    """
    rest = replace_columns(docs, *ADDED)
    names = rest.columns
    plain = rest.toDF(*[f"c{i}" for i in range(len(names))])
    the_id, text = f"c{column(rest, id_col)}", f"c{column(rest, text_col)}"
    mark = F.xxhash64(text, F.lit(1))
    some = F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = plain.withColumn("_mark", mark).withColumn("_some", some)
    texts = keyed.filter("_some").select(F.struct(F.col(the_id).alias("id"), "_mark").alias("id"), F.col(text).alias("text"))
    sets = stash(shingle_keys(texts, shingle, similarity, common_shingles(texts, shingle)), "sets")
    classes = stash(sets.groupBy("node").agg(F.min("id").alias("rep"), F.first("size").alias("size"), F.first("lanes").alias("lanes"), F.first("keys").alias("keys")), "classes")
    prints = stash(sets.select("id", "node"), "prints")
    unstash(sets)
    labels = similar_links(classes, texts, similarity, shingle)
    linked = _spread(prints, classes.select("node", "rep"), labels, "node").select("id", "component").distinct()
    where = stash(linked.select(F.col("id.id").alias("_id"), F.col("id._mark").alias("_mark2"), F.col("component.id").alias("group_id"), (F.col("id").eqNullSafe(F.col("component"))).alias("_first")), "where")
    unstash(prints, classes)
    out = keyed.join(where, F.col(the_id).eqNullSafe(F.col("_id")) & (F.col("_mark") == F.col("_mark2")) & F.col("_some"), "left")
    nth = F.row_number().over(Window.partitionBy(the_id, "_mark").orderBy(F.lit(1)))
    out = out.withColumn("group_id", F.when(F.col("_some"), F.col("group_id")).otherwise(F.col(the_id)))
    out = out.withColumn("kept", ~F.col("_some") | (F.col("_first") & (nth == 1)))
    return out.select(*[f"c{i}" for i in range(len(names))], *ADDED).toDF(*names, *ADDED)

