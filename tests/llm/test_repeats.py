import hashlib
import random

import numpy as np
import pytest

from tarnwork.llm import chunks, spans, substring_index, suffix_dedup


def brute(rows, units, join):
    """By id: windows that a smaller id has; rows with one id don't remove from each other."""
    first = {}
    known = [(float("inf") if i is None else i, units(t or "")) for i, t in rows]
    for i, u in known:
        for k in range(len(u) - 49):
            w = tuple(u[k : k + 50])
            first[w] = min(first.get(w, i), i)
    out = []
    for i, u in known:
        gone = [False] * len(u)
        for k in range(len(u) - 49):
            if first[tuple(u[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = join([x for x, g in zip(u, gone) if not g])
        out.append((None if i == float("inf") else i, len(u), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


WAYS = {"bytes": (suffix_dedup.remove_repeats, lambda t: list(t.encode()), bytes), "words": (substring_index.remove_repeats, lambda t: t.encode().split(), b" ".join)}


def texts(seed, letters, sep):
    """Texts that share passages with exact ends, passages with other surroundings, and runs of one symbol."""
    rng = random.Random(seed)
    make = lambda n: sep.join(rng.choice(letters) for _ in range(n))
    passages = [make(rng.randint(48, 130)) for _ in range(5)] + [sep.join(["a"] * 120)]
    out = []
    for i in range(60):
        parts = [make(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages).split(sep) if sep else rng.choice(passages)
            a = rng.choice([0, 0, rng.randint(0, len(p) // 3)])
            parts += [sep.join(p[a:]), make(rng.randint(0, 40))]
        out.append((rng.randint(0, 50), sep.join(x for x in parts if x)))
    return out + [out[3], out[4], (90, out[5][1]), (91, None), (None, out[6][1]), (None, out[7][1] + sep + "zz"), (92, make(49)), (93, "")]


@pytest.mark.parametrize("way", WAYS)
@pytest.mark.parametrize("letters", ["ab", "abcdefghijklmnopqrstuvwxyzé"])
def test_against_brute_force(spark, way, letters, monkeypatch):
    remove, units, join = WAYS[way]
    rows = texts(len(letters), letters, "" if way == "bytes" else " ")
    want = brute(rows, units, join)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kept string").repartition(3)
    monkeypatch.setattr(chunks, "CHUNK_BYTES", 600)
    monkeypatch.setattr(spans, "TARGET", 150)
    got = remove(df, with_text=True).collect()
    assert sorted(str(tuple(r)[:5]) for r in got) == want
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_hot_anchors_and_many_spans(spark, monkeypatch):
    """One sentence in every document, with other words around it: its windows go on one by one. Spans are reached in several cuts."""
    rng = random.Random(3)
    sentence = "".join(rng.choice("abcdefgh") for _ in range(140))
    rows = [(i, "".join(rng.choice("abcdefgh") for _ in range(rng.randint(20, 90))) + sentence[rng.choice([0, 0, 9]) :] + "".join(rng.choice("xyz") for _ in range(40))) for i in range(80)]
    monkeypatch.setattr(chunks, "CHUNK_BYTES", 900)
    monkeypatch.setattr(spans, "TARGET", 40)
    monkeypatch.setattr(spans, "FAN", 4)
    monkeypatch.setattr(spans, "HELD", 200)
    monkeypatch.setattr(suffix_dedup, "WIDE", 20)
    monkeypatch.setattr(suffix_dedup, "SPAN_BYTES", 700)
    monkeypatch.setattr(suffix_dedup, "TOGETHER", 300)
    seen = []
    monkeypatch.setattr(suffix_dedup, "hot_windows", lambda *a, f=suffix_dedup.hot_windows: seen.append(f(*a)) or seen[-1])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    remove, units, join = WAYS["bytes"]
    assert sorted(str(tuple(r)[:5]) for r in remove(df).collect()) == brute(rows, units, join)
    assert seen and seen[0].count() > 0
    remove, units, join = WAYS["words"]
    rows = [(i, " ".join(t)) for i, t in rows]
    monkeypatch.setattr(substring_index, "REQUESTS", 1)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(str(tuple(r)[:5]) for r in remove(df).collect()) == brute(rows, units, join)


def test_an_entry_for_each_task_not_each_chunk(spark, monkeypatch):
    """A sentence that is in every chunk: of its anchors and windows a task lets out one entry each, and tells its chunks the rest itself."""
    rng = random.Random(8)
    make = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    sentence = make(70)
    rows = [(i, f"{make(rng.randint(5, 30))} {sentence} {make(5)}") for i in range(80)]
    monkeypatch.setattr(chunks, "CHUNK_BYTES", 700)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    _, texts_ = chunks.fold_equal(df, "doc_id", "text")
    made = chunks.chunked(texts_, chunks.Words, []).coalesce(2).cache()
    n = made.count()
    assert n > 30

    def most(noted, layout):
        keys = [c["key"] for b in substring_index._rows(noted.filter(f"what = {substring_index.ENTRIES}"), layout).toArrow().to_batches() for _, c in layout.read(b)]
        return int(np.unique(np.concatenate(keys), return_counts=True)[1].max())

    anchors = substring_index._anchor_entries(made, 1).cache()
    assert most(anchors, substring_index.ANCHORS) <= 2
    told = anchors.filter(f"what = {substring_index.HOT_ANCHORS}")
    assert told.select("chunk").distinct().count() == n
    windows = substring_index._windows(made, told, False).coalesce(2).cache()
    assert most(windows, substring_index.WINDOWS) <= windows.rdd.getNumPartitions() * 4 < n
    hits = windows.filter(f"what = {substring_index.HITS}").select("chunk", "n", "b").collect()
    there = np.concatenate([spans.unpack(r.b, r.n, np.int64) for r in hits])
    assert len({r.chunk for r in hits}) > n // 2 and len(set(there.tolist())) > 1


def test_groups_stay_whole(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "TOGETHER", 10)
    group, size = np.array([0, 0, 1, 1, 1, 2, 3, 3]), np.array([4, 4, 5, 5, 5, 1, 2, 2])
    parts = list(suffix_dedup._parts(group, size))
    assert [(p.start, p.stop) for p in parts] == [(0, 2), (2, 5), (5, 8)]
    assert list(suffix_dedup._parts(group[:0], size[:0])) == []


def test_packed_columns(spark):
    rng = np.random.default_rng(2)
    layout = spans.Layout(lambda c: c["size"].astype(np.int64), size=np.uint8, id=np.int64)
    size = rng.integers(0, 9, 500).astype(np.uint8)
    cols = {"key": np.sort(rng.integers(0, 1 << 64, 500, np.uint64)), "size": size, "id": rng.integers(-5, 5, 500), "body": rng.integers(0, 255, int(size.sum())).astype(np.uint8)}
    got = [c for _, c in layout.read(layout.table(layout.rows(cols, 16)))]
    assert len(got) == 16 and all((spans.joined(got)[k] == cols[k]).all() for k in cols)
    order = rng.permutation(500)
    mixed = layout.in_order(cols, order)
    back = layout.in_order(mixed, np.argsort(mixed["key"], kind="stable"))
    assert all((back[k] == cols[k]).all() for k in cols)
    assert spans.spans_for(0) == 1 and spans.spans_for(spans.TARGET + 1) == 2


@pytest.mark.parametrize("way", WAYS)
def test_awkward_and_empty(awkward, awkward_rows, nothing, way):
    remove, units, join = WAYS[way]
    rows = [(i, t if t is None or len(t) < 3000 else t[:3000]) for i, t, *_ in awkward_rows]
    df = awkward.sparkSession.createDataFrame(rows, "doc_id long, text string")
    assert sorted(str(tuple(r)[:5]) for r in remove(df).collect()) == brute(rows, units, join)
    long = {r.doc_id: r for r in remove(awkward).collect()}
    assert long[8].n_removed == 0 and long[9].n_removed == long[9].n_units > 29_000
    assert remove(nothing).count() == 0


def test_common_prefixes_against_sorting():
    rng = random.Random(2)
    contents = [np.array([rng.choice((1, 2)) for _ in range(rng.randint(50, 80))], np.uint8) for _ in range(12)]
    contents.append(contents[0][5:].copy() if len(contents[0]) > 55 else contents[0].copy())
    sizes = np.array([len(c) for c in contents])
    ids = np.arange(len(contents))[::-1].astype(np.int64)
    out = suffix_dedup.window_ids(np.concatenate(contents), sizes, ids, 12)
    first = {}
    for c, i in zip(contents, ids.tolist()):
        for k in range(len(c) - 11):
            first[c[k : k + 12].tobytes()] = min(first.get(c[k : k + 12].tobytes(), i), i)
    assert out.tolist() == [first[c[k : k + 12].tobytes()] for c in contents for k in range(len(c) - 11)]


def test_lcp_values():
    text = np.array([3, 1, 3, 1, 3, 1, 2, 0], np.uint16)  # bananas-like, with its end mark
    left = np.arange(8)[::-1]
    order, _, _ = suffix_dedup.suffix_order(text, left, 50)
    suffixes = [tuple(text[o : 8].tolist()) for o in order]
    assert suffixes == sorted(suffixes)
    lcp, _ = suffix_dedup.common_prefixes(text[order - 1], text[order], 3)
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    want = [common(a, b) for a, b in zip(suffixes, suffixes[1:])]
    assert [x if x >= 0 else 3 for x in lcp[1:].tolist()] == [min(w, 3) for w in want]


def test_index_in_two_sessions(spark, tmp_path, monkeypatch):
    """A batch is deduplicated against an index that was opened from its folder alone; runs are merged when there are enough of a level."""
    monkeypatch.setattr(chunks, "CHUNK_BYTES", 600)
    monkeypatch.setattr(spans, "TARGET", 100)
    rows = [(i, t) for i, t in texts(11, "abcdef", " ") if i is not None]
    rows = sorted({i: t for i, t in rows}.items())
    units, join = WAYS["words"][1:]
    want = brute(rows, units, join)
    got, path = [], f"file://{tmp_path}/index"
    for part in (rows[:15], rows[15:16], rows[16:30], rows[30:]):
        index = substring_index.FingerprintIndex(spark, path)
        out = substring_index.add_documents(index, spark.createDataFrame(part, "doc_id long, text string"), batches=1)
        got += [str(tuple(r)[:5]) for r in out.collect()]
    assert sorted(got) == want
    index = substring_index.FingerprintIndex(spark, path)
    assert index.batches == 4
    for name, layout in (("anchors", substring_index.ANCHOR_RUN), ("windows", substring_index.WINDOW_RUN)):
        levels = [level for _, level, _ in index.state[name]]
        assert max(levels) >= 1 and all(levels.count(x) < substring_index.GROWTH for x in levels)
        for run, _, n in index.state[name]:
            keys = [c["key"] for b in index._run(run, layout).toArrow().to_batches() for _, c in layout.read(b)]
            assert all((k[1:] > k[:-1]).all() for k in keys)
            assert len(np.unique(np.concatenate(keys))) == n
    again = substring_index.add_documents(index, spark.createDataFrame(rows[:20], "doc_id long, text string"))
    assert all(r.n_removed == (r.n_units if r.n_units >= 50 else 0) for r in again.collect())


def test_windows_with_one_hash_are_told_apart(spark, monkeypatch):
    """Were all hashes of windows alike, no word would go that has no earlier equal window."""
    rng = random.Random(6)
    make = lambda n: [rng.choice("abcdefghij") for _ in range(n)]
    one, two = make(60), make(70)
    rows = [(1, " ".join(one)), (2, " ".join(two)), (3, " ".join([*make(9), *one, *make(8)]))]
    plain = chunks.Chunk.hashes
    monkeypatch.setattr(chunks.Chunk, "hashes", lambda self, at, count, weight=chunks.WEIGHTS[0]: plain(self, at, count, weight) & np.uint64(0xF << 60 if isinstance(count, int) and count == 50 else (1 << 64) - 1))
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.n_removed for r in substring_index.remove_repeats(df, batches=1).collect()}
    assert got[1] == got[2] == 0 and got[3] <= 60
