import random
import re

import numpy as np
import pytest
import xxhash

from .helpers import prose
from tarnwork.llm import simhash
from tarnwork.llm.common import stash
from tarnwork.llm.components import components, local_roots


def fingerprint(text, k=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    parts = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else ([" ".join(w)] if w else [])
    if not parts:
        return 0
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(fps, distance=3):
    u = sorted(set(fps))
    root = {x: x for x in u}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(u):
        for y in u[i + 1 :]:
            if (x ^ y).bit_count() <= distance:
                root[find(y)] = find(x)
    return {x: find(x) for x in u}


def test_fingerprints_and_components(spark, awkward, awkward_rows):
    plain = awkward.toDF(*[f"c{i}" for i in range(7)]).selectExpr("c0 AS id", "c1 AS text")
    got = simhash.link_components(stash(simhash.fingerprints(plain), "prints")).collect()
    assert len(got) == len(awkward_rows)
    short = {(str(i), fingerprint(t)) for i, t, *_ in awkward_rows if t is None or len(t) < 50_000}
    assert short <= {(str(r.id), r.fp % (1 << 64)) for r in got}
    fps = [(r.id, r.fp % (1 << 64)) for r in got]
    root = roots([f for _, f in fps])
    least = {}
    for i, f in fps:
        if i is not None:
            least[root[f]] = min(least.get(root[f], i), i)
    assert all(r.component == least.get(root[r.fp % (1 << 64)]) for r in got)


@pytest.mark.parametrize("block", [2048, 6])
def test_links_of_dense_groups(spark, block):
    """Clouds of fingerprints with chains of links; blocks of a bucket are compared with each other."""
    rng = random.Random(11)
    fps = set()
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(40):
            fps.add(x)
            for _ in range(rng.randint(1, 3)):
                x ^= 1 << rng.randrange(64)
    fps |= {rng.getrandbits(64) for _ in range(100)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = stash(spark.createDataFrame([(f,) for f in signed], "node long"), "nodes")
    own = nodes.selectExpr("node", "unhex(lpad(hex(node), 16, '0')) AS lanes")
    found = components(simhash.links(simhash.exact_keys(nodes, len(fps), 3), own, 1, 3, block)).collect()
    label = {r.node: r.label for r in found}
    root = roots(fps)
    mine, want = {}, {}
    for f, s in zip(fps, signed):
        mine.setdefault(label.get(s, s), set()).add(f)
        want.setdefault(root[f], set()).add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_segments_cover_all_bits_and_any_three():
    for n in (10, 10**6, 10**9, 10**12):
        masks = simhash.segments(n, 3)
        assert sum(masks) == (1 << 64) - 1 and len(masks) >= 5


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1050)] + [(5000, 5001), (5001, 5001)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {i: 1000 for i in range(1001, 1050)} | {5001: 5000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_local_roots():
    nodes, low = local_roots(np.array([5, 3, 9]), np.array([3, 1, 9]))
    assert dict(zip(nodes.tolist(), low.tolist())) == {3: 1, 5: 1}


def shingles(text, k=5):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def test_near_copies(spark, nothing):
    """Pairs at 0.8 or more meet nearly always, unlike texts never; one of each group stays."""
    rng = random.Random(3)
    rows, groups = [], {}
    for g in range(40):
        words = prose(rng, rng.randint(80, 400)).split()
        for v in range(3):
            own = list(words)
            for _ in range(max(1, len(own) // 80) if v else 0):
                own[rng.randrange(len(own))] = prose(rng, 1)
            rows.append((len(rows), " ".join(own), "x"))
            groups.setdefault(g, []).append(rows[-1])
    rows += [(900, None, "x"), (901, "", "x"), (902, None, "x"), (None, prose(rng, 90), "x"), (0, rows[0][1], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string").repartition(3)
    got = simhash.near_dedup(df)
    assert got.columns == ["doc_id", "text", "group_id", "kept"]
    out = got.collect()
    assert len(out) == len(rows)
    kept = sorted(r.doc_id for r in out if r.kept and r.doc_id is not None)
    assert all(i in kept for i in (900, 901, 902)) and any(r.kept and r.doc_id is None for r in out)
    assert len(set(kept)) == len(kept)
    close = missed = 0
    group = {r.doc_id: r.group_id for r in out}
    for docs in groups.values():
        for a, b in ((0, 1), (0, 2), (1, 2)):
            x, y = shingles(docs[a][1]), shingles(docs[b][1])
            if len(x & y) / len(x | y) >= 0.8:
                close += 1
                missed += group[docs[a][0]] != group[docs[b][0]]
        assert sum(d[0] in kept for d in docs) >= 1
    assert close > 60 and missed <= 0.05 * close
    assert len({group[d[0]] for docs in groups.values() for d in docs}) >= 40
    assert simhash.near_dedup(nothing).count() == 0


def test_block_edits_are_all_found(spark):
    """Copies with a block appended, cut off or inserted, from just below to well above 0.8: groups equal those of all pairs compared."""
    rng = random.Random(8)
    rows, common = [], prose(rng, 12)
    for g in range(90):
        words = prose(rng, rng.randint(60, 300)).split() + common.split()
        size = int(len(words) * rng.uniform(0.05, 0.24))
        block, at = prose(rng, size).split(), rng.randrange(20, len(words) - 20)
        other = (words + block, words[size:], words[:at] + block + words[at:])[g % 3]
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(other))]
    rows += [(1000, "one two three"), (1001, "One two  three"), (1002, "one two four")]
    sets = {i: shingles(t) or {t.lower()} for i, t in rows[:180]}
    root = {i: i for i, _ in rows}
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root[b] = root[a]
    root[1001] = 1000
    assert 40 < sum(i != r for i, r in root.items()) < 85
    got = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: r.group_id for r in got} == root


@pytest.mark.parametrize("block", [2048, 6])
def test_similar_links_whatever_the_order(spark, block):
    """A chain of sets, each near its neighbours only: the same groups with any table of common shingles and any size of blocks."""
    rng = random.Random(2)
    words = prose(rng, 1200).split()
    texts = [(i, " ".join(words[12 * i : 12 * i + 200])) for i in range(40)] + [(100 + i, prose(rng, 90)) for i in range(20)]
    docs = spark.createDataFrame(texts, "id long, text string").repartition(2)
    every = np.unique(np.concatenate([simhash._shingles(simhash._words(t), 5, simhash.SEED) for _, t in texts]))
    for common in ((every[:0], np.zeros(0, np.uint8)), (every[::3], np.full(len(every[::3]), 3, np.uint8))):
        classes = stash(simhash.shingle_keys(docs, 5, 0.8, common).withColumnRenamed("id", "rep"), "classes")
        labels = simhash.similar_links(classes, docs, 0.8, block=block)
        group = {r.rep: r.label or r.node for r in classes.join(labels, "node", "left").collect()}
        assert len({group[i] for i in range(40)}) == 1 and len(set(group.values())) == 21


def test_groups_on_the_tables(spark):
    """All pairs of the sf0.01 texts that share a shingle, compared: the same groups, so no link at 0.8 is lost and none is made up."""
    from tarnwork.llm.common import pick, table

    docs = pick(table(spark, "/root/testdata/sf0.01", "documents"), doc_id="doc_id", text="text")
    texts = {r.doc_id: r.text for r in docs.collect() if (r.text or "").split()}
    sets = {i: set(simhash._shingles(simhash._words(t), 5, simhash.SEED).tolist()) for i, t in texts.items()}
    holders, root = {}, {i: i for i in sets}
    for i, s in sets.items():
        for h in s:
            holders.setdefault(h, []).append(i)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    close = 0
    for i, s in sets.items():
        for j in {j for h in s for j in holders[h] if j < i}:
            alike = len(s & sets[j]) / len(s | sets[j])
            close += 0.8 <= alike < 0.85
            if alike >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r.doc_id: r.group_id for r in simhash.near_dedup(docs).collect() if r.doc_id in texts}
    assert got == {i: find(i) for i in sets} and close


def test_huge_group_and_dealt_buckets(spark):
    """A group whose members are mostly near each other, with some that are near none: blocks of a bucket change nothing."""
    rng = random.Random(5)
    base, texts = prose(rng, 150).split(), []
    for i in range(70):
        own = list(base)
        for _ in range(rng.choice((1, 2, 3, 9))):
            own[rng.randrange(len(own))] = prose(rng, 1)
        texts.append((i, " ".join(own)))
    sets = [shingles(t) for _, t in texts]
    links = [(a, b) for a in range(70) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    label = list(range(70))
    for _ in range(70):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert 3 < len(set(label)) < 40
    docs = spark.createDataFrame(texts, "id long, text string").repartition(2)
    classes = stash(simhash.shingle_keys(docs, 5, 0.8, (np.zeros(0, np.uint64), np.zeros(0, np.uint8))).withColumnRenamed("id", "rep"), "classes")
    for block in (2048, 9):
        labels = simhash.similar_links(classes, docs, 0.8, block=block)
        group = {r.rep: r.label or r.node for r in classes.join(labels, "node", "left").collect()}
        mine, want = {}, {}
        for i in range(70):
            mine.setdefault(group[i], []).append(i)
            want.setdefault(label[i], []).append(i)
        assert sorted(mine.values()) == sorted(want.values())


def test_spanning_takes_the_lightest_links():
    a, b = np.array([7, 7, 8, 1, 2]), np.array([8, 9, 9, 2, 1])
    assert sorted(simhash.spanning(a, b, np.array([5, 1, 2, 4, 3])).tolist()) == [1, 2, 4]


def test_a_group_that_is_almost_alike_makes_no_pairs(spark):
    """Texts of one group that miss the similarity by little are compared where they meet: out come rows for nodes and links, not for pairs; one real link is found."""
    rng = random.Random(12)
    base = [f"b{i}" for i in range(200)]
    texts = []
    for n in range(120):  # three words that only this text has, far apart: 15 of 196 shingles differ from the base, 30 from each other
        words = list(base)
        for i in range(3):
            words[20 + i * 60 + rng.randrange(40)] = f"own{n}x{i}"
        for i in range(6):
            words.append(f"tail{n}x{i}")
        texts.append(" ".join(words))
    texts.append(texts[0] + " more")
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    sets = simhash.shingle_keys(docs, 5, 0.8, (np.zeros(0, np.uint64), np.zeros(0, np.uint8)))
    classes = stash(sets.selectExpr("node", "id AS rep", "size", "lanes", "keys"), "classes")
    members = stash(simhash.shared(classes.selectExpr("posexplode(keys) AS (pos, key)", "node")).selectExpr("key", "pos", "node", "node AS label"), "members")
    own = classes.selectExpr("node", "size", "lanes", f"unhex(repeat('8000000000000000', {simhash.HEAD})) AS head")
    met = stash(simhash._apart(members, own, 0.8, 50), "apart")
    cells = met.selectExpr("cell", "node").distinct().count()
    assert 0 < met.count() == cells  # a node once in each cell
    links = simhash._verified_in_cells(met, simhash.sets_of(met.select("node").distinct(), classes, docs, 5), 0.8).collect()
    node = {r.node: r.rep for r in classes.collect()}
    want = set()
    cut = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            if len(cut[a] & cut[b]) >= 0.8 * len(cut[a] | cut[b]):
                want.add((a, b))
    got = {tuple(sorted((node[r.a], node[r.b]))) for r in links}
    assert got <= want and (0, 120) in want and len(want) < 2000
    label = lambda pairs: [min(c) for c in groups(len(texts), pairs)]
    assert label(got) == label(want)


def groups(n, pairs):
    own = [{i} for i in range(n)]
    for a, b in pairs:
        if own[a] is not own[b]:
            own[a] |= own[b]
            for i in own[b]:
                own[i] = own[a]
    return own
